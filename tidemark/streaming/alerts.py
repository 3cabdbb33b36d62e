"""Alert intake as streams: validation log, accepted-only dedup, pending orders, tiered messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rules import MESSAGE_FLOOR, AlertRules, alert_reason, parse_alerts, score_alerts, tiered_message, with_tiered_score
from tidemark.operators.paper import allocate_ids
from tidemark.sources.sinks import written
from tidemark.streaming.positions import judged_stream

LOG_COLUMNS = ("alert_id", "received_at", "ticker", "signal_date", "dedup_key", "stable_score_payload", "stable_score_recomputed", "price", "reason")


def validate_alerts(alerts: DataFrame, metadata: DataFrame, rules: AlertRules) -> DataFrame:
    """Every alert with its scores and the first failing check; duplicates not yet judged.

    ``metadata`` is the static side (ticker, name, sector, market_cap_bucket).
    """
    meta = metadata.select(F.col("ticker").alias("m_ticker"), F.col("name").alias("m_name"), F.col("sector").alias("m_sector"), F.col("market_cap_bucket").alias("m_market_cap_bucket"))
    scored = score_alerts(parse_alerts(alerts), rules)
    joined = scored.join(meta, F.col("ticker") == F.col("m_ticker"), "left")
    return joined.withColumn("reason", alert_reason(rules))


def mark_duplicates(checked: DataFrame) -> DataFrame:
    """Only the first passing alert of a key, by (received_at, alert_id), is accepted; later ones are duplicates.

    The first is found by aggregates over fixed-width columns and joined back,
    not by a window: a key repeated very often is combined map-side and its
    rows stay spread.
    """
    passing = F.col("reason") == "accepted"
    rows = checked.where(passing).select("dedup_key", "received_at", "alert_id")
    earliest = rows.groupBy("dedup_key").agg(F.min("received_at").alias("__at"))
    # Of the rows that arrived first, the lowest id.
    first = rows.join(earliest, "dedup_key").where("received_at = __at").groupBy("dedup_key").agg(F.min("__at").alias("__at"), F.min("alert_id").alias("__id"))
    j = checked.join(first, "dedup_key", "left")
    taken = F.coalesce((F.col("__at") == F.col("received_at")) & (F.col("__id") == F.col("alert_id")), F.lit(False))
    return j.withColumn("reason", F.when(passing & ~taken, "duplicate_signal").otherwise(F.col("reason"))).drop("__at", "__id")


def pending_rows(accepted: DataFrame, existing: DataFrame) -> DataFrame:
    """Pending orders of accepted alerts, numbered after the highest id of ``existing``; one key is accepted once, so none is pending yet."""
    new = accepted.select(
        "alert_id", "signal_date", "ticker", F.coalesce("m_name", F.lit("")).alias("name"), F.coalesce("m_sector", F.lit("")).alias("sector"),
        F.col("stable_score_recomputed").alias("score"),
    )
    numbered = allocate_ids(new.withColumn("pending_order_id", F.lit(None).cast("string")), existing, "pending_order_id", "PO", "alert_id")
    return numbered.select("pending_order_id", "signal_date", "ticker", "name", "sector", "score", F.lit("next_trading_day_open").alias("planned_entry"), F.lit("pending").alias("status"))


class AlertIntake:
    """Streaming job: log every alert, accept the first of each key, add pending orders.

    What a key remembers is state of the query, and the last order id is one
    row a batch, so a batch costs the same however long the log is. Each batch
    is written under its id: replayed after a failure it overwrites its folder.
    """

    def __init__(self, spark: SparkSession, base: str, metadata: DataFrame, rules: AlertRules, ttl_ms: int | None = None):
        self.spark, self.base, self.metadata, self.rules, self.ttl_ms = spark, base.rstrip("/"), metadata, rules, ttl_ms

    def _last_id(self, batch: int) -> int:
        """Highest order number before this batch: one row that the batch before it wrote."""
        found = written(self.spark, f"{self.base}/last/v={batch - 1:08d}-batch", "number long")
        return found.first().number if found is not None else 0

    def process(self, batch: DataFrame, batch_id: int) -> None:
        folder = f"v={batch_id:08d}-batch"
        batch.write.mode("overwrite").parquet(f"{self.base}/alerts/{folder}")
        # Read back so that the pending rows come from the rows just logged.
        accepted = self.spark.read.schema(batch.schema).parquet(f"{self.base}/alerts/{folder}").where("reason = 'accepted'")
        last = self._last_id(batch_id)
        known = self.spark.range(1).select(F.concat(F.lit("PO"), F.lit(last).cast("string")).alias("pending_order_id"))
        pending_rows(accepted, known).write.mode("overwrite").parquet(f"{self.base}/pending/{folder}")
        self.spark.range(1).select((F.lit(last) + accepted.count()).alias("number")).write.mode("overwrite").parquet(f"{self.base}/last/{folder}")

    def start(self, alerts: DataFrame):
        checked = validate_alerts(alerts, self.metadata, self.rules).select(*LOG_COLUMNS, "m_name", "m_sector")
        passing = F.col("reason") == "accepted"
        judged = judged_stream(checked.where(passing), self.ttl_ms).select(*checked.columns)
        log = judged.unionByName(checked.where(~passing))
        return log.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.base}/_checkpoint").trigger(availableNow=True).start()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.base}/{name}").parquet(f"{self.base}/{name}").drop("v")


def tiered_alerts(rows: DataFrame, title: str, brand: str) -> DataFrame:
    """Stateless scoring of each alert: below the floor skipped, else a message."""
    scored = with_tiered_score(rows)
    send = F.col("score") >= MESSAGE_FLOOR
    return scored.withColumn("outcome", F.when(send, "message").otherwise("skipped")).withColumn("message", F.when(send, tiered_message(title, brand)))
