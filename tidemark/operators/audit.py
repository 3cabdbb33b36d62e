"""Data audits: hashes, availability, profiles, adjustment continuity, run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import SCORE_THRESHOLD
from tidemark.functions.values import number_text, safe_float, text
from tidemark.operators.calendar import number_sessions
from tidemark.operators.windows import series


def line_hash(lines: Column, order: Column) -> Column:
    """sha256 of a key's lines in order; a key has one line per session."""
    sorted_lines = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), lines.alias("l")))), lambda s: s["l"])
    return F.sha2(F.concat_ws("\n", sorted_lines), 256)


def content_hash(bars: DataFrame, key: str = "ticker", columns: Sequence[str] = ("volume",)) -> DataFrame:
    """One hash per ticker over its ordered rows."""
    line = F.concat_ws(",", F.col("date").cast("string"), *[number_text(n) for n in columns])
    return bars.groupBy(key).agg(line_hash(line, F.col("date")).alias("content_sha256"))


def missing_sessions(bars: DataFrame, key: str = "ticker") -> DataFrame:
    """Sessions of the union inside a ticker's own range on which it has no bar.

    The range is expanded by session number, then its own days are removed.
    """
    sessions = number_sessions(bars)
    numbered = bars.select(key, "date").distinct().join(F.broadcast(sessions), "date")
    span = numbered.groupBy(key).agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    full = span.select(key, F.explode(F.sequence("a", "b")).alias("idx"))
    return full.join(numbered.select(key, "idx"), [key, "idx"], "left_anti").join(F.broadcast(sessions), "idx").select(key, "date")


def availability(bars: DataFrame, removed: DataFrame, key: str = "ticker", material: float = 0.0001) -> DataFrame:
    """First, last, rows, missing sessions, removals, adjusted-close ratio steps, hash."""
    n_missing = missing_sessions(bars, key).groupBy(key).agg(F.count("*").alias("missing_vs_union_sessions"))
    r = bars.withColumn("__r", F.try_divide("adj_close", "close"))
    stepped = r.where("__r IS NOT NULL").withColumn("__step", F.abs(F.try_divide(F.col("__r"), F.lag("__r").over(series([key]))) - 1))
    ratios = stepped.groupBy(key).agg(
        F.min("__r").alias("adj_close_ratio_min"), F.max("__r").alias("adj_close_ratio_max"),
        F.count_if(F.col("__step") > material).alias("adj_close_ratio_material_change_count"),
    )
    base = bars.groupBy(key).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct("date")).alias("duplicate_dates"),
    )
    out = base.join(n_missing, key, "left").join(removed, key, "left").join(ratios, key, "left").join(content_hash(bars, key), key)
    zeros = ("missing_vs_union_sessions", "nonpositive_ohlc_rows_removed", "nonpositive_volume_rows_removed")
    return out.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in zeros})


def profile(df: DataFrame, required: Sequence[str], date: str, code: str) -> DataFrame:
    """One row: counts, missing and all-null required fields, nulls per field, dates, code hash.

    The code set is reduced to distinct values and hashed as a sum of per-code
    hashes, so it needs no sorted list of every code.
    """
    present = [n for n in required if n in df.columns]
    nulls = [F.count_if(F.col(n).isNull()).alias(f"null_{n}") for n in df.columns]
    base = df.agg(F.count("*").alias("row_count"), F.min(text(date)).alias("min_date"), F.max(text(date)).alias("max_date"), *nulls)
    codes = df.select(F.col(code).cast("string").alias("c")).where("c <> ''").distinct()
    digest = codes.agg(F.sum(F.conv(F.substring(F.md5("c"), 1, 8), 16, 10).cast("decimal(38,0)")).cast("string")).scalar()
    empty = F.array_compact(F.array(*[F.when(F.col(f"null_{n}") == F.col("row_count"), F.lit(n)) for n in present]))
    missing = F.array(*[F.lit(n) for n in sorted(set(required) - set(df.columns))]).cast("array<string>")
    out = base.withColumns({"all_null_required_fields": F.concat_ws(",", empty), "missing_required_fields": F.concat_ws(",", missing)})
    status = F.when(F.col("row_count") == 0, "empty_sample").when(
        (F.col("missing_required_fields") != "") | (F.col("all_null_required_fields") != ""), "schema_mismatch"
    ).otherwise("ok")
    return out.withColumn("status", status).withColumn("code_set_digest", digest)


def adjustment_continuity(bars: DataFrame, key: str = "Code", expected: float | None = None, first: int = 3, low: float = 0.75, high: float = 1.25) -> DataFrame:
    """Raw and adjusted gaps at the first factor changes of each code.

    ``bars`` has Date, O, C, AdjFactor, AdjO, AdjC. A change on the first row has
    no previous row and is not tested, but counts among the first ones.
    """
    w = Window.partitionBy(key).orderBy("Date")
    changed = F.abs(F.col("AdjFactor") - 1) > 1e-12
    e = bars.select(
        "*", F.lag("C").over(w).alias("__c"), F.lag("AdjC").over(w).alias("__a"), F.row_number().over(w).alias("__rn"),
        F.sum(F.coalesce(changed, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__k"),
    )
    test = F.coalesce(changed, F.lit(False)) & (F.col("__k") <= first) & (F.col("__rn") > 1)
    raw = F.try_divide("O", "__c")
    adjusted = F.try_divide("AdjO", "__a")
    normal = F.try_divide(raw, F.col("AdjFactor"))
    good = F.coalesce(normal.between(low, high) & adjusted.between(low, high), F.lit(False))
    match = F.lit(None).cast("boolean") if expected is None else F.coalesce(F.bool_or(F.abs(F.col("AdjFactor") - expected) <= 1e-12), F.lit(False))
    out = e.groupBy(key).agg(
        F.count("AdjFactor").alias("factor_observations"), F.count_if(changed).alias("factor_changes"),
        F.round(F.min("AdjFactor"), 8).alias("factor_min"), F.round(F.max("AdjFactor"), 8).alias("factor_max"),
        F.count_if(test).alias("boundaries_tested"), F.count_if(test & good).alias("boundaries_consistent"),
        F.round(F.min(F.when(test, raw)), 8).alias("raw_gap_min"), F.round(F.max(F.when(test, normal)), 8).alias("normalized_gap_max"),
        match.alias("expected_factor_match"), F.nullif(F.count_distinct("AdjFactor"), F.lit(0)).alias("distinct_factors"),
    )
    n, k = F.col("boundaries_tested"), F.col("boundaries_consistent")
    return out.withColumn("all_boundaries_consistent", (n > 0) & (n == k))


def score_summary(rows: DataFrame, as_of: str) -> DataFrame:
    """Run summary of score rows (text columns plus ``pos``, the list order).

    The maximum's ticker is the earliest of the list; signals count formally
    only when every row is current.
    """
    ok = F.col("data_status") == "ok"
    score = F.when(ok, safe_float("stable_score", 0.0))
    agg = rows.agg(
        F.count_if(ok).alias("rows_scored"), F.count_if(ok & (safe_float("stable_score", 0.0) >= SCORE_THRESHOLD)).alias("raw_signal_count"),
        F.max_by(F.when(ok, F.col("ticker")), F.when(ok, F.struct(score.alias("s"), (-F.col("pos")).alias("p")))).alias("max_score_ticker"),
        F.coalesce(F.max(score), F.lit(0.0)).alias("max_score"), F.max(F.when(ok, F.nullif("data_date", F.lit("")))).alias("__latest"),
        F.bool_or(F.col("freshness_status") == "no_data").alias("__none"), F.bool_or(F.col("freshness_status") == "stale").alias("__stale"),
    )
    fresh = F.when((F.col("rows_scored") == 0) | F.col("__none"), "no_data").when(F.col("__stale"), "stale").otherwise("current")
    out = agg.withColumn("freshness_status", fresh).withColumn("data_date", F.coalesce("__latest", F.lit("")))
    current = F.col("freshness_status") == "current"
    status = F.when(F.col("freshness_status") == "no_data", "data_unavailable").when(F.col("freshness_status") == "stale", "data_stale").when(
        F.col("raw_signal_count") > 0, "signal_detected"
    ).otherwise("no_signal")
    return out.select(
        F.lit(as_of).alias("as_of"), "data_date", "freshness_status", "rows_scored",
        F.when(current, F.col("raw_signal_count")).otherwise(0).cast("long").alias("signal_count"), "raw_signal_count",
        F.coalesce("max_score_ticker", F.lit("")).alias("max_score_ticker"), "max_score", status.alias("status"),
    )


def verify_latest_run(ledger: DataFrame, present: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Rows of the latest requested date: count, freshness values, formal signals, missing tables."""
    latest = ledger.agg(F.max("requested_as_of")).scalar()
    rows = ledger.withColumn("__latest", latest).where(F.col("requested_as_of") == F.col("__latest"))
    formal = (F.col("freshness_status") == "current") & (safe_float("stable_score", 0.0) >= SCORE_THRESHOLD)
    missing = ",".join(t for t in required if t not in present)
    return rows.agg(
        F.max("requested_as_of").alias("latest_requested_as_of"), F.count("*").alias("latest_score_row_count"), F.max("data_date").alias("latest_data_date"),
        # Three possible words.
        F.concat_ws(",", F.array_sort(F.collect_set("freshness_status"))).alias("latest_freshness_statuses"),
        F.count_if(formal).alias("latest_signal_count"), F.lit(missing).alias("missing_tables"),
    )
