"""Daily score job: latest scored bar per ticker as ledger rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import SCORE_THRESHOLD
from tidemark.functions.values import bool_text, float_text, freshness, ratio
from tidemark.operators.signals import signal_frame

# Layout of the score rows.
REPORT_COLUMNS = (
    "date", "run_date", "requested_as_of", "data_date", "freshness_status", "ticker", "name", "weekly_above_200ma", "weekly_macd_gc",
    "weekly_macd_uptrend", "daily_rsi_40_65", "daily_volume_1_5x", "stable_score", "signal_expected", "close", "daily_rsi",
    "volume_ratio", "data_latest_date", "data_status", "rule_version", "updated_at",
)
FLAG_COLUMNS = REPORT_COLUMNS[7:12]


def score_rows(bars: DataFrame, universe: DataFrame, as_of: str, updated_at: str, rule_version: str) -> DataFrame:
    """One text row per universe ticker; tickers without a bar get a no-data row.

    Scoring has no warm-up gate. ``universe`` has ticker, name and pos.
    """
    day = F.lit(as_of).cast("date")
    frame = signal_frame(bars.where(F.col("date") <= day), readiness=False)
    cols = ["date", "close", "volume", "volume_30ma", "daily_rsi", "score", *FLAG_COLUMNS]
    last = frame.groupBy("ticker").agg(F.max_by(F.struct(*cols), "date").alias("__l")).select("ticker", "__l.*")
    j = universe.join(last, "ticker", "left")
    has = F.col("date").isNotNull()
    iso = F.col("date").cast("string")
    blank = lambda c: F.when(has, c).otherwise("")
    out = {
        "date": F.coalesce(iso, F.lit(as_of)),
        "run_date": F.lit(updated_at[:10]),
        "requested_as_of": F.lit(as_of),
        "data_date": blank(iso),
        "freshness_status": freshness(day, "date"),
        "ticker": F.col("ticker"),
        "name": F.coalesce("name", F.lit("")),
        **{n: bool_text(n) for n in FLAG_COLUMNS},
        "stable_score": blank(F.col("score").cast("string")),
        "signal_expected": bool_text(F.col("score") >= SCORE_THRESHOLD),
        "close": float_text("close"),
        "daily_rsi": float_text("daily_rsi"),
        "volume_ratio": float_text(ratio("volume", "volume_30ma")),
        "data_latest_date": blank(iso),
        "data_status": F.when(has, "ok").otherwise("no_bar_on_or_before_as_of"),
        "rule_version": F.lit(rule_version),
        "updated_at": F.lit(updated_at),
    }
    return j.select(*[out[n].alias(n) for n in REPORT_COLUMNS], "pos")
