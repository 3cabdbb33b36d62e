"""Weekly resampling, as-of fill and the scored signal frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import (
    RSI_HIGH,
    RSI_LOW,
    SCORE_THRESHOLD,
    VOLUME_MA_WINDOW,
    VOLUME_MULTIPLE,
    WEEKLY_MA_WINDOW,
)
from tidemark.functions.values import flag_mask, flag_score, truth
from tidemark.operators.windows import macd_columns, numbered, rolling_median, rsi_columns, running, series, sma, step

WEEKLY_PAYLOAD = (
    "weekly_200ma",
    "weekly_macd",
    "weekly_macd_signal",
    "weekly_above_200ma",
    "weekly_macd_gc",
    "weekly_macd_uptrend",
)
READY_INPUTS = ("weekly_200ma", "weekly_macd", "weekly_macd_signal", "daily_rsi", "volume_30ma")


def week_label(day: Column | str = "date") -> Column:
    """Friday on or after the day."""
    return F.next_day(F.date_sub(day, 1), "FRI")


def weekly_bars(bars: DataFrame, key: str = "ticker") -> DataFrame:
    return bars.groupBy(key, week_label().alias("week")).agg(
        F.min_by("open", "date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"),
        F.sum("volume").alias("volume"),
    )


def weekly_signals(weekly: DataFrame, key: str = "ticker", ma_window: int = WEEKLY_MA_WINDOW) -> DataFrame:
    """Weekly indicators and flags; ``next_week`` is the ticker's next existing week."""
    w = series([key], "week")
    base = numbered(
        weekly, [key], "week",
        [sma("close", ma_window, [key], "week").alias("weekly_200ma"), F.lead("week").over(w).alias("next_week")],
    )
    framed = macd_columns(base, "close", [key], "week", "weekly_macd")
    blocked = Window.partitionBy(key).orderBy("__blk", "week")
    up = F.col("weekly_macd") > F.col("weekly_macd_signal")
    was_down = F.lag("weekly_macd").over(blocked) <= F.lag("weekly_macd_signal").over(blocked)
    return framed.select(
        key,
        "week",
        "next_week",
        "close",
        "weekly_200ma",
        "weekly_macd",
        "weekly_macd_signal",
        truth(F.col("close") > F.col("weekly_200ma")).alias("weekly_above_200ma"),
        truth(up & was_down).alias("weekly_macd_gc"),
        truth(up).alias("weekly_macd_uptrend"),
    )


def asof_fill(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, payload: Sequence[str]) -> DataFrame:
    """Latest right row with right_on <= left_on per key, null payloads included.

    Union of both sides and a running last over a struct: no range join, one
    shuffle by key. On equal dates the right row comes first.
    """
    blank = [F.lit(None).cast(right.schema[p].dataType).alias(p) for p in payload]
    cols = [n for n in left.columns if n not in (key, left_on)]
    a = left.select(key, F.col(left_on).alias("__t"), F.lit(1).alias("__side"), *cols, *blank)
    b = right.select(
        key,
        F.col(right_on).alias("__t"),
        F.lit(0).alias("__side"),
        *[F.lit(None).cast(left.schema[n].dataType).alias(n) for n in cols],
        *payload,
    )
    w = running([key], F.struct("__t", "__side"))
    merged = a.unionByName(b).withColumn(
        "__last", F.last(F.when(F.col("__side") == 0, F.struct(*payload)), ignorenulls=True).over(w)
    )
    return merged.where("__side = 1").select(
        key, F.col("__t").alias(left_on), *cols, *[F.col(f"__last.{p}").alias(p) for p in payload]
    )


def weekly_to_daily(bars: DataFrame, weekly: DataFrame, key: str = "ticker") -> DataFrame:
    """Attach the latest weekly row whose Friday label is not after the day.

    A day always belongs to an existing week of its own ticker, so the row it may
    see is its own week's on a Friday and the previous existing week's
    otherwise. Each weekly row is offered under both addresses, which makes the
    as-of lookup an equi join.
    """
    friday = F.struct(F.col("week").alias("week"), F.lit(True).alias("friday"))
    later = F.struct(F.col("next_week").alias("week"), F.lit(False).alias("friday"))
    view = weekly.select(key, F.explode(F.array(friday, later)).alias("__at"), *WEEKLY_PAYLOAD).select(
        key, F.col("__at.week").alias("__week"), F.col("__at.friday").alias("__friday"), *WEEKLY_PAYLOAD
    )
    days = bars.withColumn("__week", week_label()).withColumn("__friday", F.col("date") == F.col("__week"))
    return days.join(view, [key, "__week", "__friday"], "left").select(*bars.columns, *WEEKLY_PAYLOAD)


def signal_frame(
    bars: DataFrame, key: str = "ticker", ma_window: int = WEEKLY_MA_WINDOW, readiness: bool = True, liquidity: bool = False
) -> DataFrame:
    """Bars with weekly and daily indicators, flags, score and entry signal.

    ``readiness`` adds the warm-up gate of the study; the daily job scores
    without it. ``liquidity`` adds the 60-session median of traded value.
    """
    extra = [step("close", [key]), sma("volume", VOLUME_MA_WINDOW, [key]).alias("volume_30ma")]
    added = ["volume_30ma"]
    if liquidity:
        extra.append(rolling_median("va", 60, [key]).alias("median_va_60"))
        added.append("median_va_60")
    daily = rsi_columns(numbered(bars, [key], "date", extra), [key]).select(*bars.columns, *added, "daily_rsi")
    joined = weekly_to_daily(daily, weekly_signals(weekly_bars(bars, key), key, ma_window), key)
    flags = {
        "weekly_above_200ma": truth("weekly_above_200ma"),
        "weekly_macd_gc": truth("weekly_macd_gc"),
        "weekly_macd_uptrend": truth("weekly_macd_uptrend"),
        "daily_rsi_40_65": truth(F.col("daily_rsi").between(RSI_LOW, RSI_HIGH)),
        "daily_volume_1_5x": truth(F.col("volume") >= F.col("volume_30ma") * VOLUME_MULTIPLE),
    }
    ready = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in READY_INPUTS])
    scored = joined.withColumns({**flags, "indicator_ready": ready}).withColumn("score", flag_score().cast("long"))
    hot = F.col("score") >= SCORE_THRESHOLD
    return scored.withColumn("entry_signal", F.col("indicator_ready") & hot if readiness else hot)


def with_liquidity(frame: DataFrame, key: str = "ticker", n: int = 60) -> DataFrame:
    return frame.withColumn("median_va_60", rolling_median("va", n, [key]))


def signal_events(frame: DataFrame, start: Column | None = None, end: Column | None = None, key: str = "ticker") -> DataFrame:
    """One row per entry signal with its flags, mask and liquidity."""
    rows = frame.where("indicator_ready AND entry_signal")
    if start is not None:
        rows = rows.where(F.col("date") >= start)
    if end is not None:
        rows = rows.where(F.col("date") <= end)
    liquidity = [F.coalesce("median_va_60", F.lit(0.0)).alias("median_va_60")] if "median_va_60" in frame.columns else []
    return rows.select(
        key,
        F.col("date").alias("signal_date"),
        "score",
        flag_mask().cast("long").alias("bitmask"),
        *liquidity,
        "weekly_above_200ma",
        "weekly_macd_gc",
        "weekly_macd_uptrend",
        "daily_rsi_40_65",
        "daily_volume_1_5x",
    )
