"""Queries for sources, cleaning, indicators and the signal frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.sql import sql
from tidemark.functions.values import ratio
from tidemark.operators import signals as S
from tidemark.operators import windows as W
from tidemark.sources import bars as B

K = ["ticker"]


@query(sql("SELECT ticker, date, \"open\", high, low, \"close\", volume, va FROM unit", "unit"), dbl="open high low close volume va", digits=8)
def daily_bars(spark, sf):
    """Bars with supplier as ticker and unit price."""
    return B.unit_price_bars(spark, sf)


@query(
    sql(
        """SELECT ticker, count(*) AS signal_count, CAST(max(score) AS BIGINT) AS max_score, min(date) AS first_signal,
        max(date) AS last_signal FROM unit_frame WHERE entry_signal GROUP BY ticker""",
        "unit_frame",
    )
)
def signal_counts(spark, sf):
    """Flagship: entry signals per ticker over the full scored frame."""
    frame = S.signal_frame(B.clean_ohlcv(B.unit_price_bars(spark, sf)))
    return frame.where("entry_signal").groupBy("ticker").agg(
        F.count("*").alias("signal_count"), F.max("score").alias("max_score"),
        F.min("date").alias("first_signal"), F.max("date").alias("last_signal"),
    )


FRAME_COLUMNS = [
    "ticker", "date", "close", "weekly_200ma", "weekly_macd", "weekly_macd_signal", "weekly_above_200ma", "weekly_macd_gc",
    "weekly_macd_uptrend", "daily_rsi", "volume_30ma", "daily_rsi_40_65", "daily_volume_1_5x", "score", "indicator_ready", "entry_signal",
]
FRAME_SELECT = "SELECT " + ", ".join(f'"{n}"' for n in FRAME_COLUMNS)


@query(sql(FRAME_SELECT.replace('"close", ', "") + " FROM unit_frame", "unit_frame"), dbl="weekly_200ma weekly_macd weekly_macd_signal daily_rsi volume_30ma", digits=4)
def signal_frame(spark, sf):
    return S.signal_frame(B.clean_ohlcv(B.unit_price_bars(spark, sf))).select(*FRAME_COLUMNS).drop("close")


@query(sql(FRAME_SELECT + ", median_va_60 FROM idx_frame", "idx_frame"), dbl="close weekly_200ma weekly_macd weekly_macd_signal daily_rsi volume_30ma median_va_60", digits=4)
def signal_frame_with_liquidity(spark, sf):
    """Signal frame on index bars with traded value and its 60-session median."""
    return S.signal_frame(B.index_bars(spark, sf), liquidity=True).select(*FRAME_COLUMNS, "median_va_60")


@query(
    sql(
        """SELECT ticker, date, CASE WHEN count("close") OVER w >= 20 THEN avg("close") OVER w END AS sma_20 FROM unit
        WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)""",
        "unit",
    ), dbl="sma_20", digits=4)
def moving_average(spark, sf):
    b = B.unit_price_bars(spark, sf)
    return b.select("ticker", "date", W.sma("close", 20, K).alias("sma_20"))


@query(
    sql(
        """SELECT ticker, date, CASE WHEN count(va) OVER w >= 60 THEN quantile_cont(va, 0.5) OVER w END AS median_va_60 FROM unit
        WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)""",
        "unit",
    ), dbl="median_va_60", digits=4)
def rolling_median(spark, sf):
    b = B.unit_price_bars(spark, sf)
    return b.select("ticker", "date", W.rolling_median("va", 60, K).alias("median_va_60"))


@query(
    sql(
        """SELECT ticker, date, ewm_20 FROM (WITH k AS (SELECT ticker, date, "close" AS x,
          row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM unit)
        SELECT ticker, date, CASE WHEN k >= 20 THEN pow(0.95, k - 1) *
          sum(CASE WHEN k = 1 THEN x ELSE 0.05 * x END * pow(0.95, 1 - k)) OVER (PARTITION BY ticker ORDER BY date) END AS ewm_20
        FROM k)""",
        "unit",
    ), dbl="ewm_20", digits=4)
def exponential_mean(spark, sf):
    b = B.unit_price_bars(spark, sf)
    return W.ewm(b, {"ewm_20": ("close", 0.05, 20, 0)}, K).select("ticker", "date", "ewm_20")


@query(sql("SELECT ticker, date, daily_rsi FROM unit_rsi", "unit_rsi"), dbl="daily_rsi", digits=5)
def rsi(spark, sf):
    return W.with_rsi(B.unit_price_bars(spark, sf), "close", K).select("ticker", "date", "daily_rsi")


@query(
    sql(
        """SELECT ticker, week, weekly_macd AS macd, weekly_macd_signal AS macd_signal,
        weekly_macd - weekly_macd_signal AS macd_histogram FROM unit_sig""",
        "unit_sig",
    ), dbl="macd macd_signal macd_histogram", digits=4)
def macd(spark, sf):
    weekly = S.weekly_bars(B.unit_price_bars(spark, sf))
    return W.with_macd(weekly, "close", K, "week").select("ticker", "week", "macd", "macd_signal", "macd_histogram")


@query(sql('SELECT ticker, week, "open", high, low, "close", volume FROM unit_weekly', "unit_weekly"), dbl="open high low close volume", digits=8)
def weekly_bars(spark, sf):
    return S.weekly_bars(B.unit_price_bars(spark, sf))


@query(
    sql(
        "SELECT ticker, week, weekly_200ma, weekly_above_200ma, weekly_macd_gc, weekly_macd_uptrend FROM unit_wsig",
        "unit_wsig",
    ), dbl="weekly_200ma", digits=4)
def weekly_flags(spark, sf):
    weekly = S.weekly_signals(S.weekly_bars(B.unit_price_bars(spark, sf)))
    return weekly.select("ticker", "week", "weekly_200ma", "weekly_above_200ma", "weekly_macd_gc", "weekly_macd_uptrend")


@query(
    sql(
        """SELECT u.ticker, u.date, w."close" AS weekly_close, w.week AS seen_week FROM unit u
        ASOF LEFT JOIN unit_weekly w ON u.ticker = w.ticker AND u.date >= w.week""",
        "unit",
        "unit_weekly",
    ), dbl="weekly_close", digits=8)
def weekly_asof_fill(spark, sf):
    """Latest weekly row not after each day, by union and running last."""
    bars = B.unit_price_bars(spark, sf)
    weekly = S.weekly_bars(bars).select("ticker", "week", F.col("close").alias("weekly_close"), F.col("week").alias("seen_week"))
    return S.asof_fill(bars.select("ticker", "date"), weekly, "ticker", "date", "week", ["weekly_close", "seen_week"])


@query(
    sql(
        """SELECT ticker, date, CASE WHEN ma <> 0 THEN volume / ma END AS volume_ratio FROM (SELECT ticker, date, volume,
        CASE WHEN count(volume) OVER v >= 30 THEN avg(volume) OVER v END AS ma FROM unit
        WINDOW v AS (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING))""",
        "unit",
    ), dbl="volume_ratio")
def volume_ratio(spark, sf):
    b = B.unit_price_bars(spark, sf).withColumn("ma", W.sma("volume", 30, K))
    return b.select("ticker", "date", ratio("volume", "ma").alias("volume_ratio"))


@query(
    sql(
        """SELECT ticker, date, "close" / lag("close") OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM unit""",
        "unit",
    ), dbl="ret")
def session_return(spark, sf):
    return B.unit_price_bars(spark, sf).select("ticker", "date", W.change("close", K).alias("ret"))


@query(sql("SELECT ticker, date, daily_rsi FROM unit_rsi", "unit_rsi"), dbl="daily_rsi", digits=5)
def grouped_map_indicators(spark, sf):
    """The grouped pandas kernel; same oracle as the window form."""
    out = W.pandas_indicators(B.unit_price_bars(spark, sf), K)
    return out.select("ticker", "date", F.nanvl("daily_rsi", F.lit(None).cast("double")).alias("daily_rsi"))
