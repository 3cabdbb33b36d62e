"""Fixed-universe study: bars -> signals -> trades per scenario -> curves."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import PRIMARY, SCENARIOS
from tidemark.operators import calendar as cal
from tidemark.operators import outcomes as out
from tidemark.operators import signals as sig
from tidemark.session import stage
from tidemark.sources import bars as src


def common_window(bars: DataFrame, frame: DataFrame) -> DataFrame:
    """Latest first bar and first ready date, earliest last bar: (start, end, tickers, ready_tickers)."""
    spans = frame.groupBy("ticker").agg(
        F.min("date").alias("first"), F.max("date").alias("last"),
        F.min(F.when(F.col("indicator_ready"), F.col("date"))).alias("ready"),
    )
    return spans.agg(
        F.greatest(F.max("first"), F.max("ready")).alias("start"), F.min("last").alias("end"),
        F.count("*").alias("tickers"), F.count("ready").alias("ready_tickers"),
    )


@dataclass
class Study:
    """Lazy frames of one study.

    The signal frame is staged: the window, the calendar, the signals and the
    bars of every scenario read it, and the indicator windows should run once.
    """

    spark: SparkSession
    sf_dir: str
    universe: str = "all"

    @cached_property
    def clean(self) -> DataFrame:
        """Clean bars for daily and weekly indicators.

        What is observed is read, and no filter passes below it: days and weeks ask
        for the same bars, so both read one aggregate and one shuffle by ticker.
        """
        bars = src.clean_ohlcv(src.index_bars(self.spark, self.sf_dir))
        return bars.observe("bars", F.count("va").alias("valued"))

    @cached_property
    def frame(self) -> DataFrame:
        full = sig.signal_frame(self.clean, liquidity=True)
        return stage(full.drop("weekly_macd", "weekly_macd_signal"), "frame")

    @cached_property
    def window(self) -> DataFrame:
        return stage(common_window(self.frame, self.frame).coalesce(1), "window")

    def edge(self, name: str) -> Column:
        return self.window.select(name).scalar()

    @cached_property
    def bars(self) -> DataFrame:
        b = self.frame.where((F.col("date") >= self.edge("start")) & (F.col("date") <= self.edge("end")))
        return src.by_ticker(b.select("ticker", "date", *src.OHLCV, "va"), rows=self.frame.count())

    @cached_property
    def numbered(self) -> DataFrame:
        return out.number_bars(self.bars)

    @cached_property
    def sessions(self) -> DataFrame:
        return cal.market_dates(self.frame, self.edge("start"), self.edge("end"))

    @cached_property
    def signals(self) -> DataFrame:
        return sig.signal_events(self.frame, self.edge("start"), self.edge("end"))

    @cached_property
    def metadata(self) -> DataFrame:
        return src.supplier_metadata(self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        """Signals with name and sector, blank when the ticker is unknown."""
        joined = self.signals.join(self.metadata.select("ticker", "name", "sector"), "ticker", "left")
        return joined.withColumns({n: F.coalesce(n, F.lit("")) for n in ("name", "sector")})

    def exits(self, scenarios=SCENARIOS) -> DataFrame:
        cols = ("ticker", "signal_date", "score", "name", "sector")
        return out.bracket_exits(self.events.select(*cols), self.numbered, self.sessions, scenarios)

    def statuses(self, scenarios=SCENARIOS) -> DataFrame:
        return out.select_non_overlapping(self.exits(scenarios), ["scenario", "ticker"])

    @cached_property
    def trades(self) -> DataFrame:
        """Accepted trades of all scenarios, staged because every table reads them."""
        return stage(out.accepted_trades(self.statuses(), self.universe), "trades")

    @cached_property
    def primary(self) -> DataFrame:
        return self.trades.where(F.col("scenario") == PRIMARY.name)

    def curve(self, trades: DataFrame | None = None) -> DataFrame:
        return out.equal_notional_curve(trades if trades is not None else self.trades, self.numbered, self.sessions, ["scenario"])

    @cached_property
    def splits(self) -> DataFrame:
        return cal.chronological_splits(self.sessions)
