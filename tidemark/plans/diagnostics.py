"""Point-in-time universes, a slot ledger over them, and its diagnostics."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import INITIAL_CAPITAL, PORTFOLIO_SLOTS, PRIMARY, UniverseRule
from tidemark.operators import calendar as cal
from tidemark.operators import diagnostics as dia
from tidemark.operators import ledger as led
from tidemark.operators import outcomes as out
from tidemark.operators import universe as uni
from tidemark.operators.windows import change
from tidemark.plans.study import Study
from tidemark.session import stage

# Thresholds in the units of the supplied tables; sizes and caps bind there.
RULES = (
    UniverseRule("liquid50", 50, 3, 45_000.0, 300.0, 0.15, 12),
    UniverseRule("liquid100", 100, 6, 30_000.0, 300.0, 0.10, 12),
)
STATIC_REGION = "ASIA"


@dataclass
class Diagnostics:
    spark: SparkSession
    sf_dir: str
    rules: tuple[UniverseRule, ...] = RULES
    study: Study | None = field(default=None)

    def __post_init__(self):
        self.study = self.study or Study(self.spark, self.sf_dir)

    @cached_property
    def all_sessions(self) -> DataFrame:
        return stage(cal.market_dates(self.study.frame).coalesce(1), "sessions")

    @cached_property
    def schedule(self) -> DataFrame:
        return stage(cal.annual_schedule(self.all_sessions).coalesce(1), "schedule")

    @cached_property
    def facts(self) -> DataFrame:
        return uni.window_facts(self.study.frame, self.schedule, self.all_sessions)

    @cached_property
    def candidates(self) -> DataFrame:
        return uni.candidates(self.facts, self.study.metadata, self.rules)

    @cached_property
    def members(self) -> DataFrame:
        """(universe, year, ticker, ...) of the ranked universes; at most target rows per year."""
        return stage(uni.sector_capped_top(self.candidates, self.rules).select("universe", "year", "ticker", "sector", "liquidity", "rank"), "members")

    @cached_property
    def static(self) -> DataFrame:
        return self.study.metadata.where(F.col("region") == STATIC_REGION).select(F.lit("static").alias("universe"), "ticker")

    @cached_property
    def years(self) -> DataFrame:
        return uni.year_of_session(self.all_sessions, self.schedule)

    def member_rows(self, rows: DataFrame, day: str) -> DataFrame:
        return uni.with_membership(rows, self.members, self.static, self.years, day)

    @cached_property
    def signals(self) -> DataFrame:
        origin = F.when(F.col("region") == STATIC_REGION, "STATIC_CODE").otherwise("ADDED_CODE")
        meta = self.study.metadata.select("ticker", "sector", origin.alias("origin_group"))
        return stage(self.member_rows(self.study.signals, "signal_date").join(meta, "ticker"), "usignals")

    @cached_property
    def shadow(self) -> DataFrame:
        s = out.one_shot_outcomes(self.signals, self.study.numbered, self.study.sessions, PRIMARY, ["universe", "signal_date"])
        return stage(dia.burden(s.drop("entry_seq", "entry_raw_open")), "shadow")

    @cached_property
    def exits(self) -> DataFrame:
        """Portfolio exits: no gap test on the entry bar, haircut when bars end early."""
        keep = ("universe", "ticker", "signal_date", "score", "sector", "median_va_60")
        x = out.bracket_exits(self.signals.select(*keep), self.study.numbered, self.study.sessions, [PRIMARY], ["universe", "signal_date"], gap_on_entry=False)
        filled = x.withColumn("last_observed_bar_date", F.col("exit_date"))
        return out.terminal_policy(filled, cal.last_day(self.study.sessions), PRIMARY.slippage, PRIMARY.commission)

    @cached_property
    def ledger(self) -> DataFrame:
        """Ten slots per universe, one position per slot, equal cash per position."""
        taken = led.slot_orders(self.exits)
        cash = INITIAL_CAPITAL / PORTFOLIO_SLOTS
        sized = taken.withColumn("shares", cash / (F.col("entry_fill_price") * (1 + PRIMARY.commission)))
        return stage(sized.drop("entry_status", "entry_idx", "entry_seq", "scenario"), "ledger")

    @cached_property
    def days(self) -> DataFrame:
        return stage(led.position_days(self.ledger, self.study.bars, self.study.sessions, PRIMARY.commission), "days")

    @cached_property
    def curve(self) -> DataFrame:
        return stage(led.portfolio_curve(self.days, self.study.sessions), "curve")

    @cached_property
    def decisions(self) -> DataFrame:
        return stage(led.dispositions(self.signals, self.ledger, self.study.bars, self.study.sessions), "decisions")

    @cached_property
    def accepted(self) -> DataFrame:
        return stage(dia.enrich_accepted(self.ledger, self.signals, self.shadow, PRIMARY.commission), "accepted")

    @cached_property
    def quality(self) -> DataFrame:
        return stage(dia.capacity_quality(self.decisions, self.shadow), "quality")

    @cached_property
    def regime(self) -> DataFrame:
        f = self.study.frame.select("ticker", "date", "close", "weekly_above_200ma", "weekly_macd_uptrend", change("close", ["ticker"]).alias("ret"))
        inside = f.where((F.col("date") >= self.study.edge("start")) & (F.col("date") <= self.study.edge("end")))
        body = self.curve.where(F.col("date") >= self.study.edge("start"))
        return stage(dia.regime_daily(self.member_rows(inside, "date"), self.signals, body, self.decisions), "regime")

    @cached_property
    def splits(self) -> DataFrame:
        return stage(cal.with_overall(self.study.splits).coalesce(1), "splits")

    @cached_property
    def episodes(self) -> DataFrame:
        # Sums in different order leave last-bit steps on flat days; they are not drawdowns.
        return led.drawdown_episodes(self.curve.withColumn("equity", F.round("equity", 6)))
