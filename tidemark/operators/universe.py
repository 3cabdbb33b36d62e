"""Point-in-time universes: eligibility, ranking, sector caps, membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import BLANK_SECTORS, EQUITY_PRODUCTS, INCLUDED_MARKETS, UNIVERSE_RULES, UniverseRule
from tidemark.functions.values import text, valid_bar
from tidemark.operators.signals import asof_fill
from tidemark.operators.order import total_rank
from tidemark.session import CALENDAR_ROWS, bounded


def eligible_master(master: DataFrame) -> DataFrame:
    """Listed domestic shares with a real sector code."""
    sector = F.trim(text("S33"))
    return master.where(
        F.col("Mkt").isin(*INCLUDED_MARKETS)
        & F.upper(F.trim(text("ProdCat"))).isin(*EQUITY_PRODUCTS)
        & ~sector.isin(*BLANK_SECTORS)
    )


def selection_windows(schedule: DataFrame, sessions: DataFrame, long: int = 252, short: int = 60) -> DataFrame:
    """(year, date) pairs of the trailing windows; years x sessions rows."""
    days = schedule.select(
        "year", "cutoff_date", F.col("idx").alias("sel"), F.explode(F.sequence(F.col("idx") - long, F.col("idx") - 1)).alias("idx")
    )
    return days.join(bounded(sessions, CALENDAR_ROWS), "idx").select(
        "year", "cutoff_date", "date", (F.col("idx") >= F.col("sel") - short).alias("recent")
    )


def window_facts(bars: DataFrame, schedule: DataFrame, sessions: DataFrame, key: str = "ticker", long: int = 252) -> DataFrame:
    """Per (year, code): completeness, cutoff close, median traded value, first bar.

    All years are one aggregation over bars joined to a small day table; the
    median holds at most 60 values per group.
    """
    days = selection_windows(schedule, sessions, long)
    facts = (
        bars.join(bounded(days, CALENDAR_ROWS), "date")
        .groupBy("year", key, "cutoff_date")
        .agg(
            (F.count_if(valid_bar()) / long).alias("completeness"),
            F.max(F.when(F.col("date") == F.col("cutoff_date"), F.col("close"))).alias("raw_close"),
            F.percentile(F.when(F.col("recent"), F.col("va")), F.lit(0.5)).alias("liquidity"),
        )
    )
    first = bars.groupBy(key).agg(F.min("date").alias("first_date"))
    return facts.join(first, key)


def rule_array(rules: Sequence[UniverseRule]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r.name).alias("universe"), F.lit(r.target).alias("target"), F.lit(r.sector_cap).alias("cap"),
                F.lit(r.min_liquidity).alias("min_liquidity"), F.lit(r.min_close).alias("min_close"),
                F.lit(r.min_completeness).alias("min_completeness"), F.lit(r.min_months_listed).alias("months"),
            )
            for r in rules
        ]
    )


def candidates(facts: DataFrame, sectors: DataFrame, rules: Sequence[UniverseRule] = UNIVERSE_RULES, key: str = "ticker") -> DataFrame:
    """Codes that pass every test of a rule at a year's cutoff."""
    tested = facts.withColumn("__r", F.explode(rule_array(rules))).select(facts["*"], "__r.*")
    passed = tested.where(
        (F.add_months("first_date", F.col("months")) <= F.col("cutoff_date"))
        & (F.col("completeness") >= F.col("min_completeness"))
        & (F.col("raw_close") >= F.col("min_close"))
        & (F.col("liquidity") >= F.col("min_liquidity"))
    )
    return passed.join(sectors.select(key, "sector"), key)


def preliminary_rank(bars: DataFrame, schedule: DataFrame, sessions: DataFrame, min_liquidity: float, min_close: float = 300.0, key: str = "ticker") -> DataFrame:
    """Liquidity order from the 60-session slice alone."""
    days = selection_windows(schedule, sessions, long=60)
    facts = bars.join(bounded(days, CALENDAR_ROWS), "date").groupBy("year", key).agg(
        F.percentile("va", F.lit(0.5)).alias("liquidity"),
        F.max(F.when(F.col("date") == F.col("cutoff_date"), F.col("close"))).alias("raw_close"),
    )
    kept = facts.where((F.col("liquidity") >= min_liquidity) & (F.col("raw_close") >= min_close))
    return total_rank(kept, ["year"], "liquidity", [key])


def sector_capped_top(cands: DataFrame, rules: Sequence[UniverseRule] = UNIVERSE_RULES, key: str = "ticker") -> DataFrame:
    """First ``target`` by liquidity with at most ``cap`` per sector.

    Two ranks replace the greedy scan. The literal bounds let Spark keep only
    the leading rows of every task before it shuffles.
    """
    order = [F.col("liquidity").desc(), F.col(key)]
    in_sector = Window.partitionBy("universe", "year", "sector").orderBy(*order)
    overall = Window.partitionBy("universe", "year").orderBy(*order)
    short = cands.withColumn("sector_rank", F.row_number().over(in_sector)).where(F.col("sector_rank") <= max(r.sector_cap for r in rules))
    capped = short.where(F.col("sector_rank") <= F.col("cap"))
    ranked = capped.withColumn("rank", F.row_number().over(overall)).where(F.col("rank") <= max(r.target for r in rules))
    return ranked.where(F.col("rank") <= F.col("target"))


def composition_hash(code: str) -> Column:
    """sha256 of the sorted code list as compact JSON; members are at most ``target``."""
    return F.sha2(F.to_json(F.array_sort(F.collect_list(code))), 256)


def selection_summary(cands: DataFrame, selected: DataFrame, schedule: DataFrame, rules: Sequence[UniverseRule] = UNIVERSE_RULES, key: str = "ticker") -> DataFrame:
    by = ["universe", "year"]
    spine = schedule.withColumn("__r", F.explode(rule_array(rules))).select(
        "__r.universe", "year", "selection_date", "cutoff_date", F.col("__r.target").cast("long").alias("target_count")
    )
    eligible = cands.groupBy(*by).agg(F.count("*").alias("eligible_count"))
    members = selected.groupBy(*by).agg(F.count("*").alias("selected_count"), composition_hash(key).alias("composition_sha256"))
    n = F.sum("n")
    sectors = selected.groupBy(*by, "sector").agg(F.count("*").alias("n")).groupBy(*by).agg(
        F.count("*").alias("sector_count"), (F.max("n") / n).alias("top_sector_member_share"),
        (F.sum(F.col("n") * F.col("n")) / (n * n)).alias("sector_member_hhi"),
    )
    out = spine.join(eligible, by, "left").join(members, by, "left").join(sectors, by, "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("eligible_count", "selected_count", "sector_count")}
    out = out.withColumns({**zero, "composition_sha256": F.coalesce("composition_sha256", F.sha2(F.lit("[]"), 256))})
    return out.withColumn("shortfall_count", F.greatest(F.col("target_count") - F.col("selected_count"), F.lit(0).cast("long")))


def membership_from_lists(df: DataFrame) -> DataFrame:
    """{universe: {year: [codes]}} rows to (universe, year, ticker)."""
    return df.select("universe", F.explode("years").alias("year", "codes")).select(
        "universe", F.col("year").cast("int").alias("year"), F.explode("codes").alias("ticker")
    )


def year_of_session(sessions: DataFrame, schedule: DataFrame) -> DataFrame:
    """Selection year in force on each session; null before the first."""
    starts = schedule.select(F.col("selection_date").alias("date"), F.col("year").alias("__y"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return sessions.join(F.broadcast(starts), "date", "left").select(
        "date", F.last("__y", ignorenulls=True).over(w).alias("year")
    )


def with_membership(rows: DataFrame, members: DataFrame, static: DataFrame | None, years: DataFrame, day: str, key: str = "ticker") -> DataFrame:
    """Rows repeated per universe they belong to on that day.

    ``members`` is (universe, year, ticker), ``static`` (universe, ticker).
    Interval membership becomes an equi join on the year in force.
    """
    dated = rows.join(bounded(years.select(F.col("date").alias(day), "year"), CALENDAR_ROWS), day, "left")
    dynamic = dated.join(members.select("universe", "year", key), ["year", key]).drop("year")
    if static is None:
        return dynamic
    return dynamic.unionByName(rows.join(static.select("universe", key), key))


def sector_asof(rows: DataFrame, master: DataFrame, years: DataFrame, first_year: Column, day: str, key: str = "ticker") -> DataFrame:
    """Sector from the annual master in force, the first one before any; '' if absent."""
    dated = rows.join(bounded(years.select(F.col("date").alias(day), "year"), CALENDAR_ROWS), day, "left").withColumn(
        "year", F.coalesce("year", first_year)
    )
    found = dated.join(master.select("year", key, F.col("sector").alias("__s")), ["year", key], "left")
    return found.withColumn("sector", F.coalesce("__s", F.lit(""))).drop("__s", "year")


def first_common_ready(frame: DataFrame, members: DataFrame, static: DataFrame, years: DataFrame, key: str = "ticker") -> DataFrame:
    """First session on which every active member of every universe is ready.

    Readiness is the latest known bar's; only members are followed, so the day
    table has universe size x sessions rows.
    """
    days = years.where("year IS NOT NULL")
    dynamic = members.join(bounded(days, CALENDAR_ROWS), "year").select("universe", key, "date")
    anyday = static.withColumn("year", F.explode(F.array_distinct(members.agg(F.collect_set("year")).scalar()))).join(
        bounded(days, CALENDAR_ROWS), "year"
    ).select("universe", key, "date")
    watch = dynamic.unionByName(anyday)
    known = asof_fill(watch, frame.select(key, F.col("date").alias("__d"), "indicator_ready"), key, "date", "__d", ["indicator_ready"])
    per = known.groupBy("universe", "date").agg(F.bool_and(F.coalesce("indicator_ready", F.lit(False))).alias("ok"))
    names = members.select("universe").union(static.select("universe")).distinct().agg(F.count("*")).scalar()
    ready = per.where("ok").groupBy("date").agg(F.count("*").alias("n")).withColumn("need", names)
    return ready.where("n = need").agg(F.min("date").alias("first_common_ready"))
