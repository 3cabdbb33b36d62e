"""Attribution, regime, capacity and episode tables over a portfolio ledger."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DISPOSITIONS, EXIT_GROUPS, FLAGS, SCORE_MASKS
from tidemark.functions.values import exit_group, mask_flag, mask_pattern, mask_score, ratio, text
from tidemark.operators.ledger import checked_one_to_one
from tidemark.operators.metrics import (
    by_split,
    concentration,
    contained,
    in_periods,
    loss_concentration,
    on_spine,
    sample_status,
    trade_stats,
)
from tidemark.operators.order import exact_quantiles
from tidemark.operators.windows import drawdown

U = ["universe"]
US = ["universe", "split"]
HORIZON_COLUMNS = tuple(f"horizon_{h}" for h in (10, 20, 40, 60))
SCORE_GROUPS = ("ALL", "90", "100", "120")
CAPACITY_GROUPS = ("accepted_all", "accepted_binding", "capacity_rejected", "duplicate_rejected", "missing_next_session", "invalid_bar")
QUALITY_GROUPS = CAPACITY_GROUPS[:3]


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("long"))


def join_all(first: DataFrame, *rest: DataFrame, on: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(on), "left"), rest, first)


def burden(df: DataFrame) -> DataFrame:
    """Exit group and the burden flag: stop family, or a losing holding-limit exit."""
    g = exit_group("exit_reason")
    bad = g.isin("stop_loss", "stop_gap") | ((g == "max_holding") & F.coalesce(F.col("net_return_pct") < 0, F.lit(False)))
    return df.withColumn("normalized_exit_reason", g).withColumn("negative_exit_burden", bad.cast("double"))


def enrich_accepted(ledger: DataFrame, signals: DataFrame, shadow: DataFrame, commission: float, key: str = "ticker") -> DataFrame:
    """Ledger with mask, origin, flags, excursions, horizons, exit group and net PnL."""
    on = ["universe", key, "signal_date"]
    parts = signals.select(*on, "bitmask", "origin_group", *FLAGS)
    extra = shadow.select(*on, "shadow_status", "mfe", "mae", *HORIZON_COLUMNS)
    joined = checked_one_to_one(checked_one_to_one(ledger, parts, on), extra, on)
    pnl = F.col("shares") * (F.col("exit_fill_price") * (1 - commission) - F.col("entry_fill_price") * (1 + commission))
    return burden(joined).withColumn("net_pnl_jpy", pnl)


def regime_daily(members: DataFrame, signals: DataFrame, curve: DataFrame, decisions: DataFrame) -> DataFrame:
    """Breadth, returns, cash use and dispositions per universe and session.

    ``members`` holds the member bars of each session with their flags and
    one-session return ``ret``; a universe has at most its target size of rows
    per session, which bounds the exact median.
    """
    on = ["universe", "date"]
    cross = members.where(F.col("close") > 0).groupBy(*on).agg(
        F.count("*").alias("active_member_count"),
        F.avg(F.col("weekly_above_200ma").cast("double")).alias("above_share"),
        F.avg(F.col("weekly_macd_uptrend").cast("double")).alias("uptrend_share"),
        F.percentile("ret", F.lit(0.5)).alias("median_return"),
        F.stddev_pop("ret").alias("return_std"),
    )
    raised = signals.groupBy("universe", F.col("signal_date").alias("date")).agg(F.count("*").alias("raw_signal_count"))
    outcome = decisions.where("entry_date IS NOT NULL").groupBy("universe", F.col("entry_date").alias("date")).agg(
        *[F.count_if(F.col("disposition") == d).alias(f"{d}_count") for d in DISPOSITIONS]
    )
    out = join_all(curve.select(*on, "cash_utilization", "active_positions", "equity"), cross, raised, outcome, on=on)
    counts = ["active_member_count", "raw_signal_count", *[f"{d}_count" for d in DISPOSITIONS]]
    out = out.withColumns({n: zero(n) for n in counts})
    return out.withColumn("signal_breadth", ratio("raw_signal_count", "active_member_count"))


def score_mask_table(signals: DataFrame, accepted: DataFrame, splits: DataFrame) -> DataFrame:
    """Five masks x splits x universes with statistics and concentrations."""
    by = [*US, "bitmask"]
    raw = in_periods(signals, splits, "signal_date")
    cohort = in_periods(accepted, splits, "signal_date")
    kept = contained(accepted, splits)
    closed = kept.where("is_closed")
    masks = F.explode(F.array(*[F.lit(m).cast("long") for m in SCORE_MASKS])).alias("bitmask")
    spine = signals.select("universe").distinct().withColumn("split", F.explode(splits.agg(F.collect_list("split")).scalar())).select("*", masks)
    parts = [
        raw.groupBy(*by).agg(F.count("*").alias("raw_signal_count")),
        cohort.groupBy(*by).agg(F.count("*").alias("accepted_signal_cohort_count")),
        closed.groupBy(*by).agg(*[F.count_if(F.col("normalized_exit_reason") == g).alias(f"{g}_exit_count") for g in EXIT_GROUPS]),
        concentration(closed, by, "ticker", "ticker_", top="top_trade_share", hhi="trade_hhi", distinct="distinct_count"),
        concentration(closed, by, "sector", "sector_", top="top_trade_share", hhi="trade_hhi", distinct="distinct_count"),
        loss_concentration(closed, by, "ticker", "ticker_").drop("ticker_distinct_loss_bucket_count"),
        loss_concentration(closed, by, "sector", "sector_").drop("sector_distinct_loss_bucket_count"),
    ]
    out = on_spine(join_all(spine, *parts, on=by), trade_stats(kept, by), by)
    zeros = ["raw_signal_count", "accepted_signal_cohort_count", "ticker_distinct_count", "sector_distinct_count", *[f"{g}_exit_count" for g in EXIT_GROUPS]]
    out = sample_status(out.withColumns({n: zero(n) for n in zeros}))
    return out.withColumns(
        {
            "bit_pattern": mask_pattern("bitmask"),
            "score": mask_score("bitmask").cast("long"),
            "cross_boundary_excluded_count": F.col("accepted_signal_cohort_count") - F.col("trade_count"),
            **{f"has_{n}": mask_flag("bitmask", bit) for n, (_, bit) in FLAGS.items()},
        }
    )


def exit_reason_table(accepted: DataFrame, splits: DataFrame) -> DataFrame:
    """Exit groups x score groups x splits: PnL share, statistics, excursions, horizons."""
    by = [*US, "score_group", "exit_reason_group"]
    wanted = splits.where("split IN ('overall', 'validation', 'final_holdout')")
    groups = F.array_compact(F.array(F.lit("ALL"), F.when(F.col("score").isin(90, 100, 120), F.col("score").cast("string"))))
    closed = (
        contained(accepted, wanted).where("is_closed").withColumn("score_group", F.explode(groups))
        .withColumn("exit_reason_group", F.col("normalized_exit_reason"))
    )
    spine = (
        accepted.select("universe").distinct()
        .withColumn("split", F.explode(wanted.agg(F.collect_list("split")).scalar()))
        .withColumn("score_group", F.explode(F.array(*[F.lit(g) for g in SCORE_GROUPS])))
        .withColumn("exit_reason_group", F.explode(F.array(*[F.lit(g) for g in EXIT_GROUPS])))
    )
    sums = closed.groupBy(*by).agg(
        F.sum("net_pnl_jpy").alias("total_net_pnl_jpy"), F.avg("mfe").alias("mean_mfe"), F.avg("mae").alias("mean_mae"),
        *[F.count(h).alias(f"{h}_available_count") for h in HORIZON_COLUMNS],
        *[F.avg(h).alias(f"{h}_mean_unrealized_return") for h in HORIZON_COLUMNS],
    )
    out = on_spine(spine.join(sums, by, "left"), trade_stats(closed, by), by)
    out = out.withColumn("total_net_pnl_jpy", F.coalesce("total_net_pnl_jpy", F.lit(0.0)))
    # Seven rows per group.
    whole = F.sum("total_net_pnl_jpy").over(Window.partitionBy(*US, "score_group"))
    out = out.withColumn("share_of_score_group_net_pnl", ratio("total_net_pnl_jpy", whole))
    return sample_status(out.withColumns({f"{h}_available_count": zero(f"{h}_available_count") for h in HORIZON_COLUMNS}))


def capacity_quality(decisions: DataFrame, shadow: DataFrame, key: str = "ticker") -> DataFrame:
    """Every signal's disposition with its one-shot outcome."""
    on = ["universe", key, "signal_date"]
    outcome = shadow.select(
        *on, "shadow_status", "exit_date", "holding_sessions", "mfe", "mae", *HORIZON_COLUMNS, "is_closed", "net_return_pct",
        "exit_reason", "normalized_exit_reason", "negative_exit_burden",
    )
    return checked_one_to_one(decisions, outcome, on, require_match=False)


def disposition_groups(df: DataFrame) -> DataFrame:
    """Overlapping report groups: accepted signals also count under binding sessions."""
    d, binding = F.col("disposition"), F.col("capacity_binding_session")
    groups = F.array_compact(
        F.array(
            F.when(d == "accepted", "accepted_all"),
            F.when((d == "accepted") & binding, "accepted_binding"),
            F.when(d != "accepted", d),
        )
    )
    return df.withColumn("disposition_group", F.explode(groups))


def capacity_table(quality: DataFrame, splits: DataFrame) -> DataFrame:
    """Six disposition groups x splits: counts, statistics, distributions, shares."""
    by = [*US, "disposition_group"]
    cohort = disposition_groups(in_periods(quality, splits, "signal_date"))
    kept = disposition_groups(contained(quality, splits))
    spine = quality.select("universe").distinct().withColumn("split", F.explode(splits.agg(F.collect_list("split")).scalar())).withColumn(
        "disposition_group", F.explode(F.array(*[F.lit(g) for g in CAPACITY_GROUPS]))
    )
    binding = in_periods(quality.where("capacity_binding_session"), splits, "signal_date").select(*US, "entry_date").distinct().groupBy(*US).agg(
        F.count("*").alias("capacity_binding_session_count")
    )
    sizes = cohort.groupBy(*by).agg(
        F.count("*").alias("signal_count"), F.avg("score").alias("score_mean"), F.avg("median_va_60").alias("liquidity_mean"),
        # Scores take a handful of values, so the exact quantiles are small.
        F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__s"),
        *[F.avg((F.col("score") == s).cast("double")).alias(f"score_{s}_share") for s in (90, 100, 120)],
    )
    liquidity = exact_quantiles(cohort, by, "median_va_60", {"liquidity_p25": 0.25, "liquidity_median": 0.5, "liquidity_p75": 0.75})
    sector = concentration(cohort, by, "sector", "sector_", top="top_signal_share", hhi="signal_hhi", distinct="distinct_count")
    contained_n = kept.groupBy(*by).agg(F.count("*").alias("contained_quality_count"))
    out = join_all(spine, sizes, liquidity, sector, contained_n, on=by).join(binding, US, "left")
    stats = sample_status(trade_stats(kept.where(F.col("disposition_group").isin(*QUALITY_GROUPS)), by))
    out = out.join(stats, by, "left")
    scored = F.col("disposition_group").isin(*QUALITY_GROUPS)
    counts = ("signal_count", "contained_quality_count", "sector_distinct_count", "capacity_binding_session_count")
    out = out.withColumns({n: zero(n) for n in counts})
    return out.withColumns(
        {
            "trade_count": F.when(scored, zero("trade_count")).otherwise(F.col("signal_count")),
            "closed_trade_count": F.when(scored, zero("closed_trade_count")),
            "open_trade_count": F.when(scored, zero("open_trade_count")),
            "max_consecutive_losses": F.when(scored, zero("max_consecutive_losses")),
            "sum_net_returns": F.when(scored, F.coalesce("sum_net_returns", F.lit(0.0))),
            "sample_status": F.when(scored, F.coalesce("sample_status", F.lit("INSUFFICIENT_SAMPLE"))).otherwise("COUNT_ONLY"),
            "cross_boundary_or_censored_count": F.col("signal_count") - F.col("contained_quality_count"),
            "score_p25": F.col("__s")[0], "score_median": F.col("__s")[1], "score_p75": F.col("__s")[2],
        }
    ).drop("__s")


def regime_summary(regime: DataFrame, accepted: DataFrame, curve: DataFrame, splits: DataFrame) -> DataFrame:
    """Session averages per split with trades, concentration and drawdown."""
    days = in_periods(regime, splits, "date")
    kept = contained(accepted, splits)
    closed = kept.where("is_closed")
    n = F.count("*")
    accepted_n, rejected_n = F.sum("accepted_count"), F.sum("capacity_rejected_count")
    daily = days.groupBy(*US).agg(
        n.alias("session_count"), F.sum("raw_signal_count").alias("raw_signal_count"),
        (100.0 * F.sum("raw_signal_count") / n).alias("raw_signal_frequency_per_100_sessions"),
        accepted_n.alias("accepted_entry_count"), rejected_n.alias("capacity_rejection_count"),
        F.sum("duplicate_rejected_count").alias("duplicate_rejection_count"),
        F.try_divide(rejected_n, accepted_n + rejected_n).alias("capacity_rejection_share"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("active_member_count", "above_share", "uptrend_share", "median_return", "return_std", "signal_breadth", "cash_utilization", "active_positions")],
        F.max("cash_utilization").alias("maximum_cash_utilization"), F.max("active_positions").alias("maximum_active_positions"),
        F.avg((F.col("active_positions") > 0).cast("double")).alias("market_exposure_share"),
    )
    worst = drawdown(by_split(curve, splits, U), US).groupBy(*US).agg(F.min("drawdown").alias("maximum_drawdown"))
    stats = trade_stats(kept, US).select(*US, "closed_trade_count", "profit_factor", "expectancy_per_trade", "win_rate", "average_holding_sessions")
    exits = closed.groupBy(*US).agg(
        F.avg(F.col("normalized_exit_reason").isin("stop_loss", "stop_gap").cast("double")).alias("stop_family_exit_share"),
        F.avg((F.col("normalized_exit_reason") == "max_holding").cast("double")).alias("max_holding_exit_share"),
    )
    tick = concentration(closed, US, "ticker", "ticker_", top="top_trade_share", hhi="trade_hhi", distinct="distinct_count")
    sect = concentration(closed, US, "sector", "sector_", top="top_trade_share", hhi="trade_hhi", distinct="distinct_count")
    out = join_all(daily, worst, stats, exits, tick, sect, on=US)
    return out.withColumns({c: zero(c) for c in ("closed_trade_count", "ticker_distinct_count", "sector_distinct_count")})


def loss_shares(days: DataFrame, dims: Sequence[str], bucket: str, prefix: str) -> DataFrame:
    """Gross negative PnL by bucket: distinct, top, top three, HHI; names withheld."""
    return top_shares(days.where("pnl_jpy < 0").groupBy(*dims, text(bucket).alias("bucket")).agg((-F.sum("pnl_jpy")).alias("w")), dims, prefix)


def adverse_net(days: DataFrame, dims: Sequence[str], bucket: str, prefix: str) -> DataFrame:
    """The same on buckets whose net PnL is negative."""
    net = days.groupBy(*dims, text(bucket).alias("bucket")).agg((-F.sum("pnl_jpy")).alias("w"))
    return top_shares(net.where("w > 0"), dims, prefix)


def top_shares(table: DataFrame, dims: Sequence[str], prefix: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*dims).orderBy(F.col("w").desc(), "bucket"))
    lead = table.withColumn("r", rank).where("r <= 3").groupBy(*dims).agg(F.max("w").alias("t1"), F.sum("w").alias("t3"))
    total = table.groupBy(*dims).agg(F.count("*").alias("n"), F.sum("w").alias("t"), F.sum(F.col("w") * F.col("w")).alias("q"))
    return total.join(lead, list(dims)).select(
        *dims, F.col("n").alias(f"{prefix}_distinct_count"), (F.col("t1") / F.col("t")).alias(f"{prefix}_top_share"),
        (F.col("t3") / F.col("t")).alias(f"{prefix}_top3_share"), (F.col("q") / (F.col("t") * F.col("t"))).alias(f"{prefix}_hhi"),
    )


def categorical_loss(days: DataFrame, dims: Sequence[str], column: str, categories: Sequence, suffix: str = "gross_loss_share", prefix: str = "") -> DataFrame:
    """Share of gross loss per listed category, zeros kept."""
    loss = F.when(F.col("pnl_jpy") < 0, -F.col("pnl_jpy")).otherwise(0.0)
    total = F.sum(loss)
    return days.groupBy(*dims).agg(
        *[F.when(total > 0, F.sum(F.when(F.col(column) == F.lit(c), loss).otherwise(0.0)) / total).alias(f"{prefix}{c}_{suffix}") for c in categories]
    )


def episode_table(episodes: DataFrame, days: DataFrame, regime: DataFrame, worst: int = 5) -> DataFrame:
    """Worst episodes with PnL, cash use, breadth and loss attribution.

    Windows exclude the peak day and include the trough. The few windows are
    turned into the sessions they contain, so days join by date.
    """
    by = ["universe", "episode_rank"]
    top = episodes.where(F.col("episode_rank") <= worst)
    spans = top.select(*by, F.explode(F.sequence(F.date_add("start_date", 1), "trough_date")).alias("date"))
    pnl = days.join(F.broadcast(spans), ["universe", "date"])
    day = regime.join(F.broadcast(spans), ["universe", "date"])
    money = pnl.groupBy(*by).agg(
        F.sum("pnl_jpy").alias("position_net_pnl_jpy"), F.sum(F.when(F.col("pnl_jpy") < 0, -F.col("pnl_jpy")).otherwise(0.0)).alias("gross_negative_position_day_pnl_jpy")
    )
    n = F.count("*")
    market = day.groupBy(*by).agg(
        n.alias("window_session_count"), F.avg("active_positions").alias("mean_active_positions"), F.max("active_positions").alias("maximum_active_positions"),
        F.avg("cash_utilization").alias("mean_cash_utilization"), F.max("cash_utilization").alias("maximum_cash_utilization"),
        F.sum("capacity_rejected_count").alias("capacity_rejection_count"), F.sum("raw_signal_count").alias("raw_signal_count"),
        (100.0 * F.sum("raw_signal_count") / n).alias("raw_signal_frequency_per_100_sessions"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("above_share", "uptrend_share", "median_return", "return_std", "signal_breadth")],
    )
    parts = [
        money, market,
        loss_shares(pnl, by, "ticker", "ticker_gross_loss"), loss_shares(pnl, by, "sector", "sector_gross_loss"),
        adverse_net(pnl, by, "ticker", "ticker_adverse_net"), adverse_net(pnl, by, "sector", "sector_adverse_net"),
        categorical_loss(pnl, by, "score", (90, 100, 120), prefix="score_"), categorical_loss(pnl, by, "trade_exit_reason", EXIT_GROUPS),
    ]
    out = join_all(top, *parts, on=by)
    change = F.col("equity_change_peak_to_trough")
    agrees = F.abs(F.col("position_net_pnl_jpy") - change) <= 1e-5 + 1e-10 * F.abs(change)
    return out.withColumn("position_pnl_reconciled", F.coalesce(agrees, F.lit(False)))


def score_monotonicity(accepted: DataFrame, splits: DataFrame) -> DataFrame:
    """Expectancy per score, the strict order test, and score-120 counts per split."""
    by = trade_stats(accepted.where(F.col("score").isin(90, 100, 120)), ["universe", "score"])
    wide = by.groupBy("universe").pivot("score", [90, 100, 120]).agg(
        F.first("closed_trade_count").alias("closed"), F.first("expectancy_per_trade").alias("expectancy"), F.first("profit_factor").alias("profit_factor")
    )
    named = wide.select("universe", *[F.col(f"{s}_{m}").alias(f"score_{s}_{m}") for s in (90, 100, 120) for m in ("closed", "expectancy", "profit_factor")])
    e = [F.col(f"score_{s}_expectancy") for s in (90, 100, 120)]
    strict = F.coalesce((e[0] < e[1]) & (e[1] < e[2]), F.lit(False))
    late = contained(accepted, splits).where("is_closed AND score = 120").groupBy("universe").agg(
        *[F.count_if(F.col("split") == s).alias(f"score_120_{s}_count") for s in ("validation", "final_holdout")]
    )
    out = named.join(late, "universe", "left").withColumn("strictly_increasing", strict)
    zeros = [f"score_{s}_closed" for s in (90, 100, 120)] + [f"score_120_{s}_count" for s in ("validation", "final_holdout")]
    return out.withColumns({n: zero(n) for n in zeros})
