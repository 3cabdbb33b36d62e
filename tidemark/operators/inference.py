"""Bootstrap, leave-one-out and verdict operators over two-arm comparisons.

Every table carries ``PAIR`` (hypothesis, universe, split), so all comparisons
run in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import (
    BOOTSTRAP_CONFIDENCE,
    BOOTSTRAP_REPLICATES,
    BOOTSTRAP_SEED,
    HIGH_EXPOSURE,
    HYPOTHESES,
    MAX_ACTIONABLE,
    MAX_TOP_SECTOR_SHARE,
    MAX_TOP_TICKER_SHARE,
    MIN_CLOSED_TRADES,
    MIN_MONTH_CLUSTERS,
    MIN_SAME_DIRECTION,
    MIN_VALID_FRACTION,
)
from tidemark.functions.values import text
from tidemark.operators.metrics import by_split, concentration, contained
from tidemark.operators.windows import drawdown

PAIR = ["hypothesis", "universe", "split"]
PRIME = 2_147_483_647


@dataclass(frozen=True)
class Policy:
    """Sample sizes and limits a comparison must meet."""

    min_trades: int = MIN_CLOSED_TRADES
    min_clusters: int = MIN_MONTH_CLUSTERS
    replicates: int = BOOTSTRAP_REPLICATES
    confidence: float = BOOTSTRAP_CONFIDENCE
    min_valid: float = MIN_VALID_FRACTION
    min_same: float = MIN_SAME_DIRECTION
    top_ticker: float = MAX_TOP_TICKER_SHARE
    top_sector: float = MAX_TOP_SECTOR_SHARE


def draw(seed: Column, rep: Column, i: Column, m: Column) -> Column:
    """Deterministic draw in [0, m): modular mixing of (seed, rep, i).

    Plain integer arithmetic below 2^63: the same on every executor, on a retry
    and in any SQL engine. It is not numpy's stream.
    """
    s = (seed + rep * 1000003 + i * 7919) % PRIME
    a = (s * 48271) % PRIME
    b = ((a * a) % PRIME + a * 16807 + 12345) % PRIME
    return ((b * 69621) % PRIME) % m


def label_seed(label: Column, seed: int = BOOTSTRAP_SEED) -> Column:
    return (F.lit(seed) + F.conv(F.substring(F.md5(label), 1, 7), 16, 10).cast("long")) % PRIME


def with_utilization(accepted: DataFrame, curve: DataFrame) -> DataFrame:
    """Cash use of the curve on the signal day; the curve has one row per session."""
    use = curve.select("universe", F.col("date").alias("signal_date"), F.col("cash_utilization").alias("signal_cash_utilization"))
    return accepted.join(F.broadcast(use), ["universe", "signal_date"], "left")


def hypothesis_arms(shadow: DataFrame, quality: DataFrame, accepted: DataFrame, curve: DataFrame, splits: DataFrame, universes: Sequence[str]) -> DataFrame:
    """Long table of all comparisons: PAIR, arm, ticker, sector, signal_date, is_closed, value."""
    wanted = splits.where("split IN ('validation', 'final_holdout')")

    def arm(df: DataFrame, hid: str, left: Column, right: Column, value: str) -> DataFrame:
        return df.select(
            F.lit(hid).alias("hypothesis"), "universe", "split", F.when(left, "left").when(right, "right").alias("arm"),
            "ticker", "sector", "signal_date", F.coalesce("is_closed", F.lit(False)).alias("is_closed"), F.col(value).alias("value"),
        ).where("arm IS NOT NULL")

    keep = lambda df: contained(df.where(F.col("universe").isin(*universes)), wanted)
    one_shot, judged, taken = keep(shadow), keep(quality), keep(with_utilization(accepted, curve))
    added, static = F.col("origin_group") == "ADDED_CODE", F.col("origin_group") == "STATIC_CODE"
    use, score = F.col("signal_cash_utilization"), F.col("score")
    ids = {h: v for h, v, _ in HYPOTHESES}
    a, b, c, d, e = ids
    parts = [
        arm(one_shot, a, added, static, ids[a]),
        arm(judged, b, F.col("disposition") == "capacity_rejected", (F.col("disposition") == "accepted") & F.col("capacity_binding_session"), ids[b]),
        arm(taken, c, use >= HIGH_EXPOSURE, use < HIGH_EXPOSURE, ids[c]),
        arm(one_shot, d, added, static, ids[d]),
        arm(taken, e, score == 120, score.isin(90, 100), ids[e]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pooled_arms(outcomes: DataFrame, hypothesis: str, left: Column, right: Column, value: str = "net_return_pct", pool: str = "scenario") -> DataFrame:
    """Arms of one comparison over all years: the column ``pool`` stands for the universe, and the split is ``all_years``."""
    return outcomes.select(
        F.lit(hypothesis).alias("hypothesis"), F.col(pool).alias("universe"), F.lit("all_years").alias("split"), F.when(left, "left").when(right, "right").alias("arm"),
        "ticker", "sector", "signal_date", F.coalesce("is_closed", F.lit(False)).alias("is_closed"), F.col(value).alias("value"),
    ).where("arm IS NOT NULL")


def arm_sums(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum and count of closed values per arm."""
    ok = F.col("is_closed") & F.col("value").isNotNull()

    def side(arm: str, fn) -> Column:
        return fn(F.when(ok & (F.col("arm") == arm), F.col("value")))

    return rows.groupBy(*by).agg(
        F.coalesce(side("left", F.sum), F.lit(0.0)).alias("ls"), side("left", F.count).alias("lc"),
        F.coalesce(side("right", F.sum), F.lit(0.0)).alias("rs"), side("right", F.count).alias("rc"),
    )


def monthly_sums(arms: DataFrame, pair: Sequence[str] = PAIR) -> DataFrame:
    closed = arms.where("is_closed AND value IS NOT NULL")
    return arm_sums(closed.withColumn("month", F.date_format("signal_date", "yyyy-MM")), [*pair, "month"])


def observed(months: DataFrame, pair: Sequence[str] = PAIR) -> DataFrame:
    """Counts, month clusters and the observed difference of means."""
    t = months.groupBy(*pair).agg(*[F.sum(n).alias(n) for n in ("ls", "lc", "rs", "rc")], F.count("*").alias("signal_month_clusters"))
    return t.select(
        *pair, F.col("lc").alias("left_closed_trades"), F.col("rc").alias("right_closed_trades"), "signal_month_clusters",
        (F.try_divide("ls", "lc") - F.try_divide("rs", "rc")).alias("observed_difference"),
    )


def enough(p: Policy) -> Column:
    return (
        (F.col("left_closed_trades") >= p.min_trades)
        & (F.col("right_closed_trades") >= p.min_trades)
        & (F.col("signal_month_clusters") >= p.min_clusters)
        & F.coalesce(F.col("observed_difference") != 0, F.lit(False))
    )


def replicate(rows: DataFrame, pair: Sequence[str], n: int, chunk: int = 100) -> DataFrame:
    """Replicate numbers per comparison, spread over the cluster in chunks."""
    chunks = rows.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // chunk))))
    spread = chunks.repartition(*pair, "__c")
    first = (F.col("__c") * chunk).cast("long")
    return spread.withColumn("rep", F.explode(F.sequence(first, F.least(first + (chunk - 1), F.lit(n - 1).cast("long")))))


def cluster_bootstrap(months: DataFrame, policy: Policy = Policy(), pair: Sequence[str] = PAIR) -> DataFrame:
    """Month-cluster bootstrap of the difference of means for every comparison.

    A comparison's months (a few hundred at most) travel as one array; each
    replicate resamples it in place, so nothing is joined or shuffled per draw.
    """
    base = observed(months, pair)
    arrays = months.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("month", "ls", "lc", "rs", "rc"))).alias("cells"))
    ready = base.where(enough(policy)).join(arrays, list(pair)).withColumn("seed", label_seed(F.concat_ws(":", *pair)))
    reps = replicate(ready.select(*pair, "cells", "seed", "observed_difference"), pair, policy.replicates)
    m = F.size("cells").cast("long")
    zero = F.struct(F.lit(0.0).alias("ls"), F.lit(0).cast("long").alias("lc"), F.lit(0.0).alias("rs"), F.lit(0).cast("long").alias("rc"))

    def add(acc: Column, i: Column) -> Column:
        cell = F.get("cells", draw(F.col("seed"), F.col("rep"), i, m).cast("int"))
        return F.struct(*[(acc[n] + cell[n]).alias(n) for n in ("ls", "lc", "rs", "rc")])

    total = F.aggregate(F.sequence(F.lit(1).cast("long"), m), zero, add)
    sampled = reps.withColumn("t", total).where("t.lc > 0 AND t.rc > 0").select(
        *pair, "observed_difference", (F.col("t.ls") / F.col("t.lc") - F.col("t.rs") / F.col("t.rc")).alias("x")
    )
    alpha = (1 - policy.confidence) / 2
    same = F.signum("x") == F.signum("observed_difference")
    # At most ``replicates`` values per comparison.
    summary = sampled.groupBy(*pair).agg(
        (F.count("*") / policy.replicates).alias("valid_replicate_fraction"),
        F.avg(same.cast("double")).alias("same_direction_fraction"),
        F.percentile("x", F.lit(alpha)).alias("ci_low"),
        F.percentile("x", F.lit(1 - alpha)).alias("ci_high"),
    )
    out = base.join(summary, list(pair), "left")
    stable = (
        (F.col("valid_replicate_fraction") >= policy.min_valid)
        & (F.col("same_direction_fraction") >= policy.min_same)
        & (((F.col("ci_low") > 0) & (F.col("observed_difference") > 0)) | ((F.col("ci_high") < 0) & (F.col("observed_difference") < 0)))
    )
    return out.withColumn("status", F.when(F.col("valid_replicate_fraction").isNotNull(), "SUFFICIENT").otherwise("INSUFFICIENT_SAMPLE")).withColumn(
        "direction_stable", F.coalesce(stable, F.lit(False))
    )


def paired_months(series: DataFrame, left: str, right: str) -> DataFrame:
    """Months both universes have: (month, difference). ``series`` is (universe, month, value)."""
    l = series.where(F.col("universe") == left).select("month", F.col("value").alias("__l"))
    r = series.where(F.col("universe") == right).select("month", F.col("value").alias("__r"))
    return l.join(r, "month").where("__l IS NOT NULL AND __r IS NOT NULL").select("month", (F.col("__l") - F.col("__r")).alias("difference"))


def paired_bootstrap(pairs: DataFrame, by: Sequence[str], policy: Policy = Policy()) -> DataFrame:
    """Bootstrap of the mean monthly difference per group."""
    base = pairs.groupBy(*by).agg(
        F.count("*").alias("paired_months"), F.avg("difference").alias("observed_difference"),
        F.transform(F.array_sort(F.collect_list(F.struct("month", "difference"))), lambda s: s["difference"]).alias("cells"),
    ).withColumn("seed", label_seed(F.concat_ws(":", F.lit("paired"), *by)))
    reps = replicate(base.where(F.col("paired_months") >= policy.min_clusters), by, policy.replicates)
    m = F.size("cells").cast("long")
    total = F.aggregate(
        F.sequence(F.lit(1).cast("long"), m), F.lit(0.0),
        lambda acc, i: acc + F.get("cells", draw(F.col("seed"), F.col("rep"), i, m).cast("int")),
    )
    sampled = reps.select(*by, "observed_difference", (total / m).alias("x"))
    direction = F.when(F.col("observed_difference") > 0, 1.0).otherwise(-1.0)
    summary = sampled.groupBy(*by).agg(
        F.avg((F.signum("x") == direction).cast("double")).alias("same_direction_fraction"),
        F.percentile("x", F.lit((1 - policy.confidence) / 2)).alias("ci_low"),
        F.percentile("x", F.lit((1 + policy.confidence) / 2)).alias("ci_high"),
    )
    out = base.drop("cells", "seed").join(summary, list(by), "left")
    tested = F.col("paired_months") >= policy.min_clusters
    stable = (F.col("same_direction_fraction") >= policy.min_same) & (
        ((F.col("observed_difference") > 0) & (F.col("ci_low") > 0)) | ((F.col("observed_difference") < 0) & (F.col("ci_high") < 0))
    )
    return out.withColumns(
        {
            "observed_difference": F.when(tested, F.col("observed_difference")),
            "direction_stable": F.coalesce(stable, F.lit(False)),
            "status": F.when(tested, "SUFFICIENT").otherwise("INSUFFICIENT_SAMPLE"),
        }
    )


def expected_sign() -> Column:
    pairs = [x for h, _, s in HYPOTHESES for x in (F.lit(h), F.lit(s))]
    return F.element_at(F.create_map(*pairs), F.col("hypothesis"))


def leave_one_out(arms: DataFrame, column: str, policy: Policy = Policy(), pair: Sequence[str] = PAIR, sign: Column | None = None) -> DataFrame:
    """Difference without each bucket, from bucket sums: (S - s) / (N - n)."""
    sign = expected_sign() if sign is None else sign
    buckets = arm_sums(arms.withColumn("bucket", text(column)), [*pair, "bucket"])
    totals = buckets.groupBy(*pair).agg(*[F.sum(n).alias(n.upper() + "0") for n in ("ls", "lc", "rs", "rc")])
    left_n, right_n = F.col("LC0") - F.col("lc"), F.col("RC0") - F.col("rc")
    effect = F.try_divide(F.col("LS0") - F.col("ls"), left_n) - F.try_divide(F.col("RS0") - F.col("rs"), right_n)
    ok = (left_n >= policy.min_trades) & (right_n >= policy.min_trades)
    tested = buckets.join(totals, list(pair)).withColumn("effect", F.when(ok, effect))
    right_way = F.signum("effect") == F.signum(sign.cast("double"))
    out = tested.groupBy(*pair).agg(
        F.count("*").alias("bucket_count"), F.count("effect").alias("evaluable_leave_one_out_count"),
        F.min("effect").alias("minimum_effect"), F.max("effect").alias("maximum_effect"),
        F.count_if(right_way).alias("__stable"),
    )
    n = F.col("evaluable_leave_one_out_count")
    return out.withColumn("direction_stable_fraction", F.try_divide("__stable", n)).withColumn(
        "direction_stable", (n > 0) & (n == F.col("bucket_count")) & (F.col("__stable") == n)
    ).drop("__stable")


def evaluate_pairs(arms: DataFrame, boot: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Bootstrap, both leave-one-outs and concentration limits to one verdict per comparison."""

    def loo(column: str, prefix: str) -> DataFrame:
        x = leave_one_out(arms, column, policy)
        return x.select(
            *PAIR, (F.col("bucket_count") == F.col("evaluable_leave_one_out_count")).alias(f"{prefix}_loo_evaluable"),
            F.col("direction_stable").alias(f"{prefix}_loo_direction_stable"),
            F.col("minimum_effect").alias(f"{prefix}_loo_minimum_effect"), F.col("maximum_effect").alias(f"{prefix}_loo_maximum_effect"),
        )

    def tops(column: str, prefix: str) -> DataFrame:
        c = concentration(arms.where("is_closed"), [*PAIR, "arm"], column)
        pick = lambda a: F.max(F.when(F.col("arm") == a, F.col("top_bucket_share")))
        return c.groupBy(*PAIR).agg(pick("left").alias(f"left_top_{prefix}_share"), pick("right").alias(f"right_top_{prefix}_share"))

    out = boot
    for side in (loo("ticker", "ticker"), loo("sector", "sector"), tops("ticker", "ticker"), tops("sector", "sector")):
        out = out.join(side, PAIR, "left")
    sign = expected_sign()
    matches = F.coalesce(F.signum("observed_difference") == sign.cast("double"), F.lit(False))
    limits = F.lit(True)
    for name, limit in (("ticker", policy.top_ticker), ("sector", policy.top_sector)):
        for side in ("left", "right"):
            limits = limits & F.coalesce(F.col(f"{side}_top_{name}_share") <= limit, F.lit(False))
    evaluable = (F.col("status") == "SUFFICIENT") & F.coalesce("ticker_loo_evaluable", F.lit(False)) & F.coalesce("sector_loo_evaluable", F.lit(False))
    out = out.withColumns(
        {"observed_direction_matches": matches, "concentration_thresholds_pass": limits, "fully_evaluable": evaluable}
    )
    passes = (
        F.col("fully_evaluable") & F.col("observed_direction_matches") & F.col("direction_stable") & F.col("ticker_loo_direction_stable")
        & F.col("sector_loo_direction_stable") & F.col("concentration_thresholds_pass")
    )
    return out.withColumn("passes_all_robust_conditions", F.coalesce(passes, F.lit(False)))


def drawdown_support(curve: DataFrame, splits: DataFrame, baseline: str, expanded: Sequence[str]) -> DataFrame:
    """Whether an expanded universe's drawdown is worse than the baseline's in a split."""
    dd = drawdown(by_split(curve, splits, ["universe"]), ["universe", "split"]).groupBy("universe", "split").agg(F.min("drawdown").alias("dd"))
    base = dd.where(F.col("universe") == baseline).select("split", F.col("dd").alias("baseline_maximum_drawdown"))
    wide = dd.where(F.col("universe").isin(*expanded)).withColumnRenamed("dd", "expanded_maximum_drawdown").join(F.broadcast(base), "split", "left")
    gap = F.col("expanded_maximum_drawdown") - F.col("baseline_maximum_drawdown")
    return wide.withColumn("expanded_minus_baseline_drawdown", gap).withColumn("expanded_drawdown_worse", F.coalesce(gap < 0, F.lit(False)))


def verdicts(pairs: DataFrame, support: DataFrame, comparisons: int) -> DataFrame:
    """Status per hypothesis, the capped actionable list and the cause letter.

    ``comparisons`` is the number of (universe, split) evaluations each
    hypothesis needs; a missing one counts as not evaluable.
    """
    joined = pairs.join(support.select("universe", "split", "expanded_drawdown_worse"), ["universe", "split"], "left")
    needs = F.col("hypothesis") == "C_HIGH_EXPOSURE"
    ok = F.col("passes_all_robust_conditions") & (~needs | F.coalesce("expanded_drawdown_worse", F.lit(False)))
    per = joined.groupBy("hypothesis").agg(
        F.count("*").alias("n"), F.bool_and("fully_evaluable").alias("e"), F.bool_and(ok).alias("p")
    )
    order = [h for h, _, _ in HYPOTHESES]
    spine = pairs.sparkSession.range(len(order)).select(
        F.element_at(F.array(*[F.lit(h) for h in order]), (F.col("id") + 1).cast("int")).alias("hypothesis"), F.col("id").alias("priority")
    )
    full = F.coalesce((F.col("n") == comparisons) & F.col("e"), F.lit(False))
    named = spine.join(per, "hypothesis", "left").withColumn("fully_evaluable", full).withColumn("passes", F.col("fully_evaluable") & F.coalesce("p", F.lit(False)))
    w = Window.partitionBy().orderBy("priority")  # five rows
    ranked = named.withColumn("rank", F.sum(F.col("passes").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy()
    count = F.sum(F.col("passes").cast("int")).over(whole)
    first = F.min(F.when(F.col("passes"), F.col("hypothesis"))).over(whole)
    return ranked.select(
        "hypothesis", "priority", "fully_evaluable", F.col("passes").alias("passes_all_robust_conditions"),
        F.when(F.col("passes"), "ACTIONABLE_DIAGNOSTIC_HYPOTHESIS").when(F.col("fully_evaluable"), "EVALUATED_NOT_ACTIONABLE").otherwise("INSUFFICIENT_SAMPLE").alias("status"),
        (F.col("passes") & (F.col("rank") <= MAX_ACTIONABLE)).alias("actionable"),
        F.when(count > 0, "ACTIONABLE_DIAGNOSTIC_HYPOTHESIS").when(F.bool_or("fully_evaluable").over(whole), "NO_ACTIONABLE_DIAGNOSTIC_HYPOTHESIS")
        .otherwise("DATA_OR_SAMPLE_INSUFFICIENT").alias("diagnostic_verdict"),
        F.when(count >= 2, "F_MULTIPLE_FACTORS").when(count == 1, F.substring(first, 1, 1)).otherwise("G_CLEAR_CAUSE_NOT_IDENTIFIED").alias("cause"),
    )


def economic_gate(metrics: DataFrame, splits: DataFrame, conc: DataFrame, baseline: str, expanded: Sequence[str]) -> DataFrame:
    """Eleven threshold tests per expanded universe, one row each, with the rollup.

    ``metrics`` has cagr, maximum_drawdown, profit_factor per universe, ``splits``
    expectancy and profit factor per (universe, split), ``conc`` the
    concentration table.
    """
    base = metrics.where(F.col("universe") == baseline).agg(F.max("cagr").alias("base_cagr"))
    s = splits.where("split IN ('validation', 'final_holdout')").groupBy("universe").agg(
        *[F.max(F.when(F.col("split") == n, F.col(m))).alias(f"{n}_{m}") for n in ("validation", "final_holdout") for m in ("expectancy_per_trade", "profit_factor")]
    )
    c = conc.groupBy("universe").agg(*[F.max(F.when(F.col("dimension") == d, F.col("top_bucket_trade_share"))).alias(f"top_{d}") for d in ("ticker", "sector")])
    row = metrics.where(F.col("universe").isin(*expanded)).join(s, "universe", "left").join(c, "universe", "left").withColumn("base_cagr", base.scalar())
    # Criteria and thresholds.
    tests = {
        "cagr_at_least_10pct": F.col("cagr") >= 0.10,
        "maximum_drawdown_at_least_minus_30pct": F.col("maximum_drawdown") >= -0.30,
        "profit_factor_at_least_1_3": F.col("profit_factor") >= 1.30,
        "validation_expectancy_positive": F.col("validation_expectancy_per_trade") > 0,
        "validation_profit_factor_above_1": F.col("validation_profit_factor") > 1.0,
        "holdout_expectancy_positive": F.col("final_holdout_expectancy_per_trade") > 0,
        "holdout_profit_factor_above_1": F.col("final_holdout_profit_factor") > 1.0,
        "cagr_advantage_over_baseline_at_least_5pp": F.col("cagr") - F.col("base_cagr") >= 0.05,
        # Needs a manual threshold, so it never passes by itself.
        "maximum_drawdown_vs_baseline": F.lit(False),
        "top_ticker_trade_share_at_most_15pct": F.col("top_ticker") <= 0.15,
        "top_sector_trade_share_at_most_35pct": F.col("top_sector") <= 0.35,
    }
    cells = F.array(*[F.struct(F.lit(n).alias("criterion"), F.coalesce(t, F.lit(False)).alias("passed")) for n, t in tests.items()])
    long = row.select("universe", F.inline(cells))
    per = Window.partitionBy("universe")
    hits = F.sum(F.col("passed").cast("long")).over(per)
    judged = long.withColumn("criteria_passed", hits).withColumn("criteria_total", F.lit(len(tests)).cast("long")).withColumn(
        "verdict", F.when(F.col("criteria_passed") == len(tests), "EXPLORATORY_PROMISE_PASS").when(F.col("criteria_passed") == 0, "NOT_PASSED").otherwise("MIXED")
    )
    whole = Window.partitionBy()  # a dozen rows per universe
    any_ = lambda v: F.bool_or(F.col("verdict") == v).over(whole)
    return judged.withColumn(
        "overall_verdict", F.when(any_("EXPLORATORY_PROMISE_PASS"), "EXPLORATORY_PROMISE_PASS").when(any_("MIXED"), "MIXED").otherwise("NOT_PASSED")
    )
