"""Trade, curve and report tables.

Tables with fixed buckets are joined onto a spine, so empty buckets appear.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DAYS_PER_YEAR, MIN_CLOSED_TRADES, SCORE_BUCKETS
from tidemark.functions.values import ratio, text
from tidemark.operators.windows import drawdown, longest_run

TRADE_STATS = (
    "trade_count", "closed_trade_count", "open_trade_count", "win_rate", "average_win", "average_loss", "payoff_ratio",
    "expectancy_per_trade", "profit_factor", "max_consecutive_losses", "average_holding_sessions", "median_holding_sessions",
    "sum_net_returns",
)
ZERO_WHEN_EMPTY = ("trade_count", "closed_trade_count", "open_trade_count", "max_consecutive_losses")


def trade_stats(trades: DataFrame, dims: Sequence[str], key: str = "ticker") -> DataFrame:
    """Counts, win rate, payoff, profit factor, loss run and holding per group.

    Only closed trades count; returns of exactly 0 are neither win nor loss.
    The median keeps a count per distinct holding (at most the holding limit).
    """
    closed = F.coalesce("is_closed", F.lit(False))
    r = F.when(closed, F.col("net_return_pct"))
    hold = F.when(closed, F.col("holding_sessions"))
    base = trades.groupBy(*dims).agg(
        F.count("*").alias("trade_count"),
        F.count_if(closed).alias("closed_trade_count"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.avg(F.when(r > 0, r)).alias("average_win"),
        F.avg(F.when(r < 0, r)).alias("average_loss"),
        F.avg(r).alias("expectancy_per_trade"),
        F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("__profit"),
        F.coalesce(-F.sum(F.when(r < 0, r)), F.lit(0.0)).alias("__loss"),
        F.avg(hold).alias("average_holding_sessions"),
        F.percentile(hold, F.lit(0.5)).alias("median_holding_sessions"),
        F.coalesce(F.sum(r), F.lit(0.0)).alias("sum_net_returns"),
    )
    runs = longest_run(
        trades.where(closed & F.col("net_return_pct").isNotNull()), dims, "exit_date", [key, "signal_date"],
        F.col("net_return_pct") < 0, "max_consecutive_losses",
    )
    return (
        base.join(runs, list(dims), "left")
        .withColumn("open_trade_count", F.col("trade_count") - F.col("closed_trade_count"))
        .withColumn("payoff_ratio", ratio("average_win", F.abs("average_loss")))
        .withColumn("profit_factor", ratio("__profit", "__loss"))
        .withColumn("max_consecutive_losses", F.coalesce("max_consecutive_losses", F.lit(0).cast("long")))
        .select(*dims, *TRADE_STATS)
    )


def on_spine(spine: DataFrame, stats: DataFrame, dims: Sequence[str], zeros: Sequence[str] = ZERO_WHEN_EMPTY) -> DataFrame:
    """Left join onto the spine; counts become 0, the sum of returns 0.0."""
    out = spine.join(stats, list(dims), "left")
    fill = {n: F.coalesce(n, F.lit(0).cast("long")) for n in zeros if n in out.columns}
    if "sum_net_returns" in out.columns:
        fill["sum_net_returns"] = F.coalesce("sum_net_returns", F.lit(0.0))
    return out.withColumns(fill)


def sample_status(stats: DataFrame, minimum: int = MIN_CLOSED_TRADES) -> DataFrame:
    enough = F.col("closed_trade_count") >= minimum
    return stats.withColumn("sample_status", F.when(enough, "SUFFICIENT").otherwise("INSUFFICIENT_SAMPLE"))


def curve_stats(curve: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Return, CAGR, drawdown, Calmar, exposure and peak positions per curve."""
    days = F.datediff(F.max("date"), F.min("date"))
    agg = drawdown(curve.where("equity IS NOT NULL"), dims).groupBy(*dims).agg(
        F.count("*").alias("__n"),
        F.min_by("equity", "date").alias("__first"),
        F.max_by("equity", "date").alias("__last"),
        days.alias("__days"),
        F.min("drawdown").alias("maximum_drawdown"),
        F.avg("exposure").alias("market_exposure"),
        F.max("active_positions").cast("long").alias("maximum_concurrent_positions"),
    )
    usable = (F.col("__n") >= 2) & (F.col("__first") > 0) & (F.col("__last") >= 0) & (F.col("__days") > 0)
    growth = F.pow(F.col("__last") / F.col("__first"), F.lit(DAYS_PER_YEAR) / F.col("__days")) - 1
    return (
        agg.withColumn("total_return", F.col("__last") / F.col("__first") - 1)
        .withColumn("cagr", F.when(usable, growth))
        .withColumn("calmar_ratio", ratio("cagr", F.abs("maximum_drawdown")))
        .select(*dims, "total_return", "cagr", "maximum_drawdown", "calmar_ratio", "market_exposure", "maximum_concurrent_positions")
    )


def capital_stats(curve: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Curve statistics of a cash portfolio: exposure is the share of days with a position."""
    held = curve.withColumn("exposure", (F.col("active_positions") > 0).cast("double"))
    cash = curve.groupBy(*dims).agg(F.avg("cash_utilization").alias("mean_cash_utilization"), F.min("cash").alias("minimum_cash"))
    return curve_stats(held, dims).join(cash, list(dims))


def period_array(periods: DataFrame, name: str = "split") -> Column:
    """A few named periods as one scalar array; see ``in_periods``."""
    return periods.agg(F.collect_list(F.struct(F.col(name), "start", "end"))).scalar()


def in_periods(df: DataFrame, periods: DataFrame, on: str, name: str = "split") -> DataFrame:
    """One row per period that contains the day: adds the name, p_start and p_end.

    The handful of periods travels as a scalar subquery, so there is neither a
    range join nor a collect.
    """
    day = F.col(on)
    hits = F.filter("__all", lambda p: (day >= p["start"]) & (day <= p["end"]))
    return df.withColumn("__all", period_array(periods, name)).withColumn("__p", F.explode(hits)).select(
        *df.columns, F.col(f"__p.{name}").alias(name), F.col("__p.start").alias("p_start"), F.col("__p.end").alias("p_end")
    )


def anchored(curve: DataFrame, dims: Sequence[str], labels: Column, out: str) -> DataFrame:
    """Rows of each period plus the last row before it.

    ``labels`` is the array of periods a row's date belongs to. A row also
    belongs to the periods of the next row, which makes it their anchor.
    """
    following = F.coalesce(F.lead("__own").over(Window.partitionBy(*dims).orderBy("date")), F.col("__own"))
    own = curve.withColumn("__own", labels)
    both = own.withColumn("__all", F.array_union("__own", following))
    return both.withColumn(out, F.explode("__all")).withColumn("inside", F.array_contains("__own", F.col(out))).drop("__own", "__all")


def yearly_table(trades: DataFrame, signals: DataFrame, curve: DataFrame, dims: Sequence[str] = ("scenario",)) -> DataFrame:
    """Per calendar year: trades by exit year, signals by signal year, anchored curve.

    Exposure and positions come from the year's own rows only.
    """
    by = [*dims, "year"]
    years = curve.select(*dims, F.year("date").alias("year")).distinct()
    cohort = trades.groupBy(*dims, F.year("signal_date").alias("year")).agg(F.count("*").alias("signal_cohort_trade_count"))
    counts = signals.groupBy(F.year("signal_date").alias("year")).agg(F.count("*").alias("signal_count"))
    stats = trade_stats(trades.withColumn("year", F.year("exit_date")), by)
    framed = anchored(curve, dims, F.array(F.year("date")), "year")
    perf = curve_stats(framed, by).drop("market_exposure", "maximum_concurrent_positions")
    own = framed.where("inside").groupBy(*by).agg(
        F.avg("exposure").alias("market_exposure"), F.max("active_positions").cast("long").alias("maximum_concurrent_positions")
    )
    out = years.join(counts, "year", "left").join(cohort, by, "left")
    out = on_spine(out, stats, by).join(perf, by, "left").join(own, by, "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in ("signal_count", "signal_cohort_trade_count")})


def yearly_capital_table(ledger: DataFrame, signals: DataFrame, curve: DataFrame, dims: Sequence[str] = ("universe",)) -> DataFrame:
    """Second yearly form: entries by entry year, capital statistics on the anchored curve."""
    by = [*dims, "year"]
    years = curve.select(*dims, F.year("date").alias("year")).distinct()
    entries = ledger.groupBy(*dims, F.year("entry_date").alias("year")).agg(F.count("*").alias("accepted_entry_count"))
    counts = signals.groupBy(*dims, F.year("signal_date").alias("year")).agg(F.count("*").alias("raw_signal_count"))
    stats = trade_stats(ledger.withColumn("year", F.year("exit_date")), by)
    perf = capital_stats(anchored(curve, dims, F.array(F.year("date")), "year"), by)
    out = on_spine(years.join(counts, by, "left").join(entries, by, "left"), stats, by).join(perf, by, "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in ("raw_signal_count", "accepted_entry_count")})


def monthly_signal_table(sessions: DataFrame, signals: DataFrame, trades: DataFrame, key: str = "ticker") -> DataFrame:
    """Sessions, signals, trades, distinct tickers and quiet sessions per month."""
    month = "year_month"
    months = sessions.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(
        F.explode(F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("interval 1 month"))).alias("m")
    ).select(F.date_format("m", "yyyy-MM").alias(month))
    label = lambda x: F.date_format(x, "yyyy-MM").alias(month)
    s = sessions.groupBy(label("date")).agg(F.count("*").alias("market_sessions"))
    # (month, ticker) and (month, day) pairs are reduced first: no wide distinct sets.
    pairs = signals.groupBy(label("signal_date"), key).agg(F.count("*").alias("n"))
    g = pairs.groupBy(month).agg(F.sum("n").alias("raw_signal_count"), F.count("*").alias("unique_tickers"))
    d = signals.select(label("signal_date"), "signal_date").distinct().groupBy(month).agg(F.count("*").alias("signal_sessions"))
    t = trades.groupBy(label("signal_date")).agg(F.count("*").alias("eligible_trade_count"))
    out = months
    for side in (s, g, d, t):
        out = out.join(side, month, "left")
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long"))
    return out.select(
        month,
        *[zero(n).alias(n) for n in ("market_sessions", "raw_signal_count", "eligible_trade_count", "unique_tickers")],
        (zero("market_sessions") - zero("signal_sessions")).alias("zero_signal_sessions"),
    )


def score_bucket_table(signals: DataFrame, trades: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Statistics for every score bucket, the unreachable one included."""
    by = [*dims, "score"]
    buckets = F.explode(F.array(*[F.lit(s).cast("long") for s in SCORE_BUCKETS])).alias("score")
    if dims:
        spine = signals.select(*dims).distinct().select(*dims, buckets)
    else:
        spine = signals.sparkSession.range(1).select(buckets)
    counts = signals.groupBy(*by).agg(F.count("*").alias("signal_count"))
    out = on_spine(spine.join(counts, by, "left"), trade_stats(trades, by), by)
    return out.withColumn("signal_count", F.coalesce("signal_count", F.lit(0).cast("long"))).withColumnRenamed("score", "score_bucket")


def ticker_table(metadata: DataFrame, signals: DataFrame, trades: DataFrame) -> DataFrame:
    """Every ticker of the universe with its signals and statistics."""
    counts = signals.groupBy("ticker").agg(F.count("*").alias("signal_count"))
    spine = metadata.select("ticker", "name", "sector").join(counts, "ticker", "left")
    out = on_spine(spine, trade_stats(trades, ["ticker"]), ["ticker"])
    return out.withColumn("signal_count", F.coalesce("signal_count", F.lit(0).cast("long")))


def sector_table(signals: DataFrame, trades: DataFrame) -> DataFrame:
    """Sectors seen on either side with signals and statistics."""
    counts = signals.groupBy("sector").agg(F.count("*").alias("signal_count"))
    stats = trade_stats(trades, ["sector"])
    spine = counts.select("sector").union(stats.select("sector")).distinct().join(counts, "sector", "left")
    out = on_spine(spine, stats, ["sector"])
    return out.withColumn("signal_count", F.coalesce("signal_count", F.lit(0).cast("long")))


def split_table(signals: DataFrame, trades: DataFrame, splits: DataFrame) -> DataFrame:
    """Study form: the cohort by signal date, statistics on trades that exit inside."""
    cohort = in_periods(trades, splits, "signal_date")
    inside = F.col("exit_date") <= F.col("p_end")
    counts = in_periods(signals.select("signal_date"), splits, "signal_date").groupBy("split").agg(F.count("*").alias("signal_count"))
    sizes = cohort.groupBy("split").agg(
        F.count("*").alias("accepted_cohort_trade_count"), F.count_if(~inside).alias("cross_boundary_excluded")
    )
    out = on_spine(splits.join(counts, "split", "left").join(sizes, "split", "left"), trade_stats(cohort.where(inside), ["split"]), ["split"])
    zeros = ("signal_count", "accepted_cohort_trade_count", "cross_boundary_excluded")
    return out.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in zeros})


def contained(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows whose signal, entry and exit all lie inside one period."""
    return in_periods(df, splits, "signal_date").where((F.col("entry_date") >= F.col("p_start")) & (F.col("exit_date") <= F.col("p_end")))


def by_split(curve: DataFrame, splits: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Curve rows per split with their anchors."""
    labels = F.transform(
        F.filter("__splits", lambda p: (F.col("date") >= p["start"]) & (F.col("date") <= p["end"])), lambda p: p["split"]
    )
    return anchored(curve.withColumn("__splits", period_array(splits)), dims, labels, "split").drop("__splits")


def split_capital_table(ledger: DataFrame, curve: DataFrame, splits: DataFrame, dims: Sequence[str] = ("universe",)) -> DataFrame:
    """Second split form: contained trades and capital statistics on the anchored curve."""
    by = [*dims, "split"]
    cohort = in_periods(ledger, splits, "signal_date")
    kept = cohort.where((F.col("entry_date") >= F.col("p_start")) & (F.col("exit_date") <= F.col("p_end")))
    sizes = cohort.groupBy(*by).agg(F.count("*").alias("signal_cohort_count"))
    perf = capital_stats(by_split(curve, splits, dims), by)
    spine = perf.select(*by).join(splits.select("split", "start", "end"), "split").join(sizes, by, "left")
    out = on_spine(spine, trade_stats(kept, by), by).join(perf, by, "left")
    cohort_n = F.coalesce("signal_cohort_count", F.lit(0).cast("long"))
    return out.withColumn("signal_cohort_count", cohort_n).withColumn(
        "cross_boundary_excluded_count", F.col("signal_cohort_count") - F.col("trade_count")
    )


def scenario_table(trades: DataFrame, curve: DataFrame, dims: Sequence[str] = ("scenario",)) -> DataFrame:
    """Trade and curve statistics per scenario, with same-bar double hits."""
    both = trades.groupBy(*dims).agg(
        F.count_if(F.col("exit_reason").startswith("stop_and_take_same_day")).alias("same_bar_both_trade_count")
    )
    return trade_stats(trades, dims).join(curve_stats(curve, dims), list(dims)).join(both, list(dims))


def path_deltas(table: DataFrame, base: str, other: str) -> DataFrame:
    """Other minus base for return, expectancy and trade count."""
    pick = lambda s, n: F.max(F.when(F.col("scenario") == s, F.col(n)))
    return table.agg(
        *[
            (pick(other, n) - pick(base, n)).alias(alias)
            for n, alias in (("total_return", "total_return_delta"), ("expectancy_per_trade", "expectancy_delta"), ("trade_count", "trade_count_delta"))
        ]
    )


def shares(df: DataFrame, dims: Sequence[str], bucket: str, weight: Column | None = None) -> DataFrame:
    """Weight per (group, bucket): the small table all concentration figures use."""
    value = F.count("*").cast("double") if weight is None else F.sum(weight)
    return df.groupBy(*dims, text(bucket).alias("bucket")).agg(value.alias("w"))


def concentration(df: DataFrame, dims: Sequence[str], bucket: str, prefix: str = "", weight: Column | None = None, top: str = "top_bucket_share", hhi: str = "hhi", distinct: str = "distinct_bucket_count") -> DataFrame:
    """Distinct buckets, top share and sum of squared shares per group.

    sum((w/T)^2) = sum(w^2)/T^2, so one pass over the bucket table is enough.
    """
    table = shares(df, dims, bucket, weight)
    total = F.sum("w")
    return table.groupBy(*dims).agg(
        F.count("*").alias(prefix + distinct),
        F.when(total > 0, F.max("w") / total).alias(prefix + top),
        F.when(total > 0, F.sum(F.col("w") * F.col("w")) / (total * total)).alias(prefix + hhi),
    )


def loss_concentration(df: DataFrame, dims: Sequence[str], bucket: str, prefix: str = "") -> DataFrame:
    """Concentration of summed losses of closed losing trades."""
    losing = df.where(F.coalesce("is_closed", F.lit(False)) & (F.col("net_return_pct") < 0))
    return concentration(losing, dims, bucket, prefix, -F.col("net_return_pct"), "top_loss_share", "loss_hhi", "distinct_loss_bucket_count")


def concentration_table(ledger: DataFrame, dims: Sequence[str] = ("universe",), key: str = "ticker") -> DataFrame:
    """Trade-count concentration by ticker and by sector, one row per dimension."""
    n = ledger.groupBy(*dims).agg(F.count("*").alias("accepted_entry_count"))
    sides = [
        concentration(ledger, dims, column, top="top_bucket_trade_share", hhi="trade_share_hhi").withColumn("dimension", F.lit(label))
        for label, column in (("ticker", key), ("sector", "sector"))
    ]
    return reduce(DataFrame.unionByName, sides).join(n, list(dims))


def signal_frequency(signals: DataFrame, ledger: DataFrame, sessions: DataFrame, gap: DataFrame, dims: Sequence[str] = ("universe",)) -> DataFrame:
    """Signals and entries per year, with the longest quiet period."""
    from tidemark.operators.calendar import first_day, last_day

    years = F.greatest(F.datediff(last_day(sessions), first_day(sessions)) / DAYS_PER_YEAR, F.lit(1e-12))
    raw = signals.groupBy(*dims).agg(F.count("*").alias("raw_signal_count"))
    taken = ledger.groupBy(*dims).agg(F.count("*").alias("accepted_entry_count"))
    out = raw.join(taken, list(dims), "left").join(gap.drop("gap_start", "gap_end"), list(dims), "left")
    out = out.withColumn("accepted_entry_count", F.coalesce("accepted_entry_count", F.lit(0).cast("long")))
    return out.withColumn("raw_signal_frequency_per_year", F.col("raw_signal_count") / years).withColumn(
        "accepted_entry_frequency_per_year", F.col("accepted_entry_count") / years
    )
