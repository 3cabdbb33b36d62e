"""Queries for bootstraps, leave-one-out, hypotheses and the economic gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.diagnostics import capital_sql, diag
from tidemark.catalog.registry import query, shared
from tidemark.catalog.sql import conc_sql, cte, sql, tstats
from tidemark.operators import inference as inf
from tidemark.operators import metrics as M
from tidemark.plans.study import Study
from tidemark.session import stage

# Validation and holdout of the supplied tables hold a few months; their comparisons use scaled sample limits, those over all years the frozen ones.
POLICY = inf.Policy(min_trades=3, min_clusters=3)
CLUSTERS = inf.Policy().min_clusters
EXPANDED = ("liquid50", "liquid100")
PAIR = "hypothesis, universe, split"

cte(
    "arms",
    """SELECT * FROM (
      SELECT 'A_ADDED_SIGNAL_QUALITY' AS hypothesis, universe, split, CASE origin_group WHEN 'ADDED_CODE' THEN 'left' ELSE 'right' END AS arm, ticker, sector, signal_date, is_closed, net_return_pct AS value FROM hshadow
      UNION ALL SELECT 'D_EXIT_ATTRIBUTION', universe, split, CASE origin_group WHEN 'ADDED_CODE' THEN 'left' ELSE 'right' END, ticker, sector, signal_date, is_closed, negative_exit_burden FROM hshadow
      UNION ALL SELECT 'B_CAPACITY_PRIORITY', universe, split, CASE WHEN disposition = 'capacity_rejected' THEN 'left' WHEN disposition = 'accepted' AND capacity_binding_session THEN 'right' END,
        ticker, sector, signal_date, is_closed, net_return_pct FROM qcont
      UNION ALL SELECT 'C_HIGH_EXPOSURE', a.universe, split, CASE WHEN cash_utilization >= 0.8 THEN 'left' WHEN cash_utilization < 0.8 THEN 'right' END, ticker, sector, signal_date, is_closed, net_return_pct
        FROM ucont a LEFT JOIN ucurve c ON c.universe = a.universe AND c.date = a.signal_date
      UNION ALL SELECT 'E_SCORE_MONOTONICITY', universe, split, CASE WHEN score = 120 THEN 'left' WHEN score IN (90, 100) THEN 'right' END, ticker, sector, signal_date, is_closed, net_return_pct FROM ucont)
    WHERE arm IS NOT NULL AND universe <> 'static' AND split IN ('validation', 'final_holdout')""",
    "hshadow", "qcont", "ucont", "ucurve",
)
cte("hshadow", """SELECT a.*, p.split FROM ushadow a JOIN osplits p ON signal_date BETWEEN p."start" AND p."end" AND entry_date >= p."start" AND exit_date <= p."end" """, "ushadow", "osplits")


def months_sql(arms: str) -> str:
    return f"""SELECT {PAIR}, strftime(signal_date, '%Y-%m') AS month, coalesce(sum(value) FILTER (arm = 'left'), 0) AS ls, count(value) FILTER (arm = 'left') AS lc,
      coalesce(sum(value) FILTER (arm = 'right'), 0) AS rs, count(value) FILTER (arm = 'right') AS rc FROM {arms} WHERE is_closed AND value IS NOT NULL GROUP BY ALL"""


def obs_sql(months: str) -> str:
    return f"""SELECT *, left_sum / nullif(left_closed_trades, 0) - right_sum / nullif(right_closed_trades, 0) AS observed_difference FROM (
      SELECT {PAIR}, sum(ls) AS left_sum, sum(rs) AS right_sum, CAST(sum(lc) AS BIGINT) AS left_closed_trades, CAST(sum(rc) AS BIGINT) AS right_closed_trades,
        count(*) AS signal_month_clusters FROM {months} GROUP BY ALL)"""


cte("hmonths", months_sql("arms"), "arms")
cte("hobs", obs_sql("hmonths"), "hmonths")


def draw_sql(seed: str, m: str) -> str:
    """The portable draw over replicate ``rep`` and position ``i``."""
    s = f"(({seed} + rep * 1000003 + i * 7919) % 2147483647)"
    a = f"(({s} * 48271) % 2147483647)"
    b = f"(({a} * {a} % 2147483647 + {a} * 16807 + 12345) % 2147483647)"
    return f"(({b} * 69621) % 2147483647) % {m}"


def seed_sql(label: str) -> str:
    return f"(20260727 + CAST('0x' || substr(md5({label}), 1, 7) AS BIGINT)) % 2147483647"


def boot_sql(obs: str, months: str, trades: int, clusters: int) -> str:
    return f"""SELECT o.{PAIR.replace(", ", ", o.")}, left_closed_trades, right_closed_trades, signal_month_clusters, observed_difference, valid_replicate_fraction,
      same_direction_fraction, ci_low, ci_high, CASE WHEN valid_replicate_fraction IS NOT NULL THEN 'SUFFICIENT' ELSE 'INSUFFICIENT_SAMPLE' END AS status,
      coalesce(valid_replicate_fraction >= 0.99 AND same_direction_fraction >= 0.95
        AND ((ci_low > 0 AND observed_difference > 0) OR (ci_high < 0 AND observed_difference < 0)), false) AS direction_stable
    FROM {obs} o LEFT JOIN (
      SELECT {PAIR}, count(*) / 10000.0 AS valid_replicate_fraction, avg((sign(x) = sign(od))::INT) AS same_direction_fraction,
        quantile_cont(x, 0.025) AS ci_low, quantile_cont(x, 0.975) AS ci_high
      FROM (SELECT {PAIR}, rep, any_value(od) AS od, sum(ls) / sum(lc) - sum(rs) / sum(rc) AS x FROM (
          SELECT d.hypothesis, d.universe, d.split, d.rep, d.od, c.ls, c.lc, c.rs, c.rc FROM (
            SELECT *, {draw_sql("seed", "m")} AS j FROM (
              SELECT {PAIR}, observed_difference AS od, signal_month_clusters AS m, unnest(range(1, signal_month_clusters + 1)) AS i,
                {seed_sql("hypothesis || ':' || universe || ':' || split")} AS seed FROM {obs}
              WHERE left_closed_trades >= {trades} AND right_closed_trades >= {trades} AND signal_month_clusters >= {clusters} AND observed_difference <> 0),
              (SELECT unnest(range(0, 10000)) AS rep)) d
          JOIN (SELECT *, row_number() OVER (PARTITION BY {PAIR} ORDER BY month) - 1 AS j FROM {months}) c USING ({PAIR}, j))
        GROUP BY ALL HAVING sum(lc) > 0 AND sum(rc) > 0) GROUP BY ALL) b USING ({PAIR})"""


cte("hboot", boot_sql("hobs", "hmonths", 3, 3), "hobs", "hmonths")


def loo_sql(column: str, sign: str, arms: str = "arms", trades: int = 3) -> str:
    return f"""SELECT {PAIR}, count(*) AS bucket_count, count(effect) AS evaluable_leave_one_out_count, min(effect) AS minimum_effect, max(effect) AS maximum_effect,
      count(*) FILTER (sign(effect) = {sign}) / nullif(count(effect), 0) AS direction_stable_fraction,
      count(effect) > 0 AND count(effect) = count(*) AND count(*) FILTER (sign(effect) = {sign}) = count(effect) AS direction_stable
    FROM (SELECT {PAIR}, {column}, CASE WHEN count(lv) >= {trades} AND count(rv) >= {trades} THEN avg(lv) - avg(rv) END AS effect FROM (
        SELECT b.*, CASE WHEN a.arm = 'left' THEN a.value END AS lv, CASE WHEN a.arm = 'right' THEN a.value END AS rv
        FROM (SELECT DISTINCT {PAIR}, {column} FROM {arms}) b LEFT JOIN (SELECT * FROM {arms} WHERE is_closed AND value IS NOT NULL) a
          ON a.hypothesis = b.hypothesis AND a.universe = b.universe AND a.split = b.split AND a.{column} <> b.{column}) GROUP BY {PAIR}, {column})
    GROUP BY {PAIR}"""


SIGN = "CASE WHEN hypothesis IN ('B_CAPACITY_PRIORITY', 'D_EXIT_ATTRIBUTION') THEN 1 ELSE -1 END"


def arms_of(d):
    return inf.hypothesis_arms(d.shadow, d.quality, d.accepted, d.curve, d.splits, EXPANDED)


@query(sql(f"SELECT {PAIR}, arm, ticker, sector, signal_date, is_closed, value FROM arms", "arms"), dbl="value")
def hypothesis_arms(spark, sf):
    return arms_of(diag(spark, sf))


@query(
    sql("SELECT a.universe, a.ticker, a.signal_date, c.cash_utilization AS signal_cash_utilization FROM ledger a LEFT JOIN ucurve c ON c.universe = a.universe AND c.date = a.signal_date", "ledger", "ucurve"),
    dbl="signal_cash_utilization",
)
def signal_cash_utilization(spark, sf):
    d = diag(spark, sf)
    return inf.with_utilization(d.ledger, d.curve).select("universe", "ticker", "signal_date", "signal_cash_utilization")


BOOT_DBL = "observed_difference valid_replicate_fraction same_direction_fraction ci_low ci_high"


@query(sql("SELECT * FROM hboot", "hboot"), dbl=BOOT_DBL)
def cluster_bootstrap(spark, sf):
    """Month-cluster bootstrap of all comparisons; draws are portable integer arithmetic."""
    return inf.cluster_bootstrap(inf.monthly_sums(arms_of(diag(spark, sf))), POLICY)


@query(
    sql(
        f"""WITH s AS (SELECT universe, strftime(date, '%Y-%m') AS month, sum(pnl_jpy) AS v FROM days GROUP BY ALL),
        p AS (SELECT l.universe, l.month, l.v - r.v AS diff FROM s l JOIN s r USING (month) WHERE r.universe = 'static' AND l.universe <> 'static'),
        o AS (SELECT universe, count(*) AS m, avg(diff) AS od, {seed_sql("'paired:' || universe")} AS seed FROM p GROUP BY universe),
        c AS (SELECT *, row_number() OVER (PARTITION BY universe ORDER BY month) - 1 AS j FROM p),
        x AS (SELECT universe, rep, any_value(od) AS od, avg(diff) AS x FROM (
          SELECT q.universe, q.rep, q.od, c.diff FROM (SELECT *, {draw_sql("seed", "m")} AS j FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM o WHERE m >= {CLUSTERS}),
            (SELECT unnest(range(0, 10000)) AS rep)) q JOIN c USING (universe, j)) GROUP BY ALL),
        b AS (SELECT universe, avg((sign(x) = CASE WHEN od > 0 THEN 1 ELSE -1 END)::INT) AS same_direction_fraction, quantile_cont(x, 0.025) AS ci_low,
          quantile_cont(x, 0.975) AS ci_high FROM x GROUP BY universe)
        SELECT universe, m AS paired_months, CASE WHEN m >= {CLUSTERS} THEN od END AS observed_difference, same_direction_fraction, ci_low, ci_high,
          coalesce(same_direction_fraction >= 0.95 AND ((od > 0 AND ci_low > 0) OR (od < 0 AND ci_high < 0)), false) AS direction_stable,
          CASE WHEN m >= {CLUSTERS} THEN 'SUFFICIENT' ELSE 'INSUFFICIENT_SAMPLE' END AS status FROM o LEFT JOIN b USING (universe)""",
        "days",
    ),
    dbl="observed_difference same_direction_fraction ci_low ci_high", digits=6,
)
def paired_month_bootstrap(spark, sf):
    """Mean monthly PnL difference of each expanded universe to the static one."""
    d = diag(spark, sf)
    months = d.days.groupBy("universe", F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum("pnl_jpy").alias("value"))
    pairs = None
    for u in EXPANDED:
        one = inf.paired_months(months, u, "static").withColumn("universe", F.lit(u))
        pairs = one if pairs is None else pairs.unionByName(one)
    return inf.paired_bootstrap(pairs, ["universe"])


LOO_DBL = "minimum_effect maximum_effect direction_stable_fraction"


@query(sql(loo_sql("ticker", SIGN), "arms"), dbl=LOO_DBL)
def leave_one_ticker_out(spark, sf):
    return inf.leave_one_out(arms_of(diag(spark, sf)), "ticker", POLICY)


@query(sql(loo_sql("sector", SIGN), "arms"), dbl=LOO_DBL)
def leave_one_sector_out(spark, sf):
    return inf.leave_one_out(arms_of(diag(spark, sf)), "sector", POLICY)


def tops_sql(column: str, arms: str = "arms") -> str:
    return f"""SELECT {PAIR}, max(s) FILTER (arm = 'left') AS left_top_{column}_share, max(s) FILTER (arm = 'right') AS right_top_{column}_share FROM (
      {conc_sql(f"(SELECT * FROM {arms} WHERE is_closed)", PAIR + ", arm", column, "", "s", "h", "d")}) GROUP BY {PAIR}"""


def pairs_sql(boot: str, arms: str, trades: int) -> str:
    return f"""SELECT *, coalesce(sign(observed_difference) = {SIGN}, false) AS observed_direction_matches,
      coalesce(left_top_ticker_share <= 0.25 AND right_top_ticker_share <= 0.25 AND left_top_sector_share <= 0.5 AND right_top_sector_share <= 0.5, false) AS concentration_thresholds_pass,
      status = 'SUFFICIENT' AND coalesce(ticker_loo_evaluable, false) AND coalesce(sector_loo_evaluable, false) AS fully_evaluable,
      coalesce(status = 'SUFFICIENT' AND ticker_loo_evaluable AND sector_loo_evaluable AND sign(observed_difference) = {SIGN} AND direction_stable AND ticker_loo_direction_stable
        AND sector_loo_direction_stable AND left_top_ticker_share <= 0.25 AND right_top_ticker_share <= 0.25 AND left_top_sector_share <= 0.5 AND right_top_sector_share <= 0.5, false) AS passes_all_robust_conditions
    FROM {boot}
    LEFT JOIN (SELECT {PAIR}, bucket_count = evaluable_leave_one_out_count AS ticker_loo_evaluable, direction_stable AS ticker_loo_direction_stable,
      minimum_effect AS ticker_loo_minimum_effect, maximum_effect AS ticker_loo_maximum_effect FROM ({loo_sql("ticker", SIGN, arms, trades)})) USING ({PAIR})
    LEFT JOIN (SELECT {PAIR}, bucket_count = evaluable_leave_one_out_count AS sector_loo_evaluable, direction_stable AS sector_loo_direction_stable,
      minimum_effect AS sector_loo_minimum_effect, maximum_effect AS sector_loo_maximum_effect FROM ({loo_sql("sector", SIGN, arms, trades)})) USING ({PAIR})
    LEFT JOIN ({tops_sql("ticker", arms)}) USING ({PAIR}) LEFT JOIN ({tops_sql("sector", arms)}) USING ({PAIR})"""


cte("hpairs", pairs_sql("hboot", "arms", 3), "hboot", "arms")


PAIRS_DBL = (
    BOOT_DBL + " " + " ".join(f"{b}_loo_{m}_effect" for b in ("ticker", "sector") for m in ("minimum", "maximum"))
    + " left_top_ticker_share right_top_ticker_share left_top_sector_share right_top_sector_share"
)


def pairs_of(d):
    arms = arms_of(d)
    return inf.evaluate_pairs(arms, inf.cluster_bootstrap(inf.monthly_sums(arms), POLICY), POLICY)


@query(
    sql("SELECT * FROM hpairs", "hpairs"),
    dbl=PAIRS_DBL,
)
def pair_evaluation(spark, sf):
    return pairs_of(diag(spark, sf))


# Comparisons over all years and tickers meet the frozen minimums; each cost and path scenario is one.
cte(
    "parms",
    """SELECT 'E_SCORE_MONOTONICITY' AS hypothesis, scenario AS universe, 'all_years' AS split, CASE WHEN score > 90 THEN 'left' ELSE 'right' END AS arm,
      ticker, sector, signal_date, is_closed, net_return_pct AS value FROM fills WHERE score >= 90""",
    "fills",
)
cte("pmonths", months_sql("parms"), "parms")
cte("pobs", obs_sql("pmonths"), "pmonths")
cte("pboot", boot_sql("pobs", "pmonths", inf.Policy().min_trades, inf.Policy().min_clusters), "pobs", "pmonths")


def pooled_of(spark, sf):
    return inf.pooled_arms(shared(Study, spark, sf).exits(), "E_SCORE_MONOTONICITY", F.col("score") > 90, F.col("score") == 90)


@query(sql("SELECT * FROM pboot", "pboot"), dbl=BOOT_DBL)
def pooled_cluster_bootstrap(spark, sf):
    """High against low scores over all years under the frozen minimums."""
    return inf.cluster_bootstrap(inf.monthly_sums(pooled_of(spark, sf)))


@query(sql(pairs_sql("pboot", "parms", inf.Policy().min_trades), "pboot", "parms"), dbl=PAIRS_DBL)
def pooled_pair_evaluation(spark, sf):
    """Bootstrap, leave-one-outs and concentration of the pooled comparisons under the frozen minimums."""
    arms = stage(pooled_of(spark, sf), "pooled-arms")
    return inf.evaluate_pairs(arms, inf.cluster_bootstrap(inf.monthly_sums(arms)))


SUPPORT = """SELECT e.universe, e.split, e.dd AS expanded_maximum_drawdown, b.dd AS baseline_maximum_drawdown, e.dd - b.dd AS expanded_minus_baseline_drawdown,
  coalesce(e.dd < b.dd, false) AS expanded_drawdown_worse FROM wdd e JOIN wdd b ON b.split = e.split AND b.universe = 'static' WHERE e.universe <> 'static'"""
cte("wdd", "SELECT universe, split, min(equity / peak - 1) AS dd FROM (SELECT *, max(equity) OVER (PARTITION BY universe, split ORDER BY date) AS peak FROM uanch) GROUP BY ALL", "uanch")


@query(sql(SUPPORT, "wdd"), dbl="expanded_maximum_drawdown baseline_maximum_drawdown expanded_minus_baseline_drawdown")
def drawdown_support(spark, sf):
    d = diag(spark, sf)
    return inf.drawdown_support(d.curve, d.splits, "static", EXPANDED)


@query(
    sql(
        f"""WITH j AS (SELECT p.*, passes_all_robust_conditions AND (hypothesis <> 'C_HIGH_EXPOSURE' OR coalesce(s.expanded_drawdown_worse, false)) AS ok
          FROM hpairs p LEFT JOIN ({SUPPORT}) s USING (universe, split)),
        h AS (SELECT unnest(['A_ADDED_SIGNAL_QUALITY', 'B_CAPACITY_PRIORITY', 'C_HIGH_EXPOSURE', 'D_EXIT_ATTRIBUTION', 'E_SCORE_MONOTONICITY']) AS hypothesis, CAST(unnest(range(0, 5)) AS BIGINT) AS priority),
        v AS (SELECT h.*, coalesce(n = 4 AND e, false) AS fully_evaluable, coalesce(n = 4 AND e AND p, false) AS passes FROM h LEFT JOIN (
          SELECT hypothesis, count(*) n, bool_and(fully_evaluable) e, bool_and(ok) p FROM j GROUP BY 1) USING (hypothesis))
        SELECT hypothesis, priority, fully_evaluable, passes AS passes_all_robust_conditions,
          CASE WHEN passes THEN 'ACTIONABLE_DIAGNOSTIC_HYPOTHESIS' WHEN fully_evaluable THEN 'EVALUATED_NOT_ACTIONABLE' ELSE 'INSUFFICIENT_SAMPLE' END AS status,
          passes AND sum(passes::INT) OVER (ORDER BY priority) <= 2 AS actionable,
          CASE WHEN bool_or(passes) OVER () THEN 'ACTIONABLE_DIAGNOSTIC_HYPOTHESIS' WHEN bool_or(fully_evaluable) OVER () THEN 'NO_ACTIONABLE_DIAGNOSTIC_HYPOTHESIS' ELSE 'DATA_OR_SAMPLE_INSUFFICIENT' END AS diagnostic_verdict,
          CASE WHEN sum(passes::INT) OVER () >= 2 THEN 'F_MULTIPLE_FACTORS' WHEN sum(passes::INT) OVER () = 1 THEN substr(min(CASE WHEN passes THEN hypothesis END) OVER (), 1, 1) ELSE 'G_CLEAR_CAUSE_NOT_IDENTIFIED' END AS cause
        FROM v""",
        "hpairs", "wdd",
    )
)
def hypothesis_verdicts(spark, sf):
    d = diag(spark, sf)
    return inf.verdicts(pairs_of(d), inf.drawdown_support(d.curve, d.splits, "static", EXPANDED), 4)


@query(
    sql(
        f"""WITH m AS (SELECT c.universe, c.cagr, c.maximum_drawdown, t.profit_factor FROM ({capital_sql("ucurve", "universe")}) c JOIN ({tstats("ledger", "universe")}) t USING (universe)),
        s AS ({tstats('(SELECT l.*, p.split FROM ledger l JOIN osplits p ON signal_date BETWEEN "start" AND "end" AND entry_date >= "start" AND exit_date <= "end")', "universe, split")}),
        k AS (SELECT m.*, (SELECT cagr FROM m b WHERE b.universe = 'static') AS base, v.expectancy_per_trade AS ve, v.profit_factor AS vp, h.expectancy_per_trade AS he, h.profit_factor AS hp,
          a.top AS tt, z.top AS ts FROM m LEFT JOIN s v ON v.universe = m.universe AND v.split = 'validation' LEFT JOIN s h ON h.universe = m.universe AND h.split = 'final_holdout'
          LEFT JOIN ({conc_sql("ledger", "universe", "ticker", "", "top", "h", "d")}) a ON a.universe = m.universe LEFT JOIN ({conc_sql("ledger", "universe", "sector", "", "top", "h", "d")}) z ON z.universe = m.universe
          WHERE m.universe <> 'static'),
        l AS (SELECT universe, unnest(['cagr_at_least_10pct', 'maximum_drawdown_at_least_minus_30pct', 'profit_factor_at_least_1_3', 'validation_expectancy_positive', 'validation_profit_factor_above_1',
            'holdout_expectancy_positive', 'holdout_profit_factor_above_1', 'cagr_advantage_over_baseline_at_least_5pp', 'maximum_drawdown_vs_baseline', 'top_ticker_trade_share_at_most_15pct',
            'top_sector_trade_share_at_most_35pct']) AS criterion,
          coalesce(unnest([cagr >= 0.1, maximum_drawdown >= -0.3, profit_factor >= 1.3, ve > 0, vp > 1, he > 0, hp > 1, cagr - base >= 0.05, false, tt <= 0.15, ts <= 0.35]), false) AS passed FROM k),
        q AS (SELECT *, CAST(sum(passed::INT) OVER (PARTITION BY universe) AS BIGINT) AS criteria_passed, CAST(11 AS BIGINT) AS criteria_total FROM l),
        r AS (SELECT *, CASE WHEN criteria_passed = 11 THEN 'EXPLORATORY_PROMISE_PASS' WHEN criteria_passed = 0 THEN 'NOT_PASSED' ELSE 'MIXED' END AS verdict FROM q)
        SELECT *, CASE WHEN bool_or(verdict = 'EXPLORATORY_PROMISE_PASS') OVER () THEN 'EXPLORATORY_PROMISE_PASS' WHEN bool_or(verdict = 'MIXED') OVER () THEN 'MIXED' ELSE 'NOT_PASSED' END AS overall_verdict FROM r""",
        "ucurve", "ledger", "osplits",
    )
)
def economic_gate(spark, sf):
    d = diag(spark, sf)
    stats = M.trade_stats(d.ledger, ["universe"]).select("universe", "profit_factor")
    metrics = M.capital_stats(d.curve, ["universe"]).join(stats, "universe")
    splits = M.split_capital_table(d.ledger, d.curve, d.splits)
    return inf.economic_gate(metrics, splits, M.concentration_table(d.ledger), "static", EXPANDED)


@query(
    sql(
        f"""SELECT universe, trade_count, closed_trade_count, CASE WHEN closed_trade_count >= 30 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT_SAMPLE' END AS sample_status
        FROM ({tstats("ledger", "universe")})""",
        "ledger",
    )
)
def sample_sufficiency(spark, sf):
    return M.sample_status(M.trade_stats(diag(spark, sf).ledger, ["universe"])).select("universe", "trade_count", "closed_trade_count", "sample_status")
