"""Queries over point-in-time universes, the slot ledger and its diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query, shared
from tidemark.catalog.sql import CSTATS_DBL, EXIT_GROUP, TSTATS_DBL, conc_sql, cstats, sql, top_sql, tstats
from tidemark.config import EXIT_GROUPS, PRIMARY
from tidemark.operators import calendar as cal
from tidemark.operators import diagnostics as dia
from tidemark.operators import ledger as led
from tidemark.operators import metrics as M
from tidemark.operators import outcomes as O
from tidemark.operators import universe as uni
from tidemark.plans.diagnostics import RULES, Diagnostics
from tidemark.plans.study import Study

ZERO = ", ".join(f"coalesce({n}, 0) AS {n}" if n in M.ZERO_WHEN_EMPTY or n == "sum_net_returns" else n for n in M.TRADE_STATS)


def diag(spark, sf) -> Diagnostics:
    d = shared(Diagnostics, spark, sf)
    d.study = shared(Study, spark, sf)
    return d


@query(sql("SELECT year, sel AS idx, selection_date, cutoff_date, short_start, long_start FROM sched", "sched"))
def annual_schedule(spark, sf):
    return diag(spark, sf).schedule


@query(
    sql(
        "SELECT universe, year, ticker, sector, completeness, raw_close, liquidity FROM cands",
        "cands",
    ),
    dbl="completeness raw_close liquidity", digits=5,
)
def universe_candidates(spark, sf):
    """Codes that pass every eligibility test, all years and rules at once."""
    return diag(spark, sf).candidates.select("universe", "year", "ticker", "sector", "completeness", "raw_close", "liquidity")


@query(
    sql(
        """SELECT year, ticker, liquidity, raw_close, row_number() OVER (PARTITION BY year ORDER BY liquidity DESC, ticker) AS rank FROM (
        SELECT s.year, b.ticker, quantile_cont(va, 0.5) AS liquidity, max(b."close") FILTER (b.date = s.cutoff_date) AS raw_close
        FROM sched s JOIN idx_sess d ON d.i BETWEEN s.sel - 60 AND s.sel - 1 JOIN idx b ON b.date = d.date GROUP BY ALL)
        WHERE liquidity >= 30000 AND raw_close >= 300""",
        "sched",
    ),
    dbl="liquidity raw_close", digits=5,
)
def preliminary_liquidity_rank(spark, sf):
    d = diag(spark, sf)
    return uni.preliminary_rank(d.study.frame, d.schedule, d.all_sessions, 30_000.0)


@query(sql("SELECT universe, year, ticker, sector, liquidity, rank FROM members", "members"), dbl="liquidity", digits=5)
def sector_capped_universe(spark, sf):
    return diag(spark, sf).members.withColumn("rank", F.col("rank").cast("long"))


@query(
    sql(
        """SELECT r.universe, s.year, s.selection_date, s.cutoff_date, CAST(r.target AS BIGINT) AS target_count, coalesce(e.n, 0) AS eligible_count,
          coalesce(m.n, 0) AS selected_count, coalesce(h, sha256('[]')) AS composition_sha256, coalesce(k.sector_count, 0) AS sector_count,
          k.top_sector_member_share, k.sector_member_hhi, CAST(greatest(r.target - coalesce(m.n, 0), 0) AS BIGINT) AS shortfall_count
        FROM rules r CROSS JOIN sched s
        LEFT JOIN (SELECT universe, year, count(*) n FROM cands GROUP BY ALL) e ON e.universe = r.universe AND e.year = s.year
        LEFT JOIN (SELECT universe, year, count(*) n, sha256('["' || string_agg(ticker, '","' ORDER BY ticker) || '"]') h FROM members GROUP BY ALL) m
          ON m.universe = r.universe AND m.year = s.year
        LEFT JOIN (""" + conc_sql("members", "universe, year", "sector", "", "top_sector_member_share", "sector_member_hhi", "sector_count") + """) k
          ON k.universe = r.universe AND k.year = s.year""",
        "members",
    ),
    dbl="top_sector_member_share sector_member_hhi",
)
def selection_summary(spark, sf):
    d = diag(spark, sf)
    return uni.selection_summary(d.candidates, d.members, d.schedule, RULES)


@query(
    sql("SELECT universe, ticker, signal_date, score, bitmask, origin_group, sector FROM usignals", "usignals"),
)
def member_signals(spark, sf):
    """Signals of each universe on days the code is a member."""
    return diag(spark, sf).signals.select("universe", "ticker", "signal_date", "score", "bitmask", "origin_group", "sector")


@query(
    sql(
        """SELECT g.ticker, g.signal_date, coalesce(m.sector, '') AS sector FROM wsignals g JOIN yos y ON y.date = g.signal_date
        LEFT JOIN (SELECT year, ticker, min(sector) AS sector FROM cands GROUP BY ALL) m
          ON m.ticker = g.ticker AND m.year = coalesce(y.year, (SELECT min(year) FROM sched))""",
        "wsignals", "yos", "cands",
    )
)
def sector_asof(spark, sf):
    """Sector from the annual list in force at the signal; blank when not listed."""
    d = diag(spark, sf)
    master = d.candidates.groupBy("year", "ticker").agg(F.min("sector").alias("sector"))
    rows = d.study.signals.select("ticker", "signal_date")
    first = d.schedule.agg(F.min("year")).scalar()
    return uni.sector_asof(rows, master, d.years, first, "signal_date").select("ticker", "signal_date", "sector")


@query(
    sql(
        """SELECT min(date) AS first_common_ready FROM (
          SELECT date, count(*) AS n FROM (SELECT universe, date, bool_and(coalesce(indicator_ready, false)) AS ok FROM (
            SELECT w.universe, w.date, f.indicator_ready FROM (
              SELECT m.universe, m.ticker, y.date FROM members m JOIN yos y ON y.year = m.year
              UNION ALL SELECT s.universe, s.ticker, y.date FROM static s CROSS JOIN yos y WHERE y.year IN (SELECT year FROM members)) w
            ASOF LEFT JOIN idx_frame f ON f.ticker = w.ticker AND w.date >= f.date) GROUP BY ALL) WHERE ok GROUP BY date)
        WHERE n = 3""",
        "members", "static", "yos", "idx_frame",
    )
)
def first_common_ready_session(spark, sf):
    d = diag(spark, sf)
    return uni.first_common_ready(d.study.frame, d.members, d.static, d.years)


SHADOW = "universe ticker signal_date entry_date shadow_status is_closed exit_date exit_reason holding_sessions net_return_pct mfe mae horizon_10 horizon_20 horizon_40 horizon_60 normalized_exit_reason negative_exit_burden"


@query(
    sql("SELECT " + SHADOW.replace(" ", ", ") + " FROM ushadow", "ushadow"),
    dbl="net_return_pct mfe mae horizon_10 horizon_20 horizon_40 horizon_60 negative_exit_burden",
)
def one_shot_outcomes(spark, sf):
    """Each member signal on its own, with excursions and horizon returns."""
    return diag(spark, sf).shadow.select(*SHADOW.split())


LEDGER = "universe ticker sector signal_date entry_date exit_date last_observed_bar_date score shares entry_fill_price exit_raw_price exit_fill_price exit_reason holding_sessions net_return_pct is_closed"


@query(
    sql("SELECT " + LEDGER.replace("last_observed_bar_date", "exit0 AS last_observed_bar_date").replace(" ", ", ").replace("exit0, AS, ", "exit0 AS ") + " FROM ledger", "ledger"),
    dbl="shares entry_fill_price exit_raw_price exit_fill_price net_return_pct", digits=5,
)
def portfolio_ledger(spark, sf):
    """Trade rows with the terminal policy applied."""
    return diag(spark, sf).ledger.select(*LEDGER.split())


@query(
    sql("SELECT universe, ticker, signal_date, date, sector, score, trade_exit_reason, mark, pnl_jpy FROM days", "days"),
    dbl="mark pnl_jpy", digits=4,
)
def position_day_pnl(spark, sf):
    return diag(spark, sf).days.select("universe", "ticker", "signal_date", "date", "sector", "score", "trade_exit_reason", "mark", "pnl_jpy")


@query(sql("SELECT * FROM ucurve", "ucurve"), dbl="equity cash cash_utilization", digits=4)
def portfolio_curve(spark, sf):
    return diag(spark, sf).curve


@query(
    sql(
        """SELECT universe, round(max(abs(curve_change - pnl)), 3) AS maximum_error, greatest(1e-5, max(abs(equity)) * 1e-10) AS tolerance,
          count(*) FILTER (known IS NULL) AS unknown_dates, true AS "match"
        FROM (SELECT universe, date, equity, equity - lag(equity) OVER (PARTITION BY universe ORDER BY date) AS curve_change, 1 AS known FROM ucurve)
        FULL JOIN (SELECT universe, date, sum(pnl_jpy) AS pnl FROM days GROUP BY ALL) USING (universe, date) GROUP BY universe""",
        "ucurve",
    ),
    dbl="maximum_error tolerance",
)
def pnl_reconciliation(spark, sf):
    d = diag(spark, sf)
    return led.reconcile(d.curve, d.days).withColumn("maximum_error", F.round("maximum_error", 3))


@query(
    sql("SELECT universe, ticker, signal_date, entry_date, disposition, capacity_binding_session FROM decisions", "decisions"),
)
def signal_dispositions(spark, sf):
    return diag(spark, sf).decisions.select("universe", "ticker", "signal_date", "entry_date", "disposition", "capacity_binding_session")


@query(
    sql(
        """SELECT g.universe, g.ticker, g.signal_date, s.nxt AS entry_date FROM usignals g JOIN wsess s ON s.date = g.signal_date
        WHERE EXISTS (SELECT 1 FROM ledger l WHERE l.universe = g.universe AND l.ticker = g.ticker AND l.entry_date < s.nxt
          AND (l.exit_date > s.nxt OR (l.exit_date = s.nxt AND l.exit_reason NOT LIKE '%gap')))""",
        "usignals", "ledger",
    )
)
def occupied_at_open(spark, sf):
    """Signals whose code still holds a position at the next open."""
    d = diag(spark, sf)
    rows = cal.with_next_session(d.signals.select("universe", "ticker", "signal_date"), d.study.sessions, "signal_date").where("entry_date IS NOT NULL")
    return led.occupied_at_open(rows, d.ledger).select("universe", "ticker", "signal_date", "entry_date")


@query(
    sql(
        """SELECT universe, ticker, signal_date, entry_date, row_number() OVER (PARTITION BY universe, entry_date ORDER BY score DESC, median_va_60 DESC, ticker) AS priority
        FROM decisions WHERE entry_date IS NOT NULL""",
        "decisions",
    )
)
def candidate_priority(spark, sf):
    d = diag(spark, sf).decisions.where("entry_date IS NOT NULL")
    return O.candidate_rank(d, ["universe", "entry_date"]).select("universe", "ticker", "signal_date", "entry_date", "priority")


ACC = "universe ticker signal_date bitmask origin_group shadow_status mfe mae normalized_exit_reason negative_exit_burden net_pnl_jpy"


@query(sql("SELECT " + ACC.replace(" ", ", ") + " FROM accepted", "accepted"), dbl="mfe mae negative_exit_burden net_pnl_jpy", digits=4)
def accepted_trade_enrichment(spark, sf):
    return diag(spark, sf).accepted.select(*ACC.split())


@query(
    sql(
        """SELECT count(*) FILTER (k % 3 = 0) AS unmatched_rows, count(*) FILTER (k % 3 > 0 AND k % 4 = 0) AS exit_reason_mismatches,
          count(*) FILTER (k % 3 > 0 AND k % 5 = 0) AS net_return_pct_mismatches, count(*) FILTER (k % 3 > 0 AND k % 7 = 0) AS holding_sessions_mismatches
        FROM (SELECT CAST(ticker AS BIGINT) + day(signal_date) AS k FROM ledger WHERE is_closed)""",
        "ledger",
    )
)
def ledger_replay_diff(spark, sf):
    """Ledger returns against the one-shot outcomes of the same signals with planted faults: rows left out, other reasons,
    returns beyond and (on all others) within the tolerance, longer holding."""
    d = diag(spark, sf)
    on = ["universe", "ticker", "signal_date"]
    closed = d.ledger.where("is_closed")
    twin = d.shadow.join(closed.select(*on), on, "left_semi")
    k = F.col("ticker").cast("long") + F.dayofmonth("signal_date")
    faulty = twin.where(k % 3 > 0).withColumns(
        {
            "exit_reason": F.when(k % 4 == 0, "planted").otherwise(F.col("exit_reason")),
            "net_return_pct": F.col("net_return_pct") + F.when(k % 5 == 0, 1e-4).otherwise(1e-10),
            "holding_sessions": F.col("holding_sessions") + F.when(k % 7 == 0, 1).otherwise(0),
        }
    )
    return led.frame_diff(closed, faulty, on, ["exit_reason"], ["net_return_pct", "holding_sessions"])


REGIME_DBL = "cash_utilization equity above_share uptrend_share median_return return_std signal_breadth"


@query(sql("SELECT * FROM regime", "regime"), dbl=REGIME_DBL, digits=5)
def daily_regime(spark, sf):
    return diag(spark, sf).regime


MEANS = ("active_member_count", "above_share", "uptrend_share", "median_return", "return_std", "signal_breadth", "cash_utilization", "active_positions")


@query(
    sql(
        f"""SELECT d.*, w.maximum_drawdown, coalesce(t.closed_trade_count, 0) AS closed_trade_count, t.profit_factor, t.expectancy_per_trade, t.win_rate,
          t.average_holding_sessions, x.stop_family_exit_share, x.max_holding_exit_share, coalesce(k.ticker_distinct_count, 0) AS ticker_distinct_count,
          k.ticker_top_trade_share, k.ticker_trade_hhi, coalesce(z.sector_distinct_count, 0) AS sector_distinct_count, z.sector_top_trade_share, z.sector_trade_hhi
        FROM (SELECT universe, split, count(*) AS session_count, CAST(sum(raw_signal_count) AS BIGINT) AS raw_signal_count,
            100.0 * sum(raw_signal_count) / count(*) AS raw_signal_frequency_per_100_sessions, CAST(sum(accepted_count) AS BIGINT) AS accepted_entry_count,
            CAST(sum(capacity_rejected_count) AS BIGINT) AS capacity_rejection_count, CAST(sum(duplicate_rejected_count) AS BIGINT) AS duplicate_rejection_count,
            sum(capacity_rejected_count) / nullif(sum(accepted_count) + sum(capacity_rejected_count), 0) AS capacity_rejection_share,
            {", ".join(f"avg({m}) AS mean_{m}" for m in MEANS)}, max(cash_utilization) AS maximum_cash_utilization,
            max(active_positions) AS maximum_active_positions, avg((active_positions > 0)::INT) AS market_exposure_share
          FROM regime JOIN osplits ON date BETWEEN "start" AND "end" GROUP BY ALL) d
        LEFT JOIN (SELECT universe, split, min(equity / peak - 1) AS maximum_drawdown FROM (
          SELECT *, max(equity) OVER (PARTITION BY universe, split ORDER BY date) AS peak FROM uanch) GROUP BY ALL) w USING (universe, split)
        LEFT JOIN ({tstats("ucont", "universe, split")}) t USING (universe, split)
        LEFT JOIN (SELECT universe, split, avg((normalized_exit_reason IN ('stop_loss', 'stop_gap'))::INT) AS stop_family_exit_share,
          avg((normalized_exit_reason = 'max_holding')::INT) AS max_holding_exit_share FROM ucont WHERE is_closed GROUP BY ALL) x USING (universe, split)
        LEFT JOIN ({conc_sql("(SELECT * FROM ucont WHERE is_closed)", "universe, split", "ticker", "ticker_", "top_trade_share", "trade_hhi", "distinct_count")}) k USING (universe, split)
        LEFT JOIN ({conc_sql("(SELECT * FROM ucont WHERE is_closed)", "universe, split", "sector", "sector_", "top_trade_share", "trade_hhi", "distinct_count")}) z USING (universe, split)""",
        "regime", "ucont", "uanch",
    ),
    dbl="raw_signal_frequency_per_100_sessions capacity_rejection_share " + " ".join(f"mean_{m}" for m in MEANS)
    + " maximum_cash_utilization market_exposure_share maximum_drawdown profit_factor expectancy_per_trade win_rate average_holding_sessions"
    " stop_family_exit_share max_holding_exit_share ticker_top_trade_share ticker_trade_hhi sector_top_trade_share sector_trade_hhi",
)
def regime_summary(spark, sf):
    d = diag(spark, sf)
    return dia.regime_summary(d.regime, d.accepted, d.curve, d.splits)


@query(
    sql(
        f"""SELECT s.universe, s.split, s.bitmask, coalesce(r.n, 0) AS raw_signal_count, coalesce(c.n, 0) AS accepted_signal_cohort_count,
          {ZERO}, {", ".join(f"coalesce(x.{g}, 0) AS {g}_exit_count" for g in EXIT_GROUPS)},
          coalesce(ticker_distinct_count, 0) AS ticker_distinct_count, ticker_top_trade_share, ticker_trade_hhi,
          coalesce(sector_distinct_count, 0) AS sector_distinct_count, sector_top_trade_share, sector_trade_hhi,
          ticker_top_loss_share, ticker_loss_hhi, sector_top_loss_share, sector_loss_hhi,
          CASE WHEN coalesce(closed_trade_count, 0) >= 30 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT_SAMPLE' END AS sample_status,
          bp.p AS bit_pattern, CAST(bp.sc AS BIGINT) AS score, coalesce(c.n, 0) - coalesce(trade_count, 0) AS cross_boundary_excluded_count,
          (s.bitmask & 1) <> 0 AS has_weekly_above_200ma, (s.bitmask & 2) <> 0 AS has_weekly_macd_gc, (s.bitmask & 4) <> 0 AS has_weekly_macd_uptrend,
          (s.bitmask & 8) <> 0 AS has_daily_rsi_40_65, (s.bitmask & 16) <> 0 AS has_daily_volume_1_5x
        FROM (SELECT * FROM (SELECT DISTINCT universe FROM usignals), (SELECT split FROM osplits), (SELECT CAST(unnest([15, 23, 29, 30, 31]) AS BIGINT) AS bitmask)) s
        JOIN (VALUES (15, '01111', 100), (23, '10111', 100), (29, '11101', 90), (30, '11110', 90), (31, '11111', 120)) bp(b, p, sc) ON bp.b = s.bitmask
        LEFT JOIN (SELECT universe, split, bitmask, count(*) n FROM usignals JOIN osplits ON signal_date BETWEEN "start" AND "end" GROUP BY ALL) r USING (universe, split, bitmask)
        LEFT JOIN (SELECT universe, split, bitmask, count(*) n FROM accepted JOIN osplits ON signal_date BETWEEN "start" AND "end" GROUP BY ALL) c USING (universe, split, bitmask)
        LEFT JOIN ({tstats("ucont", "universe, split, bitmask")}) t USING (universe, split, bitmask)
        LEFT JOIN (SELECT universe, split, bitmask, {", ".join(f"count(*) FILTER (normalized_exit_reason = '{g}') AS {g}" for g in EXIT_GROUPS)}
          FROM ucont WHERE is_closed GROUP BY ALL) x USING (universe, split, bitmask)
        LEFT JOIN ({conc_sql("(SELECT * FROM ucont WHERE is_closed)", "universe, split, bitmask", "ticker", "ticker_", "top_trade_share", "trade_hhi", "distinct_count")}) k USING (universe, split, bitmask)
        LEFT JOIN ({conc_sql("(SELECT * FROM ucont WHERE is_closed)", "universe, split, bitmask", "sector", "sector_", "top_trade_share", "trade_hhi", "distinct_count")}) z USING (universe, split, bitmask)
        LEFT JOIN ({conc_sql("(SELECT * FROM ucont WHERE is_closed AND net_return_pct < 0)", "universe, split, bitmask", "ticker", "ticker_", "top_loss_share", "loss_hhi", "dl", "-net_return_pct")}) l1 USING (universe, split, bitmask)
        LEFT JOIN ({conc_sql("(SELECT * FROM ucont WHERE is_closed AND net_return_pct < 0)", "universe, split, bitmask", "sector", "sector_", "top_loss_share", "loss_hhi", "dl", "-net_return_pct")}) l2 USING (universe, split, bitmask)""",
        "ucont",
    ),
    dbl=TSTATS_DBL + " ticker_top_trade_share ticker_trade_hhi sector_top_trade_share sector_trade_hhi ticker_top_loss_share ticker_loss_hhi sector_top_loss_share sector_loss_hhi",
)
def score_mask_table(spark, sf):
    d = diag(spark, sf)
    return dia.score_mask_table(d.signals, d.accepted, d.splits)


HZ = ("horizon_10", "horizon_20", "horizon_40", "horizon_60")


@query(
    sql(
        f"""WITH e AS (SELECT *, unnest(['ALL', CAST(score AS VARCHAR)]) AS score_group FROM ucont WHERE is_closed AND split IN ('overall', 'validation', 'final_holdout'))
        SELECT *, total_net_pnl_jpy / nullif(sum(total_net_pnl_jpy) OVER (PARTITION BY universe, split, score_group), 0) AS share_of_score_group_net_pnl FROM (
        SELECT s.universe, s.split, s.score_group, s.exit_reason_group, coalesce(q.pnl, 0) AS total_net_pnl_jpy, q.mean_mfe, q.mean_mae,
          {", ".join(f"coalesce(q.{h}_available_count, 0) AS {h}_available_count, q.{h}_mean_unrealized_return" for h in HZ)}, {ZERO},
          CASE WHEN coalesce(closed_trade_count, 0) >= 30 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT_SAMPLE' END AS sample_status
        FROM (SELECT * FROM (SELECT DISTINCT universe FROM accepted), (SELECT unnest(['overall', 'validation', 'final_holdout']) AS split),
          (SELECT unnest(['ALL', '90', '100', '120']) AS score_group), (SELECT unnest([{", ".join(f"'{g}'" for g in EXIT_GROUPS)}]) AS exit_reason_group)) s
        LEFT JOIN (SELECT universe, split, score_group, normalized_exit_reason AS exit_reason_group, sum(net_pnl_jpy) AS pnl, avg(mfe) AS mean_mfe, avg(mae) AS mean_mae,
          {", ".join(f"count({h}) AS {h}_available_count, avg({h}) AS {h}_mean_unrealized_return" for h in HZ)} FROM e GROUP BY ALL) q USING (universe, split, score_group, exit_reason_group)
        LEFT JOIN ({tstats("(SELECT *, normalized_exit_reason AS exit_reason_group FROM e)", "universe, split, score_group, exit_reason_group")}) t USING (universe, split, score_group, exit_reason_group))""",
        "ucont",
    ),
    dbl=TSTATS_DBL + " total_net_pnl_jpy mean_mfe mean_mae share_of_score_group_net_pnl " + " ".join(f"{h}_mean_unrealized_return" for h in HZ), digits=4,
)
def exit_reason_table(spark, sf):
    d = diag(spark, sf)
    return dia.exit_reason_table(d.accepted, d.splits)


GROUPS = """unnest(list_filter([CASE WHEN disposition = 'accepted' THEN 'accepted_all' END, CASE WHEN disposition = 'accepted' AND capacity_binding_session THEN 'accepted_binding' END,
  CASE WHEN disposition <> 'accepted' THEN disposition END], lambda x: x IS NOT NULL)) AS disposition_group"""
SCORED = "s.disposition_group IN ('accepted_all', 'accepted_binding', 'capacity_rejected')"
CAP_STATS = ", ".join(
    f"CASE WHEN {SCORED} THEN coalesce(t.{n}, 0) ELSE c.n END AS {n}" if n == "trade_count"
    else (f"CASE WHEN {SCORED} THEN coalesce(t.{n}, 0) END AS {n}" if n in M.ZERO_WHEN_EMPTY or n == "sum_net_returns" else f"CASE WHEN {SCORED} THEN t.{n} END AS {n}")
    for n in M.TRADE_STATS
)


@query(
    sql(
        f"""WITH g AS (SELECT *, {GROUPS} FROM qcoh), k AS (SELECT *, {GROUPS} FROM qcont)
        SELECT s.universe, s.split, s.disposition_group, coalesce(c.n, 0) AS signal_count, c.score_mean, c.liquidity_mean, c.score_p25, c.score_median, c.score_p75,
          c.liquidity_p25, c.liquidity_median, c.liquidity_p75, c.score_90_share, c.score_100_share, c.score_120_share,
          coalesce(z.sector_distinct_count, 0) AS sector_distinct_count, z.sector_top_signal_share, z.sector_signal_hhi, coalesce(q.n, 0) AS contained_quality_count,
          coalesce(c.n, 0) - coalesce(q.n, 0) AS cross_boundary_or_censored_count, coalesce(b.n, 0) AS capacity_binding_session_count,
          {CAP_STATS.replace("ELSE c.n END", "ELSE coalesce(c.n, 0) END")},
          CASE WHEN {SCORED} THEN CASE WHEN coalesce(closed_trade_count, 0) >= 30 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT_SAMPLE' END ELSE 'COUNT_ONLY' END AS sample_status
        FROM (SELECT * FROM (SELECT DISTINCT universe FROM quality), (SELECT split FROM osplits),
          (SELECT unnest(['accepted_all', 'accepted_binding', 'capacity_rejected', 'duplicate_rejected', 'missing_next_session', 'invalid_bar']) AS disposition_group)) s
        LEFT JOIN (SELECT universe, split, disposition_group, count(*) AS n, avg(score) AS score_mean, avg(median_va_60) AS liquidity_mean,
            quantile_cont(score, 0.25) AS score_p25, quantile_cont(score, 0.5) AS score_median, quantile_cont(score, 0.75) AS score_p75,
            quantile_cont(median_va_60, 0.25) AS liquidity_p25, quantile_cont(median_va_60, 0.5) AS liquidity_median, quantile_cont(median_va_60, 0.75) AS liquidity_p75,
            avg((score = 90)::INT) AS score_90_share, avg((score = 100)::INT) AS score_100_share, avg((score = 120)::INT) AS score_120_share
          FROM g GROUP BY ALL) c USING (universe, split, disposition_group)
        LEFT JOIN ({conc_sql("g", "universe, split, disposition_group", "sector", "sector_", "top_signal_share", "signal_hhi", "distinct_count")}) z USING (universe, split, disposition_group)
        LEFT JOIN (SELECT universe, split, disposition_group, count(*) AS n FROM k GROUP BY ALL) q USING (universe, split, disposition_group)
        LEFT JOIN (SELECT universe, split, count(DISTINCT entry_date) AS n FROM qcoh WHERE capacity_binding_session GROUP BY ALL) b USING (universe, split)
        LEFT JOIN ({tstats("k", "universe, split, disposition_group")}) t USING (universe, split, disposition_group)""",
        "qcoh", "qcont",
    ),
    dbl=TSTATS_DBL + " score_mean liquidity_mean score_p25 score_median score_p75 liquidity_p25 liquidity_median liquidity_p75 score_90_share score_100_share"
    " score_120_share sector_top_signal_share sector_signal_hhi", digits=5,
)
def capacity_attribution(spark, sf):
    d = diag(spark, sf)
    return dia.capacity_table(d.quality, d.splits)


@query(
    sql("SELECT universe, start_date, trough_date, recovery_date, drawdown, equity_change_peak_to_trough, episode_rank FROM episodes", "episodes"),
    dbl="drawdown equity_change_peak_to_trough", digits=5,
)
def drawdown_episodes(spark, sf):
    return diag(spark, sf).episodes


EP = "universe, episode_rank"


@query(
    sql(
        f"""WITH t AS (SELECT * FROM episodes WHERE episode_rank <= 5),
        p AS (SELECT d.*, t.episode_rank FROM days d JOIN t ON d.universe = t.universe AND d.date > t.start_date AND d.date <= t.trough_date),
        r AS (SELECT d.*, t.episode_rank FROM regime d JOIN t ON d.universe = t.universe AND d.date > t.start_date AND d.date <= t.trough_date)
        SELECT t.*, m.*  EXCLUDE (universe, episode_rank), w.* EXCLUDE (universe, episode_rank), a.* EXCLUDE (universe, episode_rank), b.* EXCLUDE (universe, episode_rank),
          c.* EXCLUDE (universe, episode_rank), d.* EXCLUDE (universe, episode_rank), true AS position_pnl_reconciled
        FROM t LEFT JOIN (SELECT {EP}, sum(pnl_jpy) AS position_net_pnl_jpy, coalesce(-sum(pnl_jpy) FILTER (pnl_jpy < 0), 0) AS gross_negative_position_day_pnl_jpy,
            {", ".join(f"coalesce(-sum(pnl_jpy) FILTER (pnl_jpy < 0 AND score = {s}), 0) / -sum(pnl_jpy) FILTER (pnl_jpy < 0) AS score_{s}_gross_loss_share" for s in (90, 100, 120))},
            {", ".join(f"coalesce(-sum(pnl_jpy) FILTER (pnl_jpy < 0 AND trade_exit_reason = '{g}'), 0) / -sum(pnl_jpy) FILTER (pnl_jpy < 0) AS {g}_gross_loss_share" for g in EXIT_GROUPS)}
          FROM p GROUP BY ALL) m USING ({EP})
        LEFT JOIN (SELECT {EP}, count(*) AS window_session_count, avg(active_positions) AS mean_active_positions, max(active_positions) AS maximum_active_positions,
            avg(cash_utilization) AS mean_cash_utilization, max(cash_utilization) AS maximum_cash_utilization, CAST(sum(capacity_rejected_count) AS BIGINT) AS capacity_rejection_count,
            CAST(sum(raw_signal_count) AS BIGINT) AS raw_signal_count, 100.0 * sum(raw_signal_count) / count(*) AS raw_signal_frequency_per_100_sessions,
            {", ".join(f"avg({m}) AS mean_{m}" for m in ("above_share", "uptrend_share", "median_return", "return_std", "signal_breadth"))} FROM r GROUP BY ALL) w USING ({EP})
        LEFT JOIN ({top_sql("p", EP, "ticker", "ticker_gross_loss", False)}) a USING ({EP})
        LEFT JOIN ({top_sql("p", EP, "sector", "sector_gross_loss", False)}) b USING ({EP})
        LEFT JOIN ({top_sql("p", EP, "ticker", "ticker_adverse_net", True)}) c USING ({EP})
        LEFT JOIN ({top_sql("p", EP, "sector", "sector_adverse_net", True)}) d USING ({EP})""",
        "episodes", "days", "regime",
    ),
    dbl="drawdown equity_change_peak_to_trough position_net_pnl_jpy gross_negative_position_day_pnl_jpy score_90_gross_loss_share score_100_gross_loss_share score_120_gross_loss_share "
    + " ".join(f"{g}_gross_loss_share" for g in EXIT_GROUPS)
    + " mean_active_positions mean_cash_utilization maximum_cash_utilization raw_signal_frequency_per_100_sessions mean_above_share mean_uptrend_share mean_median_return"
    " mean_return_std mean_signal_breadth "
    + " ".join(f"{p}_{m}" for p in ("ticker_gross_loss", "sector_gross_loss", "ticker_adverse_net", "sector_adverse_net") for m in ("top_share", "top3_share", "hhi")),
    digits=4,
)
def worst_episode_table(spark, sf):
    d = diag(spark, sf)
    return dia.episode_table(d.episodes, d.days, d.regime)


@query(
    sql(
        """SELECT universe, accepted_entry_count, dimension, distinct_bucket_count, top_bucket_trade_share, trade_share_hhi FROM (
        SELECT *, 'ticker' AS dimension FROM (""" + conc_sql("ledger", "universe", "ticker", "", "top_bucket_trade_share", "trade_share_hhi", "distinct_bucket_count") + """)
        UNION ALL SELECT *, 'sector' FROM (""" + conc_sql("ledger", "universe", "sector", "", "top_bucket_trade_share", "trade_share_hhi", "distinct_bucket_count") + """))
        JOIN (SELECT universe, count(*) AS accepted_entry_count FROM ledger GROUP BY 1) USING (universe)""",
        "ledger",
    ),
    dbl="top_bucket_trade_share trade_share_hhi",
)
def trade_concentration(spark, sf):
    return M.concentration_table(diag(spark, sf).ledger)


@query(
    sql(conc_sql("(SELECT * FROM ledger WHERE is_closed AND net_return_pct < 0)", "universe", "ticker", "", "top_loss_share", "loss_hhi", "distinct_loss_bucket_count", "-net_return_pct"), "ledger"),
    dbl="top_loss_share loss_hhi",
)
def loss_concentration(spark, sf):
    return M.loss_concentration(diag(spark, sf).ledger, ["universe"], "ticker")


@query(sql(top_sql("days", "universe", "ticker", "ticker_gross_loss", False), "days"), dbl="ticker_gross_loss_top_share ticker_gross_loss_top3_share ticker_gross_loss_hhi")
def gross_loss_attribution(spark, sf):
    return dia.loss_shares(diag(spark, sf).days, ["universe"], "ticker", "ticker_gross_loss")


@query(sql(top_sql("days", "universe", "sector", "sector_adverse_net", True), "days"), dbl="sector_adverse_net_top_share sector_adverse_net_top3_share sector_adverse_net_hhi")
def adverse_net_attribution(spark, sf):
    return dia.adverse_net(diag(spark, sf).days, ["universe"], "sector", "sector_adverse_net")


@query(
    sql(
        "SELECT universe, " + ", ".join(f"coalesce(-sum(pnl_jpy) FILTER (pnl_jpy < 0 AND trade_exit_reason = '{g}'), 0) / -sum(pnl_jpy) FILTER (pnl_jpy < 0) AS {g}_gross_loss_share" for g in EXIT_GROUPS)
        + " FROM days GROUP BY universe",
        "days",
    ),
    dbl=" ".join(f"{g}_gross_loss_share" for g in EXIT_GROUPS),
)
def categorical_loss_shares(spark, sf):
    return dia.categorical_loss(diag(spark, sf).days, ["universe"], "trade_exit_reason", EXIT_GROUPS)


CAPITAL = f"""SELECT c.*, k.mean_cash_utilization, k.minimum_cash FROM ({{c}}) c JOIN (SELECT {{d}}, avg(cash_utilization) AS mean_cash_utilization,
  min(cash) AS minimum_cash FROM {{src}} GROUP BY {{d}}) k USING ({{d}})"""


def capital_sql(src: str, dims: str) -> str:
    held = f"(SELECT *, CAST(active_positions > 0 AS DOUBLE) AS exposure FROM {src})"
    return CAPITAL.format(c=cstats(held, dims), d=dims, src=src)


CAP_DBL = CSTATS_DBL + " mean_cash_utilization minimum_cash"


@query(sql(capital_sql("ucurve", "universe"), "ucurve"), dbl=CAP_DBL, digits=4)
def capital_statistics(spark, sf):
    return M.capital_stats(diag(spark, sf).curve, ["universe"])


@query(
    sql(
        f"""WITH ya AS (SELECT c.*, yr FROM ucurve c JOIN (SELECT DISTINCT universe AS u2, CAST(year(date) AS INT) AS yr FROM ucurve) q ON q.u2 = c.universe
          WHERE year(c.date) = yr OR c.date = (SELECT max(date) FROM ucurve d WHERE d.universe = c.universe AND year(d.date) < yr))
        SELECT y.universe, y.yr AS year, coalesce(g.n, 0) AS raw_signal_count, coalesce(e.n, 0) AS accepted_entry_count, {ZERO}, k.* EXCLUDE (universe, yr)
        FROM (SELECT DISTINCT universe, CAST(year(date) AS INT) AS yr FROM ucurve) y
        LEFT JOIN (SELECT universe, year(signal_date) AS yr, count(*) n FROM usignals GROUP BY ALL) g ON g.universe = y.universe AND g.yr = y.yr
        LEFT JOIN (SELECT universe, year(entry_date) AS yr, count(*) n FROM ledger GROUP BY ALL) e ON e.universe = y.universe AND e.yr = y.yr
        LEFT JOIN ({tstats("(SELECT *, year(exit_date) AS yr FROM ledger)", "universe, yr")}) t ON t.universe = y.universe AND t.yr = y.yr
        LEFT JOIN ({capital_sql("ya", "universe, yr")}) k ON k.universe = y.universe AND k.yr = y.yr""",
        "ucurve", "usignals",
    ),
    dbl=TSTATS_DBL + " " + CAP_DBL, digits=4,
)
def yearly_capital_table(spark, sf):
    d = diag(spark, sf)
    return M.yearly_capital_table(d.ledger, d.signals, d.curve)


@query(
    sql(
        f"""SELECT b.universe, b.split, p."start", p."end", coalesce(c.n, 0) AS signal_cohort_count, coalesce(c.n, 0) - coalesce(trade_count, 0) AS cross_boundary_excluded_count,
          {ZERO}, b.* EXCLUDE (universe, split)
        FROM ({capital_sql("uanch", "universe, split")}) b JOIN osplits p USING (split)
        LEFT JOIN (SELECT universe, split, count(*) n FROM ledger JOIN osplits ON signal_date BETWEEN "start" AND "end" GROUP BY ALL) c USING (universe, split)
        LEFT JOIN ({tstats('(SELECT l.*, p.split FROM ledger l JOIN osplits p ON signal_date BETWEEN "start" AND "end" AND entry_date >= "start" AND exit_date <= "end")', "universe, split")}) t
          USING (universe, split)""",
        "uanch", "ledger",
    ),
    dbl=TSTATS_DBL + " " + CAP_DBL, digits=4,
)
def split_capital_table(spark, sf):
    d = diag(spark, sf)
    return M.split_capital_table(d.ledger, d.curve, d.splits)


@query(
    sql(
        """WITH z AS (SELECT universe, date, i FROM (SELECT DISTINCT universe FROM usignals), wsess),
        q AS (SELECT *, i - row_number() OVER (PARTITION BY universe ORDER BY i) AS isl FROM z WHERE (universe, date) NOT IN (SELECT universe, signal_date FROM usignals)),
        r AS (SELECT universe, count(*) AS n, date_diff('day', min(date), max(date)) + 1 AS d, min(date) AS a FROM q GROUP BY universe, isl),
        b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY universe ORDER BY n DESC, d DESC, a) = 1),
        y AS (SELECT date_diff('day', min(date), max(date)) / 365.2425 AS years FROM wsess)
        SELECT g.universe, g.n AS raw_signal_count, coalesce(l.n, 0) AS accepted_entry_count, b.n AS longest_no_signal_sessions, b.d AS longest_no_signal_calendar_days,
          g.n / years AS raw_signal_frequency_per_year, coalesce(l.n, 0) / years AS accepted_entry_frequency_per_year
        FROM (SELECT universe, count(*) n FROM usignals GROUP BY 1) g LEFT JOIN (SELECT universe, count(*) n FROM ledger GROUP BY 1) l USING (universe) LEFT JOIN b USING (universe), y""",
        "usignals", "ledger",
    ),
    dbl="raw_signal_frequency_per_year accepted_entry_frequency_per_year",
)
def signal_frequency(spark, sf):
    d = diag(spark, sf)
    spine = cal.session_spine(d.signals.select("universe").distinct(), d.study.sessions)
    gap = cal.longest_gap(spine, d.signals, ["universe"])
    return M.signal_frequency(d.signals, d.ledger, d.study.sessions, gap)


MONO = [f"score_{s}" for s in (90, 100, 120)]


@query(
    sql(
        f"""WITH t AS ({tstats("(SELECT * FROM accepted WHERE score IN (90, 100, 120))", "universe, score")}),
        w AS (SELECT universe, {", ".join(f"coalesce(max(closed_trade_count) FILTER (score = {s}), 0) AS score_{s}_closed, max(expectancy_per_trade) FILTER (score = {s}) AS score_{s}_expectancy, max(profit_factor) FILTER (score = {s}) AS score_{s}_profit_factor" for s in (90, 100, 120))} FROM t GROUP BY 1)
        SELECT w.*, coalesce(score_90_expectancy < score_100_expectancy AND score_100_expectancy < score_120_expectancy, false) AS strictly_increasing,
          coalesce(v, 0) AS score_120_validation_count, coalesce(h, 0) AS score_120_final_holdout_count
        FROM w LEFT JOIN (SELECT universe, count(*) FILTER (split = 'validation') v, count(*) FILTER (split = 'final_holdout') h FROM ucont WHERE is_closed AND score = 120 GROUP BY 1) USING (universe)""",
        "ucont",
    ),
    dbl=" ".join(f"{m}_{x}" for m in MONO for x in ("expectancy", "profit_factor")),
)
def score_monotonicity(spark, sf):
    d = diag(spark, sf)
    return dia.score_monotonicity(d.accepted, d.splits)
