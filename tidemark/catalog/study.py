"""Queries of the fixed-universe study: windows, outcomes, trades, curves, tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query, shared
from tidemark.catalog.sql import CSTATS_DBL, TSTATS_DBL, cstats, padded, sql, tstats
from tidemark.config import PRIMARY
from tidemark.operators import calendar as cal
from tidemark.operators import metrics as M
from tidemark.operators import outcomes as O
from tidemark.operators.windows import drawdown, longest_run
from tidemark.plans.study import Study, common_window
from tidemark.sources import bars as B


@query(sql('SELECT s AS "start", e AS "end" FROM win', "win"))
def common_window_dates(spark, sf):
    s = shared(Study, spark, sf)
    return common_window(s.frame, s.frame).select("start", "end")


@query(sql("SELECT date, i AS idx FROM unit_sess", "unit_sess"))
def market_dates(spark, sf):
    return cal.market_dates(B.unit_price_bars(spark, sf))


@query(sql('SELECT split, "start", "end", sessions FROM splits', "splits"))
def chronological_splits(spark, sf):
    return shared(Study, spark, sf).splits


@query(
    sql(
        """SELECT ticker, name, sector, signal_date, score, bitmask FROM wsignals""",
        "wsignals",
    )
)
def raw_signal_events(spark, sf):
    return shared(Study, spark, sf).events.select("ticker", "name", "sector", "signal_date", "score", "bitmask")


@query(
    sql(
        """SELECT g.ticker, g.signal_date, s.nxt AS entry_date FROM unit_signals g LEFT JOIN unit_next s ON g.signal_date = s.date""",
        "unit_signals",
        "unit_next",
    )
)
def next_session_entry(spark, sf):
    from tidemark.operators import signals as S

    bars = B.unit_price_bars(spark, sf)
    ev = S.signal_events(S.signal_frame(bars)).select("ticker", "signal_date")
    return cal.with_next_session(ev, cal.market_dates(bars), "signal_date").select("ticker", "signal_date", "entry_date")


OUT_COLS = [
    "ticker", "signal_date", "scenario", "entry_status", "entry_date", "entry_fill_price", "exit_date", "exit_raw_price", "exit_fill_price",
    "exit_reason", "holding_sessions", "gross_return_pct", "net_return_pct", "is_closed",
]
OUT_DBL = "entry_fill_price exit_raw_price exit_fill_price gross_return_pct net_return_pct"


@query(sql("SELECT " + ", ".join(OUT_COLS) + " FROM fills", "fills"), dbl=OUT_DBL, digits=5)
def bracket_exit_outcomes(spark, sf):
    """Every signal labelled with its exit under all cost and path scenarios."""
    return shared(Study, spark, sf).exits().select(*OUT_COLS)


@query(
    sql(
        f"""SELECT 'all-' || ticker || '-' || {padded('trade_seq', 4)} AS trade_id, scenario, ticker, name, sector, signal_date, score,
        entry_date, exit_date, exit_reason, holding_sessions, net_return_pct, is_closed FROM trades""",
        "trades",
    ),
    dbl="net_return_pct",
)
def independent_trades(spark, sf):
    """Non-overlapping trades per ticker and scenario, with ids."""
    return shared(Study, spark, sf).trades.select(
        "trade_id", "scenario", "ticker", "name", "sector", "signal_date", "score", "entry_date", "exit_date", "exit_reason",
        "holding_sessions", "net_return_pct", "is_closed",
    )


@query(
    sql(
        """SELECT scenario, count(*) AS raw_signals, count(*) FILTER (status = 'skipped_while_open') AS signals_skipped_while_open,
        count(*) FILTER (status = 'missing_next_session') AS signals_unfilled_missing_next_session,
        count(*) FILTER (status = 'data_end') AS signals_unfilled_at_data_end FROM statuses GROUP BY scenario""",
        "statuses",
    )
)
def signal_counters(spark, sf):
    return O.signal_counters(shared(Study, spark, sf).statuses(), ["scenario"])


@query(
    sql("SELECT scenario, date, equity, active_positions, capacity, exposure FROM curve", "curve"),
    dbl="equity exposure",
)
def equal_notional_curve(spark, sf):
    return shared(Study, spark, sf).curve()


@query(
    sql("SELECT scenario, date, active_positions FROM curve", "curve"),
)
def trade_concurrency(spark, sf):
    s = shared(Study, spark, sf)
    return O.concurrency(s.trades, s.sessions, ["scenario"])


@query(
    sql(
        """SELECT scenario, date, max(equity) OVER w AS peak, equity / max(equity) OVER w - 1 AS drawdown FROM curve
        WINDOW w AS (PARTITION BY scenario ORDER BY date)""",
        "curve",
    ),
    dbl="peak drawdown",
)
def running_drawdown(spark, sf):
    return drawdown(shared(Study, spark, sf).curve(), ["scenario"]).select("scenario", "date", "peak", "drawdown")


@query(sql(tstats("trades", "scenario"), "trades"), dbl=TSTATS_DBL)
def trade_statistics(spark, sf):
    return M.trade_stats(shared(Study, spark, sf).trades, ["scenario"])


@query(
    sql(
        f"SELECT ticker, max_consecutive_losses FROM ({tstats('ptrades', 'ticker')}) WHERE closed_trade_count > 0",
        "ptrades",
    )
)
def longest_loss_run(spark, sf):
    t = shared(Study, spark, sf).primary.where("is_closed")
    return longest_run(t, ["ticker"], "exit_date", ["signal_date"], F.col("net_return_pct") < 0, "max_consecutive_losses")


@query(sql(cstats("curve", "scenario"), "curve"), dbl=CSTATS_DBL)
def portfolio_statistics(spark, sf):
    return M.curve_stats(shared(Study, spark, sf).curve(), ["scenario"])


# Calendar-year rows with the last earlier row as anchor.
YEAR_SQL = f"""
SELECT y.scenario, y.year, coalesce(sc.n, 0) AS signal_count, coalesce(co.n, 0) AS signal_cohort_trade_count,
  coalesce(trade_count, 0) AS trade_count, coalesce(closed_trade_count, 0) AS closed_trade_count, coalesce(open_trade_count, 0) AS open_trade_count,
  win_rate, average_win, average_loss, payoff_ratio, expectancy_per_trade, profit_factor, coalesce(max_consecutive_losses, 0) AS max_consecutive_losses,
  average_holding_sessions, median_holding_sessions, coalesce(sum_net_returns, 0) AS sum_net_returns,
  p.total_return, p.cagr, p.maximum_drawdown, p.calmar_ratio, o.market_exposure, o.maximum_concurrent_positions
FROM (SELECT DISTINCT scenario, CAST(year(date) AS INT) AS year FROM curve) y
LEFT JOIN (SELECT year(signal_date) AS year, count(*) n FROM wsignals GROUP BY 1) sc ON sc.year = y.year
LEFT JOIN (SELECT scenario, year(signal_date) AS year, count(*) n FROM trades GROUP BY 1, 2) co ON co.year = y.year AND co.scenario = y.scenario
LEFT JOIN ({tstats("(SELECT *, year(exit_date) AS yr FROM trades)", "scenario, yr")}) t ON t.scenario = y.scenario AND t.yr = y.year
LEFT JOIN ({cstats('''(SELECT c.*, yr FROM curve c JOIN (SELECT DISTINCT scenario s2, year(date) AS yr FROM curve) q ON q.s2 = c.scenario
   WHERE year(c.date) = yr OR c.date = (SELECT max(date) FROM curve d WHERE d.scenario = c.scenario AND year(d.date) < yr))''', "scenario, yr")}) p
  ON p.scenario = y.scenario AND p.yr = y.year
LEFT JOIN (SELECT scenario, year(date) AS yr, avg(exposure) AS market_exposure, CAST(max(active_positions) AS BIGINT) AS maximum_concurrent_positions
  FROM curve GROUP BY 1, 2) o ON o.scenario = y.scenario AND o.yr = y.year"""


@query(sql(YEAR_SQL, "curve", "wsignals"), dbl=TSTATS_DBL + " " + CSTATS_DBL)
def yearly_table(spark, sf):
    s = shared(Study, spark, sf)
    return M.yearly_table(s.trades, s.signals, s.curve())


@query(
    sql(
        """SELECT m.year_month, market_sessions, coalesce(raw, 0) AS raw_signal_count, coalesce(tr, 0) AS eligible_trade_count,
          coalesce(tk, 0) AS unique_tickers, market_sessions - coalesce(ds, 0) AS zero_signal_sessions
        FROM (SELECT strftime(date, '%Y-%m') AS year_month, count(*) AS market_sessions FROM wsess GROUP BY 1) m
        LEFT JOIN (SELECT strftime(signal_date, '%Y-%m') AS year_month, count(*) raw, count(DISTINCT ticker) tk, count(DISTINCT signal_date) ds
          FROM wsignals GROUP BY 1) g USING (year_month)
        LEFT JOIN (SELECT strftime(signal_date, '%Y-%m') AS year_month, count(*) tr FROM ptrades GROUP BY 1) t USING (year_month)""",
        "ptrades",
    )
)
def monthly_signal_table(spark, sf):
    s = shared(Study, spark, sf)
    return M.monthly_signal_table(s.sessions, s.signals, s.primary)


ZEROED = ", ".join(
    f"coalesce({n}, 0) AS {n}" if n in M.ZERO_WHEN_EMPTY or n == "sum_net_returns" else n for n in M.TRADE_STATS
)


@query(
    sql(
        f"""SELECT b.score AS score_bucket, coalesce(n, 0) AS signal_count, {ZEROED}
        FROM (SELECT CAST(unnest([90, 100, 110, 120]) AS BIGINT) AS score) b LEFT JOIN (SELECT score, count(*) n FROM wsignals GROUP BY 1) g USING (score)
        LEFT JOIN ({tstats("ptrades", "score")}) t USING (score)""",
        "ptrades",
    ),
    dbl=TSTATS_DBL,
)
def score_bucket_table(spark, sf):
    s = shared(Study, spark, sf)
    return M.score_bucket_table(s.signals, s.primary)


@query(
    sql(
        f"""SELECT m.ticker, m.name, m.sector, coalesce(n, 0) AS signal_count, {ZEROED}
        FROM meta m LEFT JOIN (SELECT ticker, count(*) n FROM wsignals GROUP BY 1) g USING (ticker)
        LEFT JOIN ({tstats("ptrades", "ticker")}) t USING (ticker)""",
        "ptrades",
    ),
    dbl=TSTATS_DBL,
)
def ticker_table(spark, sf):
    s = shared(Study, spark, sf)
    return M.ticker_table(s.metadata, s.signals, s.primary)


@query(
    sql(
        f"""SELECT b.sector, coalesce(n, 0) AS signal_count, {ZEROED}
        FROM (SELECT sector FROM wsignals UNION SELECT sector FROM ptrades) b LEFT JOIN (SELECT sector, count(*) n FROM wsignals GROUP BY 1) g USING (sector)
        LEFT JOIN ({tstats("ptrades", "sector")}) t USING (sector)""",
        "ptrades",
    ),
    dbl=TSTATS_DBL,
)
def sector_table(spark, sf):
    s = shared(Study, spark, sf)
    return M.sector_table(s.events, s.primary)


@query(
    sql(
        f"""SELECT b.split, b."start", b."end", b.sessions, coalesce(n, 0) AS signal_count, coalesce(k, 0) AS accepted_cohort_trade_count,
          coalesce(x, 0) AS cross_boundary_excluded, {ZEROED}
        FROM splits b
        LEFT JOIN (SELECT split, count(*) n FROM wsignals JOIN splits ON signal_date BETWEEN "start" AND "end" GROUP BY 1) g USING (split)
        LEFT JOIN (SELECT split, count(*) k, count(*) FILTER (exit_date > "end") x FROM ptrades JOIN splits ON signal_date BETWEEN "start" AND "end" GROUP BY 1) c USING (split)
        LEFT JOIN ({tstats('(SELECT t.*, p.split FROM ptrades t JOIN splits p ON signal_date BETWEEN "start" AND "end" AND exit_date <= "end")', "split")}) t USING (split)""",
        "ptrades",
        "splits",
    ),
    dbl=TSTATS_DBL,
)
def split_table(spark, sf):
    s = shared(Study, spark, sf)
    return M.split_table(s.signals, s.primary, s.splits)


SCEN_SQL = f"""SELECT t.*, c.* EXCLUDE (scenario), b.n AS same_bar_both_trade_count FROM ({tstats("trades", "scenario")}) t
  JOIN ({cstats("curve", "scenario")}) c USING (scenario)
  JOIN (SELECT scenario, count(*) FILTER (exit_reason LIKE 'stop_and_take_same_day%') AS n FROM trades GROUP BY 1) b USING (scenario)"""


@query(sql(SCEN_SQL, "curve"), dbl=TSTATS_DBL + " " + CSTATS_DBL)
def scenario_sensitivity(spark, sf):
    s = shared(Study, spark, sf)
    return M.scenario_table(s.trades, s.curve())


@query(
    sql(
        f"""WITH z AS ({SCEN_SQL}) SELECT o.total_return - c.total_return AS total_return_delta,
        o.expectancy_per_trade - c.expectancy_per_trade AS expectancy_delta, o.trade_count - c.trade_count AS trade_count_delta
        FROM z o, z c WHERE o.scenario = 'basic:optimistic' AND c.scenario = 'basic:conservative'""",
        "curve",
    ),
    dbl="total_return_delta expectancy_delta",
)
def path_difference(spark, sf):
    s = shared(Study, spark, sf)
    return M.path_deltas(M.scenario_table(s.trades, s.curve()), PRIMARY.name, "basic:optimistic")


@query(
    sql(
        """WITH q AS (SELECT *, i - row_number() OVER (ORDER BY i) AS isl FROM wsess WHERE date NOT IN (SELECT signal_date FROM wsignals)),
        r AS (SELECT count(*) AS n, date_diff('day', min(date), max(date)) + 1 AS d, min(date) AS a, max(date) AS b FROM q GROUP BY isl)
        SELECT n AS longest_no_signal_sessions, d AS longest_no_signal_calendar_days, a AS gap_start, b AS gap_end FROM r ORDER BY n DESC, d DESC, a LIMIT 1""",
        "wsignals",
        "wsess",
    )
)
def longest_no_signal_gap(spark, sf):
    s = shared(Study, spark, sf)
    return cal.longest_gap(s.sessions, s.signals)


@query(
    sql(
        """SELECT t.scenario || ':' AS scenario_key, ticker, signal_date, net_return_pct FROM trades t""",
        "trades",
    ),
    dbl="net_return_pct",
)
def scenario_trades(spark, sf):
    """All scenarios' trades in one table under a key column."""
    t = shared(Study, spark, sf).trades
    return t.select(F.concat("scenario", F.lit(":")).alias("scenario_key"), "ticker", "signal_date", "net_return_pct")
