"""Shared DuckDB CTEs. They state the rules a second time, in plain SQL."""

from __future__ import annotations

TICKER = "CAST(l_suppkey AS VARCHAR)"
DAY = "CAST(l_shipdate AS DATE)"

# name -> (names it reads, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def sql(final: str, *names: str) -> str:
    """WITH clause holding the named CTEs and what they read, then the query."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in CTES[n][0]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if final.lstrip().startswith("WITH "):
        # A query that brings its own CTEs joins this clause.
        names, final = final.lstrip()[5:], ""
    else:
        names = ""
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" if not n.startswith("rec_") else f"{n[4:]} AS ({CTES[n][1]})" for n in order)
    word = "WITH RECURSIVE" if any(n.startswith("rec_") for n in order) else "WITH"
    return f"{word} {parts}, {names}" if names else f"{word} {parts}\n{final}"


cte(
    "unit",
    f"""SELECT {TICKER} ticker, {DAY} date, arg_min(p, ord) AS "open", max(p) AS high, min(p) AS low,
    arg_max(p, ord) AS "close", sum(l_quantity) AS volume, sum(l_extendedprice) AS va
    FROM (SELECT *, l_extendedprice / l_quantity AS p,
          l_orderkey * 8388608 + l_linenumber * 1048576 + l_partkey % 1048576 AS ord FROM lineitem)
    GROUP BY ALL""",
)
cte(
    "idxday",
    f"""SELECT {TICKER} ticker, {DAY} date, avg(l_discount - 0.05) g, avg(l_tax - 0.04) x, max(l_discount) up,
    max(l_tax) AS down, sum(l_quantity) AS volume, sum(l_extendedprice) AS va FROM lineitem GROUP BY ALL""",
)
cte(
    "idx",
    """SELECT ticker, date, "open", greatest("open", "close") * (1 + 0.1 * up) AS high,
    least("open", "close") * (1 - 0.1 * down) AS low, "close", volume, va
    FROM (SELECT *, 1000 * exp(lc) AS "close", 1000 * exp(lc + 0.3713 * x) AS "open"
      FROM (SELECT *, sum(0.3937 * g - 0.3713 * x) OVER (PARTITION BY ticker ORDER BY date) AS lc FROM idxday))""",
    "idxday",
)
cte(
    "meta",
    """SELECT CAST(s_suppkey AS VARCHAR) ticker, s_name AS name, n_name AS sector, r_name AS region
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)


def padded(x: str, width: int) -> str:
    """Zeros in front up to ``width``; longer text stays whole."""
    return f"CASE WHEN length(CAST({x} AS VARCHAR)) < {width} THEN lpad(CAST({x} AS VARCHAR), {width}, '0') ELSE CAST({x} AS VARCHAR) END"


def ewm_sql(rows: str, x: str, alpha: str, n: int, out: str, key: str = "ticker", order: str = "date") -> str:
    """Recursive mean as a weighted prefix sum over the non-null rows."""
    return f"""SELECT *, CASE WHEN {x} IS NOT NULL AND k_{out} >= {n}
      THEN pow(1 - {alpha}, k_{out} - 1) * sum(w_{out}) OVER (PARTITION BY {key} ORDER BY {order}) END AS {out}
    FROM (SELECT *, CASE WHEN k_{out} = 1 THEN {x} ELSE {alpha} * {x} END * pow(1 - {alpha}, -(k_{out} - 1)) AS w_{out}
      FROM (SELECT *, count({x}) OVER (PARTITION BY {key} ORDER BY {order}) AS k_{out} FROM {rows}))"""


def frame_ctes(b: str) -> None:
    """Signal frame CTEs over bars ``b``: {b}_weekly, {b}_wsig, {b}_rsi, {b}_frame, {b}_sess, {b}_next."""
    cte(
        f"{b}_weekly",
        f"""SELECT ticker, date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS week, arg_min("open", date) AS "open",
        max(high) AS high, min(low) AS low, arg_max("close", date) AS "close", sum(volume) AS volume
        FROM {b} GROUP BY ALL""",
        b,
    )
    cte(f"{b}_e12", ewm_sql(f"{b}_weekly", '"close"', "2.0/13", 12, "e12", order="week"), f"{b}_weekly")
    cte(f"{b}_e26", ewm_sql(f"{b}_e12", '"close"', "2.0/27", 26, "e26", order="week"), f"{b}_e12")
    cte(f"{b}_line", f"SELECT *, e12 - e26 AS weekly_macd FROM {b}_e26", f"{b}_e26")
    cte(f"{b}_sig", ewm_sql(f"{b}_line", "weekly_macd", "0.2", 9, "weekly_macd_signal", order="week"), f"{b}_line")
    cte(
        f"{b}_wsig",
        f"""SELECT ticker, week, "close", weekly_200ma, weekly_macd, weekly_macd_signal,
        coalesce("close" > weekly_200ma, false) AS weekly_above_200ma,
        coalesce(weekly_macd > weekly_macd_signal AND lag(weekly_macd) OVER w <= lag(weekly_macd_signal) OVER w, false) AS weekly_macd_gc,
        coalesce(weekly_macd > weekly_macd_signal, false) AS weekly_macd_uptrend
        FROM (SELECT *, CASE WHEN count(*) OVER v >= 200 THEN avg("close") OVER v END AS weekly_200ma FROM {b}_sig
              WINDOW v AS (PARTITION BY ticker ORDER BY week ROWS 199 PRECEDING))
        WINDOW w AS (PARTITION BY ticker ORDER BY week)""",
        f"{b}_sig",
    )
    cte(
        f"{b}_step",
        f"""SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS gain, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS loss
        FROM (SELECT *, "close" - lag("close") OVER (PARTITION BY ticker ORDER BY date) AS d FROM {b})""",
        b,
    )
    cte(f"{b}_ag", ewm_sql(f"{b}_step", "gain", "1.0/14", 14, "ag"), f"{b}_step")
    cte(f"{b}_al", ewm_sql(f"{b}_ag", "loss", "1.0/14", 14, "al"), f"{b}_ag")
    cte(
        f"{b}_rsi",
        f"""SELECT ticker, date, "open", high, low, "close", volume, va,
        CASE WHEN al > 0 THEN 100 - 100 / (1 + ag / al) WHEN al = 0 AND ag > 0 THEN 100.0 END AS daily_rsi,
        CASE WHEN count(volume) OVER v >= 30 THEN avg(volume) OVER v END AS volume_30ma,
        CASE WHEN count(va) OVER m >= 60 THEN quantile_cont(va, 0.5) OVER m END AS median_va_60
        FROM {b}_al WINDOW v AS (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING),
                           m AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)""",
        f"{b}_al",
    )
    cte(
        f"{b}_frame",
        f"""SELECT *, weekly_200ma IS NOT NULL AND weekly_macd IS NOT NULL AND weekly_macd_signal IS NOT NULL
          AND daily_rsi IS NOT NULL AND volume_30ma IS NOT NULL AS indicator_ready,
          weekly_200ma IS NOT NULL AND weekly_macd IS NOT NULL AND weekly_macd_signal IS NOT NULL
          AND daily_rsi IS NOT NULL AND volume_30ma IS NOT NULL AND score >= 90 AS entry_signal
        FROM (SELECT *, CAST(30 * weekly_above_200ma::INT + 30 * weekly_macd_gc::INT + 20 * weekly_macd_uptrend::INT
            + 20 * daily_rsi_40_65::INT + 20 * daily_volume_1_5x::INT AS BIGINT) AS score,
          CAST(weekly_above_200ma::INT + 2 * weekly_macd_gc::INT + 4 * weekly_macd_uptrend::INT
            + 8 * daily_rsi_40_65::INT + 16 * daily_volume_1_5x::INT AS BIGINT) AS bitmask
        FROM (SELECT r.*, w.weekly_200ma, w.weekly_macd, w.weekly_macd_signal,
            coalesce(w.weekly_above_200ma, false) AS weekly_above_200ma, coalesce(w.weekly_macd_gc, false) AS weekly_macd_gc,
            coalesce(w.weekly_macd_uptrend, false) AS weekly_macd_uptrend,
            coalesce(daily_rsi BETWEEN 40 AND 65, false) AS daily_rsi_40_65,
            coalesce(volume >= volume_30ma * 1.5, false) AS daily_volume_1_5x
          FROM {b}_rsi r ASOF LEFT JOIN {b}_wsig w ON r.ticker = w.ticker AND r.date >= w.week))""",
        f"{b}_rsi",
        f"{b}_wsig",
    )
    cte(
        f"{b}_sess",
        f"SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM {b})",
        b,
    )
    cte(f"{b}_next", f"SELECT date, lead(date) OVER (ORDER BY date) AS nxt, i FROM {b}_sess", f"{b}_sess")
    cte(f"{b}_seq", f"SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS seq FROM {b}", b)
    cte(
        f"{b}_signals",
        f"""SELECT ticker, date AS signal_date, score, bitmask, coalesce(median_va_60, 0) AS median_va_60, weekly_above_200ma,
        weekly_macd_gc, weekly_macd_uptrend, daily_rsi_40_65, daily_volume_1_5x FROM {b}_frame WHERE entry_signal""",
        f"{b}_frame",
    )


frame_ctes("unit")
frame_ctes("idx")


# --- fixed-universe study over index bars -------------------------------------------------
cte(
    "win",
    """SELECT greatest((SELECT max(f) FROM (SELECT min(date) f FROM idx GROUP BY ticker)),
      (SELECT max(r) FROM (SELECT min(date) r FROM idx_frame WHERE indicator_ready GROUP BY ticker))) AS s,
      (SELECT min(l) FROM (SELECT max(date) l FROM idx GROUP BY ticker)) AS e""",
    "idx_frame",
)
cte(
    "wsess",
    """SELECT date, lead(date) OVER (ORDER BY date) AS nxt, row_number() OVER (ORDER BY date) - 1 AS i
    FROM (SELECT DISTINCT date FROM idx, win WHERE date BETWEEN s AND e)""",
    "win",
)
cte(
    "wbars",
    """SELECT idx.*, row_number() OVER (PARTITION BY ticker ORDER BY date) AS seq FROM idx, win WHERE date BETWEEN s AND e""",
    "win",
)
cte(
    "wsignals",
    """SELECT g.*, coalesce(m.name, '') AS name, coalesce(m.sector, '') AS sector FROM idx_signals g
    JOIN win ON g.signal_date BETWEEN s AND e LEFT JOIN meta m USING (ticker)""",
    "win",
    "idx_signals",
    "meta",
)
cte(
    "scen",
    """SELECT * FROM (VALUES ('zero:conservative', 0.0, 0.0, true), ('basic:conservative', 0.001, 0.001, true),
    ('strict:conservative', 0.003, 0.002, true), ('basic:optimistic', 0.001, 0.001, false)) t(scenario, slip, comm, stop_first)""",
)


def fills_sql(signals: str, sess: str, bars: str, scen: str, ids: str = "ticker, signal_date", gap_on_entry: bool = True) -> str:
    """One row per (signal, scenario) with entry, first exit and returns."""
    gap = "true" if gap_on_entry else "off > 0"
    return f"""
    SELECT p.*, k.scenario, k.slip, k.comm, f.* EXCLUDE ({ids}, scenario),
      CASE WHEN entry_status = 'filled' THEN hit IS NOT NULL END AS is_closed,
      CASE WHEN hit IS NOT NULL THEN hit_date ELSE last_date END AS exit_date,
      CASE WHEN hit IS NOT NULL THEN hit_raw ELSE last_close END AS exit_raw_price,
      CAST(CASE WHEN hit IS NOT NULL THEN hit + 1 ELSE bars END AS BIGINT) AS holding_sessions,
      CASE WHEN hit IS NOT NULL THEN hit_reason WHEN bars IS NOT NULL THEN 'open_at_data_end' END AS exit_reason,
      (CASE WHEN hit IS NOT NULL THEN hit_raw ELSE last_close END) * (1 - slip) AS exit_fill_price,
      (CASE WHEN hit IS NOT NULL THEN hit_raw ELSE last_close END) * (1 - slip) * (1 - comm) / (entry_fill_price * (1 + comm)) - 1 AS net_return_pct,
      (CASE WHEN hit IS NOT NULL THEN hit_raw ELSE last_close END) / entry_raw_open - 1 AS gross_return_pct
    FROM (SELECT g.*, s.nxt AS entry_date, b.seq AS entry_seq, b."open" AS entry_raw_open,
            CASE WHEN s.nxt IS NULL THEN 'data_end' WHEN b.seq IS NULL THEN 'missing_next_session' ELSE 'filled' END AS entry_status
          FROM {signals} g LEFT JOIN {sess} s ON g.signal_date = s.date LEFT JOIN {bars} b ON g.ticker = b.ticker AND b.date = s.nxt) p
    CROSS JOIN {scen} k
    LEFT JOIN (
      SELECT {ids}, scenario, min(off) FILTER (reason IS NOT NULL) AS hit, arg_min(date, off) FILTER (reason IS NOT NULL) AS hit_date,
        arg_min(reason, off) FILTER (reason IS NOT NULL) AS hit_reason, arg_min(raw, off) FILTER (reason IS NOT NULL) AS hit_raw,
        max(date) AS last_date, arg_max(c, off) AS last_close, count(*) AS bars, max(fill) AS entry_fill_price
      FROM (SELECT *, CASE reason WHEN 'stop_gap' THEN o WHEN 'take_profit_gap' THEN o WHEN 'stop_loss' THEN fill * 0.9
              WHEN 'stop_and_take_same_day_stop_first' THEN fill * 0.9 WHEN 'max_holding' THEN c ELSE fill * 1.3 END AS raw
        FROM (SELECT *, CASE WHEN {gap} AND o <= fill * 0.9 THEN 'stop_gap' WHEN {gap} AND o >= fill * 1.3 THEN 'take_profit_gap'
            WHEN l <= fill * 0.9 AND h >= fill * 1.3 THEN CASE WHEN stop_first THEN 'stop_and_take_same_day_stop_first' ELSE 'stop_and_take_same_day_take_first' END
            WHEN l <= fill * 0.9 THEN 'stop_loss' WHEN h >= fill * 1.3 THEN 'take_profit' WHEN off >= 59 THEN 'max_holding' END AS reason
          FROM (SELECT g.*, q.scenario, q.slip, q.comm, q.stop_first, b.date, b."open" o, b.high h, b.low l, b."close" c, b.seq - e.seq AS off,
                  e."open" * (1 + q.slip) AS fill
                FROM {signals} g JOIN {sess} s ON g.signal_date = s.date JOIN {bars} e ON g.ticker = e.ticker AND e.date = s.nxt
                JOIN {bars} b ON b.ticker = g.ticker AND b.seq BETWEEN e.seq AND e.seq + 59 CROSS JOIN {scen} q)))
      GROUP BY ALL) f ON {' AND '.join(f'p.{i} = f.{i}' for i in ids.split(', '))} AND f.scenario = k.scenario"""


cte("fills", fills_sql("wsignals", "wsess", "wbars", "scen"), "wsignals", "wsess", "wbars", "scen")


def chain_ctes(name: str, fills: str, keys: str, order: str = "signal_date") -> None:
    """Sequential choice per key: {name}_link gives each signal its successor, {name} walks it."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ka = ", ".join(f"a.{k}" for k in keys.split(", "))
    cte(
        f"{name}_first",
        f"""SELECT {keys}, signal_date, ticker AS who, CASE WHEN is_closed THEN exit_date ELSE DATE '9999-12-31' END AS resume
        FROM {fills} WHERE entry_status = 'filled'
        QUALIFY row_number() OVER (PARTITION BY {keys}, signal_date ORDER BY {order}) = 1""",
        fills,
    )
    cte(
        f"{name}_link",
        f"""SELECT a.*, b.signal_date AS succ FROM {name}_first a ASOF LEFT JOIN {name}_first b ON {on} AND a.resume <= b.signal_date""",
        f"{name}_first",
    )
    cte(
        f"rec_{name}",
        f"""SELECT {keys}, signal_date, who, resume, succ, 1 AS n FROM {name}_link
        WHERE ({keys}, signal_date) IN (SELECT {keys}, min(signal_date) FROM {name}_link GROUP BY {keys})
        UNION ALL
        SELECT {ka}, a.signal_date, a.who, a.resume, a.succ, b.n + 1 FROM {name}_link a JOIN {name} b ON {on} AND a.signal_date = b.succ""",
        f"{name}_link",
    )


chain_ctes("chain", "fills", "scenario, ticker")
cte(
    "statuses",
    """SELECT f.*, CASE WHEN c.signal_date = f.signal_date THEN 'accepted' WHEN f.signal_date < c.resume THEN 'skipped_while_open'
      ELSE f.entry_status END AS status, CASE WHEN c.signal_date = f.signal_date THEN c.n END AS trade_seq
    FROM fills f ASOF LEFT JOIN chain c ON f.scenario = c.scenario AND f.ticker = c.ticker AND f.signal_date >= c.signal_date""",
    "rec_chain",
)
cte("trades", "SELECT * FROM statuses WHERE status = 'accepted'", "statuses")
cte("ptrades", "SELECT * FROM trades WHERE scenario = 'basic:conservative'", "trades")


# Marks by day through an as-of join; sums per day give the curve.
cte(
    "marks",
    """SELECT t.scenario, s.date, t.ticker, t.signal_date,
      CASE WHEN s.date >= t.exit_date THEN t.exit_fill_price * (1 - t.comm) ELSE b."close" END / (t.entry_fill_price * (1 + t.comm)) - 1 AS mark,
      s.date <= t.exit_date AS active
    FROM (SELECT t.*, s.date AS day FROM trades t JOIN wsess s ON s.date >= t.entry_date) t
    JOIN wsess s ON s.date = t.day ASOF JOIN wbars b ON t.ticker = b.ticker AND t.day >= b.date""",
    "trades",
)
cte(
    "curve",
    """SELECT scenario, date, 1 + total / capacity AS equity, active_positions, CAST(capacity AS BIGINT) AS capacity,
      active_positions / capacity AS exposure
    FROM (SELECT *, greatest(1, max(active_positions) OVER (PARTITION BY scenario)) AS capacity FROM (
      SELECT a.scenario, a.date, coalesce(total, 0) AS total, coalesce(n, 0) AS active_positions
      FROM (SELECT * FROM (SELECT DISTINCT scenario FROM trades), (SELECT date FROM wsess)) a
      LEFT JOIN (SELECT scenario, date, sum(mark) AS total, count(*) FILTER (active) AS n FROM marks GROUP BY ALL) m USING (scenario, date)))""",
    "marks",
)


def tstats(src: str, dims: str, key: str = "ticker") -> str:
    """Trade statistics per group of ``src``."""
    g = f"{dims}, " if dims else ""
    p = f"PARTITION BY {g}is_closed"
    order = f"ORDER BY exit_date, {key}, signal_date"
    by = f"GROUP BY {dims}" if dims else ""
    return f"""SELECT {g}count(*) AS trade_count, count(*) FILTER (is_closed) AS closed_trade_count,
      count(*) FILTER (NOT is_closed) AS open_trade_count, avg(CAST(r > 0 AS INT)) AS win_rate, avg(r) FILTER (r > 0) AS average_win,
      avg(r) FILTER (r < 0) AS average_loss, avg(r) FILTER (r > 0) / nullif(abs(avg(r) FILTER (r < 0)), 0) AS payoff_ratio,
      avg(r) AS expectancy_per_trade, coalesce(sum(r) FILTER (r > 0), 0) / nullif(coalesce(-sum(r) FILTER (r < 0), 0), 0) AS profit_factor,
      coalesce(max(run), 0) AS max_consecutive_losses, avg(holding_sessions) FILTER (is_closed) AS average_holding_sessions,
      quantile_cont(holding_sessions, 0.5) FILTER (is_closed) AS median_holding_sessions, coalesce(sum(r), 0) AS sum_net_returns
    FROM (SELECT *, CASE WHEN is_closed THEN net_return_pct END AS r,
        CASE WHEN is_closed AND net_return_pct < 0 THEN row_number() OVER ({p}, isl, net_return_pct < 0 {order}) END AS run
      FROM (SELECT *, sum(CASE WHEN net_return_pct < 0 THEN 0 ELSE 1 END) OVER ({p} {order}) AS isl FROM {src})) {by}"""


TSTATS_DBL = (
    "win_rate average_win average_loss payoff_ratio expectancy_per_trade profit_factor average_holding_sessions "
    "median_holding_sessions sum_net_returns"
)


def cstats(src: str, dims: str) -> str:
    """Curve statistics per group of ``src``."""
    return f"""SELECT {dims}, l / f - 1 AS total_return, cagr, maximum_drawdown, cagr / nullif(abs(maximum_drawdown), 0) AS calmar_ratio,
      market_exposure, maximum_concurrent_positions
    FROM (SELECT *, CASE WHEN n >= 2 AND f > 0 AND l >= 0 AND days > 0 THEN pow(l / f, 365.2425 / days) - 1 END AS cagr
      FROM (SELECT {dims}, count(*) n, arg_min(equity, date) f, arg_max(equity, date) l, date_diff('day', min(date), max(date)) AS days,
          min(equity / peak - 1) AS maximum_drawdown, avg(exposure) AS market_exposure,
          CAST(max(active_positions) AS BIGINT) AS maximum_concurrent_positions
        FROM (SELECT *, max(equity) OVER (PARTITION BY {dims} ORDER BY date) AS peak FROM {src}) GROUP BY {dims}))"""


CSTATS_DBL = "total_return cagr maximum_drawdown calmar_ratio market_exposure"

cte(
    "splits",
    """SELECT split, min(date) AS "start", max(date) AS "end", count(*) AS sessions FROM (
      SELECT date, CASE WHEN i <= floor(n * 0.6) - 1 THEN 'development' WHEN i <= floor(n * 0.8) - 1 THEN 'validation'
        ELSE 'final_holdout' END AS split FROM (SELECT date, i, count(*) OVER () AS n FROM wsess)) GROUP BY split""",
    "wsess",
)


# --- point-in-time universes, slot ledger and diagnostics ---------------------------------
cte(
    "sched",
    """SELECT y.year, s.i AS sel, s.date AS selection_date, c.date AS cutoff_date, a.date AS short_start, b.date AS long_start
    FROM (SELECT CAST(year(date) AS INT) AS year, min(i) AS i FROM idx_sess WHERE month(date) = 4 GROUP BY 1) y
    JOIN idx_sess s USING (i) JOIN idx_sess c ON c.i = y.i - 1 JOIN idx_sess a ON a.i = y.i - 60 JOIN idx_sess b ON b.i = y.i - 252""",
    "idx_sess",
)
cte(
    "facts",
    """SELECT s.year, b.ticker, s.cutoff_date, s.selection_date, count(*) / 252.0 AS completeness,
      max(b."close") FILTER (b.date = s.cutoff_date) AS raw_close, quantile_cont(va, 0.5) FILTER (d.i >= s.sel - 60) AS liquidity,
      any_value(f.first_date) AS first_date
    FROM sched s JOIN idx_sess d ON d.i BETWEEN s.sel - 252 AND s.sel - 1 JOIN idx b ON b.date = d.date
    JOIN (SELECT ticker, min(date) AS first_date FROM idx GROUP BY 1) f ON f.ticker = b.ticker GROUP BY ALL""",
    "sched",
)
cte(
    "rules",
    """SELECT * FROM (VALUES ('liquid50', 50, 3, 45000.0, 300.0, 0.15, 12), ('liquid100', 100, 6, 30000.0, 300.0, 0.10, 12))
    t(universe, target, cap, min_liquidity, min_close, min_completeness, months)""",
)
cte(
    "cands",
    """SELECT r.universe, r.target, r.cap, f.*, m.sector FROM facts f CROSS JOIN rules r JOIN meta m USING (ticker)
    WHERE first_date + to_months(r.months) <= cutoff_date AND completeness >= min_completeness AND raw_close >= min_close
      AND liquidity >= min_liquidity""",
    "facts",
    "rules",
    "meta",
)
cte(
    "members",
    """SELECT universe, year, ticker, sector, liquidity, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY universe, year ORDER BY liquidity DESC, ticker) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY universe, year, sector ORDER BY liquidity DESC, ticker) AS sr FROM cands) WHERE sr <= cap)
    WHERE rank <= target""",
    "cands",
)
cte(
    "yos",
    """SELECT d.date, (SELECT max(year) FROM sched s WHERE s.selection_date <= d.date) AS year FROM idx_sess d""",
    "sched",
)
cte("static", "SELECT 'static' AS universe, ticker FROM meta WHERE region = 'ASIA'", "meta")


def member_sql(rows: str, day: str) -> str:
    return f"""SELECT m.universe, r.* FROM {rows} r JOIN yos y ON y.date = r.{day} JOIN members m ON m.year = y.year AND m.ticker = r.ticker
    UNION ALL SELECT s.universe, r.* FROM {rows} r JOIN static s USING (ticker)"""


cte(
    "usignals",
    f"""SELECT u.*, CASE WHEN m.region = 'ASIA' THEN 'STATIC_CODE' ELSE 'ADDED_CODE' END AS origin_group
    FROM ({member_sql("wsignals", "signal_date")}) u JOIN meta m USING (ticker)""",
    "wsignals", "yos", "members", "static", "meta",
)
cte("pscen", "SELECT 'basic:conservative' AS scenario, 0.001 AS slip, 0.001 AS comm, true AS stop_first")
cte(
    "ufills",
    fills_sql("usignals", "wsess", "wbars", "pscen", "universe, ticker, signal_date", gap_on_entry=False),
    "usignals", "wsess", "wbars", "pscen",
)
EXIT_GROUP = """CASE WHEN exit_reason IN ('stop_loss', 'stop_and_take_same_day_stop_first') THEN 'stop_loss'
      WHEN exit_reason IN ('take_profit', 'stop_and_take_same_day_take_first') THEN 'take_profit'
      WHEN exit_reason IN ('stop_gap', 'take_profit_gap', 'max_holding') THEN exit_reason
      WHEN exit_reason LIKE 'premature_data_end%' THEN 'data_end_or_haircut' ELSE 'other' END"""
cte(
    "uexits",
    """SELECT * EXCLUDE (premature, raw, last_raw), CASE WHEN premature OR NOT closed0 THEN (SELECT e FROM win) ELSE exit0 END AS exit_date, closed0 OR premature AS is_closed,
      raw AS exit_raw_price, CASE WHEN closed0 OR premature THEN raw * (1 - slip) ELSE raw END AS exit_fill_price,
      CASE WHEN premature THEN 'premature_data_end_haircut' WHEN NOT closed0 THEN 'open_at_frozen_end' ELSE reason0 END AS exit_reason,
      (CASE WHEN closed0 OR premature THEN raw * (1 - slip) ELSE raw END) * (1 - comm) / (entry_fill_price * (1 + comm)) - 1 AS net_return_pct
    FROM (SELECT *, CASE WHEN premature THEN last_raw * 0.8 ELSE last_raw END AS raw FROM (
      SELECT * EXCLUDE (is_closed, exit_date, exit_raw_price, exit_reason, exit_fill_price, net_return_pct), is_closed AS closed0, exit_date AS exit0,
        exit_reason AS reason0, exit_raw_price AS last_raw, NOT is_closed AND exit_date < (SELECT e FROM win) AS premature,
        CAST(ticker AS BIGINT) % 10 AS slot FROM ufills))""",
    "ufills",
)
cte(
    "ushadow",
    f"""SELECT *, {EXIT_GROUP} AS normalized_exit_reason, CAST({EXIT_GROUP} IN ('stop_loss', 'stop_gap')
        OR ({EXIT_GROUP} = 'max_holding' AND coalesce(net_return_pct < 0, false)) AS DOUBLE) AS negative_exit_burden
    FROM (SELECT x.* EXCLUDE (is_closed, net_return_pct, exit_reason, exit_date), q.* EXCLUDE (universe, ticker, signal_date),
        CASE WHEN entry_status <> 'filled' THEN 'MISSING_NEXT_SESSION' WHEN is_closed THEN 'COMPLETE' ELSE 'RIGHT_CENSORED' END AS shadow_status,
        coalesce(is_closed, false) AS is_closed, CASE WHEN is_closed THEN net_return_pct END AS net_return_pct,
        CASE WHEN entry_status = 'filled' THEN exit_reason END AS exit_reason,
        CASE WHEN entry_status = 'filled' THEN CASE WHEN exit_reason = 'premature_data_end_haircut' THEN (SELECT e FROM win) ELSE exit_date END END AS exit_date
      FROM uexits x LEFT JOIN (
        SELECT universe, ticker, signal_date, greatest(max(ph / cash - 1), 0) AS mfe, least(min(pl / cash - 1), 0) AS mae,
          max(c / cash - 1) FILTER (off = 9 AND ok) AS horizon_10, max(c / cash - 1) FILTER (off = 19 AND ok) AS horizon_20,
          max(c / cash - 1) FILTER (off = 39 AND ok) AS horizon_40, max(c / cash - 1) FILTER (off = 59 AND ok) AS horizon_60
        FROM (SELECT x.universe, x.ticker, x.signal_date, x.entry_fill_price * 1.001 AS cash, b."close" AS c, b.seq - x.entry_seq AS off,
            CASE WHEN b.seq - x.entry_seq = hit AND hit_reason LIKE '%gap' THEN b."open"
              WHEN b.seq - x.entry_seq = hit AND hit_reason <> 'max_holding' THEN greatest(b."open", hit_raw) ELSE b.high END AS ph,
            CASE WHEN b.seq - x.entry_seq = hit AND hit_reason LIKE '%gap' THEN b."open"
              WHEN b.seq - x.entry_seq = hit AND hit_reason IN ('stop_loss', 'stop_and_take_same_day_stop_first') THEN hit_raw ELSE b.low END AS pl,
            hit IS NULL OR b.seq - x.entry_seq < hit OR hit_reason = 'max_holding' AS ok
          FROM uexits x JOIN wbars b ON b.ticker = x.ticker AND b.seq BETWEEN x.entry_seq AND x.entry_seq + coalesce(hit, 59)) GROUP BY ALL) q
      ON x.universe = q.universe AND x.ticker = q.ticker AND x.signal_date = q.signal_date)""",
    "uexits", "wbars",
)
chain_ctes("lchain", "uexits", "universe, slot", "ticker")
cte(
    "ledger",
    """SELECT x.*, 1000000.0 / (entry_fill_price * 1.001) AS shares FROM uexits x JOIN lchain c
    ON x.universe = c.universe AND x.slot = c.slot AND x.signal_date = c.signal_date AND x.ticker = c.who""",
    "rec_lchain",
)
cte(
    "days",
    f"""SELECT *, shares * (mark - coalesce(lag(mark) OVER (PARTITION BY universe, ticker, signal_date ORDER BY date), cash_in)) AS pnl_jpy,
      {EXIT_GROUP} AS trade_exit_reason
    FROM (SELECT t.*, CASE WHEN leaving THEN exit_fill_price * 0.999 ELSE b."close" END AS mark FROM (
        SELECT l.*, s.date, is_closed AND s.date = exit_date AS leaving, entry_fill_price * 1.001 AS cash_in
        FROM ledger l JOIN wsess s ON s.date BETWEEN entry_date AND exit_date) t
      ASOF JOIN wbars b ON b.ticker = t.ticker AND t.date >= b.date)""",
    "ledger", "wbars", "wsess",
)
cte(
    "ucurve",
    """SELECT universe, date, equity, equity - value AS cash, active_positions, CASE WHEN equity > 0 THEN value / equity END AS cash_utilization FROM (
      SELECT a.universe, a.date, 1e7 + sum(coalesce(pnl, 0)) OVER (PARTITION BY a.universe ORDER BY a.date) AS equity, coalesce(value, 0) AS value,
        coalesce(n, 0) AS active_positions
      FROM (SELECT * FROM (SELECT DISTINCT universe FROM days), (SELECT date FROM wsess)) a LEFT JOIN (
        SELECT universe, date, sum(pnl_jpy) AS pnl, coalesce(sum(shares * mark) FILTER (NOT leaving), 0) AS value, count(*) FILTER (NOT leaving) AS n
        FROM days GROUP BY ALL) d USING (universe, date))
    UNION ALL SELECT universe, (SELECT min(date) - 1 FROM wsess), 1e7, 1e7, 0, 0 FROM (SELECT DISTINCT universe FROM days)""",
    "days",
)
cte(
    "decisions",
    """SELECT * EXCLUDE (dup, held, taken, valid, used, hn, sched_ok), coalesce(sched_ok AND bool_or(disposition = 'capacity_rejected' AND sched_ok)
      OVER (PARTITION BY universe, entry_date), false) AS capacity_binding_session
    FROM (SELECT *, CASE WHEN entry_date IS NULL THEN 'missing_next_session' WHEN dup OR held THEN 'duplicate_rejected' WHEN taken THEN 'accepted'
        WHEN used >= 10 THEN 'capacity_rejected' WHEN NOT valid THEN 'missing_next_session' ELSE 'capacity_rejected' END AS disposition
      FROM (SELECT *, hn + coalesce(sum(CASE WHEN sched_ok AND NOT held AND taken THEN 1 ELSE 0 END) OVER (PARTITION BY universe, entry_date
            ORDER BY score DESC, median_va_60 DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
        FROM (SELECT *, entry_date IS NOT NULL AND NOT dup AS sched_ok FROM (
          SELECT g.*, s.nxt AS entry_date,
            EXISTS (SELECT 1 FROM ledger l WHERE l.universe = g.universe AND l.ticker = g.ticker AND l.entry_date <= g.signal_date AND l.exit_date > g.signal_date) AS dup,
            EXISTS (SELECT 1 FROM ledger l WHERE l.universe = g.universe AND l.ticker = g.ticker AND l.entry_date < s.nxt
              AND (l.exit_date > s.nxt OR (l.exit_date = s.nxt AND l.exit_reason NOT LIKE '%gap'))) AS held,
            EXISTS (SELECT 1 FROM ledger l WHERE l.universe = g.universe AND l.ticker = g.ticker AND l.signal_date = g.signal_date) AS taken,
            EXISTS (SELECT 1 FROM wbars b WHERE b.ticker = g.ticker AND b.date = s.nxt) AS valid,
            (SELECT count(*) FROM ledger l WHERE l.universe = g.universe AND l.entry_date < s.nxt
              AND (l.exit_date > s.nxt OR (l.exit_date = s.nxt AND l.exit_reason NOT LIKE '%gap'))) AS hn
          FROM usignals g LEFT JOIN wsess s ON s.date = g.signal_date))))""",
    "usignals", "ledger",
)
cte(
    "accepted",
    f"""SELECT l.universe, l.ticker, l.signal_date, l.entry_date, l.exit_date, l.score, l.sector, l.exit_reason, l.holding_sessions, l.net_return_pct,
      l.is_closed, l.shares, g.bitmask, g.origin_group, s.shadow_status, s.mfe, s.mae, s.horizon_10, s.horizon_20, s.horizon_40, s.horizon_60,
      {EXIT_GROUP.replace("exit_reason", "l.exit_reason")} AS normalized_exit_reason, s.negative_exit_burden,
      l.shares * (l.exit_fill_price * 0.999 - l.entry_fill_price * 1.001) AS net_pnl_jpy
    FROM ledger l JOIN usignals g ON g.universe = l.universe AND g.ticker = l.ticker AND g.signal_date = l.signal_date
    JOIN ushadow s ON s.universe = l.universe AND s.ticker = l.ticker AND s.signal_date = l.signal_date""",
    "ledger", "ushadow",
)
cte(
    "quality",
    """SELECT d.*, s.shadow_status, s.exit_date, s.holding_sessions, s.mfe, s.mae, s.horizon_10, s.is_closed, s.net_return_pct, s.exit_reason,
      s.normalized_exit_reason, s.negative_exit_burden FROM decisions d JOIN ushadow s
      ON s.universe = d.universe AND s.ticker = d.ticker AND s.signal_date = d.signal_date""",
    "decisions", "ushadow",
)
cte("frets", """SELECT ticker, date, "close", weekly_above_200ma, weekly_macd_uptrend, "close" / lag("close") OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM idx_frame""", "idx_frame")
cte(
    "regime",
    f"""SELECT c.universe, c.date, c.cash_utilization, c.active_positions, c.equity, coalesce(n, 0) AS active_member_count, above_share, uptrend_share,
      median_return, return_std, coalesce(sn, 0) AS raw_signal_count, coalesce(accepted_count, 0) AS accepted_count,
      coalesce(capacity_rejected_count, 0) AS capacity_rejected_count, coalesce(duplicate_rejected_count, 0) AS duplicate_rejected_count,
      coalesce(missing_next_session_count, 0) AS missing_next_session_count, coalesce(invalid_bar_count, 0) AS invalid_bar_count,
      coalesce(sn, 0) / nullif(coalesce(n, 0), 0) AS signal_breadth
    FROM ucurve c JOIN wsess USING (date)
    LEFT JOIN (SELECT universe, date, count(*) n, avg(weekly_above_200ma::INT) AS above_share, avg(weekly_macd_uptrend::INT) AS uptrend_share,
        quantile_cont(ret, 0.5) AS median_return, stddev_pop(ret) AS return_std FROM ({member_sql("frets", "date")}) GROUP BY ALL) m USING (universe, date)
    LEFT JOIN (SELECT universe, signal_date AS date, count(*) sn FROM usignals GROUP BY ALL) g USING (universe, date)
    LEFT JOIN (SELECT universe, entry_date AS date, count(*) FILTER (disposition = 'accepted') AS accepted_count,
        count(*) FILTER (disposition = 'capacity_rejected') AS capacity_rejected_count, count(*) FILTER (disposition = 'duplicate_rejected') AS duplicate_rejected_count,
        count(*) FILTER (disposition = 'missing_next_session') AS missing_next_session_count, count(*) FILTER (disposition = 'invalid_bar') AS invalid_bar_count
      FROM decisions GROUP BY ALL) d USING (universe, date)""",
    "ucurve", "frets", "decisions", "yos", "members", "static",
)
cte(
    "osplits",
    """SELECT split, "start", "end", sessions FROM splits UNION ALL SELECT 'overall', min("start"), max("end"), CAST(sum(sessions) AS BIGINT) FROM splits""",
    "splits",
)
cte("ucont", """SELECT a.*, p.split FROM accepted a JOIN osplits p ON signal_date BETWEEN p."start" AND p."end" AND entry_date >= p."start" AND exit_date <= p."end" """, "accepted", "osplits")
cte("qcont", """SELECT a.*, p.split FROM quality a JOIN osplits p ON signal_date BETWEEN p."start" AND p."end" AND entry_date >= p."start" AND exit_date <= p."end" """, "quality", "osplits")
cte("qcoh", """SELECT a.*, p.split FROM quality a JOIN osplits p ON signal_date BETWEEN p."start" AND p."end" """, "quality", "osplits")
cte("uanch", """SELECT c.*, p.split FROM ucurve c JOIN osplits p ON c.date BETWEEN p."start" AND p."end"
      OR c.date = (SELECT max(date) FROM ucurve d WHERE d.universe = c.universe AND d.date < p."start")""", "ucurve", "osplits")
cte(
    "episodes",
    """SELECT *, row_number() OVER (PARTITION BY universe ORDER BY drawdown, start_date, trough_date) AS episode_rank FROM (
      SELECT universe, min(date) AS start_date, arg_min(date, (equity, date)) FILTER (NOT top) AS trough_date,
        lead(min(date)) OVER (PARTITION BY universe ORDER BY isl) AS recovery_date, min(equity) FILTER (NOT top) / max(equity) FILTER (top) - 1 AS drawdown,
        min(equity) FILTER (NOT top) - max(equity) FILTER (top) AS equity_change_peak_to_trough
      FROM (SELECT *, sum(top::INT) OVER (PARTITION BY universe ORDER BY date) AS isl FROM (
        SELECT *, coalesce(equity >= max(equity) OVER (PARTITION BY universe ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS top FROM (SELECT * REPLACE (round(equity, 6) AS equity) FROM ucurve)))
      GROUP BY universe, isl) WHERE trough_date IS NOT NULL""",
    "ucurve",
)


def conc_sql(src: str, dims: str, bucket: str, prefix: str, top: str, hhi: str, distinct: str, weight: str = "1.0") -> str:
    return f"""SELECT {dims}, count(*) AS {prefix}{distinct}, max(w) / sum(w) AS {prefix}{top}, sum(w * w) / (sum(w) * sum(w)) AS {prefix}{hhi}
      FROM (SELECT {dims}, coalesce({bucket}, '') AS b, sum({weight}) AS w FROM {src} GROUP BY ALL) GROUP BY {dims}"""


def top_sql(src: str, dims: str, bucket: str, prefix: str, net: bool) -> str:
    inner = f"SELECT {dims}, CAST({bucket} AS VARCHAR) AS b, -sum(pnl_jpy) AS w FROM {src} {'' if net else 'WHERE pnl_jpy < 0'} GROUP BY ALL"
    return f"""SELECT {dims}, count(*) AS {prefix}_distinct_count, max(w) / sum(w) AS {prefix}_top_share, sum(w) FILTER (r <= 3) / sum(w) AS {prefix}_top3_share,
      sum(w * w) / (sum(w) * sum(w)) AS {prefix}_hhi FROM (SELECT *, row_number() OVER (PARTITION BY {dims} ORDER BY w DESC, b) AS r FROM ({inner}) WHERE w > 0)
      GROUP BY {dims}"""
