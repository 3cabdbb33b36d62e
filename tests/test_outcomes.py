"""Exits, selection, metrics, ranking and admission against literal loops and hand cases."""

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.config import PRIMARY, SCENARIOS, UniverseRule
from tidemark.operators import calendar as cal
from tidemark.operators import inference as inf
from tidemark.operators import ledger as led
from tidemark.operators import metrics as M
from tidemark.operators import outcomes as O
from tidemark.operators import paper as P
from tidemark.operators import universe as U
from tidemark.operators.diagnostics import exact_quantiles

D0 = dt.date(2020, 1, 1)


def price_frame(rows, ticker="a"):
    return pd.DataFrame(
        [{"ticker": ticker, "date": D0 + dt.timedelta(days=i), "open": float(o), "high": float(h), "low": float(l), "close": float(c), "volume": 1e6} for i, (o, h, l, c) in enumerate(rows)]
    )


def label(spark, pdf, days, scenarios=(PRIMARY,), **kw):
    bars = spark.createDataFrame(pdf)
    sig = spark.createDataFrame(pd.DataFrame({"ticker": pdf["ticker"].iloc[0], "signal_date": [D0 + dt.timedelta(days=d) for d in days], "score": 90}))
    return O.bracket_exits(sig, O.number_bars(bars), cal.market_dates(bars), scenarios, **kw)


def test_gap_stop_take_and_both(spark):
    flat = (100, 105, 95, 100)
    cases = {
        "stop_gap": [flat, flat, (85, 86, 84, 85)],
        "take_profit_gap": [flat, flat, (140, 141, 139, 140)],
        "stop_loss": [flat, flat, (100, 101, 80, 85)],
        "take_profit": [flat, flat, (100, 140, 99, 120)],
        "stop_and_take_same_day_stop_first": [flat, flat, (100, 140, 80, 100)],
    }
    for reason, rows in cases.items():
        r = label(spark, price_frame(rows), [0]).first()
        assert (r.exit_reason, r.holding_sessions, r.entry_date) == (reason, 2, D0 + dt.timedelta(days=1))
    both = label(spark, price_frame(cases["stop_and_take_same_day_stop_first"]), [0], SCENARIOS[3:]).first()
    assert both.exit_reason == "stop_and_take_same_day_take_first"


def test_sixtieth_session_and_costs(spark):
    r = label(spark, price_frame([(100, 105, 95, 100)] * 70), [0]).first()
    assert r.exit_reason == "max_holding" and r.holding_sessions == 60
    fill = 100 * 1.001
    assert math.isclose(r.net_return_pct, 100 * 0.999 * 0.999 / (fill * 1.001) - 1)
    open_end = label(spark, price_frame([(100, 105, 95, 100)] * 20), [0]).first()
    assert not open_end.is_closed and open_end.exit_reason == "open_at_data_end" and open_end.holding_sessions == 19


def test_signal_at_the_end_is_unfilled(spark):
    rows = {r.signal_date.day: r.entry_status for r in label(spark, price_frame([(100, 105, 95, 100)] * 3), [0, 2]).collect()}
    assert rows == {1: "filled", 3: "data_end"}


def test_selection_equals_literal_loop(spark):
    rng = np.random.default_rng(5)
    frames, sigs = [], []
    for t in "abc":
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 400)))
        o = close * np.exp(rng.normal(0, 0.01, 400))
        frames.append(pd.DataFrame({"ticker": t, "date": [D0 + dt.timedelta(days=i) for i in range(400)], "open": o, "high": np.maximum(o, close) * 1.01, "low": np.minimum(o, close) * 0.99, "close": close, "volume": 1.0}))
        sigs += [{"ticker": t, "signal_date": D0 + dt.timedelta(days=int(d)), "score": 90} for d in sorted(rng.choice(400, 60, replace=False))]
    bars = spark.createDataFrame(pd.concat(frames))
    labelled = O.bracket_exits(spark.createDataFrame(pd.DataFrame(sigs)), O.number_bars(bars), cal.market_dates(bars), [PRIMARY])
    exits = labelled.toPandas()
    got = O.select_non_overlapping(labelled, ["scenario", "ticker"]).toPandas()
    for t, part in exits.groupby("ticker"):
        free, want = dt.date(1, 1, 1), {}
        for r in part.sort_values("signal_date").itertuples():
            if r.signal_date < free:
                want[r.signal_date] = "skipped_while_open"
            elif r.entry_status != "filled":
                want[r.signal_date] = r.entry_status
            else:
                want[r.signal_date] = "accepted"
                free = r.exit_date if r.is_closed else dt.date(9999, 1, 1)
        have = dict(zip(got[got.ticker == t]["signal_date"], got[got.ticker == t]["status"]))
        assert have == want
        taken = got[(got.ticker == t) & (got.status == "accepted")].sort_values("signal_date")
        assert all(a <= b for a, b in zip(taken["exit_date"], taken["entry_date"][1:]))


def test_one_shot_excursions_and_horizons(spark):
    bars = spark.createDataFrame(price_frame([(100, 101, 99, 100)] * 65))
    sig = spark.createDataFrame(pd.DataFrame({"ticker": ["a"], "signal_date": [D0], "score": [90]}))
    r = O.one_shot_outcomes(sig, O.number_bars(bars), cal.market_dates(bars), PRIMARY).first()
    cash = 100 * 1.001 * 1.001
    assert r.shadow_status == "COMPLETE" and r.holding_sessions == 60 and r.exit_reason == "max_holding"
    assert math.isclose(r.mfe, 101 / cash - 1) and math.isclose(r.mae, 99 / cash - 1)
    assert all(math.isclose(r[f"horizon_{h}"], 100 / cash - 1) for h in (10, 20, 40, 60))


def test_trade_statistics_hand_case(spark):
    pdf = pd.DataFrame(
        {"g": 1, "ticker": list("abcd"), "is_closed": [True, True, True, False], "net_return_pct": [0.30, -0.10, -0.05, 0.02], "holding_sessions": [10, 20, 30, 5],
         "exit_date": [D0 + dt.timedelta(days=i) for i in range(4)], "signal_date": D0}
    )
    r = M.trade_stats(spark.createDataFrame(pdf), ["g"]).first()
    assert (r.trade_count, r.closed_trade_count, r.open_trade_count, r.max_consecutive_losses) == (4, 3, 1, 2)
    assert math.isclose(r.profit_factor, 2.0) and math.isclose(r.win_rate, 1 / 3) and math.isclose(r.payoff_ratio, 4.0) and r.average_holding_sessions == 20


def test_curve_statistics_hand_case(spark):
    pdf = pd.DataFrame({"g": 1, "date": [D0 + dt.timedelta(days=i) for i in range(4)], "equity": [1.0, 1.2, 0.9, 1.1], "active_positions": [0, 1, 2, 1], "exposure": [0, 0.5, 1, 0.5]})
    r = M.curve_stats(spark.createDataFrame(pdf), ["g"]).first()
    assert math.isclose(r.maximum_drawdown, -0.25) and math.isclose(r.total_return, 0.1) and r.maximum_concurrent_positions == 2


def test_drawdown_episodes_hand_case(spark):
    eq = [100, 90, 80, 101, 99, 70, 105, 103]
    pdf = pd.DataFrame({"universe": "u", "date": [D0 + dt.timedelta(days=i) for i in range(8)], "equity": [float(e) for e in eq]})
    rows = led.drawdown_episodes(spark.createDataFrame(pdf)).orderBy("episode_rank").collect()
    assert [r.start_date.day for r in rows] == [4, 1, 7] and math.isclose(rows[0].drawdown, 70 / 101 - 1)
    assert rows[2].recovery_date is None and rows[1].recovery_date.day == 4


def test_longest_gap_keeps_first_of_equal_runs(spark):
    days = pd.DataFrame({"date": [D0 + dt.timedelta(days=i) for i in range(10)]})
    sig = pd.DataFrame({"signal_date": [D0 + dt.timedelta(days=i) for i in (2, 5, 8)]})
    r = cal.longest_gap(spark.createDataFrame(days), spark.createDataFrame(sig)).first()
    assert (r.longest_no_signal_sessions, r.gap_start.day) == (2, 1)
    none = cal.longest_gap(spark.createDataFrame(days), spark.createDataFrame(days.rename(columns={"date": "signal_date"}))).first()
    assert none.longest_no_signal_sessions == 0 and none.gap_start is None


def test_sector_cap_equals_greedy(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"ticker": [f"{i:03d}" for i in range(80)], "sector": rng.integers(0, 6, 80).astype(str), "liquidity": rng.integers(1, 30, 80).astype(float)})
    rule = UniverseRule("u", 20, 4, 0.0)
    df = spark.createDataFrame(pdf.assign(universe="u", year=2000, target=20, cap=4))
    got = {r.ticker for r in U.sector_capped_top(df, [rule]).collect()}
    want, used = [], {}
    for r in pdf.sort_values(["liquidity", "ticker"], ascending=[False, True]).itertuples():
        if used.get(r.sector, 0) < 4 and len(want) < 20:
            want.append(r.ticker)
            used[r.sector] = used.get(r.sector, 0) + 1
    assert got == set(want)


def test_admission_equals_literal_loop(spark):
    rng = np.random.default_rng(9)
    n, as_of = 400, dt.date(2020, 3, 1)
    pend = pd.DataFrame({"account": rng.choice(["x", "y", "z"], n), "pos": np.arange(n), "ticker": rng.integers(0, 25, n).astype(str),
                         "signal_date": [as_of - dt.timedelta(days=int(d)) for d in rng.integers(-2, 5, n)], "status": rng.choice(["", "pending", "cancelled", "waiting_price"], n)})
    held = pd.DataFrame({"account": ["x", "x", "y"], "ticker": ["1", "2", "3"]})
    bars = pd.DataFrame({"ticker": [str(i) for i in range(15)], "date": as_of, "open": 100.0 + np.arange(15)})
    acc = pd.DataFrame({"account": ["x", "y", "z"], "cash": [2_000_000.0, 1_200_000.0, 9e6], "realized_pnl": 0.0})
    got = P.admit_pending(*[spark.createDataFrame(d) for d in (pend, held, bars, acc)], F.lit(as_of)).toPandas().sort_values("pos")["new_status"].tolist()
    own = {a: set(held[held.account == a].ticker) for a in "xyz"}
    cash, want = dict(zip(acc.account, acc.cash)), []
    prices = set(bars.ticker)
    for r in pend.itertuples():
        if r.status not in ("", "pending", "waiting_capacity", "waiting_price") or r.signal_date >= as_of:
            want.append(r.status)
        elif r.ticker in own[r.account]:
            want.append("skipped_already_held")
        elif len(own[r.account]) >= 6 or cash[r.account] < 500_000:
            want.append("waiting_capacity")
        elif r.ticker not in prices:
            want.append("waiting_price")
        else:
            want.append("executed")
            own[r.account].add(r.ticker)
            cash[r.account] -= 500_000
    assert got == want


def arms(spark, left, right, seed=None):
    rng = np.random.default_rng(seed or 0)
    rows = []
    for arm, v in (("left", left), ("right", right)):
        for m in range(1, 13):
            for i in range(4):
                x = v if seed is None else v + rng.normal(0, 0.05)
                rows.append({"hypothesis": "B_CAPACITY_PRIORITY", "universe": "u", "split": "validation", "arm": arm, "ticker": str(i), "sector": str(i % 2),
                             "signal_date": dt.date(2020, m, 10 + i), "is_closed": True, "value": float(x)})
    return spark.createDataFrame(pd.DataFrame(rows))


def test_bootstrap_of_constant_arms_is_exact(spark):
    r = inf.cluster_bootstrap(inf.monthly_sums(arms(spark, 0.05, 0.02)), inf.Policy(replicates=500)).first()
    assert r.status == "SUFFICIENT" and r.direction_stable
    assert all(math.isclose(v, 0.03, abs_tol=1e-12) for v in (r.observed_difference, r.ci_low, r.ci_high)) and r.same_direction_fraction == 1.0


def test_bootstrap_interval_close_to_numpy(spark):
    a = arms(spark, 0.05, 0.02, seed=4)
    r = inf.cluster_bootstrap(inf.monthly_sums(a), inf.Policy(replicates=4000)).first()
    m = inf.monthly_sums(a).toPandas()
    idx = np.random.default_rng(1).integers(0, len(m), (20000, len(m)))
    s = m.ls.values[idx].sum(1) / m.lc.values[idx].sum(1) - m.rs.values[idx].sum(1) / m.rc.values[idx].sum(1)
    assert abs(r.ci_low - np.quantile(s, 0.025)) < 0.002 and abs(r.ci_high - np.quantile(s, 0.975)) < 0.002


def test_leave_one_out_direction(spark):
    r = inf.leave_one_out(arms(spark, 0.05, 0.02), "ticker").first()
    assert r.direction_stable and math.isclose(r.minimum_effect, 0.03) and r.bucket_count == 4


def test_exact_quantiles_equal_pandas(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 2000), "v": np.round(rng.exponential(10, 2000), 1)})
    out = exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.75}, buckets=16).toPandas().set_index("g")
    want = pdf.groupby("g")["v"].quantile([0.25, 0.5, 0.75]).unstack()
    for n, q in (("a", 0.25), ("b", 0.5), ("c", 0.75)):
        assert np.allclose(out[n].sort_index(), want[q])


def test_quantiles_of_a_heavy_tail_are_exact_and_even(spark):
    from tidemark.operators.order import exact_quantiles as quantiles
    from tidemark.operators.order import with_range

    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 40_000, p=[0.9, 0.1]), "v": np.exp(rng.normal(0, 4, 40_000))})
    df = spark.createDataFrame(pdf)
    per = with_range(df, ["g"], "v").groupBy("g", "__range").count().toPandas()
    assert all(part["count"].max() <= part["count"].sum() / 64 for _, part in per.groupby("g"))
    got = {r.g: (r.p1, r.p50, r.p999) for r in quantiles(df, ["g"], "v", {"p1": 0.01, "p50": 0.5, "p999": 0.999}).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], np.quantile(part["v"], [0.01, 0.5, 0.999]), rtol=1e-12)


def test_total_rank_with_ties_equals_sort(spark):
    from tidemark.operators.order import total_rank_within

    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"s": rng.integers(0, 2, 5000), "score": rng.choice([90, 100, 120], 5000), "v": rng.integers(0, 300, 5000).astype(float), "t": [f"{i:05d}" for i in range(5000)]})
    got = total_rank_within(spark.createDataFrame(pdf), ["s"], "score", "v", ["t"]).toPandas()
    want = pdf.sort_values(["s", "score", "v", "t"], ascending=[True, False, False, True])
    want["rank"] = want.groupby("s").cumcount() + 1
    assert got.sort_values(["s", "rank"])[["t", "rank"]].values.tolist() == want[["t", "rank"]].values.tolist()


def test_selection_across_small_batches(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for t in ["a", "b", None, "c"]:
        free, n = dt.date(1, 1, 1), 0
        for d in range(80):
            day, out = D0 + dt.timedelta(days=d), D0 + dt.timedelta(days=d + int(rng.integers(1, 9)))
            filled, closed = bool(rng.random() < 0.8), bool(rng.random() < 0.97)
            rows.append((t, day, "filled" if filled else "missing_next_session", closed, out))
            status = "skipped_while_open" if day < free else "accepted" if filled else "missing_next_session"
            if status == "accepted":
                n, free = n + 1, out if closed else dt.date(9999, 1, 1)
            want[t, day] = (status, n if status == "accepted" else None)
    df = spark.createDataFrame(rows, "ticker string, signal_date date, entry_status string, is_closed boolean, exit_date date")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.ticker, r.signal_date): (r.status, r.trade_seq) for r in O.select_non_overlapping(df, ["ticker"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_first_crossings_in_blocks_equal_a_literal_walk(spark):
    rng = np.random.default_rng(12)
    n = 150
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.035, n)))
    o = close * np.exp(rng.normal(0, 0.05, n))  # opens outside of low and high occur
    rows = list(zip(o, close * 1.01, close * 0.99, close))
    for gap_on_entry in (True, False):
        got = {(r.signal_date, r.scenario): r for r in label(spark, price_frame(rows), range(n), SCENARIOS, gap_on_entry=gap_on_entry).collect()}
        for d in range(n - 1):
            for s in SCENARIOS:
                fill = rows[d + 1][0] * (1 + s.slippage)
                stop, take, why = fill * 0.9, fill * 1.3, None
                for off in range(min(60, n - d - 1)):
                    op, hi, lo, _ = rows[d + 1 + off]
                    gap = gap_on_entry or off > 0
                    both = "stop_and_take_same_day_" + ("stop_first" if s.path == "conservative" else "take_first")
                    why = ("stop_gap" if gap and op <= stop else "take_profit_gap" if gap and op >= take else both if lo <= stop and hi >= take
                           else "stop_loss" if lo <= stop else "take_profit" if hi >= take else "max_holding" if off == 59 else None)
                    if why:
                        break
                r = got[D0 + dt.timedelta(days=d), s.name]
                assert (r.exit_reason, r.holding_sessions) == (why or "open_at_data_end", off + 1)


def test_slot_ledger_takes_the_next_signal_after_each_exit(spark):
    rng = np.random.default_rng(5)
    rows = []
    for universe in ("u", "v"):
        for ticker in range(1, 41):
            for day in sorted(rng.choice(200, 12, replace=False).tolist()):
                status = "filled" if rng.random() < 0.9 else "missing_next_session"
                rows.append((universe, str(ticker), D0 + dt.timedelta(days=day), status, bool(rng.random() < 0.98), D0 + dt.timedelta(days=day + int(rng.integers(1, 9)))))
    exits = spark.createDataFrame(rows, "universe string, ticker string, signal_date date, entry_status string, is_closed boolean, exit_date date")
    want, free = [], {}
    for universe, ticker, day, status, closed, out in sorted(rows, key=lambda r: (r[2], r[1])):
        slot = (universe, int(ticker) % 10)
        if status == "filled" and day >= free.get(slot, D0):
            want.append((universe, ticker, day))
            free[slot] = out if closed else dt.date(9999, 12, 31)
    got = led.slot_orders(exits)
    assert got.columns == exits.columns
    assert sorted((r.universe, r.ticker, r.signal_date) for r in got.collect()) == sorted(want)
    # A slot turns over several times within twenty sessions.
    assert len(want) > 2 * 10 * 200 / 20
