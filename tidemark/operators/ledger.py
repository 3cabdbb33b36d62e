"""Portfolio ledger analytics: dispositions, position-day PnL, reconciliation, diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import INITIAL_CAPITAL, PORTFOLIO_SLOTS
from tidemark.functions.values import exit_group, valid_bar
from tidemark.operators.calendar import first_day, session_spine, with_next_session
from tidemark.operators.order import total_rank_within
from tidemark.operators.outcomes import select_non_overlapping
from tidemark.operators.windows import count_before
from tidemark.session import CALENDAR_ROWS, bounded


def slot_orders(exits: DataFrame, slots: int = PORTFOLIO_SLOTS, dims: Sequence[str] = ("universe",), key: str = "ticker") -> DataFrame:
    """The orders of a slot ledger: filled exits that a slot takes.

    A code belongs to one slot, and a slot holds one position at a time: it
    takes its first filled signal by date, then code, and after each exit the
    first one from the exit date on. Exits come after their signal dates, so
    only a slot's first code of a date can be taken; the others go before the
    shuffle, and a slot's sequence has a row for each date at most.
    """
    filled = exits.where("entry_status = 'filled'").withColumn("__slot", F.col(key).cast("long") % slots)
    first = Window.partitionBy(*dims, "__slot", "signal_date").orderBy(key)
    calls = filled.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return select_non_overlapping(calls, [*dims, "__slot"]).where("status = 'accepted'").drop("status", "trade_seq", "__slot")


def position_days(ledger: DataFrame, bars: DataFrame, sessions: DataFrame, commission: float, dims: Sequence[str] = ("universe",), key: str = "ticker") -> DataFrame:
    """Mark and PnL of every trade on every session it is held.

    Sessions are enumerated by number between entry and exit; the mark is the
    valid close, the previous mark on a missing bar, the exit cash on the exit day.
    """
    ids = [*dims, key, "signal_date"]
    idx = bounded(sessions.select("date", "idx"), CALENDAR_ROWS)
    a = idx.select(F.col("date").alias("entry_date"), F.col("idx").alias("__a"))
    b = idx.select(F.col("date").alias("exit_date"), F.col("idx").alias("__b"))
    held = (
        ledger.join(a, "entry_date")
        .join(b, "exit_date")
        .select(*ids, "sector", "score", "exit_reason", "shares", "entry_fill_price", "exit_fill_price", "exit_date", "is_closed", F.explode(F.sequence("__a", "__b")).alias("idx"))
        .join(idx, "idx")
    )
    marks = bars.select(key, "date", F.when(valid_bar(), F.col("close")).alias("__close"))
    path = held.join(marks, [key, "date"], "left")
    w = Window.partitionBy(*ids).orderBy("date")
    leaving = F.col("is_closed") & (F.col("date") == F.col("exit_date"))
    cash_in = F.col("entry_fill_price") * (1 + commission)
    seen = F.last("__close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    mark = F.when(leaving, F.col("exit_fill_price") * (1 - commission)).otherwise(F.coalesce(seen, cash_in))
    marked = path.withColumn("mark", mark).withColumn("cash_in", cash_in).withColumn("leaving", leaving)
    pnl = F.col("shares") * (F.col("mark") - F.coalesce(F.lag("mark").over(w), F.col("cash_in")))
    group = exit_group("exit_reason")
    return marked.select(
        *ids, "date", "sector", "score", group.alias("trade_exit_reason"),
        F.when(leaving, group).otherwise("mark_to_market").alias("daily_event_reason"),
        "shares", "mark", "leaving", pnl.alias("pnl_jpy"),
    )


def portfolio_curve(days: DataFrame, sessions: DataFrame, dims: Sequence[str] = ("universe",), capital: float = INITIAL_CAPITAL) -> DataFrame:
    """Equity, cash, positions and utilisation per session from position days.

    Starts with a row on the day before the first session, as the ledger does.
    """
    held = ~F.col("leaving")
    daily = days.groupBy(*dims, "date").agg(
        F.sum("pnl_jpy").alias("pnl"),
        F.sum(F.when(held, F.col("shares") * F.col("mark")).otherwise(0.0)).alias("value"),
        F.count_if(held).alias("active_positions"),
    )
    groups = days.select(*dims).distinct()
    w = Window.partitionBy(*dims).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    body = (
        session_spine(groups, sessions)
        .join(daily, [*dims, "date"], "left")
        .select(
            *dims, "date",
            (capital + F.sum(F.coalesce("pnl", F.lit(0.0))).over(w)).alias("equity"),
            F.coalesce("value", F.lit(0.0)).alias("value"),
            F.coalesce("active_positions", F.lit(0).cast("long")).alias("active_positions"),
        )
    )
    full = body.select(
        *dims, "date", "equity", (F.col("equity") - F.col("value")).alias("cash"), "active_positions",
        F.when(F.col("equity") > 0, F.col("value") / F.col("equity")).alias("cash_utilization"),
    )
    opening = groups.select(
        *dims, F.date_sub(first_day(sessions), 1).alias("date"), F.lit(capital).alias("equity"), F.lit(capital).alias("cash"),
        F.lit(0).cast("long").alias("active_positions"), F.lit(0.0).alias("cash_utilization"),
    )
    return opening.unionByName(full)


def reconcile(curve: DataFrame, days: DataFrame, dims: Sequence[str] = ("universe",)) -> DataFrame:
    """Largest gap between daily PnL sums and equity changes, and the tolerance.

    Dates known to the PnL but not to the curve are counted as unknown.
    """
    w = Window.partitionBy(*dims).orderBy("date")
    change = curve.select(*dims, "date", "equity", (F.col("equity") - F.lag("equity").over(w)).alias("curve_change"), F.lit(True).alias("__c"))
    daily = days.groupBy(*dims, "date").agg(F.sum("pnl_jpy").alias("pnl"))
    both = change.join(daily, [*dims, "date"], "full_outer")
    gap = F.when(F.col("pnl").isNotNull(), F.abs(F.col("curve_change") - F.col("pnl")))
    out = both.groupBy(*dims).agg(
        F.coalesce(F.max(gap), F.lit(0.0)).alias("maximum_error"),
        F.greatest(F.lit(1e-5), F.max(F.abs("equity")) * 1e-10).alias("tolerance"),
        F.count_if(F.col("__c").isNull()).alias("unknown_dates"),
    )
    return out.withColumn("match", (F.col("maximum_error") <= F.col("tolerance")) & (F.col("unknown_dates") == 0))


def overlap(left: DataFrame, ledger: DataFrame, day: str, test: Column, how: str, dims: Sequence[str], key: str = "ticker") -> DataFrame:
    """Semi or anti join of days with the ledger intervals that contain them.

    Both sides carry the months an interval covers, so the range test runs
    inside a hash join on (dims, code, month).
    """
    months = F.sequence(F.trunc("entry_date", "MM"), F.trunc("exit_date", "MM"), F.expr("interval 1 month"))
    spans = ledger.select(
        *[F.col(d).alias(f"__{d}") for d in dims], F.col(key).alias("__k"), F.col("entry_date").alias("__in"),
        F.col("exit_date").alias("__out"), F.col("exit_reason").alias("__why"), F.explode(months).alias("__m"),
    )
    on = (F.col(key) == F.col("__k")) & (F.trunc(day, "MM") == F.col("__m")) & test
    for d in dims:
        on = on & (F.col(d) == F.col(f"__{d}"))
    return left.join(spans, on, how)


def occupied_at_open(rows: DataFrame, ledger: DataFrame, day: str = "entry_date", how: str = "left_semi", dims: Sequence[str] = ("universe",), key: str = "ticker") -> DataFrame:
    """Rows whose code still holds an earlier position at the open of ``day``."""
    d = F.col(day)
    test = (F.col("__in") < d) & ((F.col("__out") > d) | ((F.col("__out") == d) & ~F.col("__why").isin("stop_gap", "take_profit_gap")))
    return overlap(rows, ledger, day, test, how, dims, key)


def dispositions(
    signals: DataFrame, ledger: DataFrame, bars: DataFrame, sessions: DataFrame,
    dims: Sequence[str] = ("universe",), key: str = "ticker", slots: int = PORTFOLIO_SLOTS,
) -> DataFrame:
    """What became of every signal, given the ledger.

    Adds entry_date, disposition and capacity_binding_session. Held codes at an
    open are counted by +1 / -1 steps per session; within a session candidates
    are ordered by score, liquidity and code and accepted ones take a slot.
    """
    ids = [*dims, key, "signal_date"]
    placed = with_next_session(signals, sessions, "signal_date").drop("entry_idx")
    # Still held at the close of the signal day.
    after_close = (F.col("__in") <= F.col("signal_date")) & (F.col("__out") > F.col("signal_date"))
    dup = overlap(placed.where("entry_date IS NOT NULL").select(*ids), ledger, "signal_date", after_close, "left_semi", dims, key)
    at_open = occupied_at_open(placed.where("entry_date IS NOT NULL").select(*ids, "entry_date"), ledger, dims=dims, key=key).select(*ids)
    flagged = (
        placed.join(dup.withColumn("__dup", F.lit(True)), ids, "left")
        .join(at_open.withColumn("__held", F.lit(True)), ids, "left")
        .join(ledger.select(*ids, "entry_date").withColumn("__taken", F.lit(True)), [*ids, "entry_date"], "left")
        .join(bars.select(key, F.col("date").alias("entry_date"), valid_bar().alias("__valid")), [key, "entry_date"], "left")
        .join(held_at_open(ledger, sessions, dims), [*dims, "entry_date"], "left")
    )
    scheduled = F.col("entry_date").isNotNull() & F.col("__dup").isNull()
    takes = F.when(scheduled & F.col("__held").isNull() & F.col("__taken").isNotNull(), 1).otherwise(0)
    placed_in_order = total_rank_within(flagged.withColumn("__take", takes), [*dims, "entry_date"], "score", "median_va_60", [key], "__place")
    counted = count_before(placed_in_order, [*dims, "entry_date"], "__place", F.col("__take") == 1, "__before").withColumn(
        "__used", F.coalesce("held_at_open", F.lit(0)) + F.col("__before")
    )
    verdict = (
        F.when(F.col("entry_date").isNull(), "missing_next_session")
        .when(F.col("__dup").isNotNull() | F.col("__held").isNotNull(), "duplicate_rejected")
        .when(F.col("__taken").isNotNull(), "accepted")
        .when(F.col("__used") >= slots, "capacity_rejected")
        .when(F.col("__valid").isNull(), "missing_next_session")
        .when(~F.col("__valid"), "invalid_bar")
        .otherwise("capacity_rejected")
    )
    decided = counted.withColumn("disposition", verdict)
    full = decided.where((F.col("disposition") == "capacity_rejected") & scheduled).select(*dims, "entry_date").distinct()
    binding = decided.join(full.withColumn("__full", F.lit(True)), [*dims, "entry_date"], "left")
    return binding.withColumn("capacity_binding_session", scheduled & F.col("__full").isNotNull()).select(
        *signals.columns, "entry_date", "disposition", "capacity_binding_session"
    )


def held_at_open(ledger: DataFrame, sessions: DataFrame, dims: Sequence[str] = ("universe",)) -> DataFrame:
    """Number of positions held at each session's open that no gap exit releases.

    A position counts from the session after its entry through its exit day,
    or through the day before when it left on a gap at the open.
    """
    gap = F.col("exit_reason").isin("stop_gap", "take_profit_gap")
    starts = with_next_session(ledger.select(*dims, "entry_date"), sessions, "entry_date", "date", "__i")
    later = with_next_session(ledger.where(~gap).select(*dims, "exit_date"), sessions, "exit_date", "date", "__i")
    at_gap = ledger.where(gap & (F.col("exit_date") > F.col("entry_date"))).select(*dims, F.col("exit_date").alias("date"))
    none = ledger.where(gap & (F.col("exit_date") <= F.col("entry_date"))).select(*dims, "entry_date")
    never = with_next_session(none, sessions, "entry_date", "date", "__i")
    steps = (
        starts.select(*dims, "date").withColumn("step", F.lit(1))
        .unionByName(later.select(*dims, "date").withColumn("step", F.lit(-1)))
        .unionByName(at_gap.withColumn("step", F.lit(-1)))
        .unionByName(never.select(*dims, "date").withColumn("step", F.lit(-1)))
        .where("date IS NOT NULL")
        .groupBy(*dims, "date").agg(F.sum("step").alias("step"))
    )
    w = Window.partitionBy(*dims).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return session_spine(ledger.select(*dims).distinct(), sessions).join(steps, [*dims, "date"], "left").select(
        *dims, F.col("date").alias("entry_date"), F.sum(F.coalesce("step", F.lit(0))).over(w).alias("held_at_open")
    )


def checked_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], require_match: bool = True) -> DataFrame:
    """Left join that fails on a repeated key or, if asked, on a missing match."""
    n = F.count("*").over(Window.partitionBy(*keys))

    def unique(df: DataFrame, side: str) -> DataFrame:
        marked = df.withColumn("__n", n)
        bad = F.raise_error(F.lit(f"repeated key on the {side} side"))
        return marked.withColumn("__ok", F.when(F.col("__n") == 1, True).otherwise(bad)).where("__ok").drop("__n", "__ok")

    joined = unique(left, "left").join(unique(right, "right").withColumn("__hit", F.lit(True)), list(keys), "left")
    if require_match:
        joined = joined.withColumn("__hit", F.when(F.col("__hit"), True).otherwise(F.raise_error(F.lit("row without a match")))).where("__hit")
    return joined.drop("__hit")


def frame_diff(actual: DataFrame, expected: DataFrame, keys: Sequence[str], texts: Sequence[str], numbers: Sequence[str], rtol: float = 1e-11, atol: float = 1e-8) -> DataFrame:
    """Mismatch count per column of two keyed frames, plus rows on one side only."""
    a = actual.select(*keys, *[F.col(n).alias(f"a_{n}") for n in (*texts, *numbers)], F.lit(True).alias("__a"))
    e = expected.select(*keys, *[F.col(n).alias(f"e_{n}") for n in (*texts, *numbers)], F.lit(True).alias("__e"))
    both = a.join(e, list(keys), "full_outer")
    matched = F.col("__a").isNotNull() & F.col("__e").isNotNull()
    blank = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    bad = {n: blank(f"a_{n}") != blank(f"e_{n}") for n in texts}
    for n in numbers:
        x, y = F.col(f"a_{n}").cast("double"), F.col(f"e_{n}").cast("double")
        close = F.abs(x - y) <= atol + rtol * F.abs(y)
        bad[n] = ~F.coalesce(close, x.isNull() & y.isNull())
    return both.agg(
        F.count_if(~matched).alias("unmatched_rows"), *[F.count_if(matched & t).alias(f"{n}_mismatches") for n, t in bad.items()]
    )


def drawdown_episodes(curve: DataFrame, dims: Sequence[str] = ("universe",)) -> DataFrame:
    """Peak, trough and first recovery of every drawdown, ranked by depth.

    A row at or above the running peak starts an island; an island with lower
    rows is an episode. An equal peak later restarts it. The next island's
    start is the recovery.
    """
    order = Window.partitionBy(*dims).orderBy("date")
    prior = F.max("equity").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = curve.withColumn("__new", F.coalesce((F.col("equity") >= prior).cast("int"), F.lit(1)))
    island = marked.withColumn("__i", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = island.groupBy(*dims, "__i").agg(
        F.min("date").alias("start_date"),
        F.max(F.when(F.col("__new") == 1, F.col("equity"))).alias("peak"),
        F.min(F.when(F.col("__new") == 0, F.struct("equity", "date"))).alias("low"),
    )
    nxt = F.lead("start_date").over(Window.partitionBy(*dims).orderBy("__i"))
    found = runs.withColumn("recovery_date", nxt).where("low IS NOT NULL").select(
        *dims, "start_date", F.col("low.date").alias("trough_date"), "recovery_date",
        (F.col("low.equity") / F.col("peak") - 1).alias("drawdown"),
        (F.col("low.equity") - F.col("peak")).alias("equity_change_peak_to_trough"),
    )
    depth = Window.partitionBy(*dims).orderBy("drawdown", "start_date", "trough_date")
    return found.withColumn("episode_rank", F.row_number().over(depth).cast("long"))
