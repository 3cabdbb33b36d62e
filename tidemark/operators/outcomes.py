"""Event outcomes: bracket exits, excursions, trade selection and counters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidemark.config import (
    DATA_END_HAIRCUT,
    MAX_HOLDING_SESSIONS,
    SCENARIOS,
    STOP_LOSS_PCT,
    TAKE_PROFIT_PCT,
    Scenario,
)
from tidemark.functions.values import valid_bar, zero_padded
from tidemark.operators.calendar import last_day, session_spine, with_next_session
from tidemark.operators.order import total_rank_within
from tidemark.operators.windows import series

# Exit reasons, by the code used inside the aggregate.
REASONS = {
    1: "stop_gap",
    2: "take_profit_gap",
    3: "stop_and_take_same_day_stop_first",
    4: "stop_and_take_same_day_take_first",
    5: "stop_loss",
    6: "take_profit",
    7: "max_holding",
}
HORIZONS = (10, 20, 40, 60)
#: Bars of a block of the first-crossing index.
BLOCK = 16
#: Day numbers before and after all dates.
NEVER, FOREVER = -(1 << 31), (1 << 31) - 1


def reason_text(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), code)


def number_bars(bars: DataFrame, key: str = "ticker") -> DataFrame:
    """Valid bars numbered per ticker; holding counts run over this number."""
    return bars.where(valid_bar()).withColumn("seq", F.row_number().over(series([key])))


def scenario_array(scenarios: Sequence[Scenario]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(s.name).alias("scenario"),
                F.lit(s.slippage).alias("slip"),
                F.lit(s.commission).alias("comm"),
                F.lit(s.path == "conservative").alias("stop_first"),
            )
            for s in scenarios
        ]
    )


def place_entries(signals: DataFrame, numbered: DataFrame, sessions: DataFrame, key: str = "ticker") -> DataFrame:
    """Entry on the session after the signal: adds entry_date, entry_seq, entry_status."""
    entry_bars = numbered.select(
        key, F.col("date").alias("entry_date"), F.col("seq").alias("entry_seq"), F.col("open").alias("entry_raw_open")
    )
    placed = with_next_session(signals, sessions, "signal_date").join(entry_bars, [key, "entry_date"], "left")
    return placed.withColumn(
        "entry_status",
        F.when(F.col("entry_date").isNull(), "data_end")
        .when(F.col("entry_seq").isNull(), "missing_next_session")
        .otherwise("filled"),
    )


def exit_code(o, h, l, stop, take, stop_first, offset, gap_on_entry: bool, hold: int) -> Column:
    gap = F.lit(True) if gap_on_entry else offset > 0
    hit_stop, hit_take = l <= stop, h >= take
    return (
        F.when(gap & (o <= stop), 1)
        .when(gap & (o >= take), 2)
        .when(hit_stop & hit_take, F.when(stop_first, 3).otherwise(4))
        .when(hit_stop, 5)
        .when(hit_take, 6)
        .when(offset >= hold - 1, 7)
    )


def walk(
    placed: DataFrame,
    numbered: DataFrame,
    scenarios: Sequence[Scenario],
    ids: Sequence[str],
    key: str = "ticker",
    gap_on_entry: bool = True,
    hold: int = MAX_HOLDING_SESSIONS,
) -> DataFrame:
    """Every (signal, scenario, bar) up to the holding limit with its exit code.

    Range search is replaced by arithmetic on bar numbers: each filled signal is
    exploded to the numbers it can touch and meets its bars in an equi join.
    Scenarios are evaluated on the joined rows, so bars are joined once.
    """
    ahead = placed.where("entry_status = 'filled'").select(
        key, *ids, "entry_seq", "entry_raw_open",
        F.explode(F.sequence("entry_seq", F.col("entry_seq") + (hold - 1))).alias("seq"),
    )
    path = ahead.join(numbered.select(key, "seq", "date", "open", "high", "low", "close"), [key, "seq"])
    rows = path.withColumn("s", F.explode(scenario_array(scenarios))).select(
        "*", "s.*", (F.col("seq") - F.col("entry_seq")).alias("offset"),
        (F.col("entry_raw_open") * (1 + F.col("s.slip"))).alias("entry_fill_price"),
    ).drop("s")
    rows = rows.withColumns(
        {
            "stop_price": F.col("entry_fill_price") * (1 + STOP_LOSS_PCT),
            "take_profit_price": F.col("entry_fill_price") * (1 + TAKE_PROFIT_PCT),
        }
    )
    code = exit_code(
        F.col("open"), F.col("high"), F.col("low"), F.col("stop_price"), F.col("take_profit_price"),
        F.col("stop_first"), F.col("offset"), gap_on_entry, hold,
    )
    rows = rows.withColumn("code", code)
    price = (
        F.when(F.col("code").isin(1, 2), F.col("open"))
        .when(F.col("code").isin(3, 5), F.col("stop_price"))
        .when(F.col("code").isin(4, 6), F.col("take_profit_price"))
        .when(F.col("code") == 7, F.col("close"))
    )
    return rows.withColumn("exit_raw", price).withColumn("hit", F.when(F.col("code").isNotNull(), F.col("offset")))


def bar_blocks(numbered: DataFrame, key: str = "ticker") -> DataFrame:
    """Bars of BLOCK consecutive numbers as one row: ``block``, ``path`` (their bars in order), ``lowest``, ``highest``.

    The upper level of the first-crossing index: a price that lies between the
    two extremes is met by none of the block's bars.
    """
    bar = F.struct("seq", "date", "open", "high", "low", "close")
    block = F.expr(f"cast((seq - 1) div {BLOCK} as int)")
    return numbered.groupBy(key, block.alias("block")).agg(
        F.array_sort(F.collect_list(bar)).alias("path"),
        F.min(F.least("low", "open")).alias("lowest"),
        F.max(F.greatest("high", "open")).alias("highest"),
    )


def first_exits(
    placed: DataFrame,
    numbered: DataFrame,
    scenarios: Sequence[Scenario],
    ids: Sequence[str],
    key: str = "ticker",
    gap_on_entry: bool = True,
    hold: int = MAX_HOLDING_SESSIONS,
) -> DataFrame:
    """One row per filled signal: its last bar within the limit and, per scenario k, the first crossing.

    A signal meets the few blocks its holding period touches in an equi join.
    Bars are looked at only in blocks whose extremes reach a level, and all
    scenarios are answered on the same row. Columns: last_seq, last_date,
    last_close and seq_k, date_k, code_k, raw_k (null without a crossing).
    """
    ahead = placed.where("entry_status = 'filled'").select(
        key, *ids, "entry_seq", "entry_raw_open",
        F.explode(F.expr(f"sequence(cast((entry_seq - 1) div {BLOCK} as int), cast((entry_seq + {hold - 2}) div {BLOCK} as int))")).alias("block"),
    )
    met = ahead.join(bar_blocks(numbered, key), [key, "block"])
    base = F.col("block") * BLOCK + 1
    begin = F.greatest(F.col("entry_seq") - base, F.lit(0))
    until = F.least(F.col("entry_seq") + hold - base, F.size("path"))
    met = met.withColumn("live", F.when(until > begin, F.slice("path", (begin + 1).cast("int"), (until - begin).cast("int")))).where("live IS NOT NULL")

    def crossing(s: Scenario) -> Column:
        fill = F.col("entry_raw_open") * (1 + F.lit(s.slippage))
        stop, take = fill * (1 + STOP_LOSS_PCT), fill * (1 + TAKE_PROFIT_PCT)

        def reaches(b: Column) -> Column:
            gap = F.lit(True) if gap_on_entry else b["seq"] > F.col("entry_seq")
            return (b["low"] <= stop) | (b["high"] >= take) | (gap & ((b["open"] <= stop) | (b["open"] >= take)))

        return F.when((F.col("lowest") <= stop) | (F.col("highest") >= take), F.get(F.filter("live", reaches), F.lit(0)))

    met = met.withColumns({f"b{k}": crossing(s) for k, s in enumerate(scenarios)} | {"end": F.element_at("live", -1)})
    found = [F.max("end.seq").alias("last_seq"), F.max("end.date").alias("last_date"), F.max_by("end.close", "end.seq").alias("last_close")]
    for k, s in enumerate(scenarios):
        b = F.col(f"b{k}")
        fill = F.col("entry_raw_open") * (1 + F.lit(s.slippage))
        stop, take = fill * (1 + STOP_LOSS_PCT), fill * (1 + TAKE_PROFIT_PCT)
        first = F.lit(s.path == "conservative")
        code = F.when(b.isNotNull(), exit_code(b["open"], b["high"], b["low"], stop, take, first, b["seq"] - F.col("entry_seq"), gap_on_entry, hold))
        raw = F.when(code.isin(1, 2), b["open"]).when(code.isin(3, 5), stop).when(code.isin(4, 6), take)
        found += [
            F.min(b["seq"]).alias(f"seq_{k}"),
            F.min_by(b["date"], b["seq"]).alias(f"date_{k}"),
            F.min_by(code, b["seq"]).alias(f"code_{k}"),
            F.min_by(raw, b["seq"]).alias(f"raw_{k}"),
        ]
    return met.groupBy(key, *ids).agg(*found)


def bracket_exits(
    signals: DataFrame,
    numbered: DataFrame,
    sessions: DataFrame,
    scenarios: Sequence[Scenario] = SCENARIOS,
    ids: Sequence[str] = ("signal_date",),
    key: str = "ticker",
    gap_on_entry: bool = True,
    hold: int = MAX_HOLDING_SESSIONS,
) -> DataFrame:
    """One row per (signal, scenario): fill, exit, returns, or why it was not filled.

    ``ids`` are the columns that, with the ticker, identify a signal. Scenarios
    become rows only after the first crossings of all are known.
    """
    placed = place_entries(signals, numbered, sessions, key)
    done = placed.join(first_exits(placed, numbered, scenarios, ids, key, gap_on_entry, hold), [key, *ids], "left")
    filled = F.col("entry_status") == "filled"
    at_limit = F.col("last_seq") == F.col("entry_seq") + (hold - 1)
    each = [
        F.struct(
            F.lit(s.name).alias("scenario"),
            F.when(filled, F.lit(s.slippage)).alias("slip"),
            F.when(filled, F.lit(s.commission)).alias("comm"),
            F.coalesce(F.col(f"seq_{k}"), F.when(at_limit, F.col("last_seq"))).alias("hit"),
            F.coalesce(F.col(f"date_{k}"), F.col("last_date")).alias("exit_date"),
            F.coalesce(F.col(f"raw_{k}"), F.col("last_close")).alias("exit_raw_price"),
            F.coalesce(F.col(f"code_{k}"), F.when(at_limit, 7)).alias("code"),
        )
        for k, s in enumerate(scenarios)
    ]
    kept = [*placed.columns, "last_seq"]
    out = done.select(*kept, F.explode(F.array(*each)).alias("x")).select(*kept, "x.*")
    closed = F.col("hit").isNotNull()
    fill = F.col("entry_raw_open") * (1 + F.col("slip"))
    out = out.withColumns(
        {
            "entry_fill_price": fill,
            "stop_price": fill * (1 + STOP_LOSS_PCT),
            "take_profit_price": fill * (1 + TAKE_PROFIT_PCT),
            "is_closed": F.when(filled, closed),
            "holding_sessions": (F.coalesce("hit", "last_seq") - F.col("entry_seq") + 1).cast("long"),
            "exit_reason": F.when(closed, reason_text(F.col("code"))).when(filled, "open_at_data_end"),
            "data_quality_status": F.when(closed, "complete").when(filled, "right_censored_mark_to_market"),
        }
    )
    out = out.withColumn("exit_fill_price", F.col("exit_raw_price") * (1 - F.col("slip")))
    net = F.col("exit_fill_price") * (1 - F.col("comm")) / (F.col("entry_fill_price") * (1 + F.col("comm"))) - 1
    gross = F.col("exit_raw_price") / F.col("entry_raw_open") - 1
    return (
        out.withColumn("net_return_pct", net)
        .withColumn("gross_return_pct", gross)
        .withColumn("entry_cost_pct", F.col("comm"))
        .withColumn("exit_cost_pct", F.col("comm"))
        .withColumn("total_cost_pct", F.col("gross_return_pct") - F.col("net_return_pct"))
        .drop("hit", "code", "last_seq", "slip", "comm")
    )


def terminal_policy(trades: DataFrame, calendar_end: Column, slip: float, comm: float, haircut: float = DATA_END_HAIRCUT) -> DataFrame:
    """Close a trade whose bars stop before the calendar at a share of its last close.

    ``haircut`` 0.8 and 1.0 are the two policies; a trade whose bars reach the
    end stays open at its last close, without exit slippage.
    """
    premature = ~F.col("is_closed") & (F.col("exit_date") < calendar_end)
    open_end = ~F.col("is_closed") & ~premature
    raw = F.when(premature, F.col("exit_raw_price") * haircut).otherwise(F.col("exit_raw_price"))
    fill = F.when(open_end, raw).otherwise(raw * (1 - slip))
    reason = "premature_data_end_haircut" if haircut < 1 else "premature_data_end_last_close"
    return (
        trades.withColumn("__raw", raw)
        .withColumn("__fill", fill)
        .withColumn("__premature", premature)
        .withColumn("exit_reason", F.when(premature, reason).when(open_end, "open_at_frozen_end").otherwise(F.col("exit_reason")))
        .withColumn("data_quality_status", F.when(premature, "premature_data_end_suspicion").otherwise(F.col("data_quality_status")))
        .withColumn("exit_date", F.when(premature | open_end, calendar_end).otherwise(F.col("exit_date")))
        .withColumn("is_closed", F.col("is_closed") | F.col("__premature"))
        .withColumn("exit_raw_price", F.col("__raw"))
        .withColumn("exit_fill_price", F.col("__fill"))
        .withColumn("net_return_pct", F.col("exit_fill_price") * (1 - comm) / (F.col("entry_fill_price") * (1 + comm)) - 1)
        .drop("__raw", "__fill", "__premature")
    )


def one_shot_outcomes(
    signals: DataFrame,
    numbered: DataFrame,
    sessions: DataFrame,
    scenario: Scenario,
    ids: Sequence[str] = ("signal_date",),
    key: str = "ticker",
) -> DataFrame:
    """Each signal on its own: exit, excursions and horizon returns.

    No gap test on the entry bar; bars that end before the calendar leave at the
    haircut price; favourable and adverse excursion follow the executable path
    up to the exit.
    """
    placed = place_entries(signals, numbered, sessions, key)
    rows = walk(placed, numbered, [scenario], ids, key, gap_on_entry=False)
    sig = [key, *ids]
    earlier = Window.partitionBy(*sig).orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    live = rows.withColumn("gone", F.min("hit").over(earlier)).where("gone IS NULL")
    cash = F.col("entry_fill_price") * (1 + scenario.commission)
    path_high = (
        F.when(F.col("code").isin(1, 2), F.col("open"))
        .when(F.col("code").isin(3, 5, 6), F.greatest("open", "exit_raw"))
        .otherwise(F.col("high"))
    )
    path_low = (
        F.when(F.col("code").isin(1, 2), F.col("open")).when(F.col("code").isin(3, 5), F.col("exit_raw")).otherwise(F.col("low"))
    )
    still_open = F.col("code").isNull() | (F.col("code") == 7)
    done = live.groupBy(*sig).agg(
        F.max("hit").alias("hit"),
        F.max_by("date", "hit").alias("hit_date"),
        F.max_by("code", "hit").alias("hit_code"),
        F.max_by("exit_raw", "hit").alias("hit_raw"),
        F.max("date").alias("last_date"),
        F.max_by("close", "offset").alias("last_close"),
        F.count("*").alias("bars"),
        F.max(cash).alias("entry_cash"),
        F.greatest(F.max(path_high / cash - 1), F.lit(0.0)).alias("mfe"),
        F.least(F.min(path_low / cash - 1), F.lit(0.0)).alias("mae"),
        *[
            F.max(F.when((F.col("offset") == h - 1) & still_open, F.col("close") / cash - 1)).alias(f"horizon_{h}")
            for h in HORIZONS
        ],
    )
    out = placed.join(done, sig, "left").withColumn("calendar_end", last_day(sessions))
    closed = F.col("hit").isNotNull()
    filled = F.col("entry_status") == "filled"
    premature = filled & ~closed & (F.col("last_date") < F.col("calendar_end"))
    out = out.withColumns(
        {
            "shadow_status": F.when(~filled, "MISSING_NEXT_SESSION").when(closed | premature, "COMPLETE").otherwise("RIGHT_CENSORED"),
            "is_closed": filled & (closed | premature),
            "exit_date": F.when(closed, F.col("hit_date")).when(filled, F.col("calendar_end")),
            "exit_reason": F.when(closed, reason_text(F.col("hit_code")))
            .when(premature, "premature_data_end_haircut")
            .when(filled, "open_at_frozen_end"),
            "holding_sessions": F.col("bars").cast("long"),
            "__raw": F.when(closed, F.col("hit_raw")).when(premature, F.col("last_close") * DATA_END_HAIRCUT),
        }
    )
    net = F.col("__raw") * (1 - scenario.slippage) * (1 - scenario.commission) / F.col("entry_cash") - 1
    return out.withColumn("net_return_pct", net).drop(
        "__raw", "hit", "hit_date", "hit_code", "hit_raw", "last_date", "last_close", "bars", "entry_cash", "calendar_end", "entry_idx"
    )


def select_non_overlapping(trades: DataFrame, keys: Sequence[str], order: Sequence[str] = ("signal_date",)) -> DataFrame:
    """Give every signal a status when each key may hold one trade at a time.

    Adds ``status`` (accepted, skipped_while_open, missing_next_session,
    data_end) and ``trade_seq``. A signal on the exit date may be taken again; an
    unclosed trade ends its key. A key's signals lie sorted in one partition
    and pass by in batches; each filled one points to the first signal that
    its exit leaves free, and only the accepted ones are stepped through. What
    a task keeps between batches is one key, its free day and its count.
    """
    ordered = trades.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = StructType([*trades.schema.fields, StructField("status", StringType()), StructField("trade_seq", IntegerType())])
    n_keys = len(keys)

    def run(batches):
        held, free, taken = None, NEVER, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.select(list(keys))
            codes = np.zeros(batch.num_rows, np.int64)
            for k in range(n_keys):
                codes = codes * batch.num_rows + rows.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                codes = np.unique(codes, return_inverse=True)[1]
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            day = batch.column("signal_date").cast(pa.int32()).to_numpy(zero_copy_only=False)
            fills = pc.fill_null(pc.equal(batch.column("entry_status"), "filled"), False).to_numpy(zero_copy_only=False)
            open_end = ~pc.fill_null(batch.column("is_closed"), False).to_numpy(zero_copy_only=False)
            until = pc.fill_null(batch.column("exit_date").cast(pa.int32()), FOREVER).to_numpy(zero_copy_only=False)
            until = np.where(open_end, FOREVER, until)
            accepted = np.zeros(batch.num_rows, bool)
            skipped = np.zeros(batch.num_rows, bool)
            number = np.zeros(batch.num_rows, np.int32)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                key = tuple(rows.column(k)[a].as_py() for k in range(n_keys))
                if key != held:
                    held, free, taken = key, NEVER, 0
                can = a + np.flatnonzero(fills[a:b])
                days = day[can]
                # Each signal's pointer to the first one that its exit leaves free.
                after = np.maximum(np.searchsorted(days, until[can]), np.arange(1, len(can) + 1))
                at = int(np.searchsorted(days, free))
                done = a
                while at < len(can):
                    i = int(can[at])
                    skipped[done:i] = day[done:i] < free
                    taken += 1
                    accepted[i], number[i], free, done = True, taken, int(until[i]), i + 1
                    at = int(after[at])
                skipped[done:b] = day[done:b] < free
            texts = pc.if_else(pa.array(accepted), "accepted", pc.if_else(pa.array(skipped), "skipped_while_open", batch.column("entry_status").cast(pa.string())))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts, pa.array(number, mask=~accepted)], names=[*batch.schema.names, "status", "trade_seq"])

    return ordered.mapInArrow(run, schema)


def signal_counters(statuses: DataFrame, dims: Sequence[str]) -> DataFrame:
    s = F.col("status")
    return statuses.groupBy(*dims).agg(
        F.count("*").alias("raw_signals"),
        F.count_if(s == "skipped_while_open").alias("signals_skipped_while_open"),
        F.count_if(s == "missing_next_session").alias("signals_unfilled_missing_next_session"),
        F.count_if(s == "data_end").alias("signals_unfilled_at_data_end"),
    )


def accepted_trades(statuses: DataFrame, universe: str, key: str = "ticker") -> DataFrame:
    """Accepted trades with their readable id."""
    tag = F.replace(F.col(key), F.lit("."), F.lit(""))
    return statuses.where("status = 'accepted'").withColumn(
        "trade_id", F.concat_ws("-", F.lit(universe), tag, zero_padded(F.col("trade_seq"), 4))
    ).drop("status", "entry_status", "entry_idx")


def equal_notional_curve(trades: DataFrame, numbered: DataFrame, sessions: DataFrame, dims: Sequence[str], key: str = "ticker") -> DataFrame:
    """Fixed-notional curve: 1 + sum of return marks / maximum concurrency.

    Every trade contributes the change of its mark on its own bars only (at most
    the holding limit), so daily sums plus one running sum per group replace
    suffix updates over the whole calendar.
    """
    ids = [*dims, key, "signal_date"]
    ahead = trades.select(
        *ids, "exit_date",
        (F.col("entry_fill_price") * (1 + F.col("entry_cost_pct"))).alias("cash_in"),
        (F.col("exit_fill_price") * (1 - F.col("exit_cost_pct"))).alias("cash_out"),
        F.explode(F.sequence("entry_seq", F.col("entry_seq") + F.col("holding_sessions").cast("int") - 1)).alias("seq"),
    )
    path = ahead.join(numbered.select(key, "seq", "date", "close"), [key, "seq"])
    mark = F.when(F.col("date") == F.col("exit_date"), F.col("cash_out")).otherwise(F.col("close")) / F.col("cash_in") - 1
    w = Window.partitionBy(*ids).orderBy("seq")
    steps = path.withColumn("mark", mark).withColumn("delta", F.col("mark") - F.coalesce(F.lag("mark").over(w), F.lit(0.0)))
    daily = steps.groupBy(*dims, "date").agg(F.sum("delta").alias("delta"))
    active = concurrency(trades, sessions, dims)
    peak = F.greatest(F.lit(1), F.max("active_positions").over(Window.partitionBy(*dims)))
    run = Window.partitionBy(*dims).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (
        active.join(daily, [*dims, "date"], "left")
        .withColumn("capacity", peak.cast("long"))
        .select(
            *dims,
            "date",
            (1 + F.sum(F.coalesce("delta", F.lit(0.0))).over(run) / F.col("capacity")).alias("equity"),
            "active_positions",
            "capacity",
            (F.col("active_positions") / F.col("capacity")).alias("exposure"),
        )
    )


def concurrency(trades: DataFrame, sessions: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Active trades per session, entry and exit inclusive.

    +1 on the entry session and -1 on the session after the exit, then a running
    sum: no range join between trades and sessions.
    """
    starts = trades.groupBy(*dims, F.col("entry_date").alias("date")).agg(F.count("*").alias("step"))
    ends = with_next_session(trades.select(*dims, "exit_date"), sessions, "exit_date", "date", "__i").where("date IS NOT NULL")
    stops = ends.groupBy(*dims, "date").agg((-F.count("*")).alias("step"))
    steps = starts.unionByName(stops).groupBy(*dims, "date").agg(F.sum("step").alias("step"))
    # Dims are report groups (scenario, universe), so the spine stays small.
    spine = session_spine(trades.select(*dims).distinct(), sessions)
    run = Window.partitionBy(*dims).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(steps, [*dims, "date"], "left").select(
        *dims, "date", F.sum(F.coalesce("step", F.lit(0))).over(run).alias("active_positions")
    )


def candidate_rank(df: DataFrame, by: Sequence[str], key: str = "ticker") -> DataFrame:
    """Priority among candidates of one entry session: score, liquidity, code."""
    return total_rank_within(df, by, "score", "median_va_60", [key], "priority")
