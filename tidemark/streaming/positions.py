"""Keyed state as stateful processors: accepted-only dedup and the position exit monitor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.config import MAX_HOLDING_SESSIONS, STOP_LOSS_PCT, TAKE_PROFIT_PCT

# State of an idle key is dropped after this long.
STATE_TTL_MS = 180 * 24 * 3600 * 1000
#: The state store that stateful processors need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What a position's processor reports: its exit, or how many bars of a batch came late or twice.
REPORT_SCHEMA = "position_id string, event string, exit_seq long, exit_price double, exit_reason string, bars_seen long"
POSITION_STATE = "entry double, seen long, closed boolean, last long"


class FirstOfKey(StatefulProcessor):
    """Accepts the first row of a key by (received_at, alert_id); all others are duplicates.

    Within a batch the order of arrival is that of the two columns, across
    batches that of the batches. One row is held while a batch is read, and
    one flag between batches; with a time to live the flag of an idle key goes.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", "alert_id long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, best = self.accepted.exists(), None
        for pdf in rows:
            pdf = pdf.assign(reason="duplicate_signal")
            if not known:
                pdf = pdf if best is None else pd.concat([best, pdf], ignore_index=True)
                first = pdf.sort_values(["received_at", "alert_id"], kind="stable").index[0]
                best, pdf = pdf.loc[[first]], pdf.drop(index=first)
            if len(pdf):
                yield pdf
        if best is not None:
            self.accepted.update((int(best["alert_id"].iloc[0]),))
            yield best.assign(reason="accepted")

    def close(self) -> None:
        pass


class FollowPosition(StatefulProcessor):
    """Follows one position: bought at the open of its first bar, then stop, take, holding limit.

    Rows of a batch come in any order; a bar that is not after the last one seen
    (late or repeated) is counted and reported, not used. Only the earliest
    bars up to the holding limit can still matter, so at most that many are
    held while a batch is read. With ``idle_ms`` an event-time timer forgets a
    position whose bars have stopped for that long.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", POSITION_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        entry, seen, closed, last = self.position.get() if self.position.exists() else (None, 0, False, None)
        room = 0 if closed else MAX_HOLDING_SESSIONS - seen
        held, late, newest = None, 0, None
        for pdf in rows:
            if self.idle_ms:
                top = int(pdf["time"].max().timestamp() * 1000)
                newest = top if newest is None else max(newest, top)
            new = pdf if last is None else pdf[pdf["seq"] > last]
            late += len(pdf) - len(new)
            if room > 0 and len(new):
                both = new if held is None else pd.concat([held, new])
                once = both.drop_duplicates("seq")
                late += len(both) - len(once)
                held = once.nsmallest(room, "seq")
        columns = ("seq", "open", "low", "high", "close")
        out = []
        for seq, opened, low, high, close in [] if held is None else zip(*(held[c].tolist() for c in columns), strict=True):
            entry = opened if entry is None else entry
            seen, last = seen + 1, seq
            stop, take = entry * (1 + STOP_LOSS_PCT), entry * (1 + TAKE_PROFIT_PCT)
            hit = (
                ("stop_loss", stop) if low <= stop else ("take_profit", take) if high >= take
                else ("max_holding", close) if seen >= MAX_HOLDING_SESSIONS else None
            )
            if hit:
                closed = True
                out.append((key[0], "exit", seq, hit[1], hit[0], seen))
                break
        if late:
            out.append((key[0], "late", None, None, None, late))
        if entry is not None:
            self.position.update((entry, int(seen), closed, last))
        if newest is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest + self.idle_ms)
        if out:
            names = ["position_id", "event", "exit_seq", "exit_price", "exit_reason", "bars_seen"]
            yield pd.DataFrame(out, columns=names).astype({"exit_seq": "Int64", "exit_price": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = self.position.get()[1] if self.position.exists() else 0
        self.position.clear()
        yield pd.DataFrame({"position_id": [key[0]], "event": ["forgotten"], "exit_seq": pd.array([None], "Int64"), "exit_price": [float("nan")], "exit_reason": [None], "bars_seen": [seen]})

    def close(self) -> None:
        pass


def with_state_store(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return df


def watch(ticks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Reports (REPORT_SCHEMA) of a stream of bars (position_id, seq, open, low, high, close).

    With ``idle_ms`` the stream needs an event time ``time`` with a watermark.
    """
    return with_state_store(ticks).groupBy("position_id").transformWithStateInPandas(
        FollowPosition(idle_ms), REPORT_SCHEMA, "Append", "EventTime" if idle_ms else "None"
    )


def monitor(ticks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Exits of a stream of bars: position_id, exit_seq, exit_price, exit_reason, bars_seen."""
    return watch(ticks, idle_ms).where("event = 'exit'").drop("event")


def judged_stream(passing: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of passing alerts (dedup_key, received_at, alert_id, any others) with ``reason`` accepted or duplicate_signal.

    The memory is one flag a key, whatever the log's length. A time to live
    keeps scheduling batches, so runs that end (availableNow) go without it.
    """
    schema = StructType([f for f in passing.schema.fields if f.name != "reason"]).add("reason", "string")
    return with_state_store(passing).groupBy("dedup_key").transformWithStateInPandas(FirstOfKey(ttl_ms), schema, "Append", "ProcessingTime" if ttl_ms else "None")


def first_accepted(passing: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """First passing alert of each key of a stream (dedup_key, received_at, alert_id)."""
    return judged_stream(passing, ttl_ms).where(F.col("reason") == "accepted").select("dedup_key", "alert_id")
