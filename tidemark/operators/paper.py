"""One day of the paper ledger: admissions, exits, snapshot, ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import MAX_HOLDING_SESSIONS, PAPER_SIZE, PAPER_SLOTS, STOP_LOSS_PCT, TAKE_PROFIT_PCT
from tidemark.functions.values import ratio
from tidemark.operators.windows import count_before

# Statuses that may still be admitted; ledger row layout.
OPEN_STATUSES = ("", "pending", "waiting_capacity", "waiting_price")
DAILY_LOG_COLUMNS = (
    "report_date", "row_type", "ticker", "name", "sector", "action", "reason", "status", "signal_date", "entry_date", "entry_price",
    "open", "high", "low", "close", "stop_price", "take_profit_price", "holding_days", "shares", "market_value",
    "unrealized_return_pct", "realized_pnl", "paper_trade_id", "pending_order_id", "notes",
)


def latest_bars(bars: DataFrame, as_of: Column, key: str = "ticker") -> DataFrame:
    """Last bar on or before the date per ticker."""
    rest = [n for n in ("date", "open", "high", "low", "close", "volume") if n in bars.columns]
    return bars.where(F.col("date") <= as_of).groupBy(key).agg(*[F.max_by(n, "date").alias(n) for n in rest])


def sessions_held(positions: DataFrame, bars: DataFrame, as_of: Column, ids: Sequence[str], key: str = "ticker") -> DataFrame:
    """Bars between entry and the date, both inclusive, per position.

    Two places on the ticker's bar index, subtracted: the number of bars before
    the entry, read off one running count of bars and entries, and the number of
    bars up to the date. A position is one row throughout.
    """
    named = [*ids, *([] if key in ids else [key])]
    here = F.struct(*named)
    b = bars.where(F.col("date") <= as_of).select(key, F.col("date").alias("__d"), F.lit(1).alias("__bar"))
    total = b.groupBy(key).agg(F.count("*").alias("__upto"))
    p = positions.select(key, F.col("entry_date").alias("__d"), F.lit(0).alias("__bar"), here.alias("__p"))
    # An entry sorts before the bar of its day, so that bar counts as held.
    running = Window.partitionBy(key).orderBy("__d", "__bar").rowsBetween(Window.unboundedPreceding, 0)
    both = b.withColumn("__p", F.lit(None).cast(p.schema["__p"].dataType)).unionByName(p).withColumn("__before", F.sum("__bar").over(running))
    held = both.where("__bar = 0 AND __d IS NOT NULL").join(total, key).withColumn("holding_days", F.col("__upto") - F.col("__before"))
    return held.where("holding_days > 0").select(*[F.col("__p")[n].alias(n) for n in ids], "holding_days")


def admit_pending(
    pending: DataFrame, positions: DataFrame, bars: DataFrame, accounts: DataFrame, as_of: Column,
    size: float = PAPER_SIZE, slots: int = PAPER_SLOTS,
) -> DataFrame:
    """New status of every pending row after one admission step.

    Rows are taken in ``pos`` order per account: not due stay, held are skipped,
    full accounts wait for capacity, rows without a bar today wait for a price,
    the others execute. Only the first due and priced row of a ticker can take
    a slot, so a running count of those against the free slots decides.
    """
    by = ["account", "ticker"]
    today = bars.where((F.col("date") == as_of) & (F.col("open") > 0)).select("ticker", F.col("open").alias("price"))
    held = positions.select(*by).distinct().withColumn("__held", F.lit(True))
    open_n = positions.groupBy("account").agg(F.count("*").alias("open_positions"))
    free = accounts.select("account", "cash").join(open_n, "account", "left").select(
        "account",
        F.greatest(F.lit(0), F.least(slots - F.coalesce("open_positions", F.lit(0)), F.floor(F.col("cash") / size))).cast("long").alias("__slots"),
    )
    rows = pending.join(held, by, "left").join(today, "ticker", "left").join(free, "account", "left")
    due = F.col("status").isin(*OPEN_STATUSES) & F.coalesce(F.col("signal_date") < as_of, F.lit(False))
    rows = rows.withColumn("__due", due & F.col("__held").isNull())
    lead = rows.where(F.col("__due") & F.col("price").isNotNull()).groupBy(*by).agg(F.min("pos").alias("__first"))
    rows = rows.join(lead, by, "left").withColumn("__lead", F.coalesce(F.col("pos") == F.col("__first"), F.lit(False)) & F.col("__due"))
    counted = count_before(rows, ["account"], "pos", F.col("__lead"), "__before")
    # Whether the ticker's first priced row found a slot.
    taken = counted.where(F.col("__lead") & (F.col("__before") < F.col("__slots"))).select(*by).withColumn("__bought", F.lit(True))
    out = counted.join(taken, by, "left")
    full = F.col("__before") >= F.col("__slots")
    status = (
        F.when(~due, F.col("status"))
        .when(F.col("__held").isNotNull(), "skipped_already_held")
        .when(F.col("__bought").isNotNull() & F.col("__first").isNotNull() & (F.col("pos") > F.col("__first")), "skipped_already_held")
        .when(full, "waiting_capacity")
        .when(F.col("price").isNull(), "waiting_price")
        .otherwise("executed")
    )
    done = out.withColumn("new_status", status)
    ok = F.col("new_status") == "executed"
    shares = F.lit(size) / F.col("price")
    return done.select(
        *pending.columns, "new_status",
        F.when(ok, F.round("price", 4)).alias("entry_price"), F.when(ok, F.round(shares, 8)).alias("shares"),
        F.when(ok, F.round(F.col("price") * (1 + STOP_LOSS_PCT), 4)).alias("stop_price"),
        F.when(ok, F.round(F.col("price") * (1 + TAKE_PROFIT_PCT), 4)).alias("take_profit_price"),
    )


def check_positions(positions: DataFrame, bars: DataFrame, as_of: Column, ids: Sequence[str], size: float = PAPER_SIZE) -> DataFrame:
    """Exit decision, value and PnL of every open position for one day.

    Stop before take before holding limit, filled at the level itself; a
    position without any bar is kept.
    """
    bar = latest_bars(bars, as_of)
    days = sessions_held(positions, bars, as_of, ids)
    j = positions.join(bar, "ticker", "left").join(days, list(ids), "left")
    missing = F.col("date").isNull()
    held = F.coalesce("holding_days", F.lit(0))
    reason = (
        F.when(missing, "missing_price")
        .when(F.col("low") <= F.col("stop_price"), "stop_loss")
        .when(F.col("high") >= F.col("take_profit_price"), "take_profit")
        .when(held >= MAX_HOLDING_SESSIONS, "max_holding")
        .otherwise("no_exit")
    )
    j = j.withColumn("reason", reason).withColumn("sold", F.col("reason").isin("stop_loss", "take_profit", "max_holding"))
    price = F.when(F.col("reason") == "stop_loss", F.col("stop_price")).when(F.col("reason") == "take_profit", F.col("take_profit_price")).when(F.col("sold"), F.col("close"))
    j = j.withColumn("exit_price", price)
    value = F.col("shares") * F.when(F.col("sold"), F.col("exit_price")).otherwise(F.col("close"))
    ret = ratio(F.when(F.col("sold"), F.col("exit_price")).otherwise(F.col("close")), "entry_price") - 1
    return j.select(
        *positions.columns, F.when(F.col("sold"), "SELL").otherwise("HOLD").alias("action"), "reason",
        F.when(F.col("sold"), "closed").otherwise("open").alias("new_status"), held.cast("long").alias("holding_days"),
        "exit_price", F.when(~missing, F.round(value, 2)).alias("market_value"),
        F.when(~missing, F.round(F.coalesce(ret, F.lit(0.0)), 6)).alias("return_pct"),
        F.when(F.col("sold"), F.round(value - F.coalesce("allocation", F.lit(size)), 2)).alias("pnl"),
    )


def account_snapshot(accounts: DataFrame, admitted: DataFrame, checked: DataFrame, size: float = PAPER_SIZE) -> DataFrame:
    """Cash, realised PnL, value, equity and counts per account after a step.

    ``checked`` covers the positions after admission.
    """
    buys = admitted.groupBy("account").agg(
        F.count_if(F.col("new_status") == "executed").alias("bought"),
        F.count_if(~F.col("new_status").isin("executed", "skipped_already_held")).alias("pending_orders"),
    )
    sold = F.col("new_status") == "closed"
    sells = checked.groupBy("account").agg(
        F.sum(F.when(sold, F.col("market_value")).otherwise(0.0)).alias("proceeds"), F.sum(F.when(sold, F.col("pnl")).otherwise(0.0)).alias("gain"),
        F.sum(F.when(~sold, F.coalesce("market_value", F.lit(0.0))).otherwise(0.0)).alias("value"), F.count_if(~sold).alias("open_positions"),
    )
    z = lambda n: F.coalesce(n, F.lit(0))
    out = accounts.join(buys, "account", "left").join(sells, "account", "left")
    cash = F.col("cash") - size * z("bought") + z("proceeds")
    return out.select(
        "account", F.round(cash, 2).alias("cash"), F.round(F.col("realized_pnl") + z("gain"), 2).alias("realized_pnl"),
        z("open_positions").cast("long").alias("open_positions"), z("pending_orders").cast("long").alias("pending_orders"),
        F.round(z("value"), 2).alias("market_value"), F.round(cash + z("value"), 2).alias("equity"),
    )


def opened_positions(admitted: DataFrame, as_of: Column, size: float = PAPER_SIZE) -> DataFrame:
    return admitted.where("new_status = 'executed'").select(
        "account", "ticker", as_of.alias("entry_date"), "entry_price", "shares", F.lit(size).alias("allocation"), "stop_price", "take_profit_price"
    )


def allocate_ids(new: DataFrame, existing: DataFrame, id_column: str, prefix: str, pos: str, width: int = 6) -> DataFrame:
    """prefix + zero-padded number after the largest existing one, in ``pos`` order."""
    digits = F.when(F.col(id_column).startswith(prefix), F.replace(id_column, F.lit(prefix), F.lit("")).try_cast("long"))
    top = existing.agg(F.coalesce(F.max(digits), F.lit(0))).scalar()
    counted = count_before(new.withColumn("__one", F.lit(1)), ["__one"], pos, F.lit(True), "__n").drop("__one")
    number = (F.col("__n") + 1 + F.col("__top")).cast("string")
    return counted.withColumn("__top", top).withColumn(
        id_column, F.concat(F.lit(prefix), F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number))
    ).drop("__n", "__top")
