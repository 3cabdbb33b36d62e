"""Per-key series operators as window expressions.

A key's series holds one row per session, so a window partition is bounded by
the calendar, whatever the number of input rows behind a key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import MACD_FAST, MACD_SIGNAL, MACD_SLOW, RSI_WINDOW

EWM_BLOCK = 1024


def series(keys: Sequence[str], order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order)


def running(keys: Sequence[str], order: str = "date"):
    return series(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def trailing(keys: Sequence[str], n: int, order: str = "date"):
    return series(keys, order).rowsBetween(-(n - 1), Window.currentRow)


def sma(x: str, n: int, keys: Sequence[str], order: str = "date") -> Column:
    w = trailing(keys, n, order)
    return F.when(F.count(x).over(w) >= n, F.avg(x).over(w))


def rolling_median(x: str, n: int, keys: Sequence[str], order: str = "date") -> Column:
    """Median of the last ``n`` values; null with fewer.

    The window hands out its values as an array, which is sorted once a row. An
    exact percentile as the window function counts every value in a hash map.
    """
    w = trailing(keys, n, order)
    values = F.sort_array(F.collect_list(F.col(x).cast("double")).over(w))
    return F.when(F.count(x).over(w) >= n, 0.5 * F.get(values, F.lit((n - 1) // 2)) + 0.5 * F.get(values, F.lit(n // 2)))


def change(x: str, keys: Sequence[str], order: str = "date") -> Column:
    """One-step relative change; null on the first row or a zero base."""
    return F.try_divide(F.col(x), F.lag(x).over(series(keys, order))) - 1


def numbered(df: DataFrame, keys: Sequence[str], order: str = "date", extra: Sequence[Column] = (), block: int = EWM_BLOCK) -> DataFrame:
    """Row number, block and offset per key, with other columns of the same window.

    Everything over (keys, order) goes into one select and so into one Window
    operator.
    """
    rn = F.row_number().over(series(keys, order))
    return df.select("*", rn.alias("__rn"), *extra).select(
        "*", F.floor((F.col("__rn") - 1) / block).alias("__blk"), ((F.col("__rn") - 1) % block).alias("__off")
    )


def ewm_columns(
    df: DataFrame,
    specs: dict[str, tuple[str, float, int, int]],
    keys: Sequence[str],
    order: str = "date",
    block: int = EWM_BLOCK,
) -> DataFrame:
    """Recursive exponential means y = (1-a)y + a x as window sums, on a numbered frame.

    ``specs`` maps output -> (input, alpha, min_periods, leading nulls). The
    recursion is unrolled to a weighted prefix sum. Rows are cut into blocks of
    observations so that the weights stay in double range however long a series
    is: a value is the prefix sum of its own block plus the total of the block
    before. ``block_length`` makes blocks so long that those before them weigh
    less than 1e-20. Both windows are ordered (keys, block, order), so one sort
    serves all means of one block length; the usual spans share ``block``.
    """
    out = df
    for size in sorted({block_length(alpha, block) for _, alpha, _, _ in specs.values()}):
        out = _ewm_blocks(out, {n: s for n, s in specs.items() if block_length(s[1], block) == size}, keys, order, size)
    return out


def block_length(alpha: float, block: int = EWM_BLOCK) -> int:
    """``block`` if (1-alpha)^block is between 1e-100 and 1e-20, otherwise the length that makes it about 1e-100."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    decay = -math.log10(1 - alpha) if alpha < 1 else math.inf
    return block if 20 <= decay * block <= 100 else max(1, int(100 / decay))


def _ewm_blocks(df: DataFrame, specs: dict[str, tuple[str, float, int, int]], keys: Sequence[str], order: str, block: int) -> DataFrame:
    shown = df.columns
    df = df.withColumns({"__blk": F.floor((F.col("__rn") - 1) / block), "__off": (F.col("__rn") - 1) % block}) if block != EWM_BLOCK else df
    inside = Window.partitionBy(*keys, "__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__blk").rangeBetween(-1, -1)
    terms = [
        (F.col(x) * F.when(F.col("__rn") == lead + 1, 1.0).otherwise(a) * F.pow(F.lit(1 - a), -F.col("__off"))).alias(f"__t_{n}")
        for n, (x, a, _, lead) in specs.items()
    ]
    sums = [F.sum(f"__t_{n}").over(inside).alias(f"__s_{n}") for n in specs]
    carry = [F.sum(f"__t_{n}").over(before).alias(f"__c_{n}") for n in specs]
    values = [
        F.when(
            F.col("__rn") - lead >= m,
            F.pow(F.lit(1 - a), F.col("__off")) * (F.coalesce(f"__s_{n}", F.lit(0.0)) + F.coalesce(f"__c_{n}", F.lit(0.0)) * (1 - a) ** block),
        ).alias(n)
        for n, (_, a, m, lead) in specs.items()
    ]
    out = df.select("*", *terms).select("*", *sums, *carry)
    # Later means of another length find the columns of ``numbered`` again.
    restored = [F.floor((F.col("__rn") - 1) / EWM_BLOCK).alias(c) if c == "__blk" else ((F.col("__rn") - 1) % EWM_BLOCK).alias(c) if c == "__off" else F.col(c) for c in shown]
    return out.select(*(restored if block != EWM_BLOCK else shown), *values)


def ewm(df: DataFrame, specs: dict[str, tuple[str, float, int, int]], keys: Sequence[str], order: str = "date", block: int = EWM_BLOCK) -> DataFrame:
    return ewm_columns(numbered(df, keys, order, block=block), specs, keys, order, block).select(*df.columns, *specs)


def rsi_columns(df: DataFrame, keys: Sequence[str], n: int = RSI_WINDOW, order: str = "date", out: str = "daily_rsi") -> DataFrame:
    """RSI on a numbered frame that carries the one-step change in ``__step``."""
    known = F.col("__step").isNotNull()
    base = df.select(
        "*",
        F.when(known, F.greatest("__step", F.lit(0.0))).alias("__gain"),
        F.when(known, F.greatest(-F.col("__step"), F.lit(0.0))).alias("__loss"),
    )
    # The first change is null, hence one leading null.
    means = ewm_columns(base, {"__ag": ("__gain", 1 / n, n, 1), "__al": ("__loss", 1 / n, n, 1)}, keys, order)
    g, l = F.col("__ag"), F.col("__al")
    # A zero loss mean gives 100 when there were gains and nothing when there were none.
    value = F.when(l > 0, 100 - 100 / (1 + g / l)).when((l == 0) & (g > 0), 100.0)
    return means.select(*df.columns, value.alias(out))


def step(x: str, keys: Sequence[str], order: str = "date") -> Column:
    return (F.col(x) - F.lag(x).over(series(keys, order))).alias("__step")


def with_rsi(df: DataFrame, x: str, keys: Sequence[str], n: int = RSI_WINDOW, order: str = "date", out: str = "daily_rsi") -> DataFrame:
    framed = numbered(df, keys, order, [step(x, keys, order)])
    return rsi_columns(framed, keys, n, order, out).select(*df.columns, out)


def macd_columns(df: DataFrame, x: str, keys: Sequence[str], order: str, prefix: str, spans: tuple[int, int, int] = (MACD_FAST, MACD_SLOW, MACD_SIGNAL)) -> DataFrame:
    """MACD line and signal on a numbered frame; the line starts at row ``slow``."""
    fast, slow, signal = spans
    two = ewm_columns(df, {"__f": (x, 2 / (fast + 1), fast, 0), "__s": (x, 2 / (slow + 1), slow, 0)}, keys, order)
    line = two.select(*df.columns, (F.col("__f") - F.col("__s")).alias(prefix))
    return ewm_columns(line, {f"{prefix}_signal": (prefix, 2 / (signal + 1), signal, slow - 1)}, keys, order)


def with_macd(df: DataFrame, x: str, keys: Sequence[str], order: str = "date", prefix: str = "macd") -> DataFrame:
    framed = macd_columns(numbered(df, keys, order), x, keys, order, prefix)
    return framed.select(
        *df.columns, prefix, f"{prefix}_signal", (F.col(prefix) - F.col(f"{prefix}_signal")).alias(f"{prefix}_histogram")
    )


def pandas_indicators(df: DataFrame, keys: Sequence[str], x: str = "close", order: str = "date") -> DataFrame:
    """RSI and MACD by a grouped pandas kernel; the Python twin of the window form."""
    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys, order).schema.fields]
        + ["daily_rsi double", "macd double", "macd_signal double"]
    )

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        s = pdf[x]
        step = s.diff()
        up = step.clip(lower=0).ewm(alpha=1 / RSI_WINDOW, adjust=False, min_periods=RSI_WINDOW).mean()
        down = (-step.clip(upper=0)).ewm(alpha=1 / RSI_WINDOW, adjust=False, min_periods=RSI_WINDOW).mean()
        fast = s.ewm(span=MACD_FAST, adjust=False, min_periods=MACD_FAST).mean()
        slow = s.ewm(span=MACD_SLOW, adjust=False, min_periods=MACD_SLOW).mean()
        line = fast - slow
        out = pdf[[*keys, order]].copy()
        out["daily_rsi"] = 100 - 100 / (1 + up / down)
        out["macd"] = line
        out["macd_signal"] = line.ewm(span=MACD_SIGNAL, adjust=False, min_periods=MACD_SIGNAL).mean()
        return out

    return df.select(*keys, order, x).groupBy(*keys).applyInPandas(kernel, schema)


def drawdown(df: DataFrame, keys: Sequence[str], x: str = "equity", order: str = "date") -> DataFrame:
    """Running peak and relative drawdown per row."""
    return df.withColumn("peak", F.max(x).over(running(keys, order))).withColumn(
        "drawdown", F.try_divide(F.col(x), F.col("peak")) - 1
    )


def longest_run(
    df: DataFrame,
    dims: Sequence[str],
    day: str,
    tie: Sequence[str],
    hit: Column,
    out: str = "longest_run",
) -> DataFrame:
    """Longest run of ``hit`` rows per group in (day, tie) order.

    Positions come from per-day counts, so no window spans a whole group: one
    window sorts the rows of a single day, the other sees one row per day. The
    longest run is the widest gap between neighbouring non-hit positions.
    """
    rows = df.select(*dims, day, *tie, F.coalesce(hit, F.lit(False)).alias("__hit"))
    in_day = Window.partitionBy(*dims, day).orderBy(*tie)
    misses = (
        rows.withColumn("__r", F.row_number().over(in_day))
        .withColumn("__c", F.count("*").over(Window.partitionBy(*dims, day)))
        .withColumn("__prev", F.max(F.when(~F.col("__hit"), F.col("__r"))).over(
            in_day.rowsBetween(Window.unboundedPreceding, -1)))
        .groupBy(*dims, day)
        .agg(
            F.max("__c").alias("n"),
            F.min(F.when(~F.col("__hit"), F.col("__r"))).alias("first_miss"),
            F.max(F.when(~F.col("__hit"), F.col("__r"))).alias("last_miss"),
            F.max(F.when(~F.col("__hit") & F.col("__prev").isNotNull(), F.col("__r") - F.col("__prev") - 1)).alias("inner_gap"),
        )
    )
    days = Window.partitionBy(*dims).orderBy(day)
    before = days.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        misses.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("last_pos", F.col("base") + F.col("last_miss"))
        .withColumn("prev_pos", F.coalesce(F.max("last_pos").over(before), F.lit(0)))
    )
    return placed.groupBy(*dims).agg(
        F.greatest(
            F.coalesce(F.max("inner_gap"), F.lit(0)),
            F.coalesce(F.max(F.col("base") + F.col("first_miss") - F.col("prev_pos") - 1), F.lit(0)),
            # Tail after the last miss of the whole group.
            F.max(F.col("base") + F.col("n")) - F.coalesce(F.max("last_pos"), F.lit(0)),
        ).cast("long").alias(out)
    )


def count_before(df: DataFrame, keys: Sequence[str], pos: str, hit: Column, out: str, bucket: int = 1 << 16) -> DataFrame:
    """Number of earlier ``hit`` rows per key in ``pos`` order (``pos`` is a whole number).

    Counted in two levels, inside position buckets and over bucket totals, so a
    key that holds a large part of all rows is spread over many tasks.
    """
    marked = df.withColumn("__h", F.coalesce(hit, F.lit(False)).cast("long")).withColumn("__pb", F.floor(F.col(pos) / bucket))
    totals = marked.groupBy(*keys, "__pb").agg(F.sum("__h").alias("__bt"))
    earlier = Window.partitionBy(*keys).orderBy("__pb").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "__pb", F.coalesce(F.sum("__bt").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*keys, "__pb").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumn("__in", F.coalesce(F.sum("__h").over(inside), F.lit(0)))
    return local.join(base, [*keys, "__pb"]).withColumn(out, F.col("__base") + F.col("__in")).drop("__h", "__pb", "__in", "__base")
