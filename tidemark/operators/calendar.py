"""Session calendars, schedules, splits and gap search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import SESSION_DIVISIONS, SPLITS
from tidemark.session import CALENDAR_ROWS, bounded

# Windows without a partition key in this module run over one row per session;
# a calendar has at most CALENDAR_ROWS rows.


def number_sessions(days: DataFrame) -> DataFrame:
    """Distinct dates, numbered from 0 in order."""
    return days.select("date").distinct().withColumn(
        "idx", (F.row_number().over(Window.orderBy("date")) - 1).cast("long")
    )


def first_day(df: DataFrame, x: str = "date") -> Column:
    """Smallest value as a scalar subquery: no collect, no join."""
    return df.agg(F.min(x)).scalar()


def last_day(df: DataFrame, x: str = "date") -> Column:
    return df.agg(F.max(x)).scalar()


def session_spine(groups: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every session for every group: days are exploded, then matched by date."""
    days = groups.withColumn("date", F.explode(F.sequence(first_day(sessions), last_day(sessions))))
    return days.join(bounded(sessions.select("date", "idx"), CALENDAR_ROWS), "date")


def trading_sessions(calendar: DataFrame) -> DataFrame:
    """Sessions of an exchange calendar (Date, HolDiv)."""
    return number_sessions(
        calendar.where(F.col("HolDiv").cast("string").isin(*SESSION_DIVISIONS)).select(F.col("Date").cast("date").alias("date"))
    )


def market_dates(bars: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Union of all tickers' dates inside a window."""
    rows = bars.select("date")
    if start is not None:
        rows = rows.where(F.col("date") >= start)
    if end is not None:
        rows = rows.where(F.col("date") <= end)
    return number_sessions(rows)


def next_session_map(sessions: DataFrame) -> DataFrame:
    """Calendar day -> next session strictly after it, for every day of the range.

    An as-of lookup over all days turns 'next session' into an equi join that
    also works for signal dates that are not sessions.
    """
    spine = sessions.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(
        F.explode(F.sequence("a", "b")).alias("date")
    )
    ahead = Window.orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    joined = spine.join(bounded(sessions.withColumnRenamed("date", "s_date"), CALENDAR_ROWS), F.col("date") == F.col("s_date"), "left")
    return joined.select(
        "date",
        F.first("s_date", ignorenulls=True).over(ahead).alias("next_date"),
        F.first("idx", ignorenulls=True).over(ahead).alias("next_idx"),
    )


def with_next_session(df: DataFrame, sessions: DataFrame, on: str, date_out: str = "entry_date", idx_out: str = "entry_idx") -> DataFrame:
    nxt = next_session_map(sessions).select(
        F.col("date").alias(on), F.col("next_date").alias(date_out), F.col("next_idx").alias(idx_out)
    )
    return df.join(bounded(nxt, CALENDAR_ROWS), on, "left")


def annual_schedule(sessions: DataFrame, start_year: int | None = None, end_year: int | None = None, month: int = 4, short: int = 60, long: int = 252) -> DataFrame:
    """First session of the month per year with cutoff and trailing-window starts.

    Without a first and last year, all years of the calendar whose first session
    of the month has a whole window behind it; a given year must have one.
    """
    first = (
        sessions.where(F.month("date") == month)
        .groupBy(F.year("date").alias("year"))
        .agg(F.min("idx").alias("idx"))
    )
    if start_year is None or end_year is None:
        years = first.where(F.col("idx") >= long).select("year")
    else:
        years = sessions.sparkSession.range(start_year, end_year + 1).select(F.col("id").cast("int").alias("year"))
    # At most one row per year.
    base = years.join(F.broadcast(first), "year", "left").withColumn(
        "idx",
        F.when(F.col("idx") >= long, F.col("idx")).otherwise(
            F.raise_error(F.concat(F.lit("no usable selection session in "), F.col("year").cast("string")))
        ),
    )

    def at(shift: int, name: str) -> DataFrame:
        return sessions.select((F.col("idx") + shift).alias("idx"), F.col("date").alias(name))

    for shift, name in ((0, "selection_date"), (1, "cutoff_date"), (short, "short_start"), (long, "long_start")):
        base = base.join(bounded(at(shift, name), CALENDAR_ROWS), "idx", "left")
    return base.select("year", "idx", "selection_date", "cutoff_date", "short_start", "long_start")


def chronological_splits(sessions: DataFrame) -> DataFrame:
    """60 / 20 / 20 split by session count: split, start, end, sessions."""
    n = F.count("*").over(Window.partitionBy())
    numbered = number_sessions(sessions).withColumn("n", n)
    dev = F.floor(F.col("n") * 0.6) - 1
    val = F.floor(F.col("n") * 0.8) - 1
    label = (
        F.when(F.col("n") < 5, F.raise_error(F.lit("not enough sessions for splits")))
        .when(F.col("idx") <= dev, SPLITS[0])
        .when(F.col("idx") <= val, SPLITS[1])
        .otherwise(SPLITS[2])
    )
    return numbered.groupBy(label.alias("split")).agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("sessions")
    )


def with_overall(splits: DataFrame) -> DataFrame:
    whole = splits.agg(
        F.lit("overall").alias("split"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("sessions").alias("sessions")
    )
    return splits.unionByName(whole)


def longest_gap(sessions: DataFrame, signal_days: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Longest run of sessions without a signal.

    ``sessions`` carries the dims and ``date``; ``signal_days`` the dims and
    ``signal_date``. Sessions are numbered per group, sessions with a signal are
    removed, and equal (number - rank) marks one gap.
    """
    on = [*dims, "date"]
    days = signal_days.select(*dims, F.col("signal_date").alias("date")).distinct()
    order = Window.partitionBy(*dims).orderBy("date")
    numbered = sessions.select(*on).distinct().withColumn("pos", F.row_number().over(order))
    quiet = numbered.join(days, on, "left_anti").withColumn("island", F.col("pos") - F.row_number().over(order))
    runs = quiet.groupBy(*dims, "island").agg(
        F.count("*").alias("sessions"), F.min("date").alias("start"), F.max("date").alias("end")
    ).withColumn("calendar_days", (F.datediff("end", "start") + 1).cast("long"))
    # Ties keep the earliest run.
    best = F.max(F.struct("sessions", "calendar_days", (-F.datediff("start", F.lit("1970-01-01"))).alias("early"), "start", "end")).alias("best")
    found = runs.groupBy(*dims).agg(best).select(*dims, "best.sessions", "best.calendar_days", "best.start", "best.end")
    if dims:
        # A group without a quiet session reports zeros and no dates; without
        # dims the global aggregate already returns its one row.
        found = sessions.select(*dims).distinct().join(found, list(dims), "left")
    return found.select(
        *dims,
        F.coalesce("sessions", F.lit(0)).cast("long").alias("longest_no_signal_sessions"),
        F.coalesce("calendar_days", F.lit(0)).cast("long").alias("longest_no_signal_calendar_days"),
        F.col("start").alias("gap_start"),
        F.col("end").alias("gap_end"),
    )
