"""Price-bar sources: landed provider files and the line-item bridge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.values import strict_security_code, text, to_double, valid_bar

OHLCV = ("open", "high", "low", "close", "volume")

# Provider field names.
MASTER_FIELDS = ("Date", "Code", "ProdCat", "Mkt", "S33", "S33Nm", "CoName")
BAR_FIELDS = (
    "Date", "Code", "O", "H", "L", "C", "Vo", "Va",
    "AdjFactor", "AdjO", "AdjH", "AdjL", "AdjC", "AdjVo",
)
BASIS_PREFIX = {"adjusted": "Adj", "raw": ""}

MASTER_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in MASTER_FIELDS])
# Landed values are read as text: a bad number must become null, not lose the row.
BAR_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in BAR_FIELDS])
CALENDAR_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("Date", "HolDiv")])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Source rows behind one task of a shuffle by ticker, about: what its sorts and windows hold does not grow with the input.
TASK_ROWS = 250_000


def by_ticker(df: DataFrame, key: str | Sequence[str] = "ticker", rows: int = 0) -> DataFrame:
    """One shuffle by ticker that every later window, join and group-by reuses.

    The count is given explicitly so that adaptive coalescing, which looks at
    bytes only, does not put CPU-heavy windows on a few tasks. With ``rows``,
    the size of the source, it grows beyond the session's count as the source does.
    """
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else key
    if spark.conf.get("spark.master", "").startswith("local"):
        n = spark.sparkContext.defaultParallelism
    else:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-rows // TASK_ROWS)), *keys)


def unit_price_bars(spark: SparkSession, sf_dir: str, by_nation: bool = False) -> DataFrame:
    """Daily bars with supplier (or its nation) as ticker and price = l_extendedprice / l_quantity.

    Aggregated by (ticker, date) with map-side partials first, so a supplier
    that holds a large part of all rows is reduced before it is brought together.
    """
    rows, key = read(spark, sf_dir, "lineitem"), "l_suppkey"
    # Parquet footers hold the count.
    size = rows.count()
    if by_nation:
        rows = rows.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        key = "s_nationkey"
    li = rows.select(
        F.col(key).cast("string").alias("ticker"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        # One long as sort key keeps the aggregate on the hash path.
        (
            F.col("l_orderkey") * 8388608 + F.col("l_linenumber") * 1048576 + F.col("l_partkey") % 1048576
        ).alias("pos"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("value"),
    )
    return by_ticker(
        li.groupBy("ticker", "date").agg(
            F.min_by("price", "pos").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "pos").alias("close"),
            F.sum("qty").alias("volume"),
            F.sum("value").alias("va"),
        ),
        rows=size,
    )


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of a chain-linked index per supplier.

    Unit prices of unrelated parts jump by orders of magnitude, so every bracket
    would be left on the next bar. Here a day's discounts and taxes drive
    small returns that are compounded per ticker; the series then reaches stops,
    takes and the holding limit in realistic proportions.

    Lines meet by (ticker, date) first, in as many tasks as the source has
    rows for, so that neither the aggregate's memory nor a ticker that holds a
    large part of all rows grows a task.
    """
    lines = read(spark, sf_dir, "lineitem")
    size = lines.count()
    rows = lines.select(
        F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"),
        "l_discount", "l_tax", "l_quantity", "l_extendedprice",
    )
    day = (
        by_ticker(rows, ("ticker", "date"), size)
        .groupBy("ticker", "date")
        .agg(
            F.avg(F.col("l_discount") - 0.05).alias("g"),
            F.avg(F.col("l_tax") - 0.04).alias("x"),
            F.max("l_discount").alias("up"),
            F.max("l_tax").alias("down"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("va"),
        )
    )
    level = F.sum(0.3937 * F.col("g") - 0.3713 * F.col("x")).over(
        Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        by_ticker(day, rows=size)
        .withColumn("__lc", level)
        .withColumn("close", 1000 * F.exp("__lc"))
        .withColumn("open", 1000 * F.exp(F.col("__lc") + 0.3713 * F.col("x")))
        .select(
            "ticker",
            "date",
            "open",
            (F.greatest("open", "close") * (1 + 0.1 * F.col("up"))).alias("high"),
            (F.least("open", "close") * (1 - 0.1 * F.col("down"))).alias("low"),
            "close",
            "volume",
            "va",
        )
    )


def supplier_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, name, sector (nation), region for every supplier."""
    # nation and region are fixed tables of 25 and 5 rows.
    nation = read(spark, sf_dir, "nation").join(
        F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return read(spark, sf_dir, "supplier").join(
        F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("s_suppkey").cast("string").alias("ticker"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("sector"),
        F.col("r_name").alias("region"),
    )


#: Types whose values an aggregation buffer holds in place.
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def last_wins(df: DataFrame, keys: Sequence[str], position: Column | str) -> DataFrame:
    """Keep the latest landed row per key.

    Expressed as an aggregate, so repeats of one key are combined map-side and
    a key with very many copies never sits in one window.
    """
    rest = [n for n in df.columns if n not in keys]
    order = F.col(position) if isinstance(position, str) else position
    if all(isinstance(df.schema[n].dataType, FIXED_WIDTH) for n in rest):
        # Every column of the winning row is found in the same pass, in buffers of fixed width: a hash aggregate without a sort.
        return df.groupBy(*keys).agg(*[F.max_by(n, order).alias(n) for n in rest]).select(*df.columns)
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return kept.select(*keys, *[F.col(f"__row.{n}").alias(n) for n in rest]).select(*df.columns)


def clean_ohlcv(df: DataFrame, keys: Sequence[str] = ("ticker",), drop_nontrading: bool = True) -> DataFrame:
    full = df.dropna(subset=list(OHLCV))
    return full.where(valid_bar()) if drop_nontrading else full


def clean_audit(df: DataFrame, key: str = "ticker") -> DataFrame:
    """Rows removed per ticker by each positivity rule; one row may count in both."""
    full = df.dropna(subset=list(OHLCV))
    return full.groupBy(key).agg(
        F.count_if(F.least("open", "high", "low", "close") <= 0).alias("nonpositive_ohlc_rows_removed"),
        F.count_if(F.col("volume") <= 0).alias("nonpositive_volume_rows_removed"),
    )


def wide_to_long(df: DataFrame, date: str = "Date", sep: str = "|") -> DataFrame:
    """Provider table with one column per (ticker, field) pair, in either order.

    One pass for all tickers: unpivot, read the pair from the column name, and
    pivot the five fields back. Rows with no value at all are dropped.
    """
    fields = ("Open", "High", "Low", "Close", "Volume")
    values = [n for n in df.columns if n != date]
    long = df.unpivot([date], values, "pair", "value").where(F.col("value").isNotNull())
    first = F.split_part("pair", F.lit(sep), F.lit(1))
    second = F.split_part("pair", F.lit(sep), F.lit(2))
    swapped = first.isin(*fields)
    return (
        long.select(
            F.col(date).alias("date"),
            F.when(swapped, second).otherwise(first).alias("ticker"),
            F.when(swapped, first).otherwise(second).alias("field"),
            "value",
        )
        .groupBy("ticker", "date")
        .agg(*[F.first(F.when(F.col("field") == f, F.col("value")), ignorenulls=True).alias(f.lower()) for f in fields])
    )


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Array-of-objects JSON files of a folder in one read; other shapes are an error."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def normalize_master(df: DataFrame, position: Column | str = "ingest_pos") -> DataFrame:
    order = F.col(position) if isinstance(position, str) else position
    missing = [n for n in ("Date", "Code", "Mkt", "S33") if n not in df.columns]
    if missing:
        raise ValueError(f"master lacks fields {missing}")
    have = {n: F.trim(text(n)) if n in df.columns else F.lit("") for n in MASTER_FIELDS[1:]}
    have["Code"] = strict_security_code("Code")
    rows = df.select(F.col("Date").cast("date").alias("Date"), *[e.alias(n) for n, e in have.items()], order.alias("__pos"))
    return last_wins(rows, ["Date", "Code"], "__pos").drop("__pos")


def normalize_bars(df: DataFrame, position: Column | str = "ingest_pos") -> DataFrame:
    order = F.col(position) if isinstance(position, str) else position
    missing = [n for n in BAR_FIELDS if n not in df.columns]
    if missing:
        raise ValueError(f"bars lack fields {missing}")
    rows = df.select(
        F.col("Date").cast("date").alias("Date"),
        strict_security_code("Code").alias("Code"),
        *[to_double(n).alias(n) for n in BAR_FIELDS[2:]],
        order.alias("__pos"),
    )
    return last_wins(rows, ["Date", "Code"], "__pos").drop("__pos")


def price_basis(df: DataFrame, basis: str) -> DataFrame:
    """Provider bars as open..volume on the adjusted or the raw basis."""
    if basis not in BASIS_PREFIX:
        raise ValueError("basis must be adjusted or raw")
    p = BASIS_PREFIX[basis]
    return df.select(
        F.col("Code").alias("ticker"),
        F.col("Date").alias("date"),
        F.col(f"{p}O").alias("open"),
        F.col(f"{p}H").alias("high"),
        F.col(f"{p}L").alias("low"),
        F.col(f"{p}C").alias("close"),
        F.col(f"{p}Vo").alias("volume"),
        F.col("Va").alias("va"),
    )
