"""Session settings and materialised stages."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the operators rely on; safe to set on a running session.
RUNTIME_CONF = {
    # Dates must not move with the cluster's time zone.
    "spark.sql.session.timeZone": "UTC",
    # A frame already hash-partitioned by ticker may join on (ticker, seq) or
    # (ticker, week) without a second shuffle.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# A broadcast hint is only given below this many bytes, and only when the
# caller can bound the row count from the data model.
BROADCAST_LIMIT = 64 << 20


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the benchmark; clusters bring their own."""
    return prepare(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def stage_root(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's checkpoint dir or, where it is unset, one in the warehouse.

    Both are shared by the driver and the executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return configured.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Used where several branches of one report read the same expensive frame:
    the lineage is cut, a lost executor only re-reads files, and column pruning
    works on the parquet copy.
    """
    path = f"{stage_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    for held in _SCOPES:
        held.append(out)
    return out


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def staged_here():
    """The tables staged while the block runs, so that its caller can remove them once their reader has written."""
    held: list[DataFrame] = []
    _SCOPES.append(held)
    try:
        yield held
    finally:
        _SCOPES[:] = [x for x in _SCOPES if x is not held]


def release(*staged: DataFrame) -> None:
    """Remove staged tables that nothing reads any more; frames that ``stage`` did not return are left alone."""
    for df in staged:
        path = getattr(df, "staged_at", None)
        if path:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def bounded(df: DataFrame, max_rows: int, row_bytes: int = 64) -> DataFrame:
    """Broadcast hint for a side whose size has a proven bound.

    ``max_rows`` comes from the data model (days in a calendar, scenarios,
    splits). Above the byte limit the frame is returned as it is and Spark
    shuffles both sides.
    """
    return F.broadcast(df) if max_rows * row_bytes <= BROADCAST_LIMIT else df


# One row per calendar day for two centuries.
CALENDAR_ROWS = 75_000
