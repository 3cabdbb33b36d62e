"""The documents of a training corpus: quality rules, line dedup, near duplicates, decontamination, mixing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as leaks
from tidemark.llm import jaccard_join, line_dedup, mixing, quality_rules
from tidemark.llm.frames import table
from tidemark.session import prepare, release, stage, staged_here

_used: dict[str, list[DataFrame]] = {}


def alone(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that first removes what the stage before it staged: its rows have been written by then."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = spark.sparkContext.applicationId
        release(*_used.pop(key, []))
        with staged_here() as used:
            out = step(spark, docs, sf_dir)
        _used[key] = used
        return out

    return run_step


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@alone
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the line labels are learned from the labelled documents."""
    field = quality_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs.select(*COLUMNS), field).where("kept").select(*COLUMNS)


@alone
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that had words and has none left is a copy and goes."""
    out = line_dedup.dedup(docs.select(*COLUMNS)).where("n_lines = 0 or n_kept > 0")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@alone
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of the n-gram Jaccard join: five words, 0.8; that of the smallest doc_id, null last.

    Rows that share a doc_id, or have none, are held against each other like
    all others; of equal rows one stays. Rows without words are groups of their own.
    """
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "rows")
    groups = jaccard_join.join(rows.select(F.col("row").alias("doc_id"), "text"), width=5, percent=80).select(F.col("doc_id").alias("row"), "component_id")
    # Text and the rest before row: which of equal doc_ids stays does not hang on how the rows are dealt out.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*COLUMNS).alias("hash"), "row")
    kept = rows.select("row", order.alias("order")).join(groups.hint("shuffle_hash"), "row").groupBy("component_id").agg(F.min("order").alias("order"))
    return rows.join(kept.select(F.col("order.row").alias("row")).hint("shuffle_hash"), "row", "left_semi").select(*COLUMNS)


@alone
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts; documents of nothing else go."""
    out = leaks.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@alone
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with the words it takes from each: doc_id, source, size, source_size, target, taken."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination), ("mixing sources", mixture),
]

#: The first three stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written to the shared folder and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
