"""Spark helpers shared by the operators: source tables, staged tables, connected components, grids of large groups."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import release, stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links (a, b).

    Alternating large-star and small-star rounds, each written to the shared
    folder; the number of rounds grows with the logarithm of the longest path.
    Only nodes that have a link to another node are returned.
    """
    spark = edges.sparkSession
    links = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "links")
        release(links)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        release(large)
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = nodes.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out.staged_at = links.staged_at  # for ``release``, once the components are read
    return out


def cells(members: DataFrame, group: str, node: str, limit: int) -> DataFrame:
    """Deal out ``members`` so that every two of a group meet in some cell.

    Adds ``cell``. A group of at most ``limit`` members is one cell; a larger
    one is cut into parts of about that size by a hash of the node, and each
    pair of parts is a cell, so no task holds a whole large group.
    """
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / F.lit(limit)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(17), F.col(node)), F.col("parts")).cast("int")
    dealt = members.join(sizes, group).withColumn("part", part)
    with_each = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.least(k, F.col("part")) * F.col("parts") + F.greatest(k, F.col("part")))
    return dealt.withColumn("cell", F.explode(with_each)).drop("parts", "part")


def links_of_groups(members: DataFrame, keys: list[str], links: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """(a, b): what ``links`` finds in each group of rows with equal ``keys``.

    A partition holds whole groups and is read as one Arrow table, which costs
    less than a call with a frame for each of many small groups.
    """

    def run(batches):
        held = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        made: list[tuple[int, int]] = []
        if held is not None and held.num_rows:
            held = held.sort_by([(k, "ascending") for k in keys])
            key = list(zip(*(held.column(k).to_pylist() for k in keys), strict=True))
            start = 0
            for k in range(1, len(key) + 1):
                if k == len(key) or key[k] != key[start]:
                    if k - start > 1:
                        made += links(held.slice(start, k - start))
                    start = k
        yield pa.RecordBatch.from_arrays([pa.array([int(x[i]) for x in made], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return members.repartition(*keys).mapInArrow(run, "a long, b long")
