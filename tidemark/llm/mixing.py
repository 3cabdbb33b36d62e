"""Mixing sources to target weights with built-in functions only: Sainte-Lague apportionment of equal-token blocks.

The mix has a number of blocks of ``block`` words. Sources get them by highest
quotients target / (2 k + 1), then each source's blocks go to its shards in the
same way with the shards' words as weights: integer quotas per shard. A shard
is a bounded part of a source by a hash of doc_id, its documents in hashed
order form a stream that is cut into blocks of about ``block`` words, and a
seeded order of the blocks says which ones fill the quota. So no step needs
more than one shard's blocks or the list of sources in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.frames import table
from tidemark.session import stage

#: Weights of the sources in code-point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words; most times that a source may be taken.
TOTAL, REPEATS = 1.5, 2
#: Most words of a block; the smallest source has at least LEAST_BLOCKS blocks if it has as many words.
BLOCK, LEAST_BLOCKS = 64, 64
#: Blocks of a shard, about; a longer document is a longer shard.
SHARD_BLOCKS = 4096
SEED = 11

_PRIME, _STEP = 2147483647, 48271


def scramble(x: str, salt: str) -> str:
    """SQL for a repeatable number below 2^31 from an integer, the same in any engine."""
    one = f"((abs({x}) % {_PRIME}) * {_STEP} + ({salt}) * 69621 + {SEED} * 16807) % {_PRIME}"
    two = f"(({one}) * ({one})) % {_PRIME}"
    return f"((({two}) * {_STEP} + ({one})) % {_PRIME})"


def _quotas(parts: DataFrame, keys: list[str], weight: str, total: Column, at: list[str]) -> DataFrame:
    """``total`` seats among the rows of each ``keys`` group by highest quotients weight / (2 k + 1).

    A row's seats differ from its exact share by less than (n / (2 total)) of
    the share plus one half for n rows, so only the quotients around the share
    are made and ranked. Ties go to the lower ``at``.
    """
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    rows = parts.withColumn("_all", F.sum(weight).over(group)).withColumn("_n", F.count("*").over(group)).withColumn("_seats", total)
    share = F.when(F.col("_all") > 0, F.col(weight) / F.col("_all") * F.col("_seats")).otherwise(F.lit(0.0))
    slack = F.when(F.col("_seats") > 0, share * F.col("_n") / (2 * F.col("_seats"))).otherwise(F.lit(0.0)) + 1.5
    rows = rows.withColumn("_low", F.greatest(F.floor(share - slack), F.lit(0)).cast("long")).withColumn("_high", F.ceil(share + slack).cast("long"))
    rows = rows.withColumn("_rest", F.col("_seats") - F.sum("_low").over(group))
    quotients = rows.withColumn("_k", F.explode(F.sequence(F.col("_low"), F.col("_high")))).withColumn("_q", F.col(weight) / (2 * F.col("_k") + 1))
    ranked = quotients.withColumn("_rank", F.row_number().over(group.orderBy(F.desc("_q"), *at, "_k")))
    won = F.sum(F.when((F.col("_rank") <= F.col("_rest")) & (F.col("_q") > 0), 1).otherwise(0))
    return ranked.groupBy(*parts.columns).agg((F.first("_low") + won).alias("quota"))


def targets(sized: DataFrame) -> DataFrame:
    """number, source, source_size, target per source, by water filling: weights up to REPEATS times the size."""
    order = [F.col("source").isNull(), F.col("source")]
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("number", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    sources = sources.withColumn("weight", weight.cast("long")).withColumn("cap", REPEATS * F.col("source_size"))
    filling = W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "number")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    after = filling.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    level = (TOTAL * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    # The level rises with each source found full and falls after the last of them, so the highest one holds.
    full = F.max("level").over(everything)
    return sources.withColumn("level", level).withColumn("target", F.least(F.col("cap").cast("double"), full * F.col("weight"))).select("number", "source", "source_size", "target")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken per row of ``docs`` (doc_id, text, source).

    A document's size is its words (0 for null); ``taken`` counts words, a word
    taken twice counting twice. Sources without words get nothing. Equal rows
    are separate documents that take the same place in the order; null doc_ids
    count as 0 there. An empty table gives an empty result.
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = stage(docs.select("doc_id", "source", words.alias("size")), "sized")
    sources = targets(sized)
    whole = W.partitionBy(F.lit(0))
    smallest = F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(whole)
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.coalesce(smallest, F.lit(1)) / LEAST_BLOCKS))).cast("long"))
    seats = F.round(TOTAL * F.sum("source_size").over(whole) / F.col("block")).cast("long")
    sources = stage(_quotas(sources, [], "target", seats, ["number"]), "sources")

    shards = F.greatest(F.ceil(F.col("source_size") / (SHARD_BLOCKS * F.col("block"))), F.lit(1)).cast("long")
    held = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select("doc_id", sized["source"], "size", "number", "source_size", "target", "block", "quota", shards.alias("shards"))
    held = held.withColumn("shard", F.expr(f"{scramble('coalesce(doc_id, 0)', '1')} % shards")).withColumn("super", F.expr(f"shard % ((shards + {SHARD_BLOCKS - 1}) div {SHARD_BLOCKS})"))
    sums = stage(held.groupBy("number", "block", "quota", "super", "shard").agg(F.sum("size").alias("words")), "shards")
    supers = sums.groupBy("number", "quota", "super").agg(F.sum("words").alias("words"))
    supers = _quotas(supers.withColumnRenamed("quota", "seats"), ["number"], "words", F.col("seats"), ["super"]).select("number", "super", "quota")
    parts = sums.drop("quota").join(supers.withColumnRenamed("quota", "seats"), ["number", "super"])
    parts = _quotas(parts, ["number", "super"], "words", F.col("seats"), ["shard"])
    parts = parts.withColumn("n", F.expr("CASE WHEN words > 0 THEN greatest((2 * words + block) div (2 * block), 1) ELSE 0 END")).withColumn("quota", F.least("quota", REPEATS * F.col("n")))
    key = f"({scramble('(j * 1000003 + shard * 7919 + number * 104729)', '2')} * 8388608 + j)"
    last = f"CASE WHEN n > 0 AND quota % n > 0 THEN array_sort(transform(sequence(cast(0 AS BIGINT), n - 1), j -> {key}))[cast(quota % n - 1 AS INT)] END"
    parts = parts.select("number", "shard", "words", "n", "quota", F.expr(last).alias("last"))

    stream = W.partitionBy("number", "shard").orderBy(F.expr(scramble("coalesce(doc_id, 0)", "3")), "doc_id", "size")
    placed = held.withColumn("to", F.sum("size").over(stream.rowsBetween(W.unboundedPreceding, 0))).withColumn("at", F.col("to") - F.col("size"))
    chosen = placed.join(parts.withColumnRenamed("quota", "blocks"), ["number", "shard"])
    overlap = f"CASE WHEN {key} <= last THEN least(to, (j + 1) * words div n) - greatest(at, j * words div n) ELSE cast(0 AS BIGINT) END"
    extra = f"aggregate(sequence(((at + 1) * n - 1) div words, (to * n - 1) div words), cast(0 AS BIGINT), (a, j) -> a + {overlap})"
    taken = f"CASE WHEN size > 0 THEN (blocks div n) * size + CASE WHEN last IS NULL THEN cast(0 AS BIGINT) ELSE {extra} END ELSE cast(0 AS BIGINT) END"
    return chosen.select("doc_id", "source", "size", "source_size", "target", F.expr(taken).alias("taken"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mix(table(spark, sf_dir, "documents"))


def _sql_quotas(name: str, rows: str, keys: str, weight: str, seats: str, at: str) -> str:
    """The same apportionment in DuckDB's SQL, as common table expressions ending in ``name``."""
    by = f"PARTITION BY {keys}" if keys else ""
    return f"""
{name}_a AS (SELECT *, {seats} AS _seats, sum({weight}) OVER ({by}) AS _all, count(*) OVER ({by}) AS _n FROM {rows}),
{name}_b AS (SELECT *, CASE WHEN _all > 0 THEN {weight} / _all * _seats ELSE 0.0 END AS _share FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN _seats > 0 THEN _share * _n / (2 * _seats) ELSE 0.0 END + 1.5 AS _slack FROM {name}_b),
{name}_d AS (SELECT *, CAST(greatest(floor(_share - _slack), 0) AS BIGINT) AS _low, CAST(ceil(_share + _slack) AS BIGINT) AS _high FROM {name}_c),
{name}_e AS (SELECT *, unnest(range(_low, _high + 1)) AS _k FROM (SELECT *, _seats - sum(_low) OVER ({by}) AS _rest FROM {name}_d)),
{name}_f AS (SELECT *, {weight} / (2 * _k + 1) AS _q, row_number() OVER ({by} ORDER BY {weight} / (2 * _k + 1) DESC, {at}, _k) AS _rank FROM {name}_e),
{name} AS (SELECT {keys + ', ' if keys else ''}{at}, CAST(any_value(_low) + count(*) FILTER (WHERE _rank <= _rest AND _q > 0) AS BIGINT) AS quota FROM {name}_f GROUP BY ALL)"""


_KEY = f"({scramble('(j * 1000003 + shard * 7919 + number * 104729)', '2')} * 8388608 + j)"
ORACLE = f"""
WITH sized AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number FROM sized GROUP BY source),
s1 AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][number % {len(WEIGHTS)} + 1] AS weight, {REPEATS} * source_size AS cap FROM s0),
s2 AS (SELECT *, ({TOTAL}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT number, source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM s2),
s4 AS (SELECT *, CAST(greatest(1, least({BLOCK}, floor(coalesce(min(source_size) FILTER (WHERE source_size > 0) OVER (), 1) / {LEAST_BLOCKS}))) AS BIGINT) AS block, sum(source_size) OVER () AS everything FROM s3),
{_sql_quotas('sq', 's4', '', 'target', f'CAST(round({TOTAL} * everything / block) AS BIGINT)', 'number')},
held0 AS (SELECT sized.*, s4.number, s4.source_size, s4.target, s4.block, sq.quota AS seats, CAST(greatest(ceil(s4.source_size / ({SHARD_BLOCKS} * s4.block)), 1) AS BIGINT) AS shards
  FROM sized JOIN s4 ON sized.source IS NOT DISTINCT FROM s4.source JOIN sq ON sq.number = s4.number),
held1 AS (SELECT *, {scramble('coalesce(doc_id, 0)', '1')} % shards AS shard FROM held0),
held AS (SELECT *, shard % ((shards + {SHARD_BLOCKS - 1}) // {SHARD_BLOCKS}) AS super FROM held1),
sums AS (SELECT number, block, seats, super, shard, CAST(sum(size) AS BIGINT) AS words FROM held GROUP BY ALL),
u AS (SELECT number, seats, super, sum(words) AS words FROM sums GROUP BY ALL),
{_sql_quotas('uq', 'u', 'number', 'words', 'seats', 'super')},
p0 AS (SELECT sums.number, sums.block, sums.super, sums.shard, sums.words, uq.quota AS seats FROM sums JOIN uq ON uq.number = sums.number AND uq.super = sums.super),
{_sql_quotas('pq', 'p0', 'number, super', 'words', 'seats', 'shard')},
p1 AS (SELECT p0.number, p0.shard, p0.words, pq.quota, CASE WHEN p0.words > 0 THEN greatest((2 * p0.words + p0.block) // (2 * p0.block), 1) ELSE 0 END AS n
  FROM p0 JOIN pq ON p0.number = pq.number AND p0.super = pq.super AND p0.shard = pq.shard),
p2 AS (SELECT number, shard, words, n, least(quota, {REPEATS} * n) AS blocks FROM p1),
keys AS (SELECT number, shard, n, blocks, {_KEY} AS key FROM (SELECT *, unnest(range(0, n)) AS j FROM p2)),
ends AS (SELECT number, shard, max(key) AS last FROM (SELECT *, row_number() OVER (PARTITION BY number, shard ORDER BY key) AS k FROM keys) WHERE k <= blocks % n GROUP BY ALL),
placed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY number, shard ORDER BY {scramble('coalesce(doc_id, 0)', '3')}, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS to_ FROM held),
c0 AS (SELECT placed.*, placed.to_ - placed.size AS at_, p2.words, p2.n, p2.blocks, ends.last FROM placed JOIN p2 ON placed.number = p2.number AND placed.shard = p2.shard
  LEFT JOIN ends ON placed.number = ends.number AND placed.shard = ends.shard),
c1 AS (SELECT *, unnest(range(((at_ + 1) * n - 1) // words, (to_ * n - 1) // words + 1)) AS j FROM c0 WHERE size > 0 AND last IS NOT NULL),
c2 AS (SELECT r, sum(CASE WHEN {_KEY} <= last THEN least(to_, (j + 1) * words // n) - greatest(at_, j * words // n) ELSE 0 END) AS extra FROM c1 GROUP BY r)
SELECT doc_id, source, size, source_size, target, CAST(CASE WHEN size > 0 THEN (blocks // n) * size + coalesce(extra, 0) ELSE 0 END AS BIGINT) AS taken FROM c0 LEFT JOIN c2 USING (r)
"""
