"""Shards of near equal bytes by a k-d tree over document metadata, with built-in functions only.

The points of the tree are groups of equal texts: a group has the least
doc_id, language and source of its rows and the bytes of all of them. A node
that holds k shards is cut along its widest dimension at the weighted median
(at ceil(k / 2) / k of its bytes), until each leaf is one shard, that is, until
it has reached the target bytes. Weighted medians are exact and distributed:
bytes are summed in at most SPLITS ranges of the dimension for all nodes of a
level at once, the range that holds the median is cut again, and ties of the
dimension go by a hash of the text. Only cuts, one a node, reach the driver.

A group above 1 / PIECES of a shard is dealt in pieces by a hash of doc_id.
Pieces lie side by side in the order, so a group is split only where a cut
falls into it; all other equal texts share a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.frames import table
from tidemark.session import release, stage

SHARDS = 16
#: Ranges of a round of the median search; pieces that a shard's bytes count for at least, and most pieces of a group.
SPLITS, PIECES, MOST_PIECES = 4096, 64, 4096
#: Rows of one numbering task, about.
SLOT_ROWS = 8192
#: Dimensions in the order in which the widest is sought: bytes, language, source, doc_id.
DIMENSIONS = 4


def _digest(text: Column, digits: int) -> Column:
    """The first hex digits of a SHA-256 or MD5 as a number."""
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("long")


def _pick(values: list, node: Column) -> Column:
    """The value of a row's node; ``values`` has one entry a node."""
    return F.get(F.array(*[F.lit(v) if isinstance(v, bool) else F.lit(v).cast("long") for v in values]), node)


def _medians(points: DataFrame, value: Column, goals: dict[int, tuple]) -> dict[int, tuple]:
    """Per node the value at which the bytes reach a share of it, the bytes before it and those at it.

    ``goals``: node -> (low, high, bytes before low, share's numerator, its denominator, bytes of the node).
    """
    found: dict[int, tuple] = {}
    while goals:
        top = max(goals) + 1
        row = lambda i, default: [goals[n][i] if n in goals else default for n in range(top)]  # noqa: E731,B023
        lows, highs = row(0, 0), row(1, -1)
        steps = [max(1, -(-(h - l + 1) // SPLITS)) for l, h in zip(lows, highs, strict=True)]
        node = F.col("node")
        inside = points.withColumn("_v", value).where((node < top) & (F.col("_v") >= _pick(lows, node)) & (F.col("_v") <= _pick(highs, node)))
        bucket = F.expr(f"(_v - {_sql_pick(lows)}) div {_sql_pick(steps)}")
        sums = inside.groupBy("node", bucket.alias("b")).agg(F.sum("w").alias("w"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        run = F.sum("w").over(W.partitionBy("node").orderBy("b"))
        reached = (_pick(row(2, 0), node) + F.col("upto")) * _pick(row(4, 1), node) >= _pick(row(5, 0), node) * _pick(row(3, 0), node)
        first = sums.withColumn("upto", run).where(reached).groupBy("node").agg(F.min_by(F.struct("low", "high", "upto", "w"), "b").alias("at"))
        for r in first.collect():  # one row a node
            _, _, before, up, down, total = goals.pop(r.node)
            before += r["at"].upto - r["at"].w
            if r["at"].low == r["at"].high:
                found[r.node] = (r["at"].low, before, r["at"].w)
            else:
                goals[r.node] = (r["at"].low, r["at"].high, before, up, down, total)
    return found


def _sql_pick(values: list[int]) -> str:
    return f"get(array({', '.join(f'cast({v} as bigint)' for v in values)}), node)"


def leaves(points: DataFrame, shards: int) -> DataFrame:
    """``points`` (w, h, d0 ..) with ``node``: the leaf of each, from 0 to ``shards`` - 1.

    Nodes are numbered by their first shard. One without bytes is not cut.
    Every level is written, so its expressions stay as short as the first one's.
    """
    at = points.withColumn("node", F.lit(0))
    held = {0: shards}
    root: list[tuple] = []
    while any(k > 1 for k in held.values()):
        spans = at.groupBy("node").agg(F.sum("w").alias("w"), *[f(f"d{k}").alias(f"{n}{k}") for k in range(DIMENSIONS) for n, f in (("low", F.min), ("high", F.max))])
        rows = {r.node: r for r in spans.collect() if held[r.node] > 1}  # one row a node
        if not rows:
            break
        if not root:
            root = [(float(rows[0][f"low{k}"]), float(rows[0][f"high{k}"])) for k in range(DIMENSIONS)]
        widest = {}
        for n, r in rows.items():
            width = [(float(r[f"high{k}"]) - float(r[f"low{k}"])) / (hi - lo) if hi > lo else 0.0 for k, (lo, hi) in enumerate(root)]
            widest[n] = max(range(DIMENSIONS), key=lambda k: (width[k], -k))  # noqa: B023
        left = {n: -(-held[n] // 2) for n in rows}
        of = lambda values, default, top=max(rows) + 1: _pick([values.get(n, default) for n in range(top)], F.col("node"))
        dimension = F.get(F.array(*[F.col(f"d{k}") for k in range(DIMENSIONS)]), of(widest, 0))
        goals = {n: (r[f"low{widest[n]}"], r[f"high{widest[n]}"], 0, left[n], held[n], r.w) for n, r in rows.items()}
        active = at.where(F.col("node").isin(list(rows)))
        values = _medians(active, dimension, goals)
        value = of({n: v for n, (v, _, _) in values.items()}, 0)
        hashes = _medians(active.where(dimension == value), F.col("h"), {n: (0, (1 << 60) - 1, values[n][1], left[n], held[n], rows[n].w) for n in rows})
        # The point at the median goes where it leaves the bytes nearer to the goal.
        with_left = {n: 2 * before * held[n] + w * held[n] <= 2 * rows[n].w * left[n] for n, (_, before, w) in hashes.items()}
        h = of({n: h for n, (h, _, _) in hashes.items()}, 0)
        before = (dimension < value) | ((dimension == value) & ((F.col("h") < h) | ((F.col("h") == h) & of(with_left, False))))
        step = of(left, 0)
        routed = stage(at.withColumn("node", F.when((step > 0) & ~before, (F.col("node") + step).cast("int")).otherwise(F.col("node"))), "shard-level")
        release(at)
        at = routed
        held = {m: k for n, k0 in held.items() for m, k in ([(n, left[n]), (n + left[n], k0 - left[n])] if n in rows else [(n, k0)])}
    return at


def shard(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row of ``docs`` (doc_id, text, lang, source).

    A size is the text's UTF-8 bytes (null: none) plus 1; with ``target_bytes``
    there are as many shards as that size needs. Slots number a shard's rows
    from 0 in the order of a hash of doc_id. Null ids, languages and sources
    count as empty, null and empty texts are equal texts. Rows equal in doc_id
    and text are one point; a single text longer than a shard stays whole, and
    its shard is as large as it is. An empty table gives no rows. Other columns
    of ``docs`` do not matter.
    """
    text = F.coalesce("text", F.lit(""))
    code = lambda c: F.crc32(F.coalesce(F.col(c), F.lit("")).cast("binary"))
    id_hash = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = stage(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("text_hash"), id_hash.alias("id_hash"),
        code("lang").alias("lang"), code("source").alias("source"), F.shiftright(F.coalesce(F.col("doc_id").try_cast("long"), F.lit(0)), 1).cast("long").alias("place"),
    ), "shard-rows")
    whole = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    total, n = whole["bytes"] or 0, whole["n"]
    shards = max(1, -(-total // target_bytes)) if target_bytes else shards
    piece = (_digest(F.col("id_hash"), 4) % MOST_PIECES).cast("int")
    facts = [F.sum("size").alias("w"), F.min("place").alias("place"), F.min("lang").alias("lang"), F.min("source").alias("source"), F.min("size").alias("size")]
    # Salted first, so a text with a third of all rows is no single group of the shuffle.
    salted = rows.groupBy("text_hash", piece.alias("piece")).agg(*facts)
    groups = salted.groupBy("text_hash").agg(F.sum("w").alias("group_w"), *[F.min(c).alias(f"g_{c}") for c in ("place", "lang", "source")])
    # At most shards x PIECES groups are above this size.
    heavy = stage(groups.where(F.col("group_w") * shards * PIECES > F.lit(total)), "shard-heavy")
    large = F.broadcast(heavy.select("text_hash", *[F.col(f"g_{c}").alias(f"h_{c}") for c in ("place", "lang", "source")]))
    dealt = salted.join(large, "text_hash", "left")
    is_heavy = F.col("h_place").isNotNull()
    dealt = dealt.select(
        "text_hash", F.when(is_heavy, F.col("piece")).otherwise(0).alias("piece"), "w", "size",
        *[F.coalesce(f"h_{c}", c).alias(c) for c in ("place", "lang", "source")],
    )
    points = dealt.groupBy("text_hash", "piece").agg(F.sum("w").alias("w"), F.min("size").alias("d0"), F.min("lang").alias("d1"), F.min("source").alias("d2"), F.min("place").alias("d3"))
    points = stage(points.withColumn("h", _digest(F.col("text_hash"), 12) * MOST_PIECES + F.col("piece")), "shard-points")
    homes = leaves(points, shards).select("text_hash", "piece", F.col("node").alias("shard"))
    placed = rows.join(F.broadcast(heavy.select("text_hash", F.lit(True).alias("heavy"))), "text_hash", "left")
    placed = placed.withColumn("piece", F.when(F.col("heavy"), piece).otherwise(0)).join(homes, ["text_hash", "piece"])
    # Tasks number ranges of the id's hash; as many as keep a task small.
    digits = 2
    while n > shards * SLOT_ROWS * 16**digits:
        digits += 1
    placed = placed.withColumn("part", F.substring("id_hash", 1, digits))
    sizes = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    order = W.partitionBy("shard", "part").orderBy("id_hash", "doc_id", "text_hash")
    numbered = placed.withColumn("k", F.row_number().over(order)).join(before, ["shard", "part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_kd_shards(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return shard(table(spark, sf_dir, "documents"))


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes, by half bytes."""
    table16 = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table16.append(i)
    hexed = f"hex(encode({text}))"
    halves = f"list_transform(range(0, 2 * strlen({text})), lambda i: CAST(('0x' || substr({hexed}, CAST(i + 2 - 2 * (i % 2) AS BIGINT), 1)) AS BIGINT))"
    step = f"xor({table16}[CAST(xor(c, b) & 15 AS BIGINT) + 1], c >> 4)"
    return f"xor(list_reduce({halves}, lambda c, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _sql_level(k: int) -> str:
    """One level of the tree in SQL: nodes n{k} of the points a{k} are cut, giving a{k + 1}."""
    width = lambda d: f"CASE WHEN z.H{d} > z.L{d} THEN (n.H{d}::DOUBLE - n.L{d}::DOUBLE) / (z.H{d}::DOUBLE - z.L{d}::DOUBLE) ELSE 0.0 END"
    widths = ", ".join(f"{width(d)} AS s{d}" for d in range(DIMENSIONS))
    best = "CASE " + " ".join(f"WHEN s{d} = greatest({', '.join(f's{e}' for e in range(DIMENSIONS))}) THEN {d}" for d in range(DIMENSIONS)) + " END"
    spans = ", ".join(f"min(d{d}) AS L{d}, max(d{d}) AS H{d}" for d in range(DIMENSIONS))
    return f"""
n{k} AS (SELECT node, any_value(k) AS k, sum(w) AS total, {spans} FROM a{k} GROUP BY node),
w{k} AS (SELECT node, {best} AS dim FROM (SELECT n.node, {widths} FROM n{k} n, n0 z)),
v{k} AS (SELECT a.*, total, dim, CASE dim {' '.join(f'WHEN {d} THEN d{d}' for d in range(DIMENSIONS))} END AS v FROM a{k} a JOIN n{k} USING (node) JOIN w{k} USING (node)),
u{k} AS (SELECT *, sum(w) OVER (PARTITION BY node ORDER BY v, h) AS upto, sum(w) OVER (PARTITION BY node, v, h) AS here FROM v{k}),
c{k} AS (SELECT node, v AS cv, h AS ch, upto, here FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY v, h) AS i FROM u{k} WHERE k > 1 AND upto * k >= total * ((k + 1) // 2)) WHERE i = 1),
l{k} AS (SELECT u.*, k > 1 AND NOT ((v, h) < (cv, ch) OR ((v, h) = (cv, ch) AND 2 * (c.upto - c.here) * k + c.here * k <= 2 * total * ((k + 1) // 2))) AS goes_right
  FROM u{k} u LEFT JOIN c{k} c USING (node)),
a{k + 1} AS (SELECT text_hash, piece, w, h, d0, d1, d2, d3, CASE WHEN goes_right THEN node + (k + 1) // 2 ELSE node END AS node,
  CASE WHEN k = 1 THEN 1 WHEN goes_right THEN k // 2 ELSE (k + 1) // 2 END AS k FROM l{k})"""


_LEVELS = (SHARDS - 1).bit_length()
ORACLE = f"""
WITH codes AS (SELECT s, {sql_crc32('s')} AS crc FROM (SELECT DISTINCT coalesce(lang, '') AS s FROM documents UNION SELECT DISTINCT coalesce(source, '') FROM documents)),
rws AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS text_hash, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS id_hash,
  x.crc AS lang, y.crc AS source, coalesce(doc_id, 0) >> 1 AS place FROM documents JOIN codes x ON x.s = coalesce(lang, '') JOIN codes y ON y.s = coalesce(source, '')),
g AS (SELECT text_hash, min(place) AS place, min(lang) AS lang, min(source) AS source, min(size) AS size, sum(size) * {SHARDS} * {PIECES} > (SELECT sum(size) FROM rws) AS heavy FROM rws GROUP BY text_hash),
r AS (SELECT rws.doc_id, rws.size, t, text_hash, id_hash, g.place, g.lang, g.source, CASE WHEN heavy THEN CAST('0x' || substr(id_hash, 1, 4) AS BIGINT) % {MOST_PIECES} ELSE 0 END AS piece FROM rws JOIN g USING (text_hash)),
a0 AS (SELECT text_hash, piece, sum(size) AS w, CAST('0x' || substr(text_hash, 1, 12) AS BIGINT) * {MOST_PIECES} + piece AS h, min(size) AS d0, min(lang) AS d1, min(source) AS d2, min(place) AS d3,
  0 AS node, {SHARDS} AS k FROM r GROUP BY text_hash, piece),{','.join(_sql_level(k) for k in range(_LEVELS))}
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, CAST({sql_crc32('r.t')} AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(p.node AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY p.node ORDER BY id_hash, r.doc_id, r.text_hash) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN a{_LEVELS} p ON p.text_hash = r.text_hash AND p.piece = r.piece
"""
