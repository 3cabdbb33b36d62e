"""Exact Jaccard join of word-shingle sets in a metric space of pivots and regions.

The distance 1 - J is a metric. Random documents lie at distance 1 from nearly
every document pivot, so Voronoi cells around documents alone would copy every
text into every cell. The space is therefore cut twice:

1. Outer regions. Sizes are distances from the empty set in the metric |x ^ y|;
   they cut the space into shells, and a set within reach of the next lower
   shell is copied into it (the window). J >= t leaves at most r differing
   shingles to two sets of a shell, so of r + 1 (and a few more) hashed pieces
   of the shingle universe at least some hold the same shingles in both: sets
   that agree in a piece share a region. Pieces of very few shingles say
   little and are skipped; a set with too many of those is cut again by another
   hash, until enough remain, so no link is lost. Only sets that pass a test
   get there: a set with a link misses at most 1 - J of its shingles in the
   other, so of those below a fixed hash all but that many are in other sets.
2. Inner regions. Each connected group of outer regions is joined exactly on
   its whole sets: pivots, Voronoi cells, windows of 2 (1 - t) by the triangle
   inequality, cells joined recursively. Large groups are dealt over a grid of
   tasks. Only links that connect something new are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import cells, components, table
from tidemark.llm.tokens import all_shingles, mix, slices, text_bytes, words
from tidemark.session import release, stage

#: Least similarity (per cent), fewest shingles in a piece that makes a region, growth of sizes from shell to shell, pieces
#: to spare as a share of the differing shingles. A set of n shingles has about n / (differing * (1 + spare)) in a piece;
#: with fewer than that in most pieces, no round of cuts would do.
SHAPES = ((88, 3, (5, 4), 1 / 8), (0, 2, (9, 8), 1 / 2))
#: The test before the regions looks at the shingles of lowest hash: this many times the share that linked sets may differ in.
TESTED = 2
#: Ranges of hashes in which they are counted, and bytes of them that are dealt out at once.
RANGES, DEALT_BYTES = 1024, 16 << 20
#: Documents of a group that one task joins.
CELL = 800
#: Below this many, a region is compared pair by pair.
LEAF = 24
PIVOTS = 6
#: A region whose largest cell with its window keeps more than this share is not cut further.
SPLIT = 0.6


class Shells:
    """Size classes and, for each, the differing shingles and the pieces. ``percent`` is the least similarity."""

    def __init__(self, percent: int):
        self.percent, self.low, self.reach = percent, [1], []
        _, self.piece, (up, down), self.spare = next(x for x in SHAPES if percent >= x[0])
        while self.low[-1] < 1 << 40:
            low = self.low[-1]
            high = max(low + 1, -(-low * up // down))
            while not self.low[1:] and self.differing(high) == 0:
                high += 1
            self.reach.append(self.differing(high - 1))
            self.low.append(high)

    def differing(self, smaller: int) -> int:
        """Most shingles held by one only of two linked sets, the smaller of this size."""
        union = 100 * smaller // self.percent
        return union * (100 - self.percent) // 100

    def of(self, size: int) -> range:
        at = lambda n: int(np.searchsorted(self.low, n, "right")) - 1
        return range(at(-(-size * self.percent // 100)), at(size) + 1)


def regions(held: np.ndarray, shells: Shells) -> np.ndarray:
    """Keys of the outer regions of one set of shingle hashes (ascending)."""
    keys = []
    for shell in shells.of(len(held)) if len(held) else ():
        reach = shells.reach[shell]
        if reach == 0:
            continue  # only equal sets link, and those are one node
        pieces, round_, least = reach + 1 + int(reach * shells.spare), 0, shells.piece
        while True:
            spread = mix(held + np.uint64((shell << 20) + round_ + 1))
            piece = (spread % np.uint64(pieces)).astype(np.int64)
            count = np.bincount(piece, minlength=pieces)
            low = np.bincount(piece, (spread >> np.uint64(32)).astype(np.float64), pieces).astype(np.uint64)
            high = np.bincount(piece, (mix(spread) >> np.uint64(32)).astype(np.float64), pieces).astype(np.uint64)
            strong = np.flatnonzero(count >= least)
            place = (strong.astype(np.uint64) << np.uint64(44)) ^ np.uint64(round_)
            keys.append(mix(mix(low[strong] + np.uint64(shell)) ^ (high[strong] << np.uint64(20)) ^ place))
            if pieces - len(strong) < pieces - reach:
                break
            round_ += 1
            least = shells.piece if round_ < 40 else 1
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def _sets(width: int, column: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = text_bytes(column)
    for i, j in slices(offsets):
        yield from all_shingles(words(data, offsets[i : j + 1]), width)


def _node(held: np.ndarray) -> int:
    """Hash of a whole set; equal sets are one node."""
    whole = np.add.reduce(mix(held ^ np.uint64(0xA5A5A5A5A5A5)), keepdims=True) + np.uint64(len(held))
    return int(mix(whole).view(np.int64)[0])


def _cut(percent: int) -> int:
    """Shingles with a hash below this are tested."""
    return min(TESTED * (100 - percent), 100) * (1 << 64) // 100


def sketch(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, tk, n_shingles, node, need, tested) per row of ``docs`` (doc_id, tk, text); node is null without words.

    ``tested`` holds the hashes below the cut, once for equal sets of a
    partition; a set with a link has ``need`` of them at least in common with
    the other.
    """
    cut = _cut(percent)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            size, node, need, tested = [], [], [], []
            for held in _sets(width, batch.column("text")):
                n = len(held)
                low = n if cut >> 64 else int(np.searchsorted(held, np.uint64(cut)))
                one = _node(held) if n else None
                size.append(n)
                node.append(one)
                need.append(low - n * (100 - percent) // 100 if n else None)
                tested.append(held[:low].tobytes() if n and one not in seen else None)
                seen.add(one)
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("tk"), *(pa.array(x, pa.int64()) for x in (size, node, need)), pa.array(tested, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tk", "n_shingles", "node", "need", "tested"])

    return docs.mapInArrow(run, "doc_id long, tk long, n_shingles long, node long, need long, tested binary")


def _packed(parts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value for each stretch of ``parts`` between two of ``ends``."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(parts))])


def _in_common(hashes: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending hashes: where each begins and whether two different nodes hold it."""
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return first, np.minimum.reduceat(nodes, first) != np.maximum.reduceat(nodes, first)


def _counted(nodes: np.ndarray) -> pa.RecordBatch:
    node, n = np.unique(nodes, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64())], names=["node", "n"])


def in_common(tested: DataFrame, percent: int) -> DataFrame:
    """(node, n): how many of its tested shingles another node holds too, summed over the rows of ``tested``; nodes without any are left out.

    Hashes are sorted in numpy by ranges. What is common within a batch is
    counted there and goes on as two entries for any number of sets, so no task
    reads a very common shingle once for each.
    """
    edges = np.array([k * (_cut(percent) // RANGES) for k in range(1, RANGES)], np.uint64)
    names = ["range", "done", "a", "b"]

    def deal(batches):
        for batch in batches:
            column = batch.column("tested").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            ids = batch.column("node").to_numpy()
            for i, j in slices(offsets, DEALT_BYTES):
                n = int(offsets[j] - offsets[i]) // 8
                if not n:
                    continue
                hashes = np.frombuffer(column.buffers()[2], np.uint64, n, int(offsets[i]))
                order = np.argsort(hashes)
                hashes, nodes = hashes[order], np.repeat(ids[i:j], np.diff(offsets[i : j + 1]) // 8)[order]
                first, common = _in_common(hashes, nodes)
                every = np.repeat(common, np.diff(np.append(first, n)))
                own = _counted(nodes[every])
                # Two nodes of no set stand for all; should a set have their number, it counts too many and is kept.
                goes = ~every
                for number in (0, 1):
                    goes[first[common] + number] = True
                    nodes[first[common] + number] = number
                hashes, nodes = hashes[goes], nodes[goes]
                ends = np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])
                full = np.flatnonzero(np.diff(ends))
                ends = np.append(ends[full], len(hashes))
                columns = [pa.array(full, pa.int32()), pa.array(np.zeros(len(full), bool)), _packed(hashes, ends), _packed(nodes, ends)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                if len(own):
                    ends = np.array([0, len(own)])
                    columns = [pa.array([int(own.column(0)[0].as_py()) % RANGES], pa.int32()), pa.array([True]), *(_packed(x.to_numpy(), ends) for x in own.columns)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    def count(batches):
        at, hashes, nodes = None, [], []

        def close():
            if hashes:
                h, who = np.concatenate(hashes), np.concatenate(nodes)
                order = np.argsort(h)
                first, common = _in_common(h[order], who := who[order])
                yield _counted(who[np.repeat(common, np.diff(np.append(first, len(h))))])

        for batch in batches:
            for k, done, a, b in zip(*(batch.column(x) for x in range(4)), strict=True):
                if done.as_py():
                    columns = [pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in (a, b)]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "n"])
                    continue
                if k.as_py() != at:
                    yield from close()
                    at, hashes, nodes = k.as_py(), [], []
                # Copies, so that no batch is kept.
                hashes.append(np.frombuffer(a.as_buffer(), np.uint64).copy())
                nodes.append(np.frombuffer(b.as_buffer(), np.int64).copy())
        yield from close()

    dealt = tested.select("node", "tested").mapInArrow(deal, "range int, done boolean, a binary, b binary").repartition("range").sortWithinPartitions("range")
    return dealt.mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def placed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, regions) per set with words; they go into the shuffle by region and are written nowhere else.

    Equal sets of a partition come once, so copies do not repeat their regions.
    """
    shells = Shells(percent)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            node, keys = [], []
            for held in _sets(width, batch.column("text")):
                one = _node(held) if len(held) else None
                if one is not None and one not in seen:
                    seen.add(one)
                    node.append(one)
                    keys.append(regions(held, shells).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), held], names=["node", "regions"])

    return docs.select("text").mapInArrow(run, "node long, regions array<long>")


class _Links:
    """Which sets are known to be connected, and the links that made them so."""

    def __init__(self, n: int):
        self.up, self.made, self.parts = list(range(n)), [], n

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.made.append((i, j))
            self.parts -= 1


class _Space:
    """Sets as one flat array of small numbers, for distances from one set to many.

    The array leaves out shingles that a single set holds: nothing shares them, only sizes count them.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.size = np.array([len(x) for x in sets])
        held, flat, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = times[flat] > 1
        self.flat = flat[common]
        self.first = np.concatenate([[0], np.cumsum(common)])[np.concatenate([[0], np.cumsum(self.size)])]
        self.mark = np.zeros(len(held), bool)
        self.percent = percent

    def similar(self, one: int, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shared and joint shingles of ``one`` and each of ``many``."""
        own = self.flat[self.first[one] : self.first[one + 1]]
        self.mark[own] = True
        size = self.first[many + 1] - self.first[many]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.first[many] - ends[:-1], size) + np.arange(ends[-1])
        marked = np.concatenate([[0], np.cumsum(self.mark[self.flat[at]])])
        shared = marked[ends[1:]] - marked[ends[:-1]]
        shared[many == one] = self.size[one]
        self.mark[own] = False
        return shared, self.size[many] + self.size[one] - shared

    def link(self, one: int, many: np.ndarray, links: _Links) -> np.ndarray:
        """Link ``one`` with those of ``many`` in reach; the distances."""
        shared, joint = self.similar(one, many)
        for k in many[100 * shared >= self.percent * joint]:
            links.join(one, int(k))
        return 1 - shared / joint


def join_region(space: _Space, members: np.ndarray, links: _Links) -> None:
    """All links between ``members`` that connect something new."""
    reach = 1 - space.percent / 100 + 1e-9
    if len({links.find(int(i)) for i in members}) == 1:
        return
    if len(members) <= LEAF:
        for k, one in enumerate(members[:-1]):
            space.link(int(one), members[k + 1 :], links)
        return
    pivots, away = [0], []
    for _ in range(PIVOTS):
        away.append(space.link(int(members[pivots[-1]]), members, links))
        pivots.append(int(np.argmax(np.min(away, axis=0))))
    away = np.array(away)
    inside = away - np.min(away, axis=0) <= 2 * reach
    if inside.sum(axis=1).max() <= SPLIT * len(members):
        for cell in range(PIVOTS):
            join_region(space, members[inside[cell]], links)
        return
    # Windows hold nearly all: compare each set with those that its distances to the pivots leave.
    root = np.array([links.find(int(i)) for i in members])
    for k, one in enumerate(members):
        near = (root != root[k]) & (np.abs(away - away[:, [k]]) <= reach).all(axis=0)
        if near.any():
            before = links.parts
            space.link(int(one), members[near], links)
            if links.parts != before:
                root = np.array([links.find(int(i)) for i in members])
                if (root == root[0]).all():
                    return


def _join_cell(width: int, percent: int):
    def run(rows: pa.Table) -> pa.Table:
        node, at = np.unique(rows.column("node").to_numpy(), return_index=True)
        links = _Links(len(node))
        if len(node) > 1:
            sets = list(_sets(width, rows.column("text").combine_chunks().take(pa.array(at))))
            join_region(_Space(sets, percent), np.argsort([len(x) for x in sets], kind="stable"), links)
        a, b = (np.array([node[x[k]] for x in links.made], np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Groups of documents whose shingle sets are linked by similarity.

    ``docs`` has doc_id and text; other columns are ignored. Words are runs of
    bytes other than white space, lower-cased A-Z. Returns a row per row of
    ``docs``: doc_id, n_shingles (0 for null or no words), component_id (the
    smallest doc_id reachable over links of at least ``percent`` similarity,
    its own if there is none), n_texts (different sets in the group). Rows of
    equal texts, also repeated rows, are one node and always in one group; rows
    without words link with nothing. An empty table gives an empty result.
    """
    # Rows without doc_id are found again by a hash of their text.
    known = docs.select("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("tk"), "text")
    sets = stage(sketch(known, width, percent), "sets")
    owner = [F.coalesce("doc_id", "tk").alias("owner"), F.col("doc_id").isNull().alias("none")]
    held = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("tk").alias("tk"), F.min("need").alias("need"), F.count("tested").alias("copies"))
    common = in_common(sets.where("tested is not null"), percent)
    linked = held.join(common, "node", "left").where(F.coalesce("n", F.lit(0)) >= F.col("need") * F.col("copies")).select("node", *owner)
    texts = known.select(*owner, "text").join(linked.hint("shuffle_hash"), ["owner", "none"])
    wanted = stage(texts.select("node", "text").mapInArrow(_own_text(width), "node long, text string"), "texts")
    # Goes on without the hashes.
    rows = stage(sets.select("doc_id", "n_shingles", "node"), "rows")
    release(sets)

    keys = placed(wanted, width, percent).select("node", F.explode("regions").alias("region"))
    keys = keys.withColumn("lead", F.expr("min(node) over (partition by region)"))
    outer = components(keys.where("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b")))
    dealt = cells(outer, "component", "node", CELL).select("component", "cell", "node").join(wanted, "node")
    links = dealt.groupBy("component", "cell").applyInArrow(_join_cell(width, percent), "a long, b long")

    inner = components(links)
    release(outer, wanted)
    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    labels = least.join(inner, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = labels.groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_texts"))
    labels = labels.join(least, "component").select("node", "least", "n_texts")
    return rows.join(labels, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("n_texts", F.lit(1)).alias("n_texts")
    )


def _own_text(width: int):
    """Keep rows whose text makes the node: a doc_id may have several texts."""

    def run(batches):
        for batch in batches:
            node = batch.column("node").to_numpy()
            keep = [bool(len(held)) and _node(held) == n for n, held in zip(node, _sets(width, batch.column("text")), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of documents at 3-word-shingle Jaccard 0.9 or more, over the whole table."""
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
