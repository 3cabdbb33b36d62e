"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, one kept occurrence per connected group."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import cells, components, links_of_groups, table
from tidemark.llm.tokens import mix, slices, text_bytes, words
from tidemark.session import release, stage, staged_here

#: SimHashes of linked lines differ in at most this many of 64 bits.
BITS = 3
#: Pieces of the SimHash; BITS differences leave two of them equal.
BLOCKS = (13, 13, 13, 13, 12)
#: 1 - edit distance / longer length, of linked lines.
SIMILARITY = 0.8
#: Shorter lines are only compared as they are.
FUZZY_WORDS = 5
#: Lines of a group that one task verifies.
CELL = 500


def simhash(hashed: np.ndarray, line: np.ndarray) -> np.ndarray:
    """SimHash of the different words of each line; ``line`` ascends from 0 without gaps."""
    each = np.sort((line.astype(np.uint64) << np.uint64(40)) | (hashed >> np.uint64(24)))
    each = each[np.concatenate([[True], each[1:] != each[:-1]])]
    line = (each >> np.uint64(40)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    votes = np.add.reduceat(np.unpackbits(mix(each << np.uint64(24)).view(np.uint8).reshape(-1, 8), axis=1), head, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > np.diff(np.append(head, len(each)))[:, None], axis=1).view(np.int64).ravel()


def _line_rows(batches):
    """doc_id, tk, line (from 0), key, sim, n_words, again (equal to an earlier line of the text) per line with a word."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        out = []
        for i, j in slices(offsets):
            w = words(data, offsets[i : j + 1])
            if not len(w.start):
                continue
            breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
            text = np.repeat(np.arange(j - i), np.diff(w.first))
            line = breaks[w.start] - breaks[offsets[i : j] - offsets[i]][text]
            head = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(line) != 0)]))
            count = np.diff(np.append(head, len(text)))
            place = (np.arange(len(text)) - np.repeat(head, count)).astype(np.uint64)
            key = mix(np.add.reduceat(mix(w.hash + place * np.uint64(0x9E3779B97F4A7C15)), head) + count.astype(np.uint64))
            sim = simhash(w.hash, np.repeat(np.arange(len(head)), count))
            text, line, key = text[head], line[head], key.view(np.int64)
            order = np.lexsort((line, key, text))
            again = np.zeros(len(key), bool)
            again[order[1:]] = (np.diff(text[order]) == 0) & (np.diff(key[order]) == 0)
            out.append((text + i, line, key, sim, count, again))
        if out:
            text, line, key, sim, count, again = map(np.concatenate, zip(*out, strict=True))
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()).take(rows), batch.column("tk").take(rows), pa.array(line, pa.int32()), pa.array(key), pa.array(sim), pa.array(count, pa.int32()), pa.array(again)],
                names=["doc_id", "tk", "line", "key", "sim", "n_words", "again"],
            )


def _blocks() -> list[Column]:
    """A key for each pair of pieces: their number and their bits."""
    start = np.cumsum([0, *BLOCKS])
    masks = [(((1 << n) - 1) << int(s)) for n, s in zip(BLOCKS, start, strict=False)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in (a | b for a, b in combinations(masks, 2))]
    return [F.xxhash64(F.lit(k), F.col("sim").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)]


def _near(batches):
    """Links between near SimHashes of a partition that holds whole blocks; only those that connect something new."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    block, sim = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((sim, block))
    block, sim = block[order], sim[order]
    _, sim_id = np.unique(sim, return_inverse=True)
    up = list(range(int(sim_id.max()) + 1 if len(sim_id) else 0))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    made, at, lag = [], np.arange(len(block)), 0
    while len(at):
        lag += 1
        at = at[at + lag < len(block)]
        at = at[block[at] == block[at + lag]]
        close = at[np.bitwise_count((sim[at] ^ sim[at + lag]).view(np.uint64)) <= BITS]
        for i in close:
            a, b = find(int(sim_id[i])), find(int(sim_id[i + lag]))
            if a != b:
                up[max(a, b)] = min(a, b)
                made.append((sim[i], sim[i + lag]))
    a, b = (np.array([x[k] for x in made], np.int64) for k in (0, 1))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def distance(a: str | list[str], b: str | list[str]) -> int:
    """Levenshtein distance of texts or lists, a column of the table at once as the bits of two integers (Myers 1999)."""
    n = min(len(a), len(b))
    k = next((i for i in range(n) if a[i] != b[i]), n)
    a, b = a[k:], b[k:]
    n = min(len(a), len(b))
    k = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    plus, minus = full, 0
    for x in b:
        eq = where.get(x, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
    return score


def edits(longest: np.ndarray) -> np.ndarray:
    """The edits that lines of this longer length may be apart; a share of exactly SIMILARITY still links, so the product must not fall below it by rounding."""
    return np.floor((1 - SIMILARITY) * longest + 1e-6)


def alike(a: str, b: str) -> bool:
    long, short = max(len(a), len(b)), min(len(a), len(b))
    if short < SIMILARITY * long:
        return False
    # Changing a word changes its letters and a space at most; where that is enough, letters need no comparison.
    words, others = a.split(" "), b.split(" ")
    if distance(words, others) * (max(map(len, [*words, *others])) + 1) <= (1 - SIMILARITY) * long:
        return True
    return long - distance(a, b) >= SIMILARITY * long


def _grams(text: str) -> np.ndarray:
    """Counts of letter pairs, in 256 buckets."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.bincount((code[:-1] * np.uint32(31) + code[1:]) % np.uint32(251), minlength=256).astype(np.int32)


def _verify(rows: pa.Table) -> list[tuple[int, int]]:
    key, first = np.unique(rows["key"].to_numpy(), return_index=True)
    sim, text = rows["sim"].to_numpy()[first], [rows["line_text"][int(i)].as_py() for i in first]
    up, made = np.arange(len(key)), []
    length, grams = np.array([len(x) for x in text]), np.array([_grams(x) for x in text])
    for i in range(len(key)):
        near = np.flatnonzero((up != up[i]) & (np.bitwise_count((sim ^ sim[i]).view(np.uint64)) <= BITS))
        apart = np.abs(grams[near] - grams[i]).sum(axis=1)  # an edit changes four letter pairs at most
        for j in near[apart <= 4 * edits(np.maximum(length[near], length[i]))]:
            if up[j] != up[i] and alike(text[i], text[j]):
                made.append((key[i], key[j]))
                up[up == up[j]] = up[i]
    return made


def _wanted_lines(batches):
    """key, owner, line, line_text of the lines named by (text, keys)."""
    for batch in batches:
        out = []
        for owner, text, keys in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "keys")), strict=True):
            if not keys:
                continue
            column = pa.array([text], pa.string())
            for rows in _line_rows([pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), column], names=["doc_id", "tk", "text"])]):
                lines, keys = text.split("\n"), set(keys)
                for line, key, again in zip(*(rows.column(c).to_pylist() for c in ("line", "key", "again")), strict=True):
                    if key in keys and not again:
                        out.append((key, owner, line, " ".join(lines[line].split()).lower()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["key", "owner", "line", "line_text"]
        )


def fuzzy_groups(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, best): for each line in a group of different but similar lines, the key of the line that stays.

    ``lines`` has a row per distinct line: key, owner (its smallest doc_id, null if no text with it has one),
    owner_tk (the hash of a text of the owner that has the line), sim, n_words.
    """
    fuzzy = lines.where(F.col("n_words") >= FUZZY_WORDS)
    blocked = fuzzy.select("sim").distinct().select(F.explode(F.array(*_blocks())).alias("block"), "sim")
    near = components(blocked.repartition("block").mapInArrow(_near, "a long, b long"))
    grouped = fuzzy.join(near.withColumnRenamed("node", "sim"), "sim", "left").withColumn("near", F.coalesce("component", "sim"))
    several = grouped.groupBy("near").agg(F.count("*").alias("n")).where("n > 1").select("near")
    members = stage(grouped.join(several, "near").select("near", "key", "owner", "owner_tk", "sim"), "near-lines")

    # Texts are met by their hash, so those without doc_id keep their links and do not come together in one task.
    keys = members.groupBy("owner", "owner_tk").agg(F.collect_list("key").alias("keys"))
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("tk"))
    found = named.join(keys.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("tk") == F.col("owner_tk"))).select("doc_id", "text", "keys")
    texts = stage(found.mapInArrow(_wanted_lines, "key long, owner long, line int, line_text string").dropDuplicates(["key"]), "line-texts")
    dealt = cells(members, "near", "key", CELL).select("near", "cell", "key", "sim").join(texts.select("key", "line_text"), "key")
    same = components(links_of_groups(dealt, ["near", "cell"], _verify))
    placed = same.join(texts.select(F.col("key").alias("node"), "owner", "line"), "node")
    best = placed.groupBy("component").agg(F.min(F.struct(F.col("owner").isNull(), "owner", "line", "node")).alias("best"))
    return placed.join(best, "component").select(F.col("node").alias("key"), F.col("best.node").alias("best")).distinct()


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any others) with repeated lines taken out of text, plus n_lines and n_kept.

    Lines are what \\n separates; those without a word stay and are not counted.
    Two lines are the same if their words (white space aside, A-Z lower-cased)
    are; lines of at least ``FUZZY_WORDS`` words link if their SimHashes
    differ in at most ``BITS`` bits and their edit similarity is at least
    ``SIMILARITY``. Of each connected group the occurrence with the smallest
    (doc_id, line) stays, those without doc_id last. Null texts stay null; rows
    that share a doc_id, or have none, are not held against each other for equal
    lines; an empty table gives an empty result.
    """
    source = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64("text").alias("tk"))
    rows = stage(source.select("doc_id", "tk", "text").mapInArrow(_line_rows, "doc_id long, tk long, line int, key long, sim long, n_words int, again boolean"), "lines")
    owner_tk = F.coalesce(F.min_by("tk", "doc_id"), F.min("tk")).alias("owner_tk")
    distinct = stage(rows.groupBy("key").agg(F.min("doc_id").alias("owner"), owner_tk, F.min("sim").alias("sim"), F.min("n_words").alias("n_words")), "distinct-lines")
    with staged_here() as used:
        found = fuzzy_groups(docs, distinct)
    groups = stage(found, "line-groups")
    release(*used)
    owners = distinct.select("key", "owner").join(groups, "key", "left").select("key", "owner", (F.coalesce("best", "key") == F.col("key")).alias("stays"))
    repeated = rows.select("doc_id", "tk", "line", "key", "again").join(owners, "key").select(
        "doc_id", "tk", F.when(F.col("again") | ~F.col("stays") | ~F.col("owner").eqNullSafe(F.col("doc_id")), F.col("line")).alias("line")
    )
    removed = repeated.groupBy(F.col("doc_id").alias("id"), F.col("tk").alias("k")).agg(F.count("*").alias("n"), F.collect_set("line").alias("removed"))
    joined = source.join(removed.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tk") == F.col("k")), "left")
    rest = F.when(F.size("removed") > 0, F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("removed", i)), "\n")).otherwise(F.col("text"))
    columns = [rest.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_kept")]
    n = F.coalesce("n", F.lit(0))
    return joined.select(*columns, n.alias("n_lines"), (n - F.when(F.col("n") > 0, F.size("removed")).otherwise(0)).alias("n_kept"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with repeated and nearly repeated lines taken out."""
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
