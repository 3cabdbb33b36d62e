"""Phrase collocations by set-oriented mining (SETM) over sorted occurrence relations.

The relation of length k holds, per run of text, the sorted places of frequent
k-word phrases and their words. Joining a relation with itself on piece and
adjacent place gives the occurrences of length k + 1; they are counted in
groups, the frequent groups are semi-joined to the occurrences, and what is
left is the relation the next length starts from. Both sides of the join are
sorted by piece and place and lie in the same row, so it is a merge without a
shuffle; only counts, pre-aggregated by each batch, are shuffled.

The semi-join runs against a bitmap of a fixed size that is built from the
frequent groups. A place it lets through wrongly costs time, not correctness:
every longer phrase is counted and held against the least count itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.frames import table
from tidemark.llm.tokens import mix, slices, text_bytes, words
from tidemark.session import stage

MAX_WORDS, MIN_COUNT, TOP = 3, 10, 2000
#: A shorter candidate goes if a longer one around it has at least this share of its count.
COVERED_PERCENT = 50
#: Bits of the semi-join's map, a power of two.
MAP_BITS = 1 << 27
#: Words of a row of a relation; a longer text is several rows that overlap by the longest phrase.
ROW_WORDS = 1 << 16
#: Occurrences counted at once.
COUNT_ROWS = 1 << 19
#: Parts of a language whose best phrases are found before those of the whole.
SALTS = 16
#: Bytes between words, and those that also end a piece: [\x20\x09] and [.,;:!?\x0A-\x0D].
BLANKS, BREAKS = (0x20, 0x09), (0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D)

_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_ONLY_BLANKS = np.arange(256, dtype=np.uint8)
_ONLY_BLANKS[list(BREAKS + BLANKS)] = 0x20


def _occurrences(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(languages, language of each text, words, id and place of each word) of slices of (lang, text).

    Places of one piece are consecutive; a piece end leaves a gap. An id is a
    64-bit hash of word and language (two of them meet with a chance of 2^-64).
    """
    langs = pa.compute.fill_null(batch.column(0).cast(pa.string()), "und").dictionary_encode()
    names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
    _, name_offsets = text_bytes(langs.dictionary)
    salts = words(*text_bytes(langs.dictionary)).spans(name_offsets[:-1] - name_offsets[0], name_offsets[1:] - name_offsets[0])
    data, offsets = text_bytes(batch.column(1))
    for at, to in slices(offsets):
        part = offsets[at : to + 1]
        plain = data[part[0] : part[-1]]
        w = words(_ONLY_BLANKS[plain], part - part[0])
        breaks = np.zeros(len(plain) + 1, np.int64)
        np.cumsum(_BREAK[plain], out=breaks[1:])
        code = np.repeat(codes[at:to], np.diff(w.first))
        place = np.arange(len(w.start)) + breaks[w.start]
        yield names, code, w, mix(w.hash ^ mix(salts[code] + np.uint64(1))).view(np.int64), place


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, w0, word, n): occurrences of every word in each language."""

    def run(batches):
        for batch in batches:
            for names, code, w, ids, _ in _occurrences(batch):
                found, first, n = np.unique(ids, return_index=True, return_counts=True)
                texts = [w.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([names[c] for c in code[first]], pa.string()), pa.array(found), pa.array(texts, pa.string()), pa.array(n)], names=["lang", "w0", "word", "n"])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, w0 long, word string, n long")
    return counted.groupBy("lang", "w0", "word").agg(F.sum("n").alias("n"))


def _slot(columns: list) -> Column:
    """Bit of a phrase in the map."""
    acc = F.col(columns[0])
    for c in columns[1:]:
        acc = F.shiftleft(acc, 1).bitwiseOR(F.shiftrightunsigned(acc, 63)).bitwiseXOR(F.col(c))
    return acc.bitwiseAND(F.lit(MAP_BITS - 1))


def _held(bits: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Whether the map may hold each phrase."""
    acc = columns[0].view(np.uint64)
    for c in columns[1:]:
        acc = ((acc << np.uint64(1)) | (acc >> np.uint64(63))) ^ c.view(np.uint64)
    slots = acc & np.uint64(8 * len(bits) - 1)
    return (bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bitmap(groups: DataFrame, columns: list[str]) -> np.ndarray:
    """The map of the groups: at most MAP_BITS bits, whatever their number."""
    slot = groups.select((_slot(columns) + 1).alias("s"))
    made = slot.groupBy(F.expr("bitmap_bucket_number(s)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("bits"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in made.collect():
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _relation(length: int) -> str:
    return "stop int, at array<int>, " + ", ".join(f"w{k} array<bigint>" for k in range(length))


def _rows(row: np.ndarray, stop: np.ndarray, at: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of a relation from occurrences sorted by (row, at); rows without any are left out."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[starts, len(row)].astype(np.int32), pa.int32())
    arrays = [pa.array(stop[row[starts]].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32)))]
    arrays += [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in cols]
    return pa.RecordBatch.from_arrays(arrays, names=["stop", "at", *[f"w{k}" for k in range(len(cols))]])


def occurrences(docs: DataFrame, frequent: DataFrame, longest: int) -> DataFrame:
    """The relation of length 1: places of words that the frequent ones' map holds.

    ``stop`` ends the phrases a row counts; places from there on only continue them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(frequent, ["w0"]))
    row_words = ROW_WORDS

    def run(batches):
        for batch in batches:
            for _, _, w, ids, place in _occurrences(batch):
                sizes = np.diff(w.first)
                parts = -(-sizes // row_words)
                text = np.repeat(np.arange(len(sizes)), parts)
                begin = w.first[text] + row_words * (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts))
                end = np.minimum(begin + row_words, w.first[text + 1])
                held = np.minimum(end + longest - 1, w.first[text + 1])
                n = held - begin
                pick = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(np.arange(len(text)), n)
                base = place[begin] if len(begin) else begin  # places count from the row's first word
                stop = place[end - 1] + 1 - base if len(end) else end
                keep = _held(shared.value, [ids[pick]])
                pick, row = pick[keep], row[keep]
                yield _rows(row, stop, place[pick] - base[row], [ids[pick]])

    return docs.select("lang", "text").mapInArrow(run, _relation(1))


def _flat(batch: pa.RecordBatch, length: int) -> Iterator[tuple]:
    """(row, stop, at, words) of pieces of about COUNT_ROWS occurrences, with whole rows."""
    at = batch.column(1)
    offsets = at.offsets.to_numpy()
    stop = batch.column(0).to_numpy()
    values = at.values.to_numpy()
    cols = [batch.column(2 + k).values.to_numpy() for k in range(length)]
    for a, b in slices(offsets.astype(np.int64), COUNT_ROWS):
        lo, hi = offsets[a], offsets[b]
        yield np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1])), stop[a:b], values[lo:hi], [c[lo:hi] for c in cols]


def _merged(row, at, cols):
    """Merge join of a relation with itself on the next place: row, at and words of the phrases one word longer."""
    near = np.flatnonzero((row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1))
    return row[near], at[near], [c[near] for c in cols] + [cols[-1][near + 1]]


def phrase_counts(relation: DataFrame, length: int) -> DataFrame:
    """(w0 .. wk, n) of the phrases one word longer than those of ``relation``."""
    names = [f"w{k}" for k in range(length + 1)]

    def run(batches):
        for batch in batches:
            for row, stop, at, cols in _flat(batch, length):
                row, at, cols = _merged(row, at, cols)
                keep = at < stop[row]
                cols = [c[keep] for c in cols]
                code = np.zeros(len(cols[0]), np.int64)
                for c in cols:  # dense numbers of the phrase so far and of the next word fit one integer
                    known, word = np.unique(c, return_inverse=True)
                    code = np.unique(code, return_inverse=True)[1] * np.int64(max(len(known), 1)) + word
                _, first, n = np.unique(code, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([*[pa.array(c[first]) for c in cols], pa.array(n)], names=[*names, "n"])

    schema = ", ".join(f"{n} long" for n in [*names, "n"])
    return relation.mapInArrow(run, schema).groupBy(*names).agg(F.sum("n").alias("n"))


def extended(relation: DataFrame, frequent: DataFrame, length: int) -> DataFrame:
    """The relation one word longer: the merge join of ``relation``, semi-joined with the ``frequent`` phrases' map."""
    names = [f"w{k}" for k in range(length + 1)]
    shared = relation.sparkSession.sparkContext.broadcast(_bitmap(frequent, names))

    def run(batches):
        for batch in batches:
            for row, stop, at, cols in _flat(batch, length):
                row, at, cols = _merged(row, at, cols)
                keep = _held(shared.value, cols)
                yield _rows(row[keep], stop, at[keep], [c[keep] for c in cols])

    return relation.mapInArrow(run, _relation(length + 1))


def score(cut: int) -> Column:
    """floor(1000000 a a / (l r)) of a cut, in decimals of 38 digits."""
    times = f"cast(l{cut} as decimal(19,0)) * cast(r{cut} as decimal(19,0))"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * (cast(a as decimal(16,0)) * cast(a as decimal(16,0)))) div ({times})")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, covered: int = COVERED_PERCENT) -> DataFrame:
    """The best phrases of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null language is ``und``. Repeated rows count each
    time. Very long texts and long pieces are handled in rows of ROW_WORDS
    words that overlap. Ties of score and count go by the phrase's bytes. An
    empty table, or one without frequent phrases, gives no rows. Other columns
    of ``docs`` do not matter. Counts are whole; the score is exact while a is
    below 10^16.
    """
    counts = stage(word_counts(docs), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    dictionary = stage(counts.where(F.col("n") >= min_count), "frequent-1")
    frequent = {1: dictionary.select("w0", "n")}
    relation = stage(occurrences(docs, dictionary, max_words), "relation-1")
    for length in range(2, max_words + 1):
        names = [f"w{k}" for k in range(length)]
        frequent[length] = stage(phrase_counts(relation, length - 1).where(F.col("n") >= min_count), f"frequent-{length}")
        if length < max_words:
            relation = stage(extended(relation, frequent[length], length - 1), f"relation-{length}")

    found = []
    for length in range(2, max_words + 1):
        names = [f"w{k}" for k in range(length)]
        rows = frequent[length].withColumnRenamed("n", "a")
        for cut in range(1, length):
            for side, begin, end in (("l", 0, cut), ("r", cut, length)):
                part = frequent[end - begin].select(*[F.col(f"w{k}").alias(f"w{begin + k}") for k in range(end - begin)], F.col("n").alias(f"{side}{cut}"))
                rows = rows.join(part, names[begin:end])
        cuts = F.array(*[F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, length)])
        rows = rows.select(*names, "a", F.array_min(cuts).alias("cut"))
        around = [frequent[longer].select(*[F.col(f"w{at + k}").alias(f"w{k}") for k in range(length)], "n")
                  for longer in range(length + 1, max_words + 1) for at in range(longer - length + 1)]
        if around:
            outer = around[0]
            for other in around[1:]:
                outer = outer.unionByName(other)
            rows = rows.join(outer.groupBy(*names).agg(F.max("n").alias("outer")), names, "left").where(f"outer IS NULL OR 100 * outer < {covered} * a").drop("outer")
        for k, name in enumerate(names):
            known = dictionary.select(F.col("w0").alias(name), F.col("word").alias(f"t{k}"), *([F.col("lang")] if k == 0 else []))
            rows = rows.join(known, name)
        phrase = F.array_join(F.array(*[f"t{k}" for k in range(length)]), " ")
        found.append(rows.select("lang", phrase.alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")))
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each of SALTS parts first: the task that ranks a language reads SALTS x top rows at most.
    dealt = every.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    every = dealt.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*by))).where(F.col("rank") <= top)
    order = W.partitionBy("lang").orderBy(*by)
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two and three words of every language."""
    return collocations(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
p AS (SELECT r, lang, generate_subscripts(pieces, 1) AS p, unnest(pieces) AS piece FROM (SELECT r, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS pieces FROM d)),
o AS (SELECT r, p, lang, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM (SELECT r, p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p)),
n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
f1 AS (SELECT lang, w, count(*) AS f FROM o GROUP BY ALL),
s AS (SELECT lang, w AS a, lead(w) OVER q AS b, lead(w, 2) OVER q AS c FROM o WINDOW q AS (PARTITION BY r, p ORDER BY i)),
f2 AS (SELECT lang, a, b, count(*) AS f FROM s WHERE b IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, a, b, c, count(*) AS f FROM s WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
x2 AS (SELECT f2.lang, f2.a, f2.b, f2.f, x.f AS l, y.f AS r FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w = f2.a JOIN f1 y ON y.lang = f2.lang AND y.w = f2.b WHERE f2.f >= {MIN_COUNT}),
x3 AS (SELECT f3.*, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2 FROM f3
  JOIN f1 x ON x.lang = f3.lang AND x.w = f3.a JOIN f2 yz ON yz.lang = f3.lang AND yz.a = f3.b AND yz.b = f3.c
  JOIN f2 xy ON xy.lang = f3.lang AND xy.a = f3.a AND xy.b = f3.b JOIN f1 z ON z.lang = f3.lang AND z.w = f3.c),
y3 AS (SELECT *, 1000000::HUGEINT * f * f // (l1::HUGEINT * r1) AS s1, 1000000::HUGEINT * f * f // (l2::HUGEINT * r2) AS s2 FROM x3),
o2 AS (SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b AS a, c AS b, f FROM f3) GROUP BY ALL),
c AS (SELECT x2.lang, x2.a || ' ' || x2.b AS phrase, x2.f AS a, l, r, 1000000::HUGEINT * x2.f * x2.f // (l::HUGEINT * r) AS score
    FROM x2 LEFT JOIN o2 ON o2.lang = x2.lang AND o2.a = x2.a AND o2.b = x2.b WHERE o2.f IS NULL OR 100 * o2.f < {COVERED_PERCENT} * x2.f
  UNION ALL SELECT lang, a || ' ' || b || ' ' || c, f, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM y3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT k.lang, rank, phrase, a, l, r, n.n, CAST(score AS BIGINT) AS score FROM k JOIN n ON n.lang = k.lang WHERE rank <= {TOP}
"""
