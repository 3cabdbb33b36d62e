"""Target-distribution importance resampling over pre-tokenised words.

An untrained ``tokenizers`` Split pre-tokeniser finds the words of the
ASCII-lowered text with their offsets. Runs of consecutive offset pairs are the
features; each goes to a bucket by the CRC-32 of its bytes. Histograms of all
documents and of the target texts give each bucket a gain, a document's weight
is the sum of the gains of its features, and noise from its id makes the draw
without replacement. The CRCs of a batch are made from those of its words: the
CRC of two joined byte strings is that of the first, moved on by the length of
the second, xor that of the second.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from tidemark.llm.frames import table
from tidemark.llm.kd_shards import sql_crc32
from tidemark.llm.tokens import LOWER, slices, text_bytes
from tidemark.session import stage

BUCKETS, LONGEST = 10_000, 3
#: Words of a document that can be drawn, and the share drawn.
LEAST_WORDS, DRAW_PERCENT = 20, 5
SEED = 42
#: A word's bytes are all but ASCII that is neither digit nor letter.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes that are tokenised at once; longer texts are cut between words.
CALL_BYTES = 1 << 18
#: Words whose CRC is made byte by byte for all at once; longer ones each alone.
SHORT = 48
#: Rows of a range of scores that one task orders, about, until there are MOST_RANGES of them.
RANK_ROWS, MOST_RANGES = 20_000, 4096

_IN_WORD = np.ones(256, bool)
_IN_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (out & np.uint32(1)))
    return out


_CRC = _crc_table()


def _moves(longest: int) -> np.ndarray:
    """[n, byte, value]: what a byte of a CRC register becomes after n zero bytes."""
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(longest):
        out[n + 1] = _CRC[out[n] & np.uint32(255)] ^ (out[n] >> np.uint32(8))
    return out


_MOVES = _moves(SHORT)


def _moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """CRC registers after ``by`` more zero bytes."""
    out, left = crc.copy(), by.copy()
    while True:
        n = np.minimum(left, SHORT)
        out = _MOVES[n, 0, out & 255] ^ _MOVES[n, 1, (out >> 8) & 255] ^ _MOVES[n, 2, (out >> 16) & 255] ^ _MOVES[n, 3, out >> 24]
        left = left - n
        if not left.any():
            return out


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes of each word."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    s, n = start[order], size[order]
    longer = int(np.searchsorted(-n, -SHORT))  # words above SHORT bytes come first
    reg = np.full(len(s), 0xFFFFFFFF, np.uint32)
    for k in range(SHORT):
        live = int(np.searchsorted(-n, -k))
        if live <= longer:
            break
        part = slice(longer, live)
        reg[part] = _CRC[(reg[part] ^ data[s[part] + k]) & 255] ^ (reg[part] >> np.uint32(8))
    out = np.empty(len(s), np.uint32)
    out[order] = reg ^ np.uint32(0xFFFFFFFF)
    for i in order[:longer].tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]])
    return out


def joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of first + second from those of both; ``size`` is the bytes of the second."""
    return _moved(first, size) ^ second


def _cut(data: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about CALL_BYTES that end between words."""
    at = 0
    while at < len(data):
        to = min(at + CALL_BYTES, len(data))
        while to < len(data) and _IN_WORD[data[to]]:
            to += 1
        yield at, to
        at = to


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte offsets of the words of lowered texts, as if they stood one after the other."""
    split = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
    starts, ends, counts, base = [], [], [], 0
    for text in texts:
        n = 0
        for a, b in _cut(text):
            part = text[a:b].decode("utf-8", "replace")
            pairs = np.array([at for _, at in split.pre_tokenize_str(part)], np.int64).reshape(-1, 2)
            if len(part) != b - a:  # offsets count characters
                where = np.flatnonzero((np.frombuffer(text, np.uint8, b - a, a) & 0xC0) != 0x80)
                pairs = np.append(where, b - a)[pairs]
            starts.append(pairs[:, 0] + (base + a))
            ends.append(pairs[:, 1] + (base + a))
            n += len(pairs)
        counts.append(n)
        base += len(text)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(starts or none), np.concatenate(ends or none), np.r_[0, np.cumsum(counts)].astype(np.int64)


def buckets(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, longest: int = LONGEST, size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every run of 1 to ``longest`` words of each text, runs of a text together."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    crc = word_crcs(data, start, end)
    space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    spaced = joined(space, crc, end - start)  # a blank and the word
    texts, values, run = [text], [crc], crc
    for width in range(2, longest + 1):
        inside = text[width - 1 :] == text[: len(text) - width + 1] if len(text) >= width else np.zeros(0, bool)
        run = joined(run[: len(inside)], spaced[width - 1 :], (end - start)[width - 1 :] + 1)
        texts.append(text[: len(inside)][inside])
        values.append(run[inside])
    at = np.concatenate(texts)
    order = np.argsort(at, kind="stable")
    return at[order], (np.concatenate(values) % np.uint32(size)).astype(np.uint16)[order]


def featured(docs: DataFrame, key: str, longest: int = LONGEST, size: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, buckets): the features' buckets of each text as little-endian 16-bit numbers."""
    schema = docs.select(key).schema.add("n_words", "long").add("n_features", "long").add("buckets", "binary")

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                part = LOWER[data[offsets[a] : offsets[b]]]
                bounds = offsets[a : b + 1] - offsets[a]
                raw = part.tobytes()
                start, end, first = spans([raw[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
                at, found = buckets(part, start, end, first, longest, size)
                n = np.bincount(at, minlength=b - a)
                cuts = np.r_[0, np.cumsum(n)].astype(np.int32) * 2
                held = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(found.astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(n.astype(np.int64)), held], names=[key, "n_words", "n_features", "buckets"])

    return docs.select(key, "text").mapInArrow(run, schema)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a batch and how many each row has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    values = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]].view("<u2") if held is not None else np.zeros(0, np.uint16)
    return values, np.diff(offsets) // 2


def histogram(features: DataFrame, size: int = BUCKETS) -> np.ndarray:
    """Features in each bucket; a task sends one row for each bucket, the driver gets ``size`` numbers."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0))[0], minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(size, np.int64)
    for r in features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target, one added to each count."""
    s, t, size = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weighted(features: DataFrame, gain: np.ndarray, key: str) -> DataFrame:
    """``features`` with ``weight``, the sum of the gains of its buckets, in place of them."""
    shared = features.sparkSession.sparkContext.broadcast(gain)
    schema = features.select(key, "n_words", "n_features").schema.add("weight", "long")

    def run(batches):
        for batch in batches:
            values, n = _flat(batch.column(3))
            sums = np.r_[0, np.cumsum(shared.value[values])]
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array((sums[ends] - sums[ends - n]).astype(np.int64))], names=[key, "n_words", "n_features", "weight"])

    return features.select(key, "n_words", "n_features", "buckets").mapInArrow(run, schema)


def drawn(scored: DataFrame, key: str, least_words: int = LEAST_WORDS, percent: int = DRAW_PERCENT) -> DataFrame:
    """``scored`` (staged) with ``rank`` of the drawn rows: 1, 2, 3 ... by score descending, then ``key``.

    Ranges of scores are counted first, so a task orders one range, and only
    ranges that reach into the draw are ordered.
    """
    can = scored.where(F.col("n_words") >= least_words)
    n = can.count()
    seats = percent * n // 100
    parts = min(max(1, -(-n // RANK_ROWS)), MOST_RANGES)
    edges = can.select(F.percentile_approx("score", F.lit([k / parts for k in range(1, parts)]), 10 * parts).alias("e")).first()["e"] if parts > 1 else []
    edges = sorted(set(edges or []), reverse=True)
    # The lowest edge that a score reaches numbers its range: bounded by ``parts``.
    part = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<long>"), lambda e: e > F.col("score")))
    counts = {r.part: r.n for r in can.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for k in range(len(edges) + 1):
        before.append(total)
        total += counts.get(k, 0)
    last = max((k for k, b in enumerate(before) if b < seats), default=-1)
    in_reach = (F.col("n_words") >= least_words) & (F.col("part") <= last)
    numbered = scored.withColumn("part", part)
    row = F.row_number().over(W.partitionBy("part").orderBy(F.desc("score"), F.col(key).asc_nulls_last()))
    rank = F.get(F.array(*map(F.lit, before)), F.col("part")).cast("long") + row
    reached = numbered.where(in_reach).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= seats, F.col("rank")))
    return reached.unionByName(numbered.where(~in_reach).withColumn("rank", F.lit(None).cast("long"))).drop("part")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = DRAW_PERCENT, seed: int = SEED) -> DataFrame:
    """key, n_words, n_features, weight, score, rank per row of ``docs`` (key, text); ``target`` has text.

    Drawn are ``percent`` % of the rows with at least ``least_words`` words,
    those of highest weight plus Gumbel noise; the others have no rank. Null
    texts have no words and weigh 0, very long ones are tokenised in parts cut
    between words. Ties go to the smaller key, null last; a null key draws its
    noise from an empty one. Repeated rows count each time. An empty ``docs``
    gives no rows; without target texts all its counts are 0. Other columns of
    the two tables do not matter.
    """
    features = stage(featured(docs, key, longest), "features")
    gain = gains(histogram(features), histogram(featured(target.withColumn("_k", F.lit(0)), "_k", longest)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stage(weighted(features, gain, key).withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    return drawn(scored, key, least_words, percent)


def op11_importance(spark, sf_dir: str) -> DataFrame:
    """Weight, score and place in the draw of every document, with the benchmark as target."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}')"
_RUNS = " UNION ALL ".join(f"SELECT side, r, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS f FROM x WHERE len(w) >= {n}" for n in range(1, LONGEST + 1))
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT 's' AS side, r, w FROM d UNION ALL SELECT 't', 0, {_WORDS} FROM benchmark),
f AS ({_RUNS}),
g AS (SELECT side, r, f, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT f, CAST({sql_crc32('f')} AS BIGINT) % {BUCKETS} AS b FROM (SELECT DISTINCT f FROM g)),
h AS (SELECT b, sum(n) FILTER (WHERE side = 's') AS s, sum(n) FILTER (WHERE side = 't') AS t FROM g JOIN k USING (f) GROUP BY b),
a AS (SELECT sum(s)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM h),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(h.t, 0)::DOUBLE + 1) * (a.s + {BUCKETS}) / ((coalesce(h.s, 0)::DOUBLE + 1) * (a.t + {BUCKETS})))) AS BIGINT) AS gain FROM h, a),
w AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM g JOIN k USING (f) JOIN gain USING (b) WHERE side = 's' GROUP BY r),
z AS (SELECT d.r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w ON w.r = d.r),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM z WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {DRAW_PERCENT} * n // 100 THEN rank END AS rank FROM z LEFT JOIN o USING (r)
"""
