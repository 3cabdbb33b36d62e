"""Importance resampling, k-d sharding and collocations against brute force, planted cases and odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import collocations, importance, kd_shards
from tidemark.llm.frames import table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, rank string, shard string, slot string, weight string, n string"
UP = {i: i + 32 for i in range(65, 91)}
FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, letters of several bytes, columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(90_000))
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (4, "Ünder the Sea, the sea? The SEA!", "de", "b"), (4, "Ünder the Sea, the sea? The SEA!", "de", "b"),
        (5, long, "en", "a"), (6, "x" * 300_000 + " " + "é" * 200_000, None, "c"), (None, "lonely words here", "en", None), (None, None, None, None), (7, "日本 日本 日本 日本", "und", "c"),
        (8, "big red fox. " * 30, "en", "a"), (9, "big red fox " * 12, "en", "a"),
    ]
    return spark.createDataFrame([(i, t, lang, s, 0, "r", "s", "o", "w", "n") for i, t, lang, s in rows], DOC)


def features(text):
    w = FEATURE.findall((text or "").translate(UP))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_importance(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    each = [(r.doc_id, *features(r.text)) for r in docs]
    s, t = collections.Counter(), collections.Counter()
    for _, _, f in each:
        s.update(map(bucket, f))
    for r in target:
        t.update(map(bucket, features(r.text)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, w, f in each:
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    can = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(can[: 5 * len(can) // 100]):
        r[5] = k + 1
    return sorted(map(str, out))


@pytest.mark.parametrize("which", ["given", "odd"])
def test_importance_equals_brute_force(spark, odd, which):
    docs = table(spark, SF, "documents") if which == "given" else odd
    target = table(spark, SF, "benchmark")
    got = importance.resample(docs, target)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(str(list(r)) for r in got.collect()) == brute_importance(docs.collect(), target.collect())


def test_importance_without_rows(spark, odd):
    assert importance.resample(odd.limit(0), odd).count() == 0
    rows = importance.resample(odd, odd.limit(0)).collect()
    assert len(rows) == 12 and all(r.weight == 0 for r in rows if r.n_features == 0)


def test_draw_in_ranges_is_a_total_order(spark, monkeypatch):
    monkeypatch.setattr(importance, "RANK_ROWS", 50)
    rows = [(i, 30, 1, 0, (i * 7919) % 40) for i in range(2000)] + [(5000, 3, 1, 0, 99)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    got = {r["doc_id"]: r["rank"] for r in importance.drawn(scored, "doc_id", percent=30).collect()}
    want = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))[:600]
    assert len(got) == 2001 and {k: v for k, v in got.items() if v} == {r[0]: k + 1 for k, r in enumerate(want)}


def test_crcs_of_words_and_runs():
    rng = np.random.default_rng(3)
    parts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in [1, 2, 47, 48, 49, 200, *rng.integers(1, 12, 40)]]
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    start = end - [len(p) for p in parts]
    crc = importance.word_crcs(data, start, end)
    assert crc.tolist() == [zlib.crc32(p) for p in parts]
    both = importance.joined(crc[:-1], crc[1:], (end - start)[1:])
    assert both.tolist() == [zlib.crc32(a + b) for a, b in zip(parts, parts[1:], strict=False)]


def shards_of(docs, n):
    rows = kd_shards.shard(docs, n).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for held in by.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    return rows, {k: sum(r.size for r in v) for k, v in by.items()}


def test_shards_have_near_equal_bytes(spark):
    docs = table(spark, SF, "documents")
    rows, sizes = shards_of(docs, 16)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "bytes" for r in rows)
    assert len(sizes) == 16 and max(sizes.values()) <= sum(sizes.values()) / 16 + max(r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, kd_shards.shard(docs.repartition(5), 16).collect()))


def test_a_hot_group_is_dealt_and_small_groups_stay_whole(spark):
    copies = [(i, "the same text in a third of all rows", "en", "s0") for i in range(3000)]
    pairs = [(10_000 + i, f"pair {i // 2} of two equal texts, number {i // 2 * 37}", "en", f"s{i % 7}") for i in range(4000)]
    docs = spark.createDataFrame(copies + pairs, "doc_id long, text string, lang string, source string")
    rows, sizes = shards_of(docs, 16)
    mean = sum(sizes.values()) / 16
    assert max(sizes.values()) <= 1.03 * mean and min(sizes.values()) >= 0.97 * mean
    homes = collections.defaultdict(set)
    for r in rows:
        homes[r.text_crc32].add(r.shard)
    assert sorted(len(v) for v in homes.values())[:-1] == [1] * 2000


def test_shards_of_odd_rows(spark, odd):
    rows, _ = shards_of(odd, 4)
    assert len(rows) == 12 and {r.shard for r in rows} <= set(range(4))
    assert len({r.shard for r in rows if r.doc_id == 4}) == 1
    assert kd_shards.shard(odd.limit(0), 4).count() == 0
    assert {r.shard for r in kd_shards.shard(odd, target_bytes=1 << 40).collect()} == {0}


def brute_collocations(docs, top):
    f = collections.defaultdict(collections.Counter)
    for r in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r.text or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                f["und" if r.lang is None else r.lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        n = sum(v for k, v in counts.items() if len(k) == 1)
        found = {k: v for k, v in counts.items() if len(k) > 1 and v >= 10}
        gone = {part for k, v in found.items() if len(k) == 3 for part in (k[:2], k[1:]) if part in found and 100 * v >= 50 * found[part]}
        rows = []
        for k, a in found.items():
            if k not in gone:
                score, _, left, right = min((1_000_000 * a * a // (counts[k[:c]] * counts[k[c:]]), c, counts[k[:c]], counts[k[c:]]) for c in range(1, len(k)))
                rows.append((" ".join(k), a, left, right, n, score))
        rows.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(rows[:top])]
    return sorted(out)


@pytest.mark.parametrize(("which", "top"), [("given", 2000), ("given", 7), ("odd", 2000)])
def test_collocations_equal_brute_force(spark, odd, which, top, monkeypatch):
    monkeypatch.setattr(collocations, "ROW_WORDS", 1000)  # rows of long texts overlap
    docs = table(spark, SF, "documents") if which == "given" else odd
    got = sorted(tuple(r) for r in collocations.collocations(docs, top=top).collect())
    assert got and got == brute_collocations(docs.collect(), top)


def test_collocations_with_a_full_map_are_the_same(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    want = sorted(tuple(r) for r in collocations.collocations(docs).collect())
    monkeypatch.setattr(collocations, "MAP_BITS", 1 << 15)
    assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == want
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_exact_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 3_000_000_000, 3_100_000_000, 3_200_000_000
    row = spark.createDataFrame([(a, left, right)], "a long, l1 long, r1 long").select(collocations.score(1).alias("s"), F.lit(1)).first()
    assert row.s == 1_000_000 * a * a // (left * right)
