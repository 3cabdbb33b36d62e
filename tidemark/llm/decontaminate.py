"""Benchmark decontamination with built-in functions only: a broadcast hash set of n-grams and a scan of word windows."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import table

WINDOW = 10
#: The n-grams with their items are broadcast up to this many bytes; beyond it the windows are shuffled to them,
#: each n-gram in ``SALTS`` copies so that a window common in the corpus is many keys.
BROADCAST_BYTES, SALTS = 64 << 20, 16
#: Window starts in a block of words. A window row carries its block, not its text.
BLOCK = 128
#: Everything that is not part of a word: ASCII other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Lower-cased (A-Z) words; empty for null."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def _anchor(words: Column, at: Column, first: Column, length: int) -> Column:
    """Hash of three words of a window, the same for equal windows."""
    return F.xxhash64(F.lit(length), first, F.get(words, at + F.lit((length - 1) // 2)), F.get(words, at + F.lit(length - 1)))


def grams(benchmark: DataFrame, width: int) -> DataFrame:
    """anchor, gram, length, items per different window of the items; an item of fewer words is one window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(width))
    windows = items.select("item", length.alias("length"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("at"))
    each = windows.select("item", "length", F.slice("w", F.col("at") + 1, F.col("length")).alias("g"))
    anchor = F.xxhash64("length", F.get("g", F.lit(0)), F.get("g", F.floor((F.col("length") - 1) / 2).cast("int")), F.get("g", F.col("length") - 1))
    return each.select(anchor.alias("anchor"), F.array_join("g", " ").alias("gram"), "length", "item").groupBy("anchor", "gram", "length").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, tk (hash of the text), n_words, spans (first and last word of each hit, in order and merged), items.

    Windows are looked up by a hash of three of their words and verified word
    by word. Every document also emits one marker, so nothing is joined back.
    Texts are cut into blocks of words that overlap by a window, so a text of
    any length costs in proportion to its words. Null and empty texts have no
    words and no spans; repeated rows come back as often; an empty table gives
    no rows and an empty benchmark no spans; other columns are not read.
    """
    known = grams(benchmark, width)
    lengths = sorted(r.length for r in known.select("length").distinct().collect())  # at most ``width`` numbers
    held = F.octet_length("gram") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16) + 64
    few = (known.agg(F.sum(held.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES
    words = docs.select("doc_id", F.xxhash64("text").alias("tk"), word_array(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / BLOCK).cast("int"))
    cut = F.transform(starts, lambda b: F.struct((b * BLOCK).alias("base"), F.slice("w", b * BLOCK + 1, F.lit(BLOCK + width - 1)).alias("w")))
    blocks = words.select("doc_id", "tk", "n", F.explode(cut).alias("x")).select("doc_id", "tk", F.when(F.col("x.base") == 0, F.col("n")).alias("n"), "x.base", "x.w")

    def anchors(length: int) -> Column:
        last = F.least(F.greatest(F.size("w") - F.lit(length - 1), F.lit(0)), F.lit(BLOCK))
        keys = F.transform(F.slice("w", F.lit(1), last), lambda w, i: _anchor(F.col("w"), i, w, length))
        return F.transform(keys, lambda k, i: F.struct(k.alias("anchor"), i.alias("i"), F.lit(length).alias("length")))

    # The first block of a document also emits its marker (i = -1).
    marker = F.struct(F.lit(None).cast("long").alias("anchor"), F.lit(-1).alias("i"), F.lit(0).alias("length"))
    marks = F.filter(F.array(marker), lambda m: F.col("base") == 0)
    seen = blocks.withColumn("x", F.explode(F.concat(marks, *map(anchors, lengths)))).select("doc_id", "tk", "n", "base", "w", "x.*")
    text = F.array_join(F.slice("w", F.col("i") + 1, F.col("length")), " ")
    if few:
        # The n-gram stands first: where there is none, the window's text is never made.
        found = seen.join(F.broadcast(known.withColumnRenamed("length", "l")), "anchor", "left").where((F.col("i") < 0) | (F.col("gram") == text))
    else:
        seen = seen.select("doc_id", "tk", "n", "base", "i", "length", F.when(F.col("i") >= 0, text).alias("g"), F.pmod(F.xxhash64("doc_id", "base", "i"), F.lit(SALTS)).alias("salt"))
        salted = known.select("gram", F.col("length").alias("l"), "items", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
        found = seen.join(salted, (F.col("g") == F.col("gram")) & (F.col("length") == F.col("l")) & (F.col("salt") == F.col("part")), "left")
        found = found.where((F.col("i") < 0) | F.col("items").isNotNull())
    at = F.when(F.col("i") >= 0, F.col("base") + F.col("i")).otherwise(-1)
    found = found.select("doc_id", "tk", F.when(F.col("i") < 0, F.col("n")).alias("n"), at.alias("at"), "length", "items")
    span = F.when(F.col("at") >= 0, F.struct("at", (F.col("at") + F.col("length")).alias("to")))
    by_doc = found.groupBy("doc_id", "tk").agg(
        F.max("n").alias("n_words"), F.collect_set(span).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count("n").alias("times")
    )
    last = lambda a: F.element_at(a, -1)
    step = lambda a, x: F.when(
        (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["to"] >= x["at"]),
        F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.try_element_at(a, F.lit(-1))["at"].alias("at"), F.greatest(F.try_element_at(a, F.lit(-1))["to"], x["to"]).alias("to")))),
    ).otherwise(F.concat(a, F.array(x)))
    merged = F.aggregate(F.array_sort("spans"), F.expr("cast(array() as array<struct<at:int,to:int>>)"), step)
    # Rows repeated in the input come back as often as they were there.
    return by_doc.withColumn("spans", merged).withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc_id", "tk", "n_words", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_share: float = 1.0) -> DataFrame:
    """``docs`` (doc_id, text, any others) without the words of benchmark windows.

    A document whose hit words are more than ``max_share`` of its words, or all
    of them, goes; from others the span from the first to the last letter of
    each run of hit words is cut. Null and empty texts, and all texts if the
    benchmark is empty, stay as they are.
    """
    found = hits(docs, benchmark, width)
    bad = found.where(F.size("spans") > 0).select(
        F.col("doc_id").alias("id"), F.col("tk").alias("k"), "spans", "n_words", F.aggregate("spans", F.lit(0), lambda a, x: a + x["to"] - x["at"]).alias("n_hit")
    ).dropDuplicates(["id", "k"])
    source = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64("text").alias("tk"))
    joined = source.join(bad.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tk") == F.col("k")), "left")
    joined = joined.where(F.col("spans").isNull() | ((F.col("n_hit") < F.col("n_words")) & (F.col("n_hit") <= max_share * F.col("n_words"))))
    # Words and what lies between them alternate, so the text can be put together again without the hit words.
    # Here A-Z are still letters.
    gaps = F.split("text", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    own = F.filter(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    hit = lambda i: F.exists("spans", lambda s: (s["at"] <= i) & (i < s["to"]))
    inner = lambda i: F.exists("spans", lambda s: (s["at"] < i) & (i < s["to"]))
    words = F.transform(own, lambda w, i: F.when(hit(i), F.lit("")).otherwise(w))
    between = F.transform(gaps, lambda g, i: F.when(inner(i), F.lit("")).otherwise(g))
    rest = F.array_join(F.zip_with(between, words, lambda g, w: F.concat(F.coalesce(g, F.lit("")), F.coalesce(w, F.lit("")))), "")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(rest)
    return joined.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0), lambda a, x: a + x["to"] - x["at"]).cast("long")
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
ORACLE = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g0 AS (SELECT item, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i, w FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM g0),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
ns AS (SELECT DISTINCT n FROM g),
p AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN ns ON len(w) >= n),
h AS (SELECT p.r, p.i, p.n, g.item FROM p JOIN g ON g.n = p.n AND g.gram = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
