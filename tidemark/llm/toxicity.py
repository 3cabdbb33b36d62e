"""Toxicity by compression distance: how much better a zstandard dictionary of toxic text compresses a window than one of ordinary text."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import table

#: Labelled documents of each class that dictionaries and thresholds are fitted to, at most; in the order of a hash of doc_id.
SAMPLE = 1000
#: Learned from only if crc32(doc_id as text) mod FOLDS is not HELD_OUT.
FOLDS, HELD_OUT = 5, 0
#: Words of a window, bytes of the dictionaries, and of a toxic stretch (from the start of a word).
WINDOW, ORDINARY_BYTES, TOXIC_BYTES, STRETCH = 8, 4096, 4096, 6
#: A stretch is toxic if it is in so many toxic documents, RATIO times the share of ordinary ones.
SUPPORT, RATIO = 3, 6.0
#: Follows every window, so that zstandard never stores one uncompressed and lengths stay comparable.
PAD = b" " + b"~" * 64
FEATURES = 5


@dataclass
class Model:
    """Contents of the two dictionaries; weights of the standardised window features, the last one constant."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def windows(text: str | None) -> list[bytes]:
    each = (text or "").encode().lower().split()
    return [b" " + b" ".join(each[i : i + WINDOW]) + PAD for i in range(0, len(each), WINDOW)]


def _stretches(text: str) -> tuple[bytes, set[bytes]]:
    line = b" " + b" ".join(text.encode().lower().split()) + b" "
    return line, {line[k : k + STRETCH] for k, x in enumerate(line) if x == 0x20 and k + STRETCH <= len(line)}


def _covered(line: bytes, toxic: set[bytes]) -> list[bytes]:
    """Parts of the line made of overlapping toxic stretches."""
    out, start, end = [], -1, -1
    for k in range(len(line) - STRETCH + 1):
        if line[k] == 0x20 and line[k : k + STRETCH] in toxic:
            if k > end:
                out += [line[start:end]] if start >= 0 else []
                start = k
            end = k + STRETCH
    return out + ([line[start:end]] if start >= 0 else [])


def _content(samples: list[bytes], size: int) -> bytes:
    """What zstandard's trainer picks from the samples; all different ones where they are too few for it."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(dict.fromkeys(samples))


def compressors(ordinary: bytes, toxic: bytes) -> list[zstd.ZstdCompressor]:
    """Of ordinary text, and of toxic text: the ordinary content with the toxic stretches before it."""
    how = zstd.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=3, min_match=STRETCH, strategy=zstd.STRATEGY_GREEDY, target_length=8,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    out = []
    for content in (bytes(len(toxic)) + ordinary, toxic + ordinary):
        held = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        out.append(zstd.ZstdCompressor(compression_params=how, dict_data=held))
    return out


def features(text: str | None, by: list[zstd.ZstdCompressor]) -> list[float]:
    """Of the bytes that the toxic dictionary saves per window: mean of the three highest, highest, mean, share of windows with two or more; 1."""
    plain, toxic = (x.compress for x in by)
    saved = sorted((len(plain(x)) - len(toxic(x)) for x in windows(text)), reverse=True)
    n = max(1, len(saved))
    return [sum(saved[:3]) / 3, float(sum(saved[:1])), sum(saved) / n, sum(x >= 2 for x in saved) / (n + 5), 1.0]


def fit(toxic: list[str], ordinary: list[str]) -> Model | None:
    """None where one of the classes has no document."""
    if not toxic or not ordinary:
        return None
    seen, usual = Counter(), Counter()
    lines = []
    for text in toxic:
        line, own = _stretches(text)
        lines.append(line)
        seen.update(own)
    for text in ordinary:
        usual.update(_stretches(text)[1])
    bad = {x for x, n in seen.items() if n >= SUPPORT and n / len(toxic) >= RATIO * (usual[x] + 1) / (len(ordinary) + 1)}
    parts = [x + b"|" for line in lines for x in _covered(line, bad)]
    stretch = _content(parts, TOXIC_BYTES)
    # The trainer leaves out what is rare in its samples.
    stretch = b"".join(x for x, _ in sorted(Counter(parts).items(), key=lambda p: (p[1], p[0])) if x[:-1] not in stretch) + stretch
    base = _content([x for text in ordinary for x in windows(text)], ORDINARY_BYTES).replace(PAD, b"")
    by = compressors(base, stretch)
    x = np.array([features(text, by) for text in [*toxic, *ordinary]])
    y = np.repeat([1.0, 0.0], [len(toxic), len(ordinary)])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[-1], scale[-1] = 0, 1
    z, w = (x - mean) / scale, np.zeros(FEATURES)
    for _ in range(30):  # Newton's steps on the penalised likelihood
        p = 1 / (1 + np.exp(-z @ w))
        grad = z.T @ (y - p) - w
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(FEATURES), grad)
    return Model(base, stretch, mean, scale, w)


def _fold(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit to at most ``SAMPLE`` labelled documents of each class outside the held-out fold; the bounded sample is fitted on the driver."""
    open_ = labels.where(~_fold()).select("doc_id", "toxic")
    picks = [open_.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    chosen = F.broadcast(picks[0].union(picks[1]).dropDuplicates(["doc_id"]))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").collect()
    rows = sorted((r.doc_id, r.toxic, r.text or "") for r in rows)
    return fit([t for _, k, t in rows if k == 1], [t for _, k, t in rows if k == 0])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs`` (doc_id, text). Only the text makes the score: null and empty
    texts have no window and get the score of none; without a model all scores are 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        by = compressors(model.ordinary, model.toxic) if model else None
        for batch in batches:
            if model:
                x = np.array([features(t.as_py(), by) for t in batch.column("text")]).reshape(-1, FEATURES)
                p = 1 / (1 + np.exp(-((x - model.mean) / model.scale) @ model.weights))
            else:
                p = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", _fold().alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
