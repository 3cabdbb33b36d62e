"""Quality rules by line labelling: a linear-chain conditional random field marks each line as content or boilerplate."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import table
from tidemark.llm.tokens import SPACE, slices, text_bytes, words

#: Labelled documents of each class that the field is fitted to, at most; taken in the order of a hash of doc_id.
SAMPLE = 400
#: The fit takes a text as chains of this many lines, and of a longer text at most ``CHAINS`` of them, evenly spaced
#: from its first to its last line. Judging decodes whole texts.
CHAIN, CHAINS = 256, 8
ROUNDS, RATE, DECAY = 80, 0.15, 1e-3
#: Least share of a document's words in content lines.
CONTENT = 0.5
MIN_WORDS, MAX_REPEATED = 50, 50
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")

_SYMBOL, _MARK, _UPPER, _DIGIT, _PIPE, _CONT = (np.zeros(256, bool) for _ in range(6))
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK[list(b"#*$%&|<>!?@^~_=+{}[]\\/")] = True
_UPPER[65:91], _DIGIT[48:58], _PIPE[ord("|")], _CONT[0x80:0xC0] = True, True, True, True
#: Features of a line: constant, words, upper case, marks, digits, words of marks alone or ending in one, bars,
#: repeated words, length of words, no stop at the end, equal to an earlier line.
WIDTH = 11


@dataclass
class Field:
    """Weights of content against boilerplate per feature, of each step between labels and of the first label."""

    weights: np.ndarray
    step: np.ndarray
    start: np.ndarray


#: Where no document of one of the classes is labelled: marks, upper case, bars and repeats tell against a line.
PRIOR = Field(np.array([2.5, 0.2, -4, -12, -2, -4, -6, -2, 0, -0.2, -1.0]), np.array([[1.0, -1.0], [-1.0, 1.0]]), np.zeros(2))


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the lines with a word of some texts: text number, number of words, features; and the base counts per text
    (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    w = words(data, offsets, lower=False)
    bounds, n_texts = offsets - offsets[0], len(offsets) - 1
    total = lambda flags, a, b: (lambda c: c[b] - c[a])(np.concatenate([[0], np.cumsum(flags)]))
    n_words = np.diff(w.first)
    base = np.zeros((n_texts, 5), np.int64)
    base[:, 0] = n_words
    base[:, 1] = total(~SPACE[w.data] & ~_CONT[w.data], bounds[:-1], bounds[1:])
    base[:, 2] = total(_SYMBOL[w.data], bounds[:-1], bounds[1:])
    for k in np.flatnonzero(n_words >= 3):
        h = w.hash[w.first[k] : w.first[k + 1]]
        three = h[:-2] * np.uint64(3) + (h[1:-1] ^ (h[1:-1] >> np.uint64(7))) * np.uint64(5) + (h[2:] ^ (h[2:] >> np.uint64(13))) * np.uint64(7)
        if len(np.unique(three)) < len(three):
            _, at, count = np.unique(three, return_inverse=True, return_counts=True)
            twice = np.concatenate([[False, False], count[at] > 1, [False, False]])
            base[k, 4] = (twice[:-2] | twice[1:-1] | twice[2:]).sum()
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WIDTH)), base
    breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
    text = np.repeat(np.arange(n_texts), n_words)
    line = breaks[w.start]
    head = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(line) != 0)]))
    tail = np.append(head[1:], len(text))
    count, text = tail - head, text[head]
    newline = np.concatenate([[-1], np.flatnonzero(w.data == 10), [len(w.data)]])
    start = np.maximum(newline[line[head]] + 1, bounds[text])
    end = np.minimum(newline[line[head] + 1], bounds[text + 1])
    whole = w.spans(start, end)
    order = np.lexsort((np.arange(len(whole)), whole, text))
    again = np.zeros(len(whole), bool)
    again[order[1:]] = (np.diff(text[order]) == 0) & (whole[order[1:]] == whole[order[:-1]])
    np.add.at(base[:, 3], text, again)
    first, last = w.start[head], w.end[tail - 1]
    size = np.maximum(total(~SPACE[w.data], first, last), 1)
    ends = _MARK[w.data[w.end - 1]]
    own = np.sort((np.repeat(np.arange(len(head)), count).astype(np.uint64) << np.uint64(32)) | (w.hash >> np.uint64(32)))
    different = np.bincount((own[np.concatenate([[True], own[1:] != own[:-1]])] >> np.uint64(32)).astype(np.int64), minlength=len(head))
    features = np.stack(
        [
            np.ones(len(head)), np.log1p(count) / 3, total(_UPPER[w.data], first, last) / size, total(_MARK[w.data], first, last) / size,
            total(_DIGIT[w.data], first, last) / size, np.add.reduceat(ends, head, dtype=np.int64) / count, total(_PIPE[w.data], first, last) / count,
            1 - different / count, size / count / 10, ~np.isin(w.data[last - 1], list(b".!?:")), again,
        ],
        axis=1,
    )
    return text, count, features, base


def viterbi(field: Field, text: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Most likely labels (true: content) of lines ordered by text.

    One pass ahead and one back over the lines, a text after the other: time
    and memory grow with the lines, however unevenly texts share them. Of equal
    paths the one that says boilerplate at the later line is taken.
    """
    n = len(text)
    emit = (features @ field.weights).tolist()
    first = np.concatenate([[True], np.diff(text) != 0])[:n].tolist()
    (s00, s01), (s10, s11) = field.step.tolist()
    start0, start1 = field.start.tolist()
    # Where the best path to each label comes from, and which label is better if the text ends here.
    from0, from1, better = bytearray(n), bytearray(n), bytearray(n)
    b0 = b1 = 0.0
    for i in range(n):
        if first[i]:
            b0, b1 = start0, emit[i] + start1
        else:
            stay0, fall, rise, stay1 = b0 + s00, b1 + s10, b0 + s01, b1 + s11
            from0[i], from1[i] = fall > stay0, stay1 > rise
            b0, b1 = max(stay0, fall), max(rise, stay1) + emit[i]
        better[i] = b1 > b0
    label = bytearray(n)
    for i in range(n - 1, -1, -1):
        if i + 1 == n or first[i + 1]:
            label[i] = better[i]
        else:
            label[i] = from1[i + 1] if label[i + 1] else from0[i + 1]
    return np.frombuffer(label, np.uint8).astype(bool)


def _padded(text: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` per line as (place in chain, chain): chains of at most ``CHAIN`` lines in rows of equal place; and which places exist."""
    _, text = np.unique(text, return_inverse=True)
    head = np.flatnonzero(np.concatenate([[True], np.diff(text) != 0]))
    place = np.arange(len(text)) - head[text]
    out = np.zeros((place.max() + 1, len(head), *values.shape[1:]))
    there = np.zeros(out.shape[:2], bool)
    out[place, text], there[place, text] = values, True
    return out, there


def fit(text: np.ndarray, features: np.ndarray, content: np.ndarray, weight: np.ndarray) -> Field:
    """Maximum likelihood of the labels by gradient steps (Adam); ``text`` numbers the chains, ``weight`` is per chain in their order."""
    x, there = _padded(text, features)
    y, _ = _padded(text, content.astype(float))
    y = y.astype(int)
    n_steps, n_texts = there.shape
    params = np.concatenate([np.zeros(WIDTH), np.zeros(6)])
    seen, squared = np.zeros_like(params), np.zeros_like(params)
    lse = lambda a, axis: (lambda m: m.squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis)))(a.max(axis=axis, keepdims=True))
    for k in range(1, ROUNDS + 1):
        w, step, start = params[:WIDTH], params[WIDTH : WIDTH + 4].reshape(2, 2), params[WIDTH + 4 :]
        score = np.stack([np.zeros((n_steps, n_texts)), x @ w], axis=2)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[0] = score[0] + start
        for t in range(1, n_steps):
            new = lse(ahead[t - 1][:, :, None] + step, 1) + score[t]
            ahead[t] = np.where(there[t][:, None], new, ahead[t - 1])
        for t in range(n_steps - 2, -1, -1):
            new = lse(step + (score[t + 1] + behind[t + 1])[:, None, :], 2)
            behind[t] = np.where(there[t + 1][:, None], new, 0)
        norm = lse(ahead[-1], 1)
        one = np.exp(ahead[:, :, 1] + behind[:, :, 1] - norm) * there
        grad = np.zeros_like(params)
        grad[:WIDTH] = np.einsum("tn,tnf->f", ((y == 1) & there) * weight - one * weight, x)
        for a in (0, 1):
            first = np.exp(ahead[0][:, a] + behind[0][:, a] - norm)
            grad[WIDTH + 4 + a] = (((y[0] == a) - first) * weight).sum()
            for b in (0, 1):
                pair = np.exp(ahead[:-1][:, :, a] + step[a, b] + score[1:][:, :, b] + behind[1:][:, :, b] - norm) * there[1:]
                grad[WIDTH + 2 * a + b] = ((((y[:-1] == a) & (y[1:] == b) & there[1:]) - pair) * weight).sum()
        grad = grad / weight.sum() - DECAY * params
        seen, squared = 0.9 * seen + 0.1 * grad, 0.99 * squared + 0.01 * grad**2
        params = params + RATE * (seen / (1 - 0.9**k)) / (np.sqrt(squared / (1 - 0.99**k)) + 1e-8)
    return Field(params[:WIDTH], params[WIDTH : WIDTH + 4].reshape(2, 2), params[WIDTH + 4 :])


def chains(n_lines: int) -> list[tuple[int, int]]:
    """Line ranges of a text that the fit uses: all of them in ``CHAIN`` lines each, or ``CHAINS`` evenly spaced ones."""
    if n_lines <= CHAIN * CHAINS:
        return [(k, min(k + CHAIN, n_lines)) for k in range(0, n_lines, CHAIN)]
    return [(k, k + CHAIN) for k in np.linspace(0, n_lines - CHAIN, CHAINS).astype(int).tolist()]


def _features(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        rows = []
        for i, j in slices(offsets):
            text, _, features, _ = lines_of(data, offsets[i : j + 1])
            for k in range(j - i):
                a, b = np.searchsorted(text, [k, k + 1])
                rows.append([features[a + x : a + y].tobytes() for x, y in chains(int(b - a))])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("quality").cast(pa.int32()), pa.array(rows, pa.list_(pa.binary()))], names=["id", "quality", "chains"])


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fit to at most ``SAMPLE`` labelled documents of each class: lines of good ones are content, of bad ones boilerplate.

    The driver holds at most 2 x ``SAMPLE`` x ``CHAINS`` x ``CHAIN`` lines. Of
    rows that repeat a chosen doc_id the first by text hash is taken. A bad
    document's lines that are equal to none of the signs stay noise that the
    fit averages out. Without both classes the answer is ``PRIOR``.
    """
    pick = [labels.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for q in (0, 1)]
    chosen = pick[0].union(pick[1]).select("doc_id", "quality").dropDuplicates(["doc_id"])
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = held.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.select(F.col("doc_id").cast("string").alias("id"), "quality", "text").mapInArrow(_features, "id string, quality int, chains array<binary>").collect()
    rows = sorted((r for r in rows if r.chains), key=lambda r: (len(r.id), r.id))
    n = np.bincount([r.quality for r in rows], minlength=2)
    if not n.all():
        return PRIOR
    features = [np.frombuffer(c).reshape(-1, WIDTH) for r in rows for c in r.chains]
    lines = np.array([sum(len(c) for c in r.chains) // (8 * WIDTH) for r in rows])
    quality = np.array([r.quality for r in rows])
    # A line counts for its share of its document, a class as much as the other.
    weight = len(rows) / (2 * n[quality] * lines)
    of_chain = np.repeat(np.arange(len(rows)), [len(r.chains) for r in rows])
    of_line = np.repeat(np.arange(len(features)), [len(x) for x in features])
    return fit(of_line, np.concatenate(features), quality[of_chain[of_line]], weight[of_chain])


def judge(docs: DataFrame, field: Field) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the base counts, base_failed, content_share, kept.

    Null and empty texts have no words and fail. content_share is the share of
    words in lines decoded as content. Repeated rows are judged each, an empty
    table gives no rows, other columns stay; one with the name of a result is
    replaced by it.
    """
    docs = docs.drop(*RESULTS)

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            bases, shares = [np.zeros((0, 5), np.int64)], [np.zeros(0)]
            for i, j in slices(offsets):
                text, count, features, base = lines_of(data, offsets[i : j + 1])
                content = np.bincount(text, count * viterbi(field, text, features), j - i)
                bases.append(base)
                shares.append(content / np.maximum(base[:, 0], 1))
            base, share = np.concatenate(bases), np.concatenate(shares)
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEATED * base[:, 0])
            columns = [*map(pa.array, base.T.copy()), pa.array(failed), pa.array(share), pa.array(~failed & (share >= CONTENT))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *RESULTS])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")
