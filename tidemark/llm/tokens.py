"""Words of Arrow text columns as numpy arrays.

Texts stay bytes: a word is a pair of byte positions and a 64-bit hash, so a
batch of millions of words needs no Python string. Two different words share a
hash with a chance of about 2^-64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; the work arrays take about forty times as many.
CHUNK_BYTES = 2 << 20

#: Bytes that separate words: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_LOWER, _SOLID = LOWER.tobytes(), (~SPACE).tobytes()

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 positions between them; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


@dataclass
class Words:
    """Words of some texts. ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    sums: np.ndarray

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes between two positions."""
        return mix((self.sums[end] - self.sums[start]) * _power(_P_INVERSE, len(self.sums))[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Words of the texts between ``offsets``, A-Z lower-cased unless ``lower`` is false. Positions count from the first text."""
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    # A translation of bytes costs a fraction of a lookup by numpy.
    held = data.tobytes()
    data = np.frombuffer(held.translate(_LOWER), np.uint8) if lower else data
    bounds = offsets - base
    n = len(data)
    solid = np.frombuffer(held.translate(_SOLID), bool)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = bounds[bounds < n]
    begins[inner] = solid[inner]
    start = np.flatnonzero(begins)
    # A word ends before white space, before the next word (that of the next text) or with the last byte.
    ends = solid.copy()
    ends[:-1] &= begins[1:] | ~solid[1:]
    end = np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _power(_P, n)
    np.cumsum(terms, out=sums[1:])
    out = Words(data, start, end, np.searchsorted(start, bounds), start, sums)
    out.hash = out.spans(start, end)
    return out


def shingles(w: Words, text: int, width: int) -> np.ndarray:
    """Distinct hashes, ascending, of the word windows of one text; a shorter
    text is one window, one without words has none."""
    h = w.hash[w.first[text] : w.first[text + 1]]
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(_windows(h, min(width, len(h))))


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out ^ h[k : k + len(out)])
        out += np.uint64(k)
    return out


def all_shingles(w: Words, width: int) -> Iterator[np.ndarray]:
    """``shingles`` of each text: the windows of all texts are made at once, those across two texts are left out."""
    windows = _windows(w.hash, width) if len(w.hash) >= width else np.zeros(0, np.uint64)
    for k, (i, j) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if j - i < width:
            yield shingles(w, k, width)
            continue
        held = np.sort(windows[i : j - width + 1])
        new = held[1:] != held[:-1]
        yield held if new.all() else held[np.concatenate([[True], new])]
