"""Words and word shingles of whole texts as 64-bit hashes, computed on Arrow buffers with numpy.

A word is a maximal run of bytes other than space and \\x09-\\x0D; A-Z are lower-cased first.
A word's hash is a polynomial over its bytes taken from prefix sums, so that no Python loop
runs over words. Texts are handled in slices of about ``SLICE`` bytes, always whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessera.llm.common import by_value

#: Bytes of text handled at once (a longer text is handled alone).
SLICE = 1 << 18
#: Base of the polynomial (odd, so that it has an inverse modulo 2**64) and that inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class _Tables:
    """Lookup tables and powers of the base, built once per process on first use."""

    made: dict = {}

    @classmethod
    def get(cls, n: int) -> dict:
        t = cls.made
        if not t:
            codes = np.arange(256, dtype=np.uint8)
            space = (codes == 32) | ((codes >= 9) & (codes <= 13))
            lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
            value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
            value = value[lower]
            t.update(space=space, value=value, inner=np.where(space, np.uint64(0), value), n=0)
        if t["n"] < n:
            size = max(n, SLICE + 1)
            up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
            up[0] = down[0] = 1
            # values is room that each call of words_of fills anew
            t.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down), values=np.empty(size, np.uint64))
        return t


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string array; a null counts as empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return offsets, data


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about SLICE bytes: first, past the last, their offsets from 0, bytes."""
    offsets, data = buffers(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


def words_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order; first word of each text (n + 1); start and end byte of each word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    t = _Tables.get(n + 1)
    word = ((data - np.uint8(9)) > np.uint8(4)) & (data != np.uint8(32))
    begins = word.copy()
    np.greater(word[1:], word[:-1], out=begins[1:])
    edge = offsets[1:-1]
    edge = edge[edge < n]
    begins[edge] = word[edge]
    start = np.flatnonzero(begins)
    stops = word.copy()
    np.greater(word[:-1], word[1:], out=stops[:-1])
    stops[edge[edge > 0] - 1] = word[edge[edge > 0] - 1]
    end = np.flatnonzero(stops) + 1
    # what is between words adds nothing
    values = t["values"][:n]
    np.take(t["inner"], data, out=values, mode="clip")
    np.multiply(values, t["up"][:n], out=values)
    h = np.add.reduceat(values, start) if len(start) else np.zeros(0, np.uint64)
    h *= t["down"][start]
    h += (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    h = mix(h)
    return h, np.searchsorted(start, offsets, "left"), start, end


def shingles_of(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order and the first of each text (n + 1).

    A text of 1 to k - 1 words has its whole sequence as one shingle; one without words has none.
    """
    counts = np.diff(first)
    odd = np.array([pow(BASE, j + 2, 1 << 64) for j in range(k)], np.uint64)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(made, out=out_first[1:])
    out = np.empty(out_first[-1], np.uint64)
    n = len(words) - k + 1
    if n > 0:
        h = words[:n] * odd[0]
        for j in range(1, k):
            h += words[j : j + n] * odd[j]
        owner = np.repeat(np.arange(len(counts)), counts)
        whole = owner[:n] == owner[k - 1 :]
        at = np.flatnonzero(whole)
        out[out_first[owner[at]] + at - first[owner[at]]] = mix(h[at])
    for c in range(1, k):
        short = np.flatnonzero(counts == c)
        if len(short):
            h = np.full(len(short), c, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            for j in range(c):
                h += words[first[short] + j] * odd[j]
            out[out_first[short]] = mix(h)
    return out, out_first


def sets_of(shingles: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    return [np.unique(shingles[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each whole text, in order."""
    for _, _, offsets, data in slices(texts):
        words, first, _, _ = words_of(offsets, data)
        yield from sets_of(*shingles_of(words, first, k))


def ids(column: pa.Array) -> np.ndarray:
    """Integer ids as int64 (no nulls are expected)."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


by_value(__name__)
