"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Letters of any script are lower-cased. A window of a document has as many words as the benchmark item that it is compared with. Its
fingerprint is the SimHash of its five-word shingles, weighted by how often each occurs. Windows
that hold no shingle of any item of that length cannot reach the threshold and get none. Items
whose fingerprint lies within the radius of a window's come out of the index; the exact weighted
Jaccard similarity of the shingles then decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import by_value, small_batches, table

#: Fingerprints of 64 bits within this distance are found with certainty ...
RADIUS = 19
#: ... as they differ by at most one bit in one of so many blocks (10 * 2 > 19).
BLOCKS = 10
#: Bits of a block's value at most.
BLOCK_BITS = 7
#: Windows that are fingerprinted at once (300 bytes each, and for each shingle of an item).
WINDOWS = 8192
#: Words of benchmark items that are held in memory at once; more items take more passes.
BLOCK_WORDS = 1_000_000


def simhash(shingles: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of all windows of ``length`` shingles."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1
    total = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=total[1:])
    return np.packbits(total[length:] - total[:-length] > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard: sum of the lesser over sum of the greater number of occurrences."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


class Items:
    """The index of a bounded block of benchmark items."""

    def __init__(self, texts: list[str | None]):
        found: list[np.ndarray] = []
        n_words: list[int] = []
        for _, _, offsets, data in W.slices(pc.utf8_lower(pa.array(texts, pa.large_string()))):
            h, first, _, _ = W.words_of(offsets, data)
            s, at = W.shingles_of(h, first)
            found += [s[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            n_words += np.diff(first).tolist()
        self.shingles, self.words = found, np.array(n_words, np.int64)
        self.lengths = np.array([len(s) for s in found], np.int64)
        self.prints = np.array([simhash(s, len(s))[0] if len(s) else 0 for s in found], np.uint64)
        known = np.concatenate(found) if found else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(found)), self.lengths)
        order = np.lexsort((owner, known))
        self.known, self.owner = known[order], owner[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        # for each block the items by length and by each value that differs in a bit at most
        edges = np.linspace(0, 64, BLOCKS + 1).astype(int)
        self.blocks = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            mask = np.uint64((1 << (b - a)) - 1)
            value = (self.prints >> np.uint64(a)) & mask
            flips = np.array([0, *(1 << k for k in range(b - a))], np.uint64)
            keys = (self.lengths[:, None] * (1 << BLOCK_BITS) + (value[:, None] ^ flips).astype(np.int64)).ravel()
            order = np.argsort(keys, kind="stable")
            self.blocks.append((np.uint64(a), mask, keys[order], order // len(flips)))

    @classmethod
    def again(cls, state: dict) -> "Items":
        """The index out of its attributes, which travel as plain arrays."""
        out = cls.__new__(cls)
        out.__dict__ = state
        return out

    def anchors(self, shingles: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        at = np.flatnonzero(self.bits[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(at) and len(self.known):
            k = np.searchsorted(self.known, shingles[at])
            at = at[(k < len(self.known)) & (self.known[np.minimum(k, len(self.known) - 1)] == shingles[at])]
        return at

    def within(self, prints: np.ndarray, length: int) -> np.ndarray:
        """(window, item) pairs within the radius among items of that number of shingles."""
        found = [np.zeros(0, np.int64)]
        for shift, mask, keys, owner in self.blocks:
            k = length * (1 << BLOCK_BITS) + ((prints >> shift) & mask).astype(np.int64)
            lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            w = np.repeat(np.arange(len(k)), hi - lo)
            at = np.arange(len(w)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[w]
            i = owner[at]
            good = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
            found.append(w[good] * len(self.prints) + i[good])
        both = np.unique(np.concatenate(found))
        return np.column_stack([both // max(1, len(self.prints)), both % max(1, len(self.prints))])

    def matches(self, shingles: np.ndarray, n_words: int, threshold: float) -> Iterator[tuple[int, float, int]]:
        """(item, best similarity, first word of the first best window) of one whole text."""
        at = self.anchors(shingles)
        if not len(at):
            return
        best: dict[int, tuple[float, int]] = {}
        if n_words < 5:
            found = np.flatnonzero((self.words == n_words) & (self.lengths == 1))
            best = {int(i): (1.0, 0) for i in found if self.shingles[i][0] == shingles[0]}
        else:
            lo, hi = np.searchsorted(self.known, shingles[at], "left"), np.searchsorted(self.known, shingles[at], "right")
            owners = np.unique(np.concatenate([self.owner[a:b] for a, b in sorted(set(zip(lo.tolist(), hi.tolist(), strict=True)))]))
            for length in np.unique(self.lengths[owners[self.words[owners] >= 5]]).tolist():
                size = min(length, len(shingles))
                mark = np.zeros(len(shingles) + 1, np.int64)
                np.add.at(mark, np.maximum(at - size + 1, 0), 1)
                np.add.at(mark, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(mark[:-1])[: len(shingles) - size + 1] > 0)
                for run in (r[a : a + WINDOWS] for r in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) for a in range(0, len(r), WINDOWS)):
                    piece = shingles[run[0] : run[-1] + size]
                    for w, i in self.within(simhash(piece, size), length).tolist():
                        s = similarity(piece[w : w + size], self.shingles[i])
                        if s >= threshold and s > best.get(i, (0.0, 0))[0]:
                            best[i] = (s, int(run[0]) + w)
        for i, (s, start) in sorted(best.items()):
            yield i, s, start


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, nameless: bool = False) -> Iterator[tuple[list[int], list[str | None]]]:
    """The items in blocks of bounded size, in order of their ids; those without an id if ``nameless``."""
    block_ids: list[int] = []
    block: list[str | None] = []
    size = 0
    for r in benchmark.select(F.col(id_col).cast("long"), text_col).where(F.lit(nameless) | F.col(id_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator():
        block_ids.append(r[0])
        block.append(r[1])
        size += len((r[1] or "").split())
        if size >= BLOCK_WORDS:
            yield block_ids, block
            block_ids, block, size = [], [], 0
    if block:
        yield block_ids, block


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, similarity, first_word, n_words.

    A document with fewer words than the item is compared as a whole. Items of fewer than five
    words match only a document of exactly these words; items and documents without words match
    nothing. Null texts count as empty; rows with a null id have no result; an item or document
    that occurs repeatedly gives a row each time. Either table may be empty. A long text is searched
    whole, some thousand windows at a time; of windows as similar the first is told.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    out = None
    for item_ids, texts in item_blocks(benchmark, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast((item_ids, Items(texts).__dict__))

        def run(batches, shared=shared):
            item_ids, items = shared.value[0], Items.again(shared.value[1])
            for b in batches:
                got: list[tuple] = []
                ids = W.ids(b.column(0))
                for a, _, offsets, data in W.slices(pc.utf8_lower(b.column(1))):
                    h, first, _, _ = W.words_of(offsets, data)
                    s, at = W.shingles_of(h, first)
                    hit = np.unique(np.searchsorted(at, items.anchors(s), "right") - 1) if len(s) else []
                    for d in hit:
                        n = int(first[d + 1] - first[d])
                        for i, sim, start in items.matches(s[at[d] : at[d + 1]], n, threshold):
                            got.append((int(ids[a + d]), item_ids[i], sim, start, min(n, int(items.words[i]))))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text holds no item, whether the item has an id or not; null ids are kept rows like others."""
    spark = docs.sparkSession
    small_batches(spark)
    out = docs
    for _, texts in item_blocks(benchmark, item_id_col, item_text_col, nameless=True):
        shared = spark.sparkContext.broadcast(Items(texts).__dict__)

        def run(batches, shared=shared):
            items = Items.again(shared.value)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for a, _, offsets, data in W.slices(pc.utf8_lower(b.column(b.schema.get_field_index(text_col)))):
                    h, first, _, _ = W.words_of(offsets, data)
                    s, at = W.shingles_of(h, first)
                    for d in np.unique(np.searchsorted(at, items.anchors(s), "right") - 1) if len(s) else []:
                        keep[a + d] = not any(True for _ in items.matches(s[at[d] : at[d + 1]], int(first[d + 1] - first[d]), threshold))
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out


def op3_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the items."""
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


by_value(__name__)
