"""Language-model scores by a probabilistic suffix tree over words.

Counts come from all training documents. The tree's states are contexts of up to DEPTH words whose
next-symbol distribution diverges from that of their longest proper suffix; next symbols that tell
enough by themselves are explicit, the rest of their mass is spread as their suffix spreads it, down
to the smoothed single-word distribution, so that every state's distribution sums to one. A word is
scored in the state of the longest suffix of what precedes it.

Thresholds are absolute counts and evidence, so the tree grows with the corpus. It is kept in
written tables. A log probability is a sum of one value for each run of 1 to DEPTH + 1 symbols that
end at a word (what the run adds as an entry, and its state's share for the shorter suffix), so
runs are looked up by their hash. Counts and lookups travel as sorted arrays, dealt into buckets by
the leading bits of a hash; a task holds one bucket at a time, and no key's rows are more than one
for each batch. What is broadcast has a bounded size and only saves work: the values of the most
frequent runs, and a sketch of those that the tables hold.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import Scratch, by_value, held_out, shuffles_dropped, small_batches, table

#: Longest context.
DEPTH = 3
#: Shares of all training tokens from which a word (2,000,000 at most) and a run's value (1,000,000
#: of a length at most) are broadcast; those of rarer ones are looked up in tables.
MIN_HEAD, MIN_CACHED = 5e-7, 1e-6
#: An entry is explicit from this count on, and if its count times its own log ratio in nats reaches this.
MIN_COUNT, MIN_GAIN = 2, 4.0
#: A context stays if its divergence in nats, and that times its count, reach these.
MIN_DIVERGENCE, MIN_EVIDENCE = 0.01, 6.0
#: 64-bit words of a sketch at most, as a power of two (64 MB).
SKETCH_BITS = 23
#: Keys of a bucket, about; more keys take more buckets.
BUCKET_KEYS = 1_000_000
DISCOUNT = 0.75
SMOOTH = 0.1
END = 0x1E0D0C0B0A09A7E5
#: Leading bits of a word's hash that make its bucket while words are counted.
WORD_BITS = 10
#: Distinct entries that a counting task holds before it passes them on.
HELD = 700_000
#: Passes in which rows are scored, each over its part of them.
PASSES = 2
#: Entries of a batch that a task passes on.
BATCH_KEYS = 100_000


@dataclass
class Lookup:
    """Positions of 64-bit keys in a sorted table.

    Slots part the range that the keys take, not all numbers: keys of a bucket share their leading bits.
    """

    keys: np.ndarray
    starts: np.ndarray = field(init=False)
    least: np.uint64 = field(init=False)
    shift: np.uint64 = field(init=False)

    def __post_init__(self):
        n = len(self.keys)
        self.least = self.keys[0] if n else np.uint64(0)
        span = int(self.keys[-1]) - int(self.least) if n else 0
        shift = max(0, span.bit_length() - max(4, int(math.log2(n + 1)) + 1))
        self.shift = np.uint64(shift)
        count = np.bincount(((self.keys - self.least) >> self.shift).view(np.int64), minlength=(span >> shift) + 1)
        self.starts = np.zeros(len(count), np.int32 if n < 1 << 31 else np.int64)
        np.cumsum(count[:-1], out=self.starts[1:])
        self.keys = np.append(self.keys, np.uint64(2**64 - 1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        # those below the range wrap around; whatever slot they are given, no key there equals them
        out = np.take(self.starts, ((h - self.least) >> self.shift).view(np.int64), mode="clip").astype(np.int64)
        key = np.take(self.keys, out, mode="clip")
        at = np.flatnonzero(key < h)
        pos, wanted = out[at], h[at]
        while len(at):
            pos += 1
            here = np.take(self.keys, pos, mode="clip")
            low = here < wanted
            ends = at[~low]
            out[ends], key[ends] = pos[~low], here[~low]
            at, pos, wanted = at[low], pos[low], wanted[low]
        out[(key != h) | (out == len(self.keys) - 1)] = -1
        return out


@dataclass
class Sketch:
    """A Bloom filter of 64-bit keys, each within one word of ``bits``."""

    bits: np.ndarray

    def __post_init__(self):
        self.shift = np.uint64(64 - (len(self.bits).bit_length() - 1))

    @staticmethod
    def of(packed: DataFrame, width: int, n: int) -> np.ndarray:
        """The words of the filter of the first of ``width`` columns in pieces, about ``n`` rows, of 10 bits a key while SKETCH_BITS allows."""
        power = min(SKETCH_BITS, max(4, math.ceil(math.log2(n * 10 / 64 + 1))))
        part = min(power, 16)

        def gather(batches):
            held: list[np.ndarray] = []

            def out():
                h = np.concatenate(held)
                at, m = h >> np.uint64(64 - power), masks(h)
                order = np.argsort(at)
                at, m = at[order], m[order]
                first = np.flatnonzero(np.diff(at, prepend=at[:1] + np.uint64(1)))
                at, m = at[first], np.bitwise_or.reduceat(m, first)
                low = np.uint64((1 << part) - 1)
                segment = (at >> np.uint64(part)).astype(np.int64)
                edge = np.flatnonzero(np.diff(segment, prepend=-1))
                rows = [(int(segment[a]), (at[a:b] & low).astype(np.uint16).tobytes(), m[a:b].tobytes()) for a, b in zip(edge, [*edge[1:], len(at)], strict=True)]
                columns = zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["segment", "at", "m"])

            for b in batches:
                for x in b.column(0):
                    held.append(np.frombuffer(x.as_buffer(), np.uint64).reshape(width, -1)[0])
                    if sum(map(len, held)) > HELD:
                        yield out()
                        held = []
            if sum(map(len, held)):
                yield out()

        def unite(batches):
            now: dict[int, np.ndarray] = {}
            for b in batches:
                for segment, at, m in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                    words = now.setdefault(segment, np.zeros(1 << part, np.uint64))
                    words[np.frombuffer(at.as_buffer(), np.uint16)] |= np.frombuffer(m.as_buffer(), np.uint64)
            for segment, words in now.items():
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([words.tobytes()], pa.binary())], names=["segment", "words"])

        bits = np.zeros(1 << power, np.uint64)
        with shuffles_dropped(packed.sparkSession):
            made = packed.select("x").mapInArrow(gather, "segment int, at binary, m binary").repartition("segment").mapInArrow(unite, "segment int, words binary").collect()
        for r in made:
            bits[r["segment"] << part : (r["segment"] + 1) << part] = np.frombuffer(r["words"], np.uint64)
        return bits

    def has(self, h: np.ndarray) -> np.ndarray:
        """Whether each key may be among those of the filter; always true for those that are."""
        m = masks(h)
        return np.take(self.bits, (h >> self.shift).view(np.int64), mode="clip") & m == m


def masks(h: np.ndarray) -> np.ndarray:
    """The three bits of each key in its word of a sketch."""
    one, low = np.uint64(1), np.uint64(63)
    return (one << (h & low)) | (one << ((h >> np.uint64(6)) & low)) | (one << ((h >> np.uint64(12)) & low))


def streams(texts: pa.Array):
    """For slices of whole texts: first row, symbols with an END before and after each text, first symbol of each text's row (n + 1)."""
    for a, _, offsets, data in W.slices(texts):
        h, first, _, _ = W.words_of(offsets, data)
        n = len(offsets) - 1
        starts = first + 2 * np.arange(n + 1)
        out, word = np.full(starts[-1], END, np.uint64), np.ones(starts[-1], bool)
        word[starts[:-1]] = word[starts[1:] - 1] = False
        out[word] = h
        yield a, out, starts


def joined(context: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """The hash of a run, out of those of all but its last symbol and of all but its first."""
    return W.mix(context * np.uint64(0x9E3779B97F4A7C15) + (shorter ^ (shorter >> np.uint64(29))))


def levels(s: np.ndarray, n: int) -> list[np.ndarray]:
    """Hashes of all runs of 1 to n symbols, by their first symbol."""
    out = [s]
    for _ in range(1, n):
        out.append(joined(out[-1][:-1], out[-1][1:]))
    return out


def gram(s: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n symbols up to and including each end."""
    return levels(s, n)[-1][ends - n + 1]


def places(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of scored symbols (all but the END before each text), their rows, and the symbols before each in its row."""
    scored = np.ones(n, bool)
    scored[starts[:-1]] = False
    at = np.flatnonzero(scored)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts) - 1)
    return at, row, at - starts[row]


def apart(starts: np.ndarray, n: int) -> np.ndarray:
    """Whether each run of n symbols, by its first, reaches from one row into another."""
    out = np.zeros(max(0, starts[-1] - n + 1), bool)
    for k in range(1, n):
        at = starts[1:-1] - k
        out[at[(at >= 0) & (at < len(out))]] = True
    return out


def bits_for(n: int) -> int:
    """How many leading bits of a hash make its bucket, for ``n`` keys."""
    return max(4, math.ceil(math.log2(n / BUCKET_KEYS + 1)))


def dealt(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """bucket, first and past the last of each bucket's keys, which are sorted."""
    if not len(keys):
        return
    shift = np.uint64(64 - bits)
    first, last = int(keys[0] >> shift), int(keys[-1] >> shift)
    edge = [0, *np.searchsorted(keys, np.arange(first + 1, last + 1, dtype=np.uint64) << shift).tolist(), len(keys)]
    yield from ((bucket, a, b) for bucket, (a, b) in enumerate(zip(edge, edge[1:], strict=False), first) if a < b)


@dataclass
class Model:
    """The tree: head words, all values as pieces (key, v, c) by ``bits`` and, if kept, tables of the states (context, keep) and explicit entries (g, mass) of each depth."""

    tokens: int
    types: int
    depth: int
    words: np.ndarray
    counts: np.ndarray
    tree: list[tuple[DataFrame, DataFrame]]
    values: DataFrame
    bits: int

    @cached_property
    def contexts(self) -> list[tuple[Lookup, np.ndarray]]:
        """The states of each depth, read to the driver (for small trees)."""
        return [(Lookup(h), x) for h, x in (_read(states) for states, _ in self.tree)]

    @cached_property
    def entries(self) -> list[tuple[Lookup, np.ndarray]]:
        """The explicit entries of each depth, read to the driver (for small trees)."""
        return [(Lookup(h), x) for h, x in (_read(entries) for _, entries in self.tree)]

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + SMOOTH) / (self.tokens + SMOOTH * (self.types + 1))

    def walk(self, s: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of scored symbols; the probability of each as explicit parts and as the factor of the base (for small trees)."""
        at, _, depth = places(starts, len(s))
        explicit, factor = np.zeros(len(at)), np.ones(len(at))
        for n, ((contexts, keep), (entries, mass)) in enumerate(zip(self.contexts, self.entries, strict=True), 1):
            live = np.flatnonzero(depth >= n)
            if not len(live):
                break
            c = contexts.find(gram(s, at[live] - 1, n))
            live, c = live[c >= 0], c[c >= 0]
            explicit[live] *= keep[c]
            factor[live] *= keep[c]
            e = entries.find(gram(s, at[live], n + 1))
            explicit[live[e >= 0]] += mass[e[e >= 0]]
        return at, explicit, factor


def _read(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys and the numbers of a table, those of equal keys added up."""
    got = rows.toArrow()
    return _added(got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy())


def _added(h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, x = h[order], x[order]
    first, n = _runs(h)
    return (h, x) if n == len(h) else (h[first], np.add.reduceat(x, first))


def _summed(x: np.ndarray) -> np.ndarray:
    """Columns with equal first rows as one, their last rows added up; sorted by the first row."""
    order = np.argsort(x[0])
    first, n = _runs(np.take(x[0], order, mode="clip"))
    out = _picked(x, order[first])
    if n < len(order):
        total = np.cumsum(np.take(x[-1], order, mode="clip"))
        out[-1] = np.diff(total[np.append(first[1:], len(order)) - 1], prepend=np.uint64(0))
    return out


def _picked(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``x[:, at]``, column by column, which takes about half the time."""
    out = np.empty((len(x), len(at)), x.dtype)
    for c, o in zip(x, out, strict=True):
        np.take(c, at, out=o, mode="clip")
    return out


def _runs(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Where runs of equal sorted keys begin, and how many there are."""
    first = np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return first, len(first)


#: Columns of 64-bit numbers in sorted pieces, each of one bucket of its first column: what is looked
#: up, what asks, and the values of states and of explicit entries (key, v, c).
PACKED = "bucket int, kind int, x binary"
TABLE, ASKING, STATES, ENTRIES = range(4)


class Dealer:
    """Gathers columns of numbers and passes them on as pieces, sorted and dealt by the first column."""

    def __init__(self, kind: int, bits: int):
        self.kind, self.bits, self.held = kind, bits, []

    def add(self, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(x)
        if sum(x.shape[1] for x in self.held) > HELD:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            x = np.concatenate(self.held, 1)
            self.held = []
            yield from pieces(_picked(x, np.argsort(x[0])), self.kind, self.bits)


class Spool:
    """Columns of numbers to be read again: up to HELD rows in memory, those before them in a temporary file that goes when it is closed."""

    def __init__(self):
        self.held, self.file, self.shapes = [], None, []

    def add(self, x: np.ndarray) -> None:
        self.held.append(x)
        if sum(x.shape[1] for x in self.held) > HELD:
            x = np.concatenate(self.held, 1)
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(x.tobytes())
            self.shapes.append(x.shape)
            self.held = []

    def read(self) -> Iterator[np.ndarray]:
        if self.file:
            with self.file as f:
                f.seek(0)
                for rows, n in self.shapes:
                    yield np.frombuffer(f.read(8 * rows * n), np.uint64).reshape(rows, n)
        yield from self.held


def pieces(x: np.ndarray, kind: int, bits: int, skip: int = 0) -> Iterator[pa.RecordBatch]:
    """Sorted columns dealt by the first; the first ``skip`` columns are left out."""
    rows, size = [], 0
    for bucket, a, b in dealt(x[0], bits):
        rows.append((bucket, kind, x[skip:, a:b].tobytes()))
        size += b - a
        if size > BATCH_KEYS or b == x.shape[1]:
            columns = zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["bucket", "kind", "x"])
            rows, size = [], 0


def _packed(rows: DataFrame, bits: int) -> DataFrame:
    """A table of 64-bit columns as pieces."""

    def run(batches):
        dealer = Dealer(TABLE, bits)
        for b in batches:
            yield from dealer.add(np.stack([c.to_numpy().view(np.uint64) for c in b.columns]))
        yield from dealer.rest()

    return rows.mapInArrow(run, PACKED)


def _plain(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in columns], names=names)


def _unpacked(packed: DataFrame, width: int, pick, schema: str) -> DataFrame:
    """What ``pick`` makes of each piece of ``width`` columns, as rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            for x in b.column(0):
                yield from _plain(pick(np.frombuffer(x.as_buffer(), np.uint64).reshape(width, -1)), names)

    return packed.select("x").mapInArrow(run, schema)


def _length(packed: DataFrame, width: int) -> int:
    """Rows in pieces of ``width`` columns."""
    return (packed.agg(F.coalesce(F.sum(F.octet_length("x").cast("long")), F.lit(0))).first()[0]) // (8 * width)


def _met(table: DataFrame, asking: DataFrame, width: int, work, schema: str = PACKED) -> DataFrame:
    """What ``work`` makes of the buckets of a table of ``width`` columns and of the pieces that ask it.

    ``work`` gives functions of a bucket's sorted table, which is held, and a generator for what is
    left at the end; the first function takes one asking piece at a time, so a key may have any
    number of rows, and the second ends the bucket.
    """

    def run(batches):
        each, after, finish = work()
        bucket, held, table, lookup = None, [], None, None

        def end():
            if lookup is not None:
                yield from after(bucket, table)

        for b in batches:
            for k, kind, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if k != bucket:
                    yield from end()
                    bucket, held, table, lookup = k, [], None, None
                x = np.frombuffer(x.as_buffer(), np.uint64)
                if kind == TABLE:
                    held.append(x.reshape(width, -1))
                elif held or lookup is not None:
                    if lookup is None:
                        table = np.concatenate(held, 1)
                        table = _picked(table, np.argsort(table[0]))
                        lookup, held = Lookup(table[0]), []
                    yield from each(table, lookup, x)
        yield from end()
        yield from finish()

    met = table.unionByName(asking).repartition("bucket").sortWithinPartitions("bucket", "kind")
    return met.mapInArrow(run, schema)


def _counts(texts: DataFrame, n: int, bits: int, shared=None) -> DataFrame:
    """Of single symbols, g and c; of runs of several, pieces of shorter (all but the first), context (all but the last) and c.

    Single symbols are all counted. Of longer runs those are that occur MIN_COUNT times or more; by
    the sketch ``shared`` of runs one shorter that do, most others are not even gathered.
    """

    def gather(batches):
        sketch = Sketch(shared.value) if shared else None
        held: list[np.ndarray] = []

        def out(x):
            # the hash of several symbols is made of the other columns again
            yield from pieces(x, ASKING, bits, skip=int(n > 1))

        for b in batches:
            for _, s, starts in streams(b.column(0)):
                if n == 1:
                    g, c = np.unique(np.delete(s, starts[:-1]), return_counts=True)
                    held.append(np.stack([g, c.astype(np.uint64)]))
                else:
                    runs = levels(s, n - 1)[-1]
                    often = sketch.has(runs)
                    at = np.flatnonzero(often[:-1] & often[1:] & ~apart(starts, n))
                    context, shorter = runs[at], runs[at + 1]
                    g = joined(context, shorter)
                    order = np.argsort(g)
                    first, k = _runs(g[order])
                    some = order[first]
                    held.append(np.stack([g[some], context[some], shorter[some], np.diff(first, append=len(g)).astype(np.uint64)]))
                if sum(x.shape[1] for x in held) > HELD:
                    held = [_summed(np.concatenate(held, 1))]
                    if held[0].shape[1] > HELD // 2:
                        yield from out(held.pop())
        if held:
            yield from out(_summed(np.concatenate(held, 1)))

    def merge(batches):
        bucket, held, dealer = None, [], Dealer(ASKING, bits)

        def out():
            x = np.concatenate(held, 1)
            if n == 1:
                yield from _plain([c.view(np.int64) for c in _summed(x)], ["g", "c"])
            else:
                x = _summed(np.concatenate([joined(x[0], x[1])[None], x]))
                yield from dealer.add(x[[2, 1, 3]][:, x[-1] >= MIN_COUNT])

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if k != bucket and held:
                    yield from out()
                    held = []
                bucket = k
                held.append(np.frombuffer(x.as_buffer(), np.uint64).reshape(2 if n == 1 else 3, -1))
        if held:
            yield from out()
        yield from dealer.rest()

    packed = texts.mapInArrow(gather, PACKED).repartition("bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(merge, "g long, c long" if n == 1 else PACKED)


def _gains(c: np.ndarray, times: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries: their share of their context, its log ratio to their suffix's, their mass if they are explicit (or 0)."""
    c, times, q = c.astype(np.float64), times.astype(np.float64), q.view(np.float64)
    p = c / times
    ratio = np.log(p / q)
    return p, ratio, np.where(np.abs(c * ratio) >= MIN_GAIN, (c - DISCOUNT) / times, 0.0)


def _suffixed(bits: int):
    """Pieces of runs by their context: context, shorter, c and what the shorter context gives their last symbol."""

    def work():
        dealer = Dealer(ASKING, bits)

        def each(table, lookup, x):
            shorter, context, c = x.reshape(3, -1)
            at = lookup.find(shorter)
            on = at >= 0
            yield from dealer.add(np.stack([context[on], shorter[on], c[on], table[2][at[on]]]))

        return each, lambda bucket, table: (), dealer.rest

    return work


def _grown(bits: int, last: bool):
    """Of pieces of runs by their context: the values of states (STATES) and of entries (ENTRIES) and, but for the last level, the runs' hash, c, probability and value as an entry (NaN: none).

    A bucket's runs are read twice: for the mass that each context keeps for the shorter one, and for what it gives its runs.
    """

    def work():
        runs, entries = Dealer(TABLE, bits), Dealer(ENTRIES, bits)
        now: list[tuple[np.ndarray, Spool]] = []

        def each(table, lookup, x):
            context, shorter, c, q = x.reshape(4, -1)
            at = lookup.find(context)
            on = at >= 0
            at, shorter, c, q = at[on], shorter[on], c[on], q[on]
            if not now:
                now.append((np.zeros((4, table.shape[1])), Spool()))
            sums, spool = now[0]
            p, ratio, mass = _gains(c, table[1][at], q)
            first, n = _runs(at)
            if n:
                sums[:, at[first]] += np.add.reduceat(np.stack([p, q.view(np.float64), p * ratio, mass]), first, axis=1)
                spool.add(np.stack([at.view(np.uint64), shorter, c, q]))
            yield from ()

        def after(bucket, table):
            (p, q, d, mass), spool = now.pop()
            times = table[1].astype(np.float64)
            rest_p, rest_q = np.maximum(1 - p, 1e-9), np.maximum(1 - q, 1e-9)
            divergence = d + rest_p * np.log(rest_p / rest_q)
            stays = (divergence >= MIN_DIVERGENCE) & (divergence * times >= MIN_EVIDENCE) & (mass > 0)
            keep = np.where(stays, np.clip(1 - mass, 1e-9, 1.0), 1.0)
            x = np.stack([table[0][stays], np.log10(keep[stays]).view(np.uint64), table[1][stays]])
            if x.shape[1]:
                yield from pieces(x, STATES, bits)
            for at, shorter, c, q in spool.read():
                at, q = at.view(np.int64), q.view(np.float64)
                state = stays[at]
                _, _, mass = _gains(c, table[1][at], q)
                own, spread = np.where(state, mass, 0.0), keep[at] * q
                key, some = joined(table[0][at], shorter), own > 0
                v = np.full(len(at), np.nan)
                v[some] = np.log10(1 + own[some] / spread[some])
                yield from entries.add(np.stack([key[some], v[some].view(np.uint64), c[some]]))
                if not last:
                    yield from runs.add(np.stack([key, c, (spread + own).view(np.uint64), v.view(np.uint64)]))

        def finish():
            yield from entries.rest()
            yield from runs.rest()

        return each, after, finish

    return work


def fit(docs: DataFrame, scratch: Scratch, text_col: str = "text", depth: int = DEPTH, keep_tree: bool = False) -> tuple[Model, DataFrame]:
    """The model of all texts of ``docs``, and the counts of all words (h, c).

    Null and empty texts count as an end alone; no texts give a model without words. Other columns
    are not read. A long text is a stream like others, never cut. Only with ``keep_tree`` the tree
    stays beside the values that scoring needs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    vocabulary = scratch.save(_counts(texts, 1, WORD_BITS).withColumnRenamed("g", "h"), hashes=True)
    tokens, types = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    words, counts = _read(vocabulary.where(F.col("c") >= F.lit(tokens * MIN_HEAD)))
    bits = bits_for(tokens)
    prob = (F.col("c") + SMOOTH) / F.lit(tokens + SMOOTH * (types + 1))
    before = scratch.save(_packed(vocabulary.where(F.col("c") >= MIN_COUNT).select("h", "c", prob.alias("prob"), F.lit(float("nan")).alias("v")), bits))
    tree: list[tuple[DataFrame, DataFrame]] = []
    parts: list[DataFrame] = []

    def keeps(x):
        return [x[0].view(np.int64), 10.0 ** x[1].view(np.float64)]

    def masses(x):
        v = x[3].view(np.float64)
        some = ~np.isnan(v)
        return [x[0][some].view(np.int64), x[2].view(np.float64)[some] * (1 - 10.0 ** -v[some])]

    for n in range(1, depth + 1):
        last = n == depth and not keep_tree
        # a run's first and last n symbols occur at least as often as the run, so nothing is lost where they meet
        shared = spark.sparkContext.broadcast(Sketch.of(before, 4, _length(before, 4)))
        found = scratch.save(_counts(texts, n + 1, bits, shared))
        shared.destroy()
        half = scratch.save(_met(before, found, 4, _suffixed(bits)))
        scratch.drop(found)
        grown, values, states = scratch.save_apart(_met(before, half, 4, _grown(bits, last)), "kind", [[TABLE], [STATES, ENTRIES], [STATES]])
        scratch.drop(half)
        scratch.drop(before)
        parts.append(values)
        before = grown
        if keep_tree:
            tree.append((scratch.save(_unpacked(states, 3, keeps, "context long, keep double")), scratch.save(_unpacked(grown, 4, masses, "g long, mass double"))))
    scratch.drop(before)
    # a run may be an entry and a state, with the same count; their values are added where they are read
    values = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], PACKED)
    return Model(tokens, types, depth, words, counts, tree, values, bits), vocabulary


#: Kinds of rows that meet in a bucket, in this order: what a batch of texts knows already, the
#: values of words, words asked for, the values of runs, runs asked for.
HEADER, WORDS, WORDS_ASKED, RUNS, RUNS_ASKED = range(5)
ROWS = "bucket int, kind int, uid long, x binary, y binary"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "kind", "uid", "x", "y"])


def _values(keyed: DataFrame, kind: int, bits: int) -> DataFrame:
    """A table of keys and numbers in ROWS."""

    def run(batches):
        held: list[np.ndarray] = []

        def out():
            x = np.concatenate(held, 1)
            x = x[:, np.argsort(x[0])]
            v = x[1].view(np.float64)
            return _rows([(bucket, kind, 0, x[0, a:b].tobytes(), v[a:b].tobytes()) for bucket, a, b in dealt(x[0], bits)])

        for b in batches:
            held.append(np.stack([b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64)]))
            if sum(x.shape[1] for x in held) > HELD:
                yield out()
                held = []
        if held:
            yield out()

    return keyed.mapInArrow(run, ROWS)


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score and score (log10).

    Null and empty texts are the end alone; null and repeated ids are rows like others; an empty
    table gives an empty result. Other columns are not read. A long text is scored whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    least = model.tokens * MIN_CACHED

    def frequent(x):
        some = x[2] >= least
        return [x[0][some].view(np.int64), x[1][some].view(np.float64)]

    cached, cached_v = _read(_unpacked(model.values, 3, frequent, "key long, v double"))
    n_values = _length(model.values, 3)
    size = model.tokens + SMOOTH * (model.types + 1)
    rarer = vocabulary.where(F.col("c") < F.lit(model.tokens * MIN_HEAD)).select("h", F.log10((F.col("c") + SMOOTH) / F.lit(size)).alias("v"))
    log_base, log_none = np.log10(model.base(model.counts)), math.log10(SMOOTH / size)
    shared = spark.sparkContext.broadcast((model.words, log_base, cached, cached_v, Sketch.of(model.values, 3, n_values)))
    depth, bits = model.depth, min(model.bits, bits_for(max(n_values, model.types)))
    # the first column of a piece is its keys, the second their values; a bucket of the fit lies within one of fewer bits
    third = "octet_length(x) div 3"
    runs = model.values.select(F.shiftright("bucket", model.bits - bits).alias("bucket"), F.lit(RUNS).alias("kind"), F.lit(0).cast("long").alias("uid"), F.expr(f"substring(x, 1, {third})").alias("x"), F.expr(f"substring(x, 1 + {third}, {third})").alias("y"))

    def ask(batches):
        words, log_base, cached, cached_v, bloom = shared.value
        words, cached, sketch = Lookup(words), Lookup(cached), Sketch(bloom)
        log_base, cached_v = np.append(log_base, log_none), np.append(cached_v, 0.0)
        # what the most frequent words are worth as contexts is found with the words
        found = cached.find(words.keys[:-1])
        word_v, open_ = np.append(cached_v[found], 0.0), np.append(found < 0, True)
        task = TaskContext.get().partitionId()
        for no, b in enumerate(batches):
            uid, n = (task << 32) | no, b.num_rows
            tokens, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
            base, full = np.zeros(n), np.zeros(n)
            asked: dict[int, list] = {WORDS_ASKED: [], RUNS_ASKED: []}
            for a, s, starts in streams(b.column(1)):
                k = len(starts) - 1
                row = np.repeat(np.arange(k), np.diff(starts))
                head = words.find(s)
                # all symbols are scored but the END before each text
                rare, v = head < 0, log_base[head]
                rare[starts[:-1]], v[starts[:-1]] = False, 0.0
                tokens[a : a + k] = np.diff(starts) - 1
                rare = np.flatnonzero(rare)
                known[a : a + k] = tokens[a : a + k] - np.bincount(row[rare], minlength=k)
                base[a : a + k] = np.bincount(row, v, minlength=k)
                asked[WORDS_ASKED].append((s[rare], a + row[rare]))
                for j, runs in enumerate(levels(s, depth + 1) if depth else [], 1):
                    if j == 1:
                        # the contexts, all symbols but the END after each text
                        v, left = word_v[head], open_[head]
                        v[starts[1:] - 1], left[starts[1:] - 1] = 0.0, False
                        full[a : a + k] += np.bincount(row, v, minlength=k)
                        left = np.flatnonzero(left)
                        left = left[sketch.has(runs[left])]
                        found = cached.find(runs[left])
                    else:
                        # a run that ends its text is no context of a state
                        left = np.flatnonzero(sketch.has(runs) & ~apart(starts, j))
                        found = cached.find(runs[left])
                    full[a : a + k] += np.bincount(row[left], cached_v[found], minlength=k)
                    left = left[found < 0]
                    asked[RUNS_ASKED].append((runs[left], a + row[left]))
            out = []
            for kind, parts in asked.items():
                h, r = (np.concatenate(c) if c else np.zeros(0, np.uint64) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                order = np.argsort(h)
                # a batch has far fewer rows than 65,536 unless the session asks for larger ones
                h, r = h[order], r[order].astype(np.uint16 if n <= 1 << 16 else np.uint32)
                out += [(bucket, kind, uid, h[i:j].tobytes(), r[i:j].tobytes()) for bucket, i, j in dealt(h, bits)] if len(h) else []
            ids, lost = b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False)
            out.append((uid % (1 << bits), HEADER, uid, np.stack([ids.view(np.uint64), lost.astype(np.uint64), tokens.view(np.uint64), known.view(np.uint64), base.view(np.uint64), full.view(np.uint64)]).tobytes(), b""))
            yield _rows(out)

    def answer(batches):
        bucket, tables = None, {}
        for b in batches:
            out = []
            for k, kind, uid, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
                if k != bucket:
                    bucket, tables = k, {}
                if kind == HEADER:
                    out.append((0, kind, uid, x.as_py(), b""))
                elif kind in (WORDS, RUNS):
                    tables.setdefault(kind, []).append((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.float64)))
                elif kind - 1 in tables:
                    if isinstance(tables[kind - 1], list):
                        keys, v = _added(*(np.concatenate(c) for c in zip(*tables[kind - 1], strict=True)))
                        tables[kind - 1] = Lookup(keys), v
                    lookup, v = tables[kind - 1]
                    found = lookup.find(np.frombuffer(x.as_buffer(), np.uint64))
                    of_key = np.frombuffer(y.as_buffer(), np.uint16 if 2 * len(found) == len(y.as_buffer()) else np.uint32)
                    here = of_key[found >= 0]
                    if len(here):
                        times = np.bincount(here)
                        row = np.flatnonzero(times)
                        sums = np.bincount(here, v[found[found >= 0]])[row]
                        out.append((0, kind, uid, row.astype(np.uint32).tobytes(), np.stack([times[row].astype(np.float64), sums]).tobytes()))
            if out:
                yield _rows(out)

    def add_up(batches):
        now = None

        def out():
            ids, lost, tokens, known, base, full = now
            return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64), mask=lost > 0), *(pa.array(c) for c in (tokens.view(np.int64), known.view(np.int64), base.view(np.float64), base.view(np.float64) + full.view(np.float64)))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            for kind, x, y in zip(b.column(1).to_pylist(), b.column(3), b.column(4), strict=True):
                if kind == HEADER:
                    if now is not None:
                        yield out()
                    now = np.frombuffer(x.as_buffer(), np.uint64).reshape(6, -1).copy()
                    continue
                row, (times, sums) = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.float64).reshape(2, -1)
                if kind == WORDS_ASKED:
                    now[3][row] += times.astype(np.uint64)
                    now[4].view(np.float64)[row] += sums - times * log_none
                else:
                    now[5].view(np.float64)[row] += sums
        if now is not None:
            yield out()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    done = []
    for k in range(PASSES):
        # a pass over a part of the rows needs its share of the disk for what they ask
        asked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(PASSES)) == k).mapInArrow(ask, ROWS)
        met = asked.unionByName(_values(rarer, WORDS, bits)).unionByName(runs).repartition("bucket").sortWithinPartitions("bucket", "kind", "uid")
        known = met.mapInArrow(answer, ROWS).repartition("uid").sortWithinPartitions("uid", "kind")
        done.append(scratch.save(known.mapInArrow(add_up, "doc_id long, n_tokens long, n_known long, base_score double, score double")))
    out = reduce(DataFrame.unionByName, done)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(int(model.tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def op10_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learnt from nine of ten."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "suffixtree")
    model, vocabulary = fit(docs.where(~held_out(F.col("doc_id"), 10)), scratch)
    out = score(docs, model, vocabulary, scratch)
    return out.select("doc_id", held_out(F.col("doc_id"), 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


by_value(__name__)
