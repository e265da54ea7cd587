"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Two documents link when 100 * |A & B| >= 80 * |A | B| over their sets of five-word shingles. Then
the prefixes of both sets, the n - ceil(0.8 n) + 1 first shingles in any order that all documents
share, have a shingle in common. The order here puts rare shingles first, as far as a sketch of
all documents' shingle counts tells, so that common passages join documents only where little
else is in them; a bad estimate costs time, never a link. Each shared prefix shingle has its least
document as leader, and a document belongs to the blocks of the leaders of its prefix. Every
linked pair meets in a block. First only parity sketches of the sets travel: the bits in which two
sketches differ are at most the shingles in which the sets differ, so what has no partner within
the bound of its size leaves the block for good. Then the texts of the others follow. Within a
block overlap counts are accumulated over the n-grams, pairs
below the bound that their sizes give are discarded, and the links leave as a spanning forest.

Documents with equal sets are one row. A block beyond the bounds is cut in chunks, each with the
leader; documents that came out connected to the leader need no more comparing with each other,
the rest meets all chunks in a second round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import Scratch, by_value, small_batches, table
from tessera.llm.components import components

#: Counters of the sketch, whatever the input (a task passes on 4 MB).
CELLS = 1 << 22
PART = 1 << 18
#: Documents and shingles of a chunk.
CHUNK_ROWS = 1500
CHUNK_SHINGLES = 2_000_000
#: The (document, block) table is broadcast up to so many rows (24 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bits of the longest sketch.
MOST_BITS = 1 << 16
#: Shingles held by at least so many documents of a block are multiplied densely, in column blocks.
DENSE = 24
COLUMNS = 2048


def _profile(docs: DataFrame) -> DataFrame:
    """Per document: set size, digest and sketch; per task: its shingles' counters, up to 255, in parts."""

    names = ["doc_id", "n", "d1", "d2", "sketch", "part", "cells"]

    def run(batches):
        cells = np.zeros(CELLS, np.uint16)
        for b in batches:
            ids, sizes, d1, d2, sketches = W.ids(b.column(0)), [], [], [], []
            for s in W.shingle_sets(b.column(1)):
                at = (s & np.uint64(CELLS - 1)).astype(np.int64)
                cells[at] = np.minimum(cells[at], 254) + 1
                sizes.append(len(s))
                sketches.append(sketch(s))
                d1.append(int(W.mix(s + np.uint64(1)).sum(dtype=np.uint64)))
                d2.append(int(W.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
            n = len(ids)
            digests = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (d1, d2)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes, pa.int64()), *digests, pa.array(sketches, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        parts = [i for i in range(CELLS // PART) if cells[i * PART : (i + 1) * PART].any()]
        none = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(parts), pa.binary()), pa.array(parts, pa.int32()), pa.array([cells[i * PART : (i + 1) * PART].astype(np.uint8).tobytes() for i in parts], pa.binary())], names=names)

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sketch binary, part int, cells binary")


def _levels(profile: DataFrame) -> np.ndarray:
    """For each counter 0 (not known to be frequent) or the bit length of its count."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, cells in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(cells.as_buffer(), np.uint8).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "cells"])

    counts = np.zeros(CELLS, np.int32)
    summed = profile.where("part is not null").select("part", "cells").repartition(CELLS // PART, "part").mapInArrow(add, "part int, cells binary")
    for r in summed.toLocalIterator():
        counts[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["cells"], np.int32)
    mean = counts.mean()
    frequent = np.flatnonzero(counts > max(8, mean + 6 * np.sqrt(mean)))
    levels = np.zeros(CELLS, np.uint8)
    levels[frequent] = np.ceil(np.log2(counts[frequent] + 1.0))
    return levels


def prefix(s: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(0.8 n) + 1 shingles of a sorted set, rare ones first: those not known to be frequent, and the others."""
    n = len(s)
    level = levels[(s & np.uint64(CELLS - 1)).astype(np.int64)]
    first = np.argsort((level.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")[: n - (4 * n + 4) // 5 + 1]
    rare = level[first] == 0
    return s[first[rare]].view(np.int64), s[first[~rare]].view(np.int64)


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))


def _met_rarely(grams: DataFrame) -> DataFrame:
    """doc_id and block out of (gram, doc_id) rows of grams that no large part of the documents holds: one shuffle, then runs of equal grams."""

    def run(batches):
        gram = leader = None
        for b in batches:
            g, d = W.ids(b.column(0)), W.ids(b.column(1))
            if not len(g):
                continue
            new = np.ones(len(g), bool)
            new[1:] = g[1:] != g[:-1]
            new[0] = gram is None or g[0] != gram
            start = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
            lead = np.where(start >= 0, d[np.maximum(start, 0)], leader if leader is not None else 0)
            follows = np.flatnonzero(~new & (d != lead))
            pairs = np.stack([d[follows], lead[follows]])
            own = np.stack([lead[follows], lead[follows]])
            both = np.unique(np.concatenate([pairs, own], 1), axis=1) if len(follows) else pairs
            gram, leader = int(g[-1]), int(lead[-1])
            if both.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(both[0].copy()), pa.array(both[1].copy())], names=["doc_id", "block"])

    return grams.select("gram", "doc_id").repartition("gram").sortWithinPartitions("gram", "doc_id").mapInArrow(run, "doc_id long, block long")


def _met_often(grams: DataFrame) -> DataFrame:
    """The same of frequent grams: leaders by partial aggregation, and a join that can split a gram's rows."""
    leaders = grams.groupBy("gram").agg(F.min("doc_id").alias("block"), F.max("doc_id").alias("last")).where("block < last").select("gram", "block")
    return grams.join(leaders, "gram").select("doc_id", "block")


def sketch(s: np.ndarray) -> bytes:
    """For each bit whether an odd number of shingles falls on it; about twice as many bits as shingles."""
    if not len(s):
        return b""
    bits = 64
    while bits < min(2 * len(s), MOST_BITS):
        bits *= 2
    odd = np.bincount(((s >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def partnered(sizes: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """Whether each set may link with another: the sizes allow it, and the sketches differ in few enough bits.

    Sets at 80 % differ in at most a ninth of their sizes' sum. Half of a sketch on the other half
    gives the sketch of half the length, as sets of a quarter more shingles may have.
    """
    out = np.zeros(len(sizes), bool)
    bits = np.array([len(x) for x in sketches])
    for length in np.unique(bits):
        own = np.flatnonzero(bits == length)
        twice = np.flatnonzero(bits == 2 * length)
        all_ = np.concatenate([own, twice])
        if len(all_) < 2:
            continue
        x = np.zeros((len(all_), length // 8), np.uint64)
        for k, i in enumerate(all_):
            words = np.frombuffer(sketches[i], np.uint64)
            x[k] = words if k < len(own) else words[: length // 8] ^ words[length // 8 :]
        n = sizes[all_]
        for k in range(len(own)):
            fits = (5 * np.minimum(n, n[k]) >= 4 * np.maximum(n, n[k])).nonzero()[0]
            fits = fits[fits > k]
            near = fits[9 * np.bitwise_count(x[fits] ^ x[k]).sum(1, dtype=np.int64) <= n[fits] + n[k]]
            if len(near):
                out[all_[k]] = True
                out[all_[near]] = True
    return out


def _partnered(rows: DataFrame) -> DataFrame:
    """Of (block, x, y, doc_id, n, sketch) rows those with a possible partner in their block, without sketch."""

    def run(batches):
        key, held = None, []

        def done():
            if len(held) > 1:
                keep = partnered(np.array([n for _, n, _ in held], np.int64), [s for _, _, s in held])
                for (doc, _, _), k in zip(held, keep, strict=True):
                    if k:
                        yield (*key, doc)

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["block", "x", "y", "doc_id"])

        for b in batches:
            out = []
            for block, x, y, doc, n, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (block, x, y) != key:
                    out += done()
                    key, held = (block, x, y), []
                held.append((doc, n, bits))
            if out:
                yield batch(out)
        out = list(done())
        if out:
            yield batch(out)

    ordered = rows.select("block", "x", "y", "doc_id", "n", "sketch").repartition("block", "x", "y").sortWithinPartitions("block", "x", "y", "doc_id")
    return ordered.mapInArrow(run, "block long, x int, y int, doc_id long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The product of the incidence matrix with its transpose: overlap counts of all pairs."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    edge = np.flatnonzero(np.diff(flat, prepend=flat[:1] - np.uint64(1)))
    held = np.diff(np.append(edge, len(flat)))
    out = np.zeros((m, m), np.float32)
    heavy = np.flatnonzero(held >= DENSE)
    for at in range(0, len(heavy), COLUMNS):
        cols = heavy[at : at + COLUMNS]
        x = np.zeros((m, len(cols)), np.float32)
        where = np.concatenate([row[edge[c] : edge[c] + held[c]] for c in cols])
        x[where, np.repeat(np.arange(len(cols)), held[cols])] = 1
        out += x @ x.T
    upper = np.zeros(m * m, np.int64)
    for d in np.unique(held[(held > 1) & (held < DENSE)]).tolist():
        rows = row[edge[held == d][:, None] + np.arange(d)]
        for p in range(d):
            for q in range(p + 1, d):
                upper += np.bincount(rows[:, p] * m + rows[:, q], minlength=m * m) if m <= 256 else 0
                if m > 256:
                    np.add.at(upper, rows[:, p] * m + rows[:, q], 1)
    upper = upper.reshape(m, m)
    return np.rint(out).astype(np.int64) + upper + upper.T


def forest(ids: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Edges (document, least document) that connect what links connect within one block."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(ids) == 2:
        a, b = sizes
        if 5 * min(a, b) >= 4 * max(a, b):
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            if 100 * both >= 80 * (a + b - both) and ids[0] != ids[1]:
                yield int(ids.max()), int(ids.min())
        return
    both = overlaps(sets)
    total = sizes[:, None] + sizes[None, :]
    # 100 i >= 80 (a + b - i), which no pair of too different sizes reaches
    linked = 180 * both >= 80 * total
    label = ids.copy()
    while True:
        new = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1)
        new = np.minimum(new, label)
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(label != ids):
        yield int(ids[i]), int(label[i])


def _linked(rows: DataFrame) -> DataFrame:
    """Edges a, b out of (block, x, y, doc_id, text) rows; a block's rows stand together."""

    def run(batches):
        key, ids, sets = None, [], []

        def done():
            if len(ids) > 1:
                yield from forest(np.array(ids, np.int64), sets)

        for b in batches:
            out = []
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            docs = W.ids(b.column(3)).tolist()
            for k, d, s in zip(keys, docs, W.shingle_sets(b.column(4)), strict=True):
                if k != key:
                    out += done()
                    key, ids, sets = k, [], []
                ids.append(d)
                sets.append(s)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
        out = list(done())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return rows.repartition("block", "x", "y").sortWithinPartitions("block", "x", "y").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (block, x, y, doc_id) with their texts."""
    members = members.distinct()
    side = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    return docs.join(side, "doc_id").select("block", "x", "y", "doc_id", "text")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the least id that links reach.

    Null, empty and wordless texts have no shingles and link with nothing; a text of one to four
    words has one shingle. Rows with a null id link with nothing and have a null component; rows
    that repeat an id are one document. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = rows.where("doc_id is not null")
    profile = scratch.save(_profile(known))
    levels = spark.sparkContext.broadcast(_levels(profile))
    sizes = profile.where("part is null").select("doc_id", "n", "d1", "d2")
    sketches = profile.where("n > 0").select("doc_id", "n", "sketch")
    classes = scratch.save(sizes.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id")))

    def prefixes(batches):
        for b in batches:
            found = [prefix(s, levels.value) for s in W.shingle_sets(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([x for x, _ in found]), _lists([x for _, x in found])], names=["doc_id", "rare", "often"])

    chosen = classes.select(F.col("class_id").alias("doc_id")).distinct()
    starts = scratch.save(known.mapInArrow(prefixes, "doc_id long, rare array<long>, often array<long>").join(chosen, "doc_id", "left_semi"))
    rarely = _met_rarely(starts.select("doc_id", F.explode("rare").alias("gram")))
    met = scratch.save(rarely.unionByName(_met_often(starts.select("doc_id", F.explode("often").alias("gram")))).distinct())
    scratch.drop(starts)
    size_of = classes.groupBy(F.col("class_id").alias("doc_id")).agg(F.max("n").alias("n"))
    sized = met.join(size_of, "doc_id")
    blocks = sized.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
    chunks = F.greatest(F.ceil(F.col("m") / CHUNK_ROWS), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    blocks = scratch.save(blocks.select("block", chunks.alias("chunks")))
    dealt = met.join(blocks, "block")
    own = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("chunks") - 1)
    first = dealt.select("block", F.explode(F.when(F.col("doc_id") == F.col("block"), everywhere).otherwise(F.array(own))).alias("x"), F.lit(0).alias("y"), "doc_id")
    edges = scratch.save(_linked(_texts(known, scratch.save(_partnered(first.join(sketches, "doc_id"))))))
    parts = components(edges, scratch)
    # Second round: in blocks of several chunks, what is not connected to the leader meets every chunk.
    cut = dealt.where("chunks > 1")
    if cut.take(1):
        part_of = scratch.save(parts)
        c = cut.join(part_of.withColumnsRenamed({"node": "doc_id", "component": "c"}), "doc_id", "left").join(part_of.withColumnsRenamed({"node": "block", "component": "lc"}), "block", "left")
        c = scratch.save(c.select("block", "doc_id", "chunks", (F.coalesce("c", "doc_id") != F.coalesce("lc", "block")).alias("rest")))
        rests = c.where("rest").groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("rests"))
        c = c.join(rests, "block")
        every_rest = F.sequence(F.lit(0), F.col("rests") - 1)
        whole = c.select("block", own.alias("x"), F.explode(every_rest).alias("y"), "doc_id")
        rest = c.where("rest").select("block", F.explode(everywhere).alias("x"), F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.col("rests")).cast("int").alias("y"), "doc_id")
        both = whole.unionByName(rest).distinct()
        more = scratch.save(_linked(_texts(known, scratch.save(_partnered(both.join(sketches, "doc_id"))))))
        edges = edges.unionByName(more)
        parts = components(edges, scratch)
    parts = scratch.save(parts)
    out = sizes.join(classes, ["n", "d1", "d2"], "left").join(parts, F.col("class_id") == F.col("node"), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id", "doc_id").alias("component_id"))
    unknown = rows.where("doc_id is null").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), pa.array([len(s) for s in W.shingle_sets(b.column(1))], pa.int64()), pa.nulls(b.num_rows, pa.int64())], names=["doc_id", "n_shingles", "component_id"]) for b in batches), "doc_id long, n_shingles long, component_id long")
    return out.unionByName(unknown)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


by_value(__name__)
