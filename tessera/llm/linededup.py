"""Line dedup across documents: exact reference counts, sharded cuckoo filters, reversible.

The state is written tables. ``holdings`` has a row for each line key and document that holds it;
``counts`` has for each key how many documents hold it and the largest of them. Keys held by
enough documents are also in cuckoo filters, sharded by key; these tell which holdings may be
frequent before anything is shuffled for the exact join. Inserting and deleting documents updates
the counts of their keys alone, and the filters by keys that became or ceased to be frequent, so
lines come back.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import Scratch, by_value, small_batches, table

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys in a filter at most; more keys take more shards.
SHARD_KEYS = 500_000
#: Filters are broadcast up to so many bytes in all; beyond, holdings go to their shard's filter, in so many lanes.
BROADCAST_BYTES = 64 << 20
LANES = 16
#: Steps after which a store's tables are written anew.
COMPACT = 8


class Cuckoo:
    """A cuckoo filter: 4 fingerprints of 16 bits in a bucket; it deletes what it inserted."""

    def __init__(self, capacity: int, slots: np.ndarray | None = None):
        self.buckets = 1 << max(3, math.ceil(math.log2(max(1, capacity) / 3.4)))
        self.slots = np.zeros((self.buckets, 4), np.uint16) if slots is None else slots.copy()
        if slots is not None:
            self.buckets = len(slots)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = W.mix(np.asarray(keys).astype(np.uint64))
        mark = np.maximum(h >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        one = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (W.mix(mark.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        """Whether all went in; False asks for a larger filter."""
        rng = np.random.default_rng(1)
        for mark, one, two in zip(*self._places(keys), strict=True):
            at = int(one)
            for bucket in (int(one), int(two)):
                free = np.flatnonzero(self.slots[bucket] == 0)
                if len(free):
                    self.slots[bucket, free[0]] = mark
                    break
            else:
                for _ in range(500):
                    k = int(rng.integers(4))
                    mark, self.slots[at, k] = self.slots[at, k], mark
                    at = int(self._other(np.array([at]), np.array([mark], np.uint16))[0])
                    free = np.flatnonzero(self.slots[at] == 0)
                    if len(free):
                        self.slots[at, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted."""
        for mark, one, two in zip(*self._places(keys), strict=True):
            for bucket in (int(one), int(two)):
                found = np.flatnonzero(self.slots[bucket] == mark)
                if len(found):
                    self.slots[bucket, found[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return (self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1)

    @classmethod
    def of(cls, keys: np.ndarray) -> Cuckoo:
        size = len(keys)
        while not (out := cls(size)).insert(keys):
            size *= 2
        return out


def lines_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of all texts: first line of each text (n + 1), start and end byte of each, code points and two hashes of its key."""
    t = W._Tables.get(len(data) + 1)
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, offsets, "left")
    counts = np.diff(before) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    start[first[:-1]], end[first[1:] - 1] = offsets[:-1], offsets[1:]
    owner = np.searchsorted(offsets, breaks, "right") - 1
    line = np.arange(len(breaks)) + owner
    end[line], start[line + 1] = breaks, breaks + 1
    solid = ~t["space"][data] if n else np.zeros(0, bool)
    at = np.flatnonzero(solid)
    a, b = np.searchsorted(at, start), np.searchsorted(at, end)
    full = b > a
    at = np.append(at, 0)
    s, e = np.where(full, at[np.minimum(a, len(at) - 1)], 0), np.where(full, at[np.maximum(b, 1) - 1] + 1, 0)
    points = np.zeros(n + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    hashes = []
    for v in (t["value"], W.mix(t["value"])):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(v[data] * t["up"][:n], out=total[1:])
        hashes.append(W.mix((total[e] - total[s]) * t["down"][s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    return first, start, end, points[e] - points[s], hashes[0], hashes[1]


def holdings(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2 (a 128-bit key) and doc_id: once for each key of ``min_chars`` code points or more that a text holds."""

    def run(batches):
        for b in batches:
            ids = W.ids(b.column(0))
            for at, _, offsets, data in W.slices(b.column(1)):
                first, _, _, points, k1, k2 = lines_of(offsets, data)
                long = np.flatnonzero(points >= min_chars)
                doc = ids[at + np.searchsorted(first, long, "right") - 1]
                order = np.lexsort((k2[long], k1[long], doc))
                x = np.column_stack([k1[long].view(np.int64), k2[long].view(np.int64), doc])[order]
                new = np.ones(len(x), bool)
                new[1:] = (x[1:] != x[:-1]).any(1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in x[new].T.copy()], names=["k1", "k2", "doc_id"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "k1 long, k2 long, doc_id long")


def counted(held: DataFrame) -> DataFrame:
    """The exact reference counts: n_docs and keeper (the largest doc_id) of each key."""
    once = held.groupBy("k1", "k2", "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


def _filters(frequent: DataFrame) -> DataFrame:
    """shard, n_shards and slots: filters of the frequent keys, of SHARD_KEYS keys at most on average."""
    shards = max(1, -(-frequent.count() // SHARD_KEYS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        c = Cuckoo.of(pdf["k1"].to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n_shards": [shards], "slots": [c.slots.tobytes()]})

    sharded = frequent.select("k1", F.pmod(F.col("k2"), F.lit(shards)).cast("long").alias("shard"))
    return sharded.groupBy("shard").applyInPandas(build, "shard long, n_shards long, slots binary")


@dataclass
class LineStore:
    """The state of incremental line dedup.

    ``held`` are the holdings, ``counts`` the exact reference counts of all keys, ``filters`` the cuckoo
    filters of the frequent ones by shard. Inserting and deleting documents recounts only the keys
    of their lines, and puts into the filters or takes out of them only keys whose frequency crossed
    the bound; both leave the store as it was and return another. ``changed`` are the keys that the last step
    recounted. Every COMPACT steps the tables are written anew, so that reading stays as cheap.
    """

    scratch: Scratch
    held: DataFrame
    counts: DataFrame
    filters: DataFrame
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS
    steps: int = 0
    changed: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineStore:
        small_batches(docs.sparkSession)
        scratch = Scratch(docs.sparkSession, "lines")
        held = scratch.save(holdings(docs, min_chars), hashes=True)
        counts = scratch.save(counted(held), hashes=True)
        return cls(scratch, held, counts, scratch.save(_filters(counts.where(F.col("n_docs") >= min_docs))), min_chars, min_docs)

    @property
    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    def insert(self, docs: DataFrame) -> LineStore:
        """The state with more documents; an id that is there already gains the lines of the new text."""
        more = holdings(docs, self.min_chars).distinct().join(self.held, ["k1", "k2", "doc_id"], "left_anti")
        more = self.scratch.save(more.select("k1", "k2", "doc_id"), hashes=True)
        added = more.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("more"), F.max("doc_id").alias("largest"))
        now = added.join(self.counts, ["k1", "k2"], "left").select(
            "k1", "k2", F.coalesce("n_docs", F.lit(0)).alias("before"), (F.coalesce("n_docs", F.lit(0)) + F.col("more")).alias("n_docs"), F.greatest("keeper", "largest").alias("keeper")
        )
        return self._with(self.held.unionByName(more), self.scratch.save(now, hashes=True))

    def delete(self, ids: DataFrame) -> LineStore:
        """The state without the documents whose ids the first column of ``ids`` has."""
        gone = self.scratch.save(ids.select(F.col(ids.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct())
        kept = self.held.join(gone, "doc_id", "left_anti").select("k1", "k2", "doc_id")
        keys = self.scratch.save(self.held.join(gone, "doc_id", "left_semi").select("k1", "k2").distinct(), hashes=True)
        left = counted(kept.join(keys, ["k1", "k2"], "left_semi"))
        now = keys.join(self.counts.select("k1", "k2", F.col("n_docs").alias("before")), ["k1", "k2"]).join(left, ["k1", "k2"], "left")
        return self._with(kept, self.scratch.save(now.select("k1", "k2", "before", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), "keeper"), hashes=True))

    def _with(self, held: DataFrame, now: DataFrame) -> LineStore:
        """The state of these holdings, with new counts for some keys (k1, k2, before, n_docs, keeper)."""
        same = self.counts.join(now, ["k1", "k2"], "left_anti")
        counts = same.unionByName(now.where("n_docs > 0").select("k1", "k2", "n_docs", "keeper"))
        if (self.steps + 1) % COMPACT == 0:
            held, counts = self.scratch.save(held, hashes=True), self.scratch.save(counts, hashes=True)
        was, is_ = F.col("before") >= self.min_docs, F.col("n_docs") >= self.min_docs
        crossed = now.where(was != is_).select("k1", "k2", is_.alias("up"))
        return LineStore(self.scratch, held, counts, self._refiltered(crossed, counts), self.min_chars, self.min_docs, self.steps + 1, now)

    def _refiltered(self, crossed: DataFrame, counts: DataFrame) -> DataFrame:
        """The filters with keys put in and taken out; all anew where one is full."""
        n = self.filters.agg(F.max("n_shards")).first()[0]
        changes = crossed.select("k1", "up", F.pmod(F.col("k2"), F.lit(n or 1)).cast("long").alias("shard"))
        if not n:
            return self.scratch.save(_filters(counts.where(F.col("n_docs") >= self.min_docs)))

        def update(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            if not len(new):
                return old
            out, in_ = (new["k1"][new["up"] == x].to_numpy().view(np.uint64) for x in (False, True))
            c = Cuckoo(2 * len(in_), np.frombuffer(old["slots"].iloc[0], np.uint16).reshape(-1, 4) if len(old) else None)
            c.delete(out)
            ok = c.insert(in_)
            return pd.DataFrame({"shard": [new["shard"].iloc[0]], "n_shards": [n], "slots": [c.slots.tobytes() if ok else None]})

        made = self.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(update, "shard long, n_shards long, slots binary")
        made = self.scratch.save(made)
        return made if not made.where("slots is null").take(1) else self.scratch.save(_filters(counts.where(F.col("n_docs") >= self.min_docs)))

    def candidates(self) -> DataFrame:
        """The holdings whose key passes its shard's filter: all frequent ones, and few others.

        Filters are broadcast while they are small; beyond, each meets the holdings of its shard.
        """
        size, n = self.filters.agg(F.coalesce(F.sum(F.octet_length("slots")), F.lit(0)), F.max("n_shards")).first()
        if size > BROADCAST_BYTES:
            return self._met_by_shard(n)
        found = {r["shard"]: r["slots"] for r in self.filters.collect()}
        shared = self.held.sparkSession.sparkContext.broadcast(found)

        def run(batches):
            filters = {k: Cuckoo(0, np.frombuffer(s, np.uint16).reshape(-1, 4)) for k, s in shared.value.items()}
            for b in batches:
                k1, k2 = W.ids(b.column(0)), W.ids(b.column(1))
                keep = np.zeros(b.num_rows, bool)
                for shard, c in filters.items():
                    at = np.flatnonzero(np.mod(k2, n) == shard)
                    keep[at] = c.contains(k1[at].view(np.uint64))
                yield b.filter(pa.array(keep))

        return self.held.mapInArrow(run, self.held.schema)

    def _met_by_shard(self, n: int) -> DataFrame:
        """Each shard's filter, and behind it the holdings of its keys, in one stream.

        A key's holdings are dealt over LANES copies of its filter, so that a key that most documents hold is no task of its own.
        """
        none = F.lit(None)
        filters = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane"), none.cast("long").alias("k1"), none.cast("long").alias("k2"), none.cast("long").alias("doc_id"), "slots")
        rows = self.held.select(F.pmod(F.col("k2"), F.lit(n)).cast("long").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(LANES)).cast("int").alias("lane"), "k1", "k2", "doc_id", none.cast("binary").alias("slots"))

        def run(batches):
            key, now = None, None
            for b in batches:
                here = np.stack([W.ids(b.column(0)), W.ids(b.column(1))])
                is_filter = b.column(5).is_valid().to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(np.append(True, (np.diff(here) != 0).any(0) | is_filter[1:]))
                keep = np.zeros(b.num_rows, bool)
                for at, end in zip(edges.tolist(), [*edges[1:].tolist(), b.num_rows], strict=True):
                    if is_filter[at]:
                        key, now = tuple(here[:, at]), Cuckoo(0, np.frombuffer(b.column(5)[at].as_buffer(), np.uint16).reshape(-1, 4))
                        at += 1
                    if at < end and tuple(here[:, at]) == key:
                        keep[at:end] = now.contains(W.ids(b.column(2).slice(at, end - at)).view(np.uint64))
                if keep.any():
                    yield b.select(["k1", "k2", "doc_id"]).filter(pa.array(keep))

        met = filters.unionByName(rows).repartition("shard", "lane").sortWithinPartitions(F.col("shard"), F.col("lane"), F.col("slots").isNull())
        return met.mapInArrow(run, "k1 long, k2 long, doc_id long")

    def drops(self) -> DataFrame:
        """doc_id and the keys whose lines it loses."""
        hits = self.candidates().join(self.frequent, ["k1", "k2"]).where("doc_id <> keeper")
        return hits.groupBy("doc_id").agg(F.collect_set("k1").alias("__keys"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` with their text without the dropped lines, and n_lines and n_dropped.

        A document's lines go where their key is frequent and another document is its keeper; all
        its lines with the key stay in the keeper. Null and empty texts are one empty line; rows
        with a null id hold and lose nothing; rows that repeat an id are one document. An empty table
        gives an empty result; a long text is split whole. Input columns named n_lines or n_dropped
        are replaced.
        """
        min_chars = self.min_chars
        rows = docs.drop("n_lines", "n_dropped", "__keys")
        drops = self.drops().withColumnRenamed("doc_id", "__doc")
        both = rows.join(drops, F.col(f"`{id_col}`").cast("long") == F.col("__doc"), "left").drop("__doc")
        out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "n_lines long", "n_dropped long"])

        def run(batches):
            for b in batches:
                names = b.schema.names
                text_at, keys_at = names.index(text_col), names.index("__keys")
                texts, keys, out = b.column(text_at), b.column(keys_at), []
                n_lines, n_dropped = np.ones(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
                for at, _, offsets, data in W.slices(texts):
                    first, start, end, points, k1, _ = lines_of(offsets, data)
                    raw = data.tobytes()
                    for i in range(len(offsets) - 1):
                        a, z = int(first[i]), int(first[i + 1])
                        n_lines[at + i] = z - a
                        if keys[at + i].is_valid:
                            gone = np.isin(k1[a:z].view(np.int64), np.array(keys[at + i].as_py(), np.int64)) & (points[a:z] >= min_chars)
                            n_dropped[at + i] = gone.sum()
                            out.append(b"\n".join(raw[start[j] : end[j]] for j in range(a, z) if not gone[j - a]))
                        else:
                            out.append(raw[offsets[i] : offsets[i + 1]])
                columns = {n: c for n, c in zip(names, b.columns, strict=True)}
                columns[text_col] = pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(texts.type)
                columns |= {"n_lines": pa.array(n_lines), "n_dropped": pa.array(n_dropped)}
                del columns["__keys"]
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return both.mapInArrow(run, out_schema)


def op7_cuckoo_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that five or more of them hold, but for the keeper's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = LineStore.build(docs).apply(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, n, line, CASE WHEN length(k) >= 40 THEN translate(k, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS key
  FROM (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS line,
               regexp_replace(regexp_replace(unnest(ls), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS k
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
f AS (SELECT key, max(doc_id) AS keeper FROM l WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE keeper IS NULL OR keeper = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN f USING (key) GROUP BY l.doc_id
"""

by_value(__name__)
