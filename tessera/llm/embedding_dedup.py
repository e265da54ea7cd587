"""Embedding near-dedup by hierarchical navigable small-world graphs, one for each shard.

Equal vectors are one. The rest is dealt into shards; each shard's graph is built by itself; every
vector queries every shard. A beam begins narrow and is widened, for all queries of a task until a
recall audit against an exact scan of some of them passes (recall a query, without the query itself,
for queries of few links and of many apart; while links are too few to judge by, it goes on), and for a single query while its whole
beam lies above the threshold, ending in an exact scan of the shard, so that no number of partners
is a cap. Candidates are verified by cosine in double precision. A query's few links in a shard leave
a task as pairs, so that each counts for both its ends whichever found it; many leave it as their
number and as edges that connect what the links connect.

A graph is read once for a lane of queries, which stream past it in batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import Scratch, by_value, table
from tessera.llm.components import components

#: Shards at least, vectors of a shard at most, and their bytes.
SHARDS = 6
SHARD_ROWS = 500_000
SHARD_BYTES = 128 << 20
#: Queries of a lane at least (more where shards are large), and of one lockstep batch.
LANE_ROWS = 20_000
BATCH = 256
#: Links of a query in a shard up to which they are told as pairs.
PAIRS = 64
#: Marks of visited nodes that a query keeps, a power of two; a lost mark costs time only.
VISITED = 4096
#: Neighbours of a node on the upper layers (twice as many on the lowest), beam while building.
NEIGHBOURS = 12
BUILD_BEAM = 48
#: The first beam of a query, nodes that it expands at once, recall that must be reached.
BEAM = 16
EXPAND = 4
RECALL = 0.98
#: The audit draws queries until those of SMALL links at most have AUDIT_LINKS together, or AUDIT_MOST
#: are drawn and scanning for more would cost much beside a wide beam; with fewer links than that it
#: proves little, the first beam of the queries at hand is WIDE, and those that follow are drawn from too.
AUDIT_LINKS = 200
AUDIT_MOST = 2048
SMALL = 16
WIDE = 128
#: Comparisons of a scan that may be spent for one that a wide beam makes; those of a scan are some 27
#: times cheaper (12 and 330 ns with 64 dimensions), so this is about a third of the beam's time at most.
SCANNED = 8
#: Slack of single precision while searching.
SLACK = 1e-4


class Graph:
    """A navigable small-world graph over unit vectors (rows of ``x``, float32)."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray] | None = None, entry: int = 0, seed: int = 5):
        self.x, n = x, len(x)
        if links is not None:
            self.links, self.entry = links, entry
            return
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(NEIGHBOURS)).astype(int), 6)
        order = rng.permutation(n)
        top = int(level.max()) if n else 0
        self.links = [np.full((n, NEIGHBOURS * (2 if k == 0 else 1)), -1, np.int32) for k in range(top + 1)]
        self.entry, self.level_of_entry = (int(order[0]), int(level[order[0]])) if n else (0, 0)
        done = 1
        while done < n:
            batch = order[done : done + min(max(done, 16), BATCH)]
            self._insert(batch, level)
            done += len(batch)

    def _insert(self, batch: np.ndarray, level: np.ndarray) -> None:
        q = self.x[batch]
        at = np.full(len(batch), self.entry, np.int32)
        among = q @ q.T
        np.fill_diagonal(among, -2)
        for k in range(len(self.links) - 1, -1, -1):
            if k <= self.level_of_entry:
                at = self._greedy(q, at, k)
            mine = np.flatnonzero(level[batch] >= k)
            if not len(mine):
                continue
            if k <= self.level_of_entry:
                ids, sims = self.search(q[mine], BUILD_BEAM, at[mine], k)
            else:
                ids, sims = np.full((len(mine), 1), -1, np.int32), np.full((len(mine), 1), -2, np.float32)
            # the others of the batch on this layer, scanned
            near = min(16, len(mine))
            part = among[np.ix_(mine, mine)]
            best = np.argsort(-part, axis=1, kind="stable")[:, :near]
            ids = np.concatenate([ids, batch[mine][best]], 1).astype(np.int32)
            sims = np.concatenate([sims, np.take_along_axis(part, best, 1)], 1)
            ids[sims < -1.5] = -1
            chosen = self._choose(batch[mine], ids, sims, self.links[k].shape[1] if k else NEIGHBOURS)
            self.links[k][batch[mine], : chosen.shape[1]] = chosen
            self._backlinks(batch[mine], chosen, k)
        high = int(level[batch].max())
        if high > self.level_of_entry:
            self.entry, self.level_of_entry = int(batch[level[batch].argmax()]), high

    def _choose(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each node's candidates, nearest first, those nearer to it than to any chosen before; then the nearest others."""
        order = np.argsort(-np.where(ids < 0, -3, sims), axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        n, k = ids.shape
        v = self.x[np.maximum(ids, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        taken, rank = np.zeros((n, k), bool), np.full((n, k), 2 * k)
        count = np.zeros(n, int)
        worst = np.full((n, k), -2.0, np.float32)
        for j in range(k):
            ok = (ids[:, j] >= 0) & (worst[:, j] < sims[:, j]) & (count < most)
            taken[:, j] = ok
            rank[ok, j] = j
            count += ok
            worst = np.where(ok[:, None], np.maximum(worst, between[:, j, :]), worst)
        rest = (ids >= 0) & ~taken
        rank[rest] = (np.arange(k)[None, :] + k).repeat(n, 0)[rest]
        best = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, best, 1)
        out[np.take_along_axis(rank, best, 1) >= 2 * k] = -1
        return out

    def _backlinks(self, nodes: np.ndarray, chosen: np.ndarray, k: int) -> None:
        src, dst = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            return
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        target, first, count = np.unique(dst, return_index=True, return_counts=True)
        width = self.links[k].shape[1]
        slot = np.arange(len(dst)) - np.repeat(first, count)
        for at in range(0, int(count.max()), 32):
            part = (slot >= at) & (slot < at + 32)
            some, of = np.unique(np.repeat(np.arange(len(target)), count)[part], return_inverse=True)
            self._add_links(target[some], of, slot[part] - at, src[part], k)

    def _add_links(self, target: np.ndarray, of: np.ndarray, slot: np.ndarray, src: np.ndarray, k: int) -> None:
        """Link ``src`` from the targets that ``of`` numbers, at most 32 each; a full node keeps its best."""
        width = self.links[k].shape[1]
        new = np.full((len(target), int(slot.max()) + 1), -1, np.int32)
        new[of, slot] = src
        old = self.links[k][target]
        new[(new[:, :, None] == old[:, None, :]).any(2)] = -1
        ids = np.concatenate([old, new], 1)
        free = (ids >= 0).sum(1) <= width
        packed = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), 1)[:, :width]
        self.links[k][target[free]] = packed[free]
        full = np.flatnonzero(~free)
        if len(full):
            at = ids[full]
            sims = np.einsum("nkd,nd->nk", self.x[np.maximum(at, 0)], self.x[target[full]])
            self.links[k][target[full]] = -1
            kept = self._choose(target[full], at, sims.astype(np.float32), width)
            self.links[k][target[full], : kept.shape[1]] = kept

    def _greedy(self, q: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        at = at.copy()
        best = np.einsum("nd,nd->n", self.x[at], q)
        active = np.arange(len(q))
        while len(active):
            around = self.links[k][at[active]]
            sims = np.einsum("nkd,nd->nk", self.x[np.maximum(around, 0)], q[active])
            sims[around < 0] = -2
            j = sims.argmax(1)
            better = sims[np.arange(len(active)), j] > best[active]
            move = active[better]
            at[move], best[move] = around[better, j[better]], sims[better, j[better]]
            active = move
        return at

    def search(self, q: np.ndarray, beam: int, at: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the beam of each query, best first; -1 where a beam is not full."""
        n = len(q)
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -2, np.float32)
        ids[:, 0] = at
        sims[:, 0] = np.einsum("nd,nd->n", self.x[at], q)
        open_ = ids >= 0
        seen = np.full((n, VISITED), -1, np.int32)
        seen[np.arange(n), at & (VISITED - 1)] = at
        active = np.arange(n)
        width = self.links[k].shape[1]
        while len(active):
            o = open_[active]
            first = np.argsort(~o, axis=1, kind="stable")[:, :EXPAND]  # beams are sorted, so these are the best open ones
            valid = np.take_along_axis(o, first, 1)
            node = np.where(valid, np.take_along_axis(ids[active], first, 1), 0)
            np.put_along_axis(o, first, False, 1)
            around = np.where(valid[:, :, None], self.links[k][node], -1).reshape(len(active), -1)
            around = np.where(seen[active[:, None], around & (VISITED - 1)] == around, -1, around)
            around.sort(1)
            around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
            r, c = np.nonzero(around >= 0)
            # a node whose mark was lost may still be in the beam
            there = (ids[active[r]] == around[r, c][:, None]).any(1)
            around[r[there], c[there]] = -1
            r, c = r[~there], c[~there]
            seen[active[r], around[r, c] & (VISITED - 1)] = around[r, c]
            got = np.full((len(active), EXPAND * width), -2, np.float32)
            got[r, c] = np.einsum("nd,nd->n", self.x[around[r, c]], q[active[r]])
            all_ids = np.concatenate([ids[active], around], 1)
            all_sims = np.concatenate([sims[active], got], 1)
            all_open = np.concatenate([o, around >= 0], 1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[active] = np.take_along_axis(all_ids, order, 1)
            sims[active] = np.take_along_axis(all_sims, order, 1)
            open_[active] = np.take_along_axis(all_open, order, 1)
            active = active[open_[active].any(1)]
        ids[sims < -1.5] = -1
        return ids, sims

    def nearest(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(len(q), self.entry, np.int32)
        for k in range(len(self.links) - 1, 0, -1):
            at = self._greedy(q, at, k)
        return self.search(q, min(beam, len(self.x)), at)

    def within(self, q: np.ndarray, bound: float, beam: int) -> list[np.ndarray]:
        """For each query the nodes found above ``bound``; a beam that lies wholly above it is widened, at last to an exact scan."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        left = np.arange(len(q))
        while len(left):
            if beam > 512:
                for i in left:
                    out[i] = np.flatnonzero(self.x @ q[i] >= bound)
                break
            ids, sims = self.nearest(q[left], beam)
            hit = sims >= bound
            wide = hit.all(1) & (beam < len(self.x))
            for j in np.flatnonzero(~wide & hit.any(1)):
                out[left[j]] = np.sort(ids[j][hit[j]]).astype(np.int64)
            left, beam = left[wide], beam * 4
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Audit:
    """Of a lane's queries some that link, with what they link with in the shard by an exact scan."""

    def __init__(self, graph: Graph, unit: np.ndarray, ids: np.ndarray, threshold: float):
        self.graph, self.unit, self.ids, self.threshold = graph, unit, ids, threshold
        self.asked: list[np.ndarray] = []
        self.truth: list[np.ndarray] = []
        self.drawn = self.few = 0

    @property
    def proves(self) -> bool:
        """Whether enough links are known to judge a beam for queries that were not drawn."""
        return self.few >= AUDIT_LINKS

    def draw(self, q_ids: np.ndarray, q: np.ndarray) -> bool:
        """Scan for some of these queries, until there are enough links; whether all were drawn."""
        share = len(q) * WIDE * 2 * NEIGHBOURS * SCANNED // max(1, len(self.unit))
        drawn = np.random.default_rng(11).permutation(len(q))[: max(AUDIT_MOST - self.drawn, share)]
        for at in range(0, len(drawn), 64):
            if self.proves:
                return False
            some = drawn[at : at + 64]
            for i, near in zip(some.tolist(), (self.unit @ q[some].T >= self.threshold).T, strict=True):
                t = np.flatnonzero(near & (self.ids != q_ids[i]))
                # what further draws are for is few links
                if len(t) and (len(t) <= SMALL or self.drawn < AUDIT_MOST):
                    self.asked.append(q[i].astype(np.float32))
                    self.truth.append(t)
                    self.few += len(t) * (len(t) <= SMALL)
            self.drawn += len(some)
        return len(drawn) == len(q)

    def beam(self, q_ids: np.ndarray, q: np.ndarray) -> tuple[int, float]:
        """The first beam that finds enough of the links known by now, for these queries; the recall."""
        # where all queries were drawn, the audit is complete however few the links
        whole = self.draw(q_ids, q)
        beam, recall = BEAM if whole or self.proves else WIDE, 1.0
        small = np.array([len(t) <= SMALL for t in self.truth], bool)
        while self.truth:
            got = self.graph.within(np.stack(self.asked), self.threshold - SLACK, beam)
            each = np.array([len(np.intersect1d(t, g)) / len(t) for t, g in zip(self.truth, got, strict=True)])
            recall = min(float(each[x].mean()) for x in (small, ~small) if x.any())
            if recall >= RECALL or beam > 512:
                break
            beam *= 2
        return beam, recall


def linked(graph: Graph, unit: np.ndarray, q: np.ndarray, threshold: float, beam: int, ids: np.ndarray, q_ids: np.ndarray) -> list[np.ndarray]:
    """For each query the nodes that it links with, itself left out."""
    out = []
    single = q.astype(np.float32)
    for at in range(0, len(q), BATCH):
        for i, found in enumerate(graph.within(single[at : at + BATCH], threshold - SLACK, beam), at):
            found = found[unit[found] @ q[i] >= threshold] if len(found) else found
            out.append(found[ids[found] != q_ids[i]] if len(found) else found)
    return out


class Lane:
    """Queries against one shard's graph: told are few links as (a, b, weight of b, weight of a, home of a), many as (a, None, weight, None, None) and edges (a, b, 0, None, None)."""

    def __init__(self, graph: Graph, unit: np.ndarray, ids: np.ndarray, weights: np.ndarray, threshold: float):
        self.graph, self.unit, self.ids, self.weights, self.threshold = graph, unit, ids, weights, threshold
        self.label = np.arange(len(ids))
        self.waiting: list[tuple] = []
        self.audit: Audit | None = Audit(graph, unit, ids, threshold)
        self.beam: int | None = None
        self.recall = 1.0

    def ask(self, q_ids: np.ndarray, q_weights: np.ndarray, home: np.ndarray, q: np.ndarray) -> list[tuple]:
        """What is told of these queries, or of all so far once there are enough to audit."""
        self.waiting.append((q_ids, q_weights, home, q))
        return self.told() if self.audit is None or sum(len(w[0]) for w in self.waiting) >= AUDIT_MOST else []

    def end(self) -> list[tuple]:
        """A row without links that carries the audit's recall, also where nothing links."""
        return [(None, None, None, None, None)]

    def told(self) -> list[tuple]:
        if not self.waiting:
            return []
        q_ids, q_weights, home, q = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
        self.waiting = []
        if self.audit is not None:
            self.beam, recall = self.audit.beam(q_ids, q)
            self.recall = min(self.recall, recall)
            if self.audit.proves:
                self.audit = None  # the beam holds for the rest of the lane
        out: list[tuple] = []
        for a, w, h, found in zip(q_ids.tolist(), q_weights.tolist(), home.tolist(), linked(self.graph, self.unit, q, self.threshold, self.beam, self.ids, q_ids), strict=True):
            if len(found) <= PAIRS:
                out += [(a, b, n, w, h) for b, n in zip(self.ids[found].tolist(), self.weights[found].tolist(), strict=True)]
                continue
            out += [(a, None, int(self.weights[found].sum()), None, None), (a, int(self.ids[found[0]]), 0, None, None)]
            groups = np.unique(self.label[found])
            if len(groups) > 1:
                out += [(int(self.ids[groups[0]]), int(self.ids[g]), 0, None, None) for g in groups[1:]]
                self.label[np.isin(self.label, groups)] = groups[0]
        return out


def link(vectors: DataFrame, threshold: float = 0.95, shards: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector: vec_id, n_links, component_id and kept (whether it is the least of its component).

    Vectors that are null, zero or hold null, NaN or infinite components link with nothing (an
    empty one is zero); vectors of different lengths never link. Rows with a null id have no links
    and are kept, with a null component. Repeated rows are copies and link. Pairs at exactly the
    threshold link. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v"))
    sound = v.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    classes = scratch.save(rows.where("sound").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.min("v").alias("v")))
    sizes = classes.groupBy(F.size("v").alias("dim")).count().collect()
    shards = shards or max([SHARDS, *(-(-r["count"] // min(SHARD_ROWS, max(1, SHARD_BYTES // (4 * r["dim"])))) for r in sizes)])
    n = sum(r["count"] for r in sizes)
    lanes = max(1, n // max(LANE_ROWS, n // shards // 2))
    dealt = classes.select("id", "weight", "v", F.size("v").alias("dim"), F.pmod("h1", F.lit(shards)).cast("int").alias("shard"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x = np.stack(pdf["v"].to_numpy()).astype(np.float32)
        g = Graph(_unit(x).astype(np.float32))
        return pd.DataFrame({
            "dim": [x.shape[1]], "shard": [pdf["shard"].iloc[0]], "x": [x.tobytes()], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "weights": [pdf["weight"].to_numpy(np.int64).tobytes()],
            "links": [[k.tobytes() for k in g.links]], "entry": [g.entry],
        })

    graphs = scratch.save(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, x binary, ids binary, weights binary, links array<binary>, entry int"))
    columns = "dim int, lane int, no int, x binary, ids binary, weights binary, home binary"

    def pack(batches):
        """Queries as arrays, by their dimensions."""
        task = TaskContext.get().partitionId()
        for no, b in enumerate(batches):
            dims = b.column(3).to_numpy()
            rows = []
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                x = own.column(2).flatten().to_numpy().astype(np.float32)
                rows.append((int(dim), (task * 31 + no) % lanes, no + 1, x.tobytes(), *(own.column(i).to_numpy().astype(np.int64).tobytes() for i in (0, 1, 4))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < 3 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], names=["dim", "lane", "no", "x", "ids", "weights", "home"])

    asked = dealt.select("id", "weight", "v", "dim", F.col("shard").cast("long")).mapInArrow(pack, columns)
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(None).cast("array<binary>").alias("links"), F.lit(None).cast("int").alias("entry"))
    served = graphs.select("dim", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("no"), "x", "ids", "weights", F.lit(None).cast("binary").alias("home"), "shard", "links", "entry")

    def ask(batches):
        lane, of, shard = None, None, None

        def out(told):
            rows = [(*t, shard, lane.recall, lane.beam) for t in told]
            types = (*[pa.int64()] * 5, pa.int32(), pa.float64(), pa.int32())
            names = ["a", "b", "n", "m", "home", "shard", "recall", "beam"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names=names)

        for batch in batches:
            for r in range(batch.num_rows):
                dim, at, no, x, ids, weights, home, s, links, entry = (c[r] for c in batch.columns)
                key = (dim.as_py(), s.as_py(), at.as_py())
                if no.as_py() == 0:
                    if lane is not None:
                        yield out([*lane.told(), *lane.end()])
                    node_ids = np.frombuffer(ids.as_buffer(), np.int64)
                    unit = _unit(np.frombuffer(x.as_buffer(), np.float32).reshape(len(node_ids), -1))
                    graph = Graph(unit.astype(np.float32), [np.frombuffer(k.as_buffer(), np.int32).reshape(len(node_ids), -1) for k in links.values], entry.as_py())
                    lane, of, shard = Lane(graph, unit, node_ids, np.frombuffer(weights.as_buffer(), np.int64), threshold), key, key[1]
                elif key == of:  # otherwise the shard holds no vector of these dimensions
                    q = [np.frombuffer(c.as_buffer(), np.int64) for c in (ids, weights, home)]
                    told = lane.ask(*q, _unit(np.frombuffer(x.as_buffer(), np.float32).reshape(len(q[0]), -1)))
                    if told:
                        yield out(told)
        if lane is not None:
            yield out([*lane.told(), *lane.end()])

    met = served.unionByName(asked).select("dim", "lane", "no", "x", "ids", "weights", "home", "shard", "links", "entry")
    met = met.repartition("dim", "shard", "lane").sortWithinPartitions("dim", "shard", "lane", "no")
    found = scratch.save(met.mapInArrow(ask, "a long, b long, n long, m long, home long, shard int, recall double, beam int"))
    recall = found.agg(F.min("recall")).first()[0]
    if recall is not None and recall < RECALL:
        raise RuntimeError(f"an audit found a recall of {recall:.4f} at the widest beam; {RECALL} is asked for")
    # each pair for both its ends, but for an end that counted its links in the other's shard
    pairs = found.where("m is not null")
    ends = pairs.select("a", "b", "n", "shard").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("m").alias("n"), F.col("home").cast("int").alias("shard"))).dropDuplicates(["a", "b"])
    many = found.where("a is not null and b is null").select("a", "n", "shard")
    counts = ends.join(many, ["a", "shard"], "left_anti").select("a", "n").unionByName(many.select("a", "n")).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    parts = scratch.save(components(found.where("b is not null"), scratch))
    known = classes.join(counts, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.where("sound").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors of all embeddings."""
    return link(table(spark, sf_dir, "embeddings"))


by_value(__name__)
