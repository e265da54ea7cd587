"""Quality classifier: a sparse rule ensemble over statistics of the text.

Small boosted trees are grown over the statistics of a bounded sample of labelled rows; every path
to a node is a conjunctive rule; a lasso logistic regression over the rules keeps a few of them;
these are compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import by_value, held_out, small_batches, table

STATS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "pipes", "marks", "other_symbols", "non_ascii",
    "letterless", "stops", "short_words", "distinct_words", "distinct_pairs", "distinct_fives", "top_word", "repeats", "lines", "line_repeats", "line_words",
)
#: The prefix of the statistics' columns beside the columns of a table.
PREFIX = "__stat_"
#: Labelled rows that are fitted at most: those with the smallest hash of their id.
MAX_ROWS = 20_000


def _classes() -> np.ndarray:
    """For each byte a mask of: A-Z, a-z, 0-9, |, !?, other ASCII symbols, ASCII punctuation, beyond ASCII (lead bytes)."""
    out = np.zeros(256, np.uint8)
    for c in range(256):
        s = chr(c)
        if c >= 0xC0:
            out[c] = 128
        elif c >= 128 or c <= 32:
            out[c] = 0
        elif "A" <= s <= "Z":
            out[c] = 1
        elif "a" <= s <= "z":
            out[c] = 2
        elif s.isdigit():
            out[c] = 4
        elif s == "|":
            out[c] = 8
        elif s in "!?":
            out[c] = 16
        elif s in ".,;:'\"-()":
            out[c] = 64
        else:
            out[c] = 32
    return out


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[at])


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATS for each whole text; null and empty texts have all statistics 0."""
    classes, parts = _classes(), []
    for _, _, offsets, data in W.slices(texts):
        n = len(offsets) - 1
        h, first, start, end = W.words_of(offsets, data)
        kind = classes[data]
        size, count = np.diff(offsets), np.diff(first)
        by = {k: _per_text((kind & k) > 0, offsets) for k in (1, 2, 4, 8, 16, 32, 128)}
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum((kind & (1 | 2 | 128)) > 0, out=letters[1:])
        letterless = _per_text(letters[end] == letters[start], first)
        stops = _per_text(data[end - 1] == 46, first) if len(end) else np.zeros(n, np.int64)
        short = _per_text(end - start <= 3, first)
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[first[:-1][count > 0]] = False
        repeats = _per_text(same, first)
        pairs = h.copy()
        pairs[:-1] += W.mix(h[1:])
        fives, fives_first = W.shingles_of(h, first)
        breaks = np.flatnonzero(data == 10)
        line_no = np.searchsorted(breaks, start)
        line = np.zeros(n)
        line_repeats = np.zeros(n)
        unique = np.zeros((n, 4))
        for i in range(n):
            a, b = int(first[i]), int(first[i + 1])
            if a == b:
                continue
            _, counts = np.unique(h[a:b], return_counts=True)
            unique[i, 0], unique[i, 3] = len(counts), counts.max()
            unique[i, 1] = len(np.unique(pairs[a : b - 1])) if b - a > 1 else 1
            unique[i, 2] = len(np.unique(fives[fives_first[i] : fives_first[i + 1]]))
            starts = np.flatnonzero(np.diff(line_no[a:b], prepend=-1))
            line[i] = len(starts)
            if len(starts) > 1:
                line_repeats[i] = 1 - len(np.unique(np.add.reduceat(pairs[a:b], starts))) / len(starts)
        d, m = np.maximum(size, 1), np.maximum(count, 1)
        alpha = np.maximum(by[1] + by[2], 1)
        n_fives = np.maximum(np.diff(fives_first), 1)
        parts.append(
            np.column_stack([
                np.log1p(size), np.log1p(count), (size - count) / m, by[1] / alpha, by[4] / d, (by[8] + by[16] + by[32]) / d, by[8] / d, by[16] / d, by[32] / d, by[128] / d,
                letterless / m, stops / m, short / m, unique[:, 0] / m, unique[:, 1] / np.maximum(count - 1, 1), unique[:, 2] / n_fives, unique[:, 3] / m, repeats / m, line / m, line_repeats, count / np.maximum(line, 1),
            ]) * (count > 0)[:, None]
        )
    return np.vstack(parts) if parts else np.zeros((0, len(STATS)))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a double column for each statistic, named PREFIX and its name."""
    small_batches(docs.sparkSession)
    names = [PREFIX + s for s in STATS]
    kept = docs.drop(*names)

    def run(batches):
        for b in batches:
            x = statistics(b.column(b.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x[:, i]) for i in range(len(names)))], names=[*b.schema.names, *names])

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), *(f"`{n}` double" for n in names)]))


@dataclass(frozen=True)
class Rules:
    """Conjunctions of (statistic, above, bound) with their weights."""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]

    def column(self) -> Column:
        """The score, 0 to 1, over the columns of ``with_statistics``."""
        z = F.lit(self.bias)
        for weight, terms in self.rules:
            hit = None
            for stat, above, bound in terms:
                c = F.col(PREFIX + stat)
                one = c > F.lit(bound) if above else c <= F.lit(bound)
                hit = one if hit is None else hit & one
            z = z + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, path: tuple, rules: list, out: np.ndarray) -> None:
    """Grow one tree on binned statistics; each node's path is a rule."""
    g, h = grad[rows].sum(), hess[rows].sum()
    out[rows] = g / (h + 1.0)
    if depth == 0 or len(rows) < 20:
        return
    best, found = 1e-3, None
    for f in features:
        b = bins[rows, f]
        cg, ch = np.cumsum(np.bincount(b, grad[rows], 64))[:-1], np.cumsum(np.bincount(b, hess[rows], 64))[:-1]
        n = np.cumsum(np.bincount(b, minlength=64))[:-1]
        gain = cg**2 / (ch + 1) + (g - cg) ** 2 / (h - ch + 1) - g**2 / (h + 1)
        gain[(n < 8) | (n > len(rows) - 8)] = 0
        at = int(gain.argmax())
        if gain[at] > best:
            best, found = gain[at], (int(f), at)
    if found is None:
        return
    f, at = found
    left = bins[rows, f] <= at
    for above, part in ((False, rows[left]), (True, rows[~left])):
        deeper = (*path, (f, above, at))
        rules.append(deeper)
        _tree(bins, grad, hess, part, features, depth - 1, deeper, rules, out)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 200) -> tuple[np.ndarray, float]:
    """L1 logistic regression by accelerated proximal gradient steps; the bias is not penalised."""
    n, m = x.shape
    step = 4.0 / (np.linalg.norm(x.T @ x / n, 2) + 1)
    w, b, v, c, t = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(m), 0.0, 1.0
    c = b
    for _ in range(steps):
        # in single precision, as the rules' hits are: no copy of them in double
        r = _sigmoid((x @ v.astype(np.float32)).astype(float) + c) - y
        new = v - step * ((x.T @ r.astype(np.float32)).astype(float) / n)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        bias = c - step * r.mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / s * (new - w), bias + (t - 1) / s * (bias - b)
        w, b, t = new, bias, s
    return w, b


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 1e-3, seed: int = 7) -> Rules:
    """Grow trees, turn their paths into rules, keep those with a lasso weight.

    With no rows the score is 0.5, with one class only its smoothed share.
    """
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Rules(float(np.log(share / (1 - share))), ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(x.shape[1])])
    z, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = _sigmoid(z)
        rows = np.sort(rng.choice(len(y), max(1, int(len(y) * 0.6)), replace=False))
        features = np.sort(rng.choice(x.shape[1], max(3, x.shape[1] // 2), replace=False))
        out = np.zeros(len(y))
        found: list = []
        _tree(bins, y - p, p * (1 - p) + 1e-6, rows, features, depth, (), found, out)
        z += 0.3 * out
        paths += found
    paths = [q for q in dict.fromkeys(tuple(sorted(p)) for p in paths) if all(a < len(cuts[f]) for f, _, a in q)]
    hits = np.column_stack([np.logical_and.reduce([(bins[:, f] > a) if above else (bins[:, f] <= a) for f, above, a in p]) for p in paths]).astype(np.float32)
    _, first = np.unique(np.packbits(hits > 0, axis=0), axis=1, return_index=True)
    first = np.sort(first)
    hits, paths = hits[:, first], [paths[i] for i in first]
    w, b = _lasso(hits, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return Rules(float(b), tuple((float(w[i]), tuple((STATS[f], above, float(cuts[f][a])) for f, above, a in paths[i])) for i in kept))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5) -> Rules:
    """Fit on at most ``max_rows`` labelled documents outside fold 0.

    The sample is the labelled ids with the smallest hashes, so its size is bounded whatever the
    input; an id with several labels has the lowest, one with several texts the least of them; null
    labels and null ids are left out. No labels give a score of 0.5 everywhere.
    """
    label = F.min((F.col(label_col) >= 1).cast("int")).alias("__label")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col), folds)).groupBy(F.col(id_col).alias("__id")).agg(label)
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    rows = rows.groupBy("__id").agg(F.min("__label").alias("__label"), F.min("__text").alias("__text"))
    found = with_statistics(rows, "__text").select("__label", *(PREFIX + s for s in STATS)).toPandas().to_numpy(dtype=float)
    found = found[np.lexsort(found.T)]  # rows come in any order; the fit must not
    return fit(found[:, 1:], found[:, 0])


def score(docs: DataFrame, rules: Rules, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted (1 if score >= threshold); input columns so named are replaced.

    Null, empty and wordless texts have statistics of 0 and the score that the rules give these. Null
    and repeated ids are rows like others, equal texts have equal scores, long texts are read whole;
    an empty table gives an empty result.
    """
    kept = docs.drop("score", "predicted")
    out = with_statistics(kept, text_col).withColumn("score", rules.column())
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(*(PREFIX + s for s in STATS))


def op1_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learnt from four of five labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, rules).select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", "predicted")


by_value(__name__)
