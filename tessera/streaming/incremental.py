"""Incremental leaves: the aggregation states of a stream's rows by time window, merged on reading.

The measures of a cube are bounded queries; this lets their leaves be kept up to date from an
unbounded source. Each micro-batch is reduced to state columns by window and grouping, with a
watermark that bounds what is kept; a reader merges the states of any windows into values.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import filters as fl
from tessera.operators.aggregations import aggregation
from tessera.operators.measures import Aggregator


def states(rows: DataFrame, measures: Sequence[Aggregator], group_by: Iterable[str], time: str, window: str, late: str | None = None) -> DataFrame:
    """window_start, the grouping columns and each measure's state columns, of a stream or a bounded frame."""
    rows = rows.withColumn(time, F.col(f"`{time}`").cast("timestamp"))
    if late is not None:
        rows = rows.withWatermark(time, late)
    made = []
    for m in measures:
        agg = aggregation(m.aggregation, dict(m.options))
        if agg.opaque or agg.ranked:
            raise ValueError(f"{m.name} has no state that merges in a stream")
        c = F.lit(1) if m.source == "*" else F.col(f"`{m.source}`")
        if m.filter != fl.ALL:
            c = F.when(m.filter.on(lambda x: F.col(f"`{x}`") if x in rows.columns else None), c)
        made += [s.alias(f"{m.name}#{i}") for i, s in enumerate(agg.states(c))]
    out = rows.groupBy(F.window(time, window).alias("__window"), *(F.col(f"`{g}`") for g in group_by)).agg(*made)
    return out.select(F.col("__window.start").alias("window_start"), *(F.col(f"`{c}`") for c in out.columns if c != "__window"))


def values(kept: DataFrame, measures: Sequence[Aggregator], group_by: Iterable[str]) -> DataFrame:
    """The measures at a grouping (``window_start`` may be part of it), out of states of any number of windows."""
    merged, shown = [], []
    for m in measures:
        agg = aggregation(m.aggregation, dict(m.options))
        names = [f"{m.name}#{i}" for i in range(agg.size)]
        merged += [s.alias(n) for s, n in zip(agg.merge([F.col(f"`{n}`") for n in names]), names, strict=True)]
        shown.append(agg.final([F.col(f"`{n}`") for n in names]).alias(m.name))
    group_by = list(group_by)
    return kept.groupBy(*(F.col(f"`{g}`") for g in group_by)).agg(*merged).select(*(F.col(f"`{g}`") for g in group_by), *shown)
