"""Several groupings of one cube in one result."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import filters as fl
from tessera.operators import measures as ms
from tessera.plans.cube import Cube, CubeQuery


def rollup(*columns: str) -> list[tuple[str, ...]]:
    return [columns[:k] for k in range(len(columns), -1, -1)]


def cube(*columns: str) -> list[tuple[str, ...]]:
    return [c for k in range(len(columns), -1, -1) for c in combinations(columns, k)]


def grouping_sets(c: Cube, measures: Sequence[str], sets: Iterable[Sequence[str]], filter: fl.Filter = fl.ALL, markers: bool = False) -> DataFrame:
    """The measures at each grouping; columns that a grouping lacks are null, marked by ``grouping_<column>`` = 1.

    Where all measures are aggregators, the scan's rows are grouped once, to the union of all
    columns, and GROUPING SETS go over these few rows by merging states; else each grouping is a
    query of its own and the results are united.
    """
    sets = [tuple(s) for s in sets]
    every = tuple(dict.fromkeys(x for s in sets for x in s))
    q, _ = c.prepared(CubeQuery(tuple(measures), every, filter))
    planner = c.planner(q)
    nodes = [planner.node(m, q.filter, every, None) for m in measures]
    plain = all(isinstance(planner.resolve(m), ms.Aggregator) and not n.agg.opaque and not n.agg.ranked and n.agg.entries is None for m, n in zip(measures, nodes, strict=True)) and not hasattr(c.table, "states")
    if plain:
        df, columns = planner.states(every, nodes)
        # Spark's grouping sets as an explicit expansion of the pre-aggregated rows
        flags = [F.struct(*(F.lit(int(x not in s)).alias(x) for x in every)) for s in sets]
        df = df.withColumn("__set", F.explode(F.array(*flags)))
        keys = [F.when(F.col(f"__set.`{x}`") == 0, F.col(f"`{x}`")).alias(x) for x in every]
        marks = [F.col(f"__set.`{x}`").alias(f"grouping_{x}") for x in every]
        states = [s for n in nodes for s in columns[id(n)]]
        df = df.select(*keys, *marks, *states)
        merged = [m.alias(t) for n in nodes for m, t in zip(n.agg.merge([F.col(s) for s in columns[id(n)]]), columns[id(n)], strict=True)]
        out = df.groupBy(*(F.col(f"`{x}`") for x in every), *(F.col(f"`grouping_{x}`") for x in every)).agg(*merged)
        shown = [n.agg.final([F.col(s) for s in columns[id(n)]]).alias(m) for n, m in zip(nodes, measures, strict=True)]
    else:
        parts = []
        for s in sets:
            one = c.query(*measures, group_by=s, filter=filter)
            parts.append(one.select(*(F.col(f"`{x}`") if x in s else F.lit(None).alias(x) for x in every), *(F.lit(int(x not in s)).alias(f"grouping_{x}") for x in every), *(F.col(f"`{m}`") for m in measures)))
        out, shown = reduce(DataFrame.unionByName, parts), [F.col(f"`{m}`") for m in measures]
    return out.select(*(F.col(f"`{x}`") for x in every), *((F.col(f"`grouping_{x}`") for x in every) if markers else ()), *shown)
