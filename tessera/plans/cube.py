"""Cubes: a table and a forest of measures that answer queries; composites of cubes; a registry."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import filters as fl
from tessera.operators import measures as ms
from tessera.operators.aggregations import aggregation
from tessera.plans.forest import Forest
from tessera.plans.planner import Leaf, Planner
from tessera.sources.tables import SqlColumn, Table

#: The virtual column of a composite that has the name of the cube a row comes from.
SLICER = "~CompositeSlicer"
#: Options that change results; Spark decides by itself what others ask for (CONCURRENT, SEQUENTIAL, BLOCKING, NON_BLOCKING, PARTITIONED, INDUCE_BY_*).
OPTIONS = frozenset("UNKNOWN_MEASURES_ARE_EMPTY EXCEPTIONS_AS_MEASURE_VALUE EXPLAIN DEBUG DRILLTHROUGH NO_CACHE AGGREGATION_CARRIERS_STAY_WRAPPED CONCURRENT SEQUENTIAL BLOCKING NON_BLOCKING PARTITIONED INDUCE_BY_TABLE INDUCE_BY_ENGINE".split())


@dataclass(frozen=True)
class Top:
    """The first rows by some columns of the result."""

    columns: tuple[str, ...]
    limit: int
    descending: bool = True


@dataclass(frozen=True)
class CubeQuery:
    """Measures at a grouping (default: the grand total) under a filter (default: all)."""

    measures: tuple[Any, ...] = ()
    group_by: tuple[Any, ...] = ()
    filter: fl.Filter = fl.ALL
    marker: Any = None
    options: frozenset[str] = frozenset()
    top: Top | None = None


@dataclass
class Cube:
    """A table with measures.

    ``implicit_filter`` (a function of the query) is added to every query, as row-level security
    is; ``implicit_options`` likewise; ``case_insensitive`` lets names of columns differ in case.
    With ``cache`` (``persist`` of what a query returns, by query) repeated queries read memory, the
    last ``cache_size`` of them.
    """

    name: str
    table: Any
    forest: Forest = field(default_factory=Forest)
    implicit_filter: Callable[[CubeQuery], fl.Filter] | None = None
    implicit_options: frozenset[str] = frozenset()
    case_insensitive: bool = False
    cache: bool = False
    cache_size: int = 64
    tags: frozenset[str] = frozenset()
    explained: list[str] = field(default_factory=list)
    _cached: dict = field(default_factory=dict)

    # --- queries ---------------------------------------------------------------------------------

    def query(self, *measures: Any, group_by: Iterable[Any] = (), filter: fl.Filter = fl.ALL, marker: Any = None, options: Iterable[str] = (), top: Top | None = None) -> DataFrame:
        """Shorthand for ``execute``."""
        group = (group_by,) if isinstance(group_by, str) else tuple(group_by)
        return self.execute(CubeQuery(tuple(measures), group, filter, marker, frozenset(options), top))

    def execute(self, q: CubeQuery) -> DataFrame:
        """The result as a lazy frame: the grouping columns, then a column for each measure.

        A slice is there if some measure has a value for it; without measures all slices are. A
        grand total is one row, also over no rows.
        """
        q, names = self.prepared(q)
        if "DRILLTHROUGH" in q.options:
            return self._rows_behind(q)
        key = q if self.cache and "NO_CACHE" not in q.options and self._hashable(q) else None
        if key in self._cached:
            return self._cached[key]
        planner = self.planner(q)
        g = tuple(planner.name_of(c) for c in q.group_by)
        if "AGGREGATION_CARRIERS_STAY_WRAPPED" in q.options:
            return self.carriers(planner, q, g)
        out, _ = planner.compile(list(q.measures), q.filter, g, q.marker)
        out = out.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in out.columns))
        if q.top is not None:
            order = [F.col(f"`{c}`").desc_nulls_last() if q.top.descending else F.col(f"`{c}`").asc_nulls_last() for c in q.top.columns]
            out = out.orderBy(*order).limit(q.top.limit)
        if q.options & {"EXPLAIN", "DEBUG"}:
            self.explained = planner.log
            for line in planner.log:
                print(f"[EXPLAIN] {self.name}: {line}")
            out.explain("formatted" if "DEBUG" in q.options else "simple")
        if key is not None:
            out = self._cached[key] = out.persist()
            while len(self._cached) > self.cache_size:
                self._cached.pop(next(iter(self._cached))).unpersist()
        return out

    @staticmethod
    def _hashable(q: CubeQuery) -> bool:
        try:
            hash(q)
        except TypeError:
            return False
        return True

    def carriers(self, planner: Planner, q: CubeQuery, g: tuple[str, ...]) -> DataFrame:
        """The states of aggregators in place of their values, as ``name#0``, ``name#1``, ...; others as values."""
        nodes = {(m if isinstance(m, str) else m.name): planner.node(m, q.filter, g, q.marker) for m in q.measures}
        wrapped = {m: n for m, n in nodes.items() if isinstance(n, Leaf) and not n.agg.opaque and not n.empty}
        if len(wrapped) < len(nodes):
            raise ValueError(f"no state to give for {sorted(set(nodes) - set(wrapped))}")
        own = hasattr(planner.table, "states")
        df, columns = (planner.table if own else planner).states(*([planner] if own else []), g, list(wrapped.values()))
        return df.select(*(F.col(f"`{c}`") for c in g), *(F.col(c).alias(f"{m}#{i}") for m, n in wrapped.items() for i, c in enumerate(columns[id(n)])))

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the cube under its name.

        Without measures the cube is its table's visible rows, with only the joins of the columns that
        the text speaks of. With ``MEASURE(name)`` the text is one SELECT of measures and columns, with
        WHERE on rows, GROUP BY columns, and HAVING, ORDER BY and LIMIT on the result.
        """
        if re.search(r"\bmeasure\s*\(", text, re.I):
            return self._sql_of_measures(text)
        known = [c for c in self.table.columns()] if re.search(r"(?:select|,|\.)\s*\*", text, re.I) else self.table.in_sql(text)
        self.visible(known).createOrReplaceTempView(self.name)
        return self.spark.sql(text)

    def _sql_of_measures(self, text: str) -> DataFrame:
        form = r"\s*select\s+(?P<items>.+?)\s+from\s+`?(?P<cube>[\w.]+)`?(?:\s+where\s+(?P<where>.+?))?(?:\s+group\s+by\s+(?P<group>.+?))?(?P<rest>\s+(?:having|order\s+by|limit)\b.*)?\s*;?\s*"
        m = re.fullmatch(form, text, re.I | re.S)
        if m is None or m["cube"] != self.name:
            raise ValueError(f"no SELECT of measures FROM {self.name}: {text}")
        call = re.compile(r"\bmeasure\s*\(\s*(?:`([^`]+)`|([^()`]+?))\s*\)", re.I)
        names = tuple(dict.fromkeys(a or b for a, b in call.findall(m["items"] + (m["rest"] or ""))))
        group = tuple(c.strip().strip("`") for c in m["group"].split(",")) if m["group"] else ()
        cube, condition = self, fl.ALL
        if m["where"]:
            if not isinstance(self.table, Table):
                raise ValueError("WHERE needs a cube over a table")
            cube = replace(self, table=self.table.with_column(SqlColumn("__where", m["where"])), cache=False)
            condition = fl.where("__where", True)
        view = f"{self.name}_{uuid.uuid4().hex}"
        cube.query(*names, group_by=group, filter=condition).createOrReplaceTempView(view)
        shown = call.sub(lambda c: f"`{c[1] or c[2]}`", m["items"])
        rest = re.sub(r"^\s*having\b", " WHERE", call.sub(lambda c: f"`{c[1] or c[2]}`", m["rest"] or ""), flags=re.I)
        return self.spark.sql(f"SELECT {shown} FROM {view} {rest}")

    def visible(self, names: Iterable[str], q: CubeQuery | None = None) -> DataFrame:
        """Columns of the table's rows that the cube's implicit filter lets pass."""
        names, q = list(dict.fromkeys(names)), q or CubeQuery()
        f = fl.ALL if self.implicit_filter is None else self.implicit_filter(q)
        t = replace(self.table, query=q) if isinstance(self.table, Composite) else self.table
        if f == fl.ALL:
            return t.frame(names)
        df = t.frame([*names, *(c for c in sorted(f.columns()) if t.has(c) and c not in names)])
        return df.where(f.on(lambda c: F.col(f"`{c}`") if t.has(c) else None)).select(*(F.col(f"`{c}`") for c in names))

    def statistics(self, column: str, top: int = 100) -> DataFrame:
        """About how many values a column has, and its most frequent ones with their counts, in one pass."""
        df = self.visible([column]).select(F.col(f"`{column}`").alias("c"))
        return df.agg(F.approx_count_distinct("c").alias("cardinality"), F.expr(f"approx_top_k(c, {int(top)})").alias("top"))

    def execute_async(self, q: CubeQuery, consume: Callable[[DataFrame], Any] = lambda df: df.toPandas()) -> tuple[str, Any]:
        """Run a query and what consumes it in a thread of its own: an id for ``cancel``, and a future."""
        from concurrent.futures import ThreadPoolExecutor

        group = f"tessera-{uuid.uuid4().hex}"
        pool = ThreadPoolExecutor(1)

        def work():
            sc = self.spark.sparkContext
            sc.setJobGroup(group, f"cube {self.name}", interruptOnCancel=True)
            return consume(self.execute(q))

        future = pool.submit(work)
        pool.shutdown(wait=False)
        return group, future

    def cancel(self, group: str) -> None:
        self.spark.sparkContext.cancelJobGroup(group)

    def clear_cache(self) -> None:
        for df in self._cached.values():
            df.unpersist()
        self._cached.clear()

    def create_view(self, view: str, *measures: Any, **query: Any) -> DataFrame:
        """A query's result as a temporary view for Spark SQL."""
        out = self.query(*measures, **query)
        out.createOrReplaceTempView(view)
        return out

    # --- parts ------------------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.table.spark if hasattr(self.table, "spark") else self.table.base.sparkSession

    def planner(self, q: CubeQuery) -> Planner:
        table = replace(self.table, query=q) if isinstance(self.table, Composite) else self.table
        return Planner(table, self.forest.all(), self.generated(), {}, "UNKNOWN_MEASURES_ARE_EMPTY" in q.options, q.options, "EXCEPTIONS_AS_MEASURE_VALUE" in q.options)

    def prepared(self, q: CubeQuery) -> tuple[CubeQuery, dict[str, str]]:
        """The query with what the cube implies, in the table's names; how to show the names asked for."""
        unknown = {o for o in q.options - OPTIONS if not o.startswith("TABLEQUERY_PER_")}
        if unknown:
            raise ValueError(f"unknown options {sorted(unknown)}")
        options = q.options | self.implicit_options
        f = q.filter if self.implicit_filter is None else fl.and_(q.filter, self.implicit_filter(q))
        shown: dict[str, str] = {}
        group = q.group_by
        if self.case_insensitive:
            actual = {c.lower(): c for c in reversed([*self.columns()])}

            def real(c: str) -> str:
                found = actual.get(c.lower(), c)
                if found != c:
                    shown.setdefault(found, c)
                return found

            group = tuple(dict.fromkeys(real(c) if isinstance(c, str) else c for c in group))
            f = rename(f, lambda c: actual.get(c.lower(), c))
        return replace(q, filter=f, options=options, group_by=group), shown

    def generated(self) -> frozenset[str]:
        """Columns that measures of the forest make."""
        return frozenset(c for m in self.forest.all().values() if isinstance(m, ms.Dispatchor) and m.decomposition is not None for c in m.decomposition.outputs())

    def columns(self) -> dict[str, str]:
        """Name -> type of the columns that queries may use, generated ones included."""
        return {**dict.fromkeys(sorted(self.generated()), "string"), **self.table.columns()}

    def coordinates(self, column: str, matcher: Any = None, limit: int = 100) -> tuple[int, list]:
        """About how many values a column has, and up to ``limit`` of the most frequent that pass a matcher."""
        df = self.visible([column]).select(F.col(f"`{column}`").alias("c"))
        if matcher is not None:
            df = df.where(fl.matcher(matcher).on(F.col("c")))
        counts = df.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
        top = counts.where("c is not null").orderBy(F.desc("n"), "c").limit(limit).collect()
        return df.agg(F.approx_count_distinct("c")).first()[0], [r["c"] for r in top]

    def drillthrough(self, q: CubeQuery) -> DataFrame:
        """The rows behind a query: its grouping columns, and for each leaf the raw value where the leaf's condition holds (1 for rows)."""
        return self.execute(replace(q, options=q.options | {"DRILLTHROUGH"}))

    def _rows_behind(self, q: CubeQuery) -> DataFrame:
        if isinstance(self.table, Composite):
            return self.table.rows_behind(self, q)
        planner = self.planner(q)
        g = tuple(planner.name_of(c) for c in q.group_by)
        for m in q.measures:
            planner.node(m, q.filter, g, q.marker)
        leaves = list({(n.measure.name, repr(n.filter)): n for n in planner.steps.values() if isinstance(n, Leaf) and not n.empty}.values())
        needed = [*g, *(c for x in leaves for c in x.filter.columns()), *(c for x in leaves for c in x.inputs(self.table)), *q.filter.columns()]
        df = planner.base(list(dict.fromkeys(c for c in needed if planner.known(c))))

        def resolve(c: str) -> Column | None:
            return F.col(f"`{c}`") if planner.known(c) else None

        some = fl.or_(*(x.filter for x in leaves)) if leaves else q.filter
        df = df.where(some.on(resolve)) if some != fl.ALL else df
        names: dict[str, int] = {}
        out = []
        for x in leaves:
            raw = F.lit(1).cast("long") if x.column == "*" else F.lit(None).cast("double") if x.agg.opaque else x.value()
            n = names[x.measure.name] = names.get(x.measure.name, 0) + 1
            shown = x.measure.name if n == 1 else f"{x.measure.name}_{n}"
            rest = fl.without(x.filter, some)
            out.append((F.when(rest.on(resolve), raw) if rest != fl.ALL else raw).alias(shown))
        return df.select(*(F.col(f"`{c}`") for c in g if planner.known(c)), *(F.lit("generated").alias(c) for c in g if not planner.known(c)), *out)


def rename(f: fl.Filter, name: Callable[[str], str]) -> fl.Filter:
    if isinstance(f, fl.Where):
        return replace(f, column=name(f.column))
    if isinstance(f, (fl.And, fl.Or)):
        return (fl.and_ if isinstance(f, fl.And) else fl.or_)(*(rename(x, name) for x in f.of))
    return fl.not_(rename(f.of, name)) if isinstance(f, fl.Not) else f


# --- composites --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SubMeasure(ms.Measure):
    """A measure of the sub-cubes, aggregated over them."""

    aggregation: Any = "SUM"
    tags: frozenset[str] = frozenset()

    def build(self, planner: Planner, s: Any):
        own = planner.table.carrier(self.name) if isinstance(planner.table, Composite) else None
        return Leaf(s.group_by, own if own is not None else aggregation(self.aggregation), self.name, s.filter, self, marker=s.marker)


@dataclass
class Composite:
    """Cubes as one table: their rows together. A column that a cube lacks has the cube's name there."""

    cubes: tuple[Cube, ...]
    #: The query that is planned, which the implicit filters of the cubes may ask about.
    query: CubeQuery | None = None

    @property
    def spark(self) -> SparkSession:
        return self.cubes[0].spark

    def has(self, name: str) -> bool:
        return name == SLICER or any(c.table.has(name) or name in c.generated() for c in self.cubes)

    def columns(self) -> dict[str, str]:
        out: dict[str, str] = {SLICER: "string"}
        for c in reversed(self.cubes):
            out |= c.columns()
        return out

    def in_sql(self, sql: str) -> list[str]:
        return []

    def frame(self, names: list[str]) -> DataFrame:
        parts = [c.visible([n for n in names if c.table.has(n)], self.query) for c in self.cubes]
        out = None
        for c, part in zip(self.cubes, parts, strict=True):
            part = part.select(*(F.lit(c.name).alias(n) if not c.table.has(n) else F.col(f"`{n}`").cast("string").alias(n) if self._mixed(n) else F.col(f"`{n}`") for n in names))
            out = part if out is None else out.unionByName(part)
        return out

    def carrier(self, measure: str):
        """The aggregation whose state all sub-cubes that have the measure can give, if there is one."""
        found = [c.forest.get(measure) for c in self.cubes if c.forest.get(measure) is not None]
        if found and all(isinstance(m, ms.Aggregator) and m.aggregation != "expression" for m in found) and len({(m.aggregation, repr(m.options)) for m in found}) == 1:
            return aggregation(found[0].aggregation, dict(found[0].options))
        return None

    def filter_for(self, f: fl.Filter, c: Cube) -> fl.Filter:
        """The filter as a sub-cube takes it: conditions on columns it lacks are all or none, by its name."""
        if isinstance(f, fl.Where):
            if c.table.has(f.column) or f.column in c.generated():
                return f
            return fl.ALL if f.matcher.accepts(c.name) else fl.NONE
        if isinstance(f, (fl.And, fl.Or)):
            return (fl.and_ if isinstance(f, fl.And) else fl.or_)(*(self.filter_for(x, c) for x in f.of))
        return fl.not_(self.filter_for(f.of, c)) if isinstance(f, fl.Not) else f

    def states(self, planner: Planner, g: tuple[str, ...], leaves: list[Leaf]) -> tuple[DataFrame, dict[int, list[str]]]:
        columns = {id(x): [f"__v{next(planner.counter)}" for _ in range(x.agg.size)] for x in leaves}
        parts = []
        for c in self.cubes:
            inner = Planner(c.table, c.forest.all(), c.generated(), {}, options=planner.options)
            own_g = tuple(n for n in g if c.table.has(n) or n in c.generated())
            base_filter = c.implicit_filter(replace(self.query or CubeQuery(), group_by=own_g)) if c.implicit_filter else fl.ALL
            inner.table = replace(c.table, query=self.query) if isinstance(c.table, Composite) else c.table
            asked: list[tuple[Leaf, Any]] = []
            for x in leaves:
                f = fl.and_(self.filter_for(x.filter, c), base_filter)
                if f == fl.NONE:
                    continue
                if isinstance(x.measure, SubMeasure):
                    if c.forest.get(x.measure.name) is not None:
                        asked.append((x, inner.node(x.measure.name, f, own_g, x.marker)))
                elif x.empty or x.column == "*" or all(map(c.table.has, x.inputs(c.table))) and (x.inputs(c.table) or x.agg.opaque):
                    asked.append((x, inner.node(x.measure, f, own_g, None)))
            if not asked:
                continue
            inner.count_uses([n for _, n in asked])
            merging = [(x, n) for x, n in asked if isinstance(n, Leaf) and not n.agg.opaque]
            others = [(x, n) for x, n in asked if not (isinstance(n, Leaf) and not n.agg.opaque)]
            frames = []
            if merging:
                df, states = inner.states(own_g, [n for _, n in merging])
                frames.append(df.select(*(F.col(f"`{k}`") for k in own_g), *(F.col(s).alias(t) for x, n in merging for s, t in zip(states[id(n)], columns[id(x)], strict=True))))
            if others:
                inner.leaves([n for _, n in others])
                found = [(x, inner.value(n)) for x, n in others]
                joined = inner.join([v.frame for _, v in found if v.frame is not None], own_g)
                if joined is not None:
                    frames.append(joined.df.select(*(F.col(f"`{k}`") for k in own_g), *(v.column.alias(columns[id(x)][0]) for x, v in found if v.frame is not None)))
            for df in frames:
                parts.append(df.select(*(F.col(f"`{k}`").cast("string").alias(k) if self._mixed(k) else F.col(f"`{k}`") if k in own_g else F.lit(c.name).alias(k) for k in g if k in own_g), *(F.lit(c.name).alias(k) for k in g if k not in own_g), *(t for t in df.columns if t.startswith("__v"))))
        if not parts:
            schema = ", ".join([*(f"`{k}` string" for k in g), *(f"{t} double" for ts in columns.values() for t in ts)]) or "__none int"
            return self.spark.createDataFrame([], schema), columns
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        for ts in columns.values():
            for t in ts:
                if t not in out.columns:
                    out = out.withColumn(t, F.lit(None).cast("double"))
        merged = []
        for x in leaves:
            ts = columns[id(x)]
            made = [F.max(ts[0])] if x.empty else x.agg.merge([F.col(t) for t in ts])
            merged += [m.alias(t) for m, t in zip(made, ts, strict=True)]
        return out.groupBy(*(F.col(f"`{k}`") for k in g)).agg(*merged), columns

    def rows_behind(self, cube: Cube, q: CubeQuery) -> DataFrame:
        """The rows behind a query in each cube, as its own drill-through shows them."""
        asked = cube.forest.reachable([m if isinstance(m, str) else m.name for m in q.measures]).all()
        g, out = [c for c in q.group_by if isinstance(c, str)], None
        for c in self.cubes:
            f = self.filter_for(q.filter, c)
            names = [m.name if isinstance(m, SubMeasure) else m for m in asked.values() if (c.forest.get(m.name) is not None if isinstance(m, SubMeasure) else isinstance(m, ms.Aggregator) and (m.source == "*" or c.table.has(m.source)))]
            if f == fl.NONE or not names:
                continue
            own_g = tuple(n for n in g if c.table.has(n) or n in c.generated())
            part = c.execute(CubeQuery(tuple(names), own_g, f, q.marker, frozenset(["DRILLTHROUGH"])))
            keys = [F.lit(c.name).alias(n) if n not in own_g else F.col(f"`{n}`").cast("string").alias(n) if self._mixed(n) else F.col(f"`{n}`") for n in g]
            part = part.select(*keys, *(F.col(f"`{n}`") for n in part.columns if n not in own_g))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out if out is not None else self.spark.createDataFrame([], ", ".join([*(f"`{n}` string" for n in g), *(f"`{n}` double" for n in asked)]) or "none int")

    def _mixed(self, column: str) -> bool:
        """Whether some cube lacks the column, so that its values are texts everywhere."""
        return not all(c.table.has(column) for c in self.cubes)


def composite(name: str, cubes: Iterable[Cube], forest: Forest | None = None, **options: Any) -> Cube:
    """A cube over cubes: their measures, added up, and those of ``forest`` on top.

    A measure of ``forest`` that is called as one of the cubes' keeps its name; the cubes' gets
    the suffix of its first cube's name.
    """
    cubes = tuple(cubes)
    own = forest.all() if forest is not None else {}
    measures: dict[str, ms.Measure] = {}
    for c in cubes:
        for m in c.forest.all().values():
            if m.name not in own:
                measures.setdefault(m.name, SubMeasure(m.name, m.aggregation if isinstance(m, ms.Aggregator) and m.aggregation != "expression" else "SUM"))
    return Cube(name, Composite(cubes), Forest({**measures, **own}), **options)


# --- registry ----------------------------------------------------------------------------------------


@dataclass
class Schema:
    """Cubes, tables, forests and markers by name, with what a user interface asks about them."""

    cubes: dict[str, Cube] = field(default_factory=dict)
    tables: dict[str, Table] = field(default_factory=dict)
    forests: dict[str, Forest] = field(default_factory=dict)
    markers: dict[str, tuple] = field(default_factory=dict)

    def register(self, name: str, thing: Cube | Table | Forest) -> None:
        kind = self.cubes if isinstance(thing, Cube) else self.tables if isinstance(thing, Table) else self.forests
        if name in kind:
            raise ValueError(f"{name} is registered already")
        kind[name] = thing  # type: ignore[index]

    def register_marker(self, name: str, possible: Iterable[Any], default: Any = None) -> None:
        self.markers[name] = (tuple(possible), default)

    def open_cube(self, name: str, table: str, forest: str, **options: Any) -> Cube:
        self.register(name, Cube(name, self.tables[table], self.forests[forest], **options))
        return self.cubes[name]

    def metadata(self) -> dict[str, Any]:
        return {
            "cubes": {n: {"columns": c.columns(), "measures": {m.name: {"type": type(m).__name__, "tags": sorted(getattr(m, "tags", ()))} for m in c.forest.all().values()}, "tags": sorted(c.tags)} for n, c in self.cubes.items()},
            "tables": {n: {"columns": t.columns()} for n, t in self.tables.items()},
            "forests": {n: sorted(f.all()) for n, f in self.forests.items()},
            "markers": {n: {"possible": list(p), "default": d} for n, (p, d) in self.markers.items()},
        }

    def execute(self, cube: str, q: CubeQuery) -> DataFrame:
        return self.cubes[cube].execute(q)

    def tagged(self, tag: str) -> list[str]:
        return [n for n, c in self.cubes.items() if tag in c.tags]


def levels(hierarchies: Mapping[str, Iterable[str]], hierarchy: str, depth: int) -> tuple[str, ...]:
    """The first ``depth`` levels of a hierarchy, as grouping columns."""
    return tuple(hierarchies[hierarchy])[:depth]
