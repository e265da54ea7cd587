"""From measures to one lazy Spark plan.

A query expands into steps (measure, filter, grouping, marker); equal steps are one. Leaves of one
grouping become one aggregation over one scan: the condition that they share is its WHERE, what is
left of each its own condition. A coarser grouping is derived from a finer one that is read anyway
where the states of its aggregations merge. Formulas are columns of the frame that holds their
operands; frames are joined only where a measure needs values of different origin.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import filters as fl
from tessera.operators import measures as ms
from tessera.operators.aggregations import Aggregation, aggregation
from tessera.operators.combinations import Context, combination, present
from tessera.operators.decompositions import Decomposition
from tessera.sources.tables import CalculatedMembers, Derived, FormulaColumn, FunctionColumn, SqlColumn, Table

#: The coordinate of a generated column on a measure that does not generate it.
GENERATED = "generated"
#: Slices that a filter's values may make at most when a shift writes where no row is.
CARTESIAN = 16_384


@dataclass(frozen=True)
class Step:
    """One measure at one filter, grouping and marker."""

    measure: ms.Measure
    filter: fl.Filter
    group_by: tuple[str, ...]
    marker: Any = None


@dataclass(eq=False)
class Node:
    group_by: tuple[str, ...]


@dataclass(eq=False)
class Leaf(Node):
    agg: Aggregation
    column: str
    filter: fl.Filter
    measure: ms.Measure
    empty: bool = False
    #: SQL text of the value that is aggregated, where it is no column.
    sql: str | None = None
    #: The marker of the step, for measures of sub-cubes.
    marker: Any = None

    def inputs(self, table: Any) -> list[str]:
        """The columns that the value is made of."""
        if self.agg.opaque or self.sql is not None:
            return table.in_sql(self.column if self.sql is None else self.sql)
        return [] if self.column == "*" else [self.column]

    def value(self) -> Column:
        """The value of a row."""
        if self.sql is not None:
            return F.expr(self.sql)
        return F.lit(1) if self.column == "*" else F.col(f"`{self.column}`")


@dataclass(eq=False)
class Formula(Node):
    make: Callable[[list[Column]], Column]
    of: list[Node]


@dataclass(eq=False)
class Again(Node):
    """The child's value, aggregated to a coarser grouping."""

    agg: Aggregation
    of: Node


@dataclass(eq=False)
class Spread(Node):
    of: Node
    decomposition: Decomposition
    agg: Aggregation
    filter: fl.Filter


@dataclass(eq=False)
class Shifted(Node):
    read: Node
    write: Node
    shiftor: ms.Shiftor
    filter: fl.Filter
    marker: Any


@dataclass(eq=False)
class NoValue(Node):
    pass


@dataclass
class Frame:
    """A frame with unique ``group_by`` columns and value columns of unique names."""

    df: DataFrame
    group_by: tuple[str, ...]
    version: int = 0


@dataclass
class Value:
    frame: Frame | None
    column: Column


@dataclass
class Planner:
    """Compiles the steps of one query on one table."""

    table: Any
    forest: dict[str, ms.Measure]
    generated: frozenset[str] = frozenset()
    extra: dict[str, Any] = field(default_factory=dict)
    unknown_is_empty: bool = False
    options: frozenset[str] = frozenset()
    errors_as_values: bool = False

    def __post_init__(self):
        self.steps: dict[tuple, Node] = {}
        self.path: list[ms.Measure] = []
        self.values: dict[int, Value] = {}
        self.joined: dict[tuple, Frame] = {}
        self.counter = itertools.count()
        self.uses: dict[int, int] = {}
        self.log: list[str] = []
        self.pending: dict[tuple, tuple[Frame, tuple[str, ...], list]] = {}
        self.registered: set[int] = set()

    # --- measures to nodes ---------------------------------------------------------------------

    def resolve(self, name: str | ms.Measure) -> ms.Measure:
        if isinstance(name, ms.Measure):
            return name
        if name in self.forest:
            return self.forest[name]
        if self.unknown_is_empty:
            return ms.EmptyMeasure(name)
        raise ValueError(f"unknown measure {name}")

    def node(self, name: str | ms.Measure, f: fl.Filter, g: tuple[str, ...], marker: Any) -> Node:
        m = self.resolve(name)
        key = (id(self.forest.get(m.name)) if self.forest.get(m.name) is m else m.name, id(m) if m.name not in self.forest else 0, f, g, repr(marker))
        if key in self.steps:
            return self.steps[key]
        if any(m is p for p in self.path):
            raise ValueError(f"the measures {' > '.join(p.name for p in [*self.path, m])} go round in a circle")
        self.path.append(m)
        try:
            made = self.expand(Step(m, f, g, marker))
        except Exception as e:
            if not self.errors_as_values or len(self.path) > 1:
                raise
            text = f"{type(e).__name__}: {e}"
            made = Formula(g, lambda v: F.when(present(v), F.lit(text)), [self.slices(f, g)])
        finally:
            self.path.pop()
        self.steps[key] = made
        return made

    def slices(self, f: fl.Filter, g: tuple[str, ...]) -> Node:
        return self.node(SLICES, f, g, None)

    def context(self, s: Step) -> Context:
        return Context(s.filter, s.group_by, s.marker, self.options, lambda c: F.col(f"`{c}`"))

    def expand(self, s: Step) -> Node:
        m, f, g, marker = s.measure, s.filter, s.group_by, s.marker
        if isinstance(m, ms.EmptyMeasure):
            return NoValue(g)
        if isinstance(m, ms.Aggregator):
            return self.leaf(m, f, g)
        if isinstance(m, ms.Combinator):
            return self.formula(s, m.underlyings, m.combination, m.options, g)
        if isinstance(m, ms.Filtrator):
            return self.node(m.underlying, fl.and_(f, m.filter), g, marker)
        if isinstance(m, ms.Unfiltrator):
            return self.node(m.underlying, m.edited(f), g, marker)
        if isinstance(m, ms.Partitionor):
            inner = tuple(dict.fromkeys([*g, *(self.name_of(c) for c in m.group_by)]))
            made = self.formula(s, m.underlyings, m.combination, m.options, inner)
            return made if set(inner) == set(g) else Again(g, aggregation(m.aggregation, dict(m.aggregation_options)), made)
        if isinstance(m, ms.Columnator):
            bound = set(g) | {c for c, v in fl.pinned(f).items() if len(v) == 1}
            hidden = any((c in bound) == m.hide_if_present for c in m.columns)
            return NoValue(g) if hidden else self.formula(s, m.underlyings, m.combination, m.options, g)
        if isinstance(m, ms.Dispatchor):
            below, under = m.decomposition.below(g, f)
            child = self.node(m.underlying, under, below, marker)
            return Spread(g, child, m.decomposition, aggregation(m.aggregation, dict(m.aggregation_options)), f)
        if isinstance(m, ms.Shiftor):
            return Shifted(g, self.node(m.underlying, m.edited(f, marker), g, marker), self.slices(f, g), m, f, marker)
        if isinstance(m, ms.Routing):
            found = list(m.route(s))
            for r in found:
                if r.measure.name not in m.underlyings:
                    raise ValueError(f"{m.name} routes to {r.measure.name}, which it does not declare")
            return Formula(g, lambda v: F.coalesce(*v), [self.node(r.measure, r.filter, g, r.marker) for r in found]) if found else NoValue(g)
        if hasattr(m, "build"):
            return m.build(self, s)
        raise ValueError(f"no plan for {type(m).__name__}")

    def name_of(self, c: Any) -> str:
        """The name of a grouping column; one that is defined in place becomes known to this query."""
        if isinstance(c, str):
            return c
        name = c.name or c.column
        self.extra[name] = c
        return name

    def formula(self, s: Step, underlyings, key, options, g: tuple[str, ...]) -> Node:
        make, ctx = combination(key), self.context(s)
        if not underlyings:
            return Formula(g, lambda v: F.when(present(v), make([], dict(options), ctx)), [self.slices(s.filter, g)])
        names = {"names": tuple(u if isinstance(u, str) else u.name for u in underlyings)}
        return Formula(g, lambda v: make(v, names | dict(options), ctx), [self.node(u, s.filter, g, s.marker) for u in underlyings])

    def leaf(self, m: ms.Aggregator, f: fl.Filter, g: tuple[str, ...]) -> Node:
        # conditions on columns that only other measures generate say nothing here
        own = fl.suppress(fl.and_(f, m.filter), self.absent(f))
        if m.aggregation == "expression" and (call := simple_call(m.source)):
            # one call of an aggregate that merges takes conditions and coarser groupings as a column's does
            return Leaf(g, aggregation(call[0]), m.source, own, m, sql=call[1])
        agg = aggregation(m.aggregation, dict(m.options))
        if agg.by_type is not None and self.known(m.source):
            agg = agg.typed(self.base([m.source]).schema[m.source].dataType.simpleString())
        return Leaf(g, agg, m.source, own, m, m.aggregation == "EMPTY")

    def absent(self, f: fl.Filter) -> set[str]:
        return {c for c in f.columns() if c in self.generated and not self.known(c)}

    def known(self, c: str) -> bool:
        return c in self.extra or self.table.has(c)

    # --- nodes to frames -------------------------------------------------------------------------

    def compile(self, measures: list[str | ms.Measure], f: fl.Filter, g: tuple[str, ...], marker: Any) -> tuple[DataFrame, list[str]]:
        """A frame of the grouping columns and a column for each measure; slices where none has a value are out."""
        nodes = [self.node(m, f, g, marker) for m in measures]
        if not nodes:
            nodes = [self.slices(f, g)]
        self.count_uses(nodes)
        self.leaves(nodes)
        # aggregations straight over a scan's frame share it with the coarser leaves made of it
        for n in list(self.steps.values()):
            if isinstance(n, Again) and id(n) in self.uses and id(n) not in self.registered and self.ready(n.of):
                self.register(n)
        found = [self.value(n) for n in nodes]
        frame = self.join([v.frame for v in found if v.frame is not None], g)
        names = [m if isinstance(m, str) else m.name for m in measures]
        if frame is None:
            df = self.nothing(g)
            return df.select(*(F.col(f"`{c}`") for c in g), *(F.lit(None).cast("double").alias(n) for n in names)), names
        out = frame.df.select(*(F.col(f"`{c}`") for c in g), *(v.column.alias(f"__m{i}") for i, v in enumerate(found)))
        if g:
            out = out.where(present([F.col(f"__m{i}") for i in range(len(found))]))
        # neither a measure without value nor one that only materialises slices has a type of its own
        none = [v.frame is None or isinstance(n, Leaf) and n.empty for v, n in zip(found, nodes, strict=True)]
        shown = [F.lit(None).cast("double") if x else F.col(f"__m{i}") for i, x in enumerate(none)]
        return out.select(*(F.col(f"`{c}`") for c in g), *(c.alias(n) for c, n in zip(shown, names, strict=False))), names

    def nothing(self, g: tuple[str, ...]) -> DataFrame:
        base = self.base([c for c in g if self.known(c)]).limit(0)
        for c in g:
            if not self.known(c):
                base = base.withColumn(c, F.lit(GENERATED))
        return base.select(*(F.col(f"`{c}`") for c in g))

    def count_uses(self, nodes: list[Node]) -> None:
        for n in nodes:
            self.uses[id(n)] = self.uses.get(id(n), 0) + 1
            if self.uses[id(n)] == 1:
                self.count_uses(children(n))

    def leaves(self, nodes: list[Node]) -> None:
        """Aggregate all leaves below ``nodes``, in as few scans as their groupings allow."""
        found: dict[int, Leaf] = {}
        seen: set[int] = set()

        def walk(n: Node) -> None:
            if id(n) not in seen:
                seen.add(id(n))
                if isinstance(n, Leaf):
                    found[id(n)] = n
                for c in children(n):
                    walk(c)

        for n in nodes:
            walk(n)
        groups: dict[tuple, list[Leaf]] = {}
        for leaf in found.values():
            apart = (repr(leaf.filter), id(leaf)) if leaf.agg.ranked or self.entrywise(leaf) else repr(leaf.filter) if leaf.agg.opaque else None
            groups.setdefault((frozenset(leaf.group_by), apart), []).append(leaf)
        # conditions of opaque leaves must be the scan's; they join the plain leaves if these have the same
        for (g, apart), own in [x for x in groups.items() if isinstance(x[0][1], str)]:
            plain = groups.get((g, None), [])
            if plain and all(repr(p.filter) == apart for p in plain):
                groups[(g, None)] = plain + own
                del groups[(g, apart)]
        plain_groups = [g for g, apart in groups if apart is None]
        members = {n for n, c in self.extra.items() if isinstance(c, CalculatedMembers)}
        derived: dict[frozenset, frozenset] = {}
        for g in sorted(plain_groups, key=len, reverse=True):
            if any(x.agg.opaque for x in groups[(g, None)]):
                continue
            finer = [h for h in plain_groups if g < h and h not in derived and not (h - g) & members]
            if finer:
                derived[g] = min(finer, key=len)
        for (g, apart), own in groups.items():
            if apart is None and g in derived:
                continue
            more = [x for h, into in derived.items() if into == g and apart is None for x in groups[(h, None)]]
            self.scan(own, more)

    def scan(self, own: list[Leaf], more: list[Leaf]) -> None:
        """One aggregation for the leaves of a grouping, and the states from which coarser ones are made."""
        g = own[0].group_by
        if own[0].agg.ranked:
            self.values[id(own[0])] = self.ranked(own[0])
            return
        if self.entrywise(own[0]):
            self.values[id(own[0])] = self.united(own[0])
            return
        if hasattr(self.table, "states"):
            df, columns = self.table.states(self, g, [*own, *more])
        else:
            df, columns = self.states(g, [*own, *more])
        frame = Frame(df, g)
        for leaf in own:
            self.values[id(leaf)] = Value(frame, leaf.agg.final([F.col(c) for c in columns[id(leaf)]]))
        by_target: dict[tuple, list[Leaf]] = {}
        for leaf in more:
            by_target.setdefault(tuple(sorted(leaf.group_by)), []).append(leaf)
        for leaves in by_target.values():
            self.pending.setdefault((id(frame), frozenset(leaves[0].group_by)), (frame, leaves[0].group_by, []))[2].extend((leaf, leaf.agg, columns[id(leaf)]) for leaf in leaves)

    def base(self, names: list[str], as_stored: frozenset[str] = frozenset()) -> DataFrame:
        """The table's columns of these names, also those that the query itself defines (but for ``as_stored``)."""
        own = [n for n in names if n in self.extra and n not in as_stored]
        stored = [n for n in names if n not in own]
        for n in names:
            if n in own:
                stored += self.inputs_of(self.extra[n])
        df = self.table.frame(list(dict.fromkeys(stored)))
        for n in own:
            c = self.extra[n]
            if isinstance(c, CalculatedMembers):
                df = self.with_members(df, n, c)
            else:
                one = Table(df, derived={c.name: c})
                df = df.withColumn(n, one._derive(c))
        return df

    def with_members(self, df: DataFrame, name: str, c: CalculatedMembers) -> DataFrame:
        """Each row once for its own value of the column and once for each member that it passes."""
        own = F.col(f"`{c.column}`").cast("string")
        labels = [F.when(m.on(lambda x: F.col(f"`{x}`")), F.lit(label)) for label, m in c.members]
        # the row's own value may be null, so members go in structs and only theirs are dropped
        entries = F.concat(F.array(F.struct(own.alias("v"))), F.transform(F.array_compact(F.array(*labels)), lambda x: F.struct(x.alias("v"))))
        return df.withColumn("__member", F.explode(entries)).withColumn(name, F.col("__member.v")).drop("__member")

    def inputs_of(self, c: Any) -> list[str]:
        if isinstance(c, CalculatedMembers):
            return list(dict.fromkeys([c.column, *(x for _, m in c.members for x in m.columns())]))
        if isinstance(c, (SqlColumn, FormulaColumn, FunctionColumn)):
            return self.table.inputs_of(c)
        raise ValueError(f"no grouping column: {c!r}")

    def states(self, g: tuple[str, ...], leaves: list[Leaf]) -> tuple[DataFrame, dict[int, list[str]]]:
        shared = fl.common([x.filter for x in leaves])
        # rows are grouped by what decides their members first; the few groups are then spread over these
        members = {c: self.extra[c] for c in g if isinstance(self.extra.get(c), CalculatedMembers)}
        if any(x.agg.opaque for x in leaves) or any(members.keys() & x.filter.columns() for x in leaves):
            members = {}
        asked, g = g, tuple(dict.fromkeys([*(c for c in g if c not in members), *(i for c in members.values() for i in self.inputs_of(c))]))
        needed = [c for c in g if self.known(c)]
        needed += [c for x in leaves for c in sorted(x.filter.columns())]
        for x in leaves:
            needed += x.inputs(self.table)
        for x in leaves:
            if not x.agg.opaque and x.sql is None and x.column != "*" and not self.known(x.column):
                raise ValueError(f"unknown column {x.column} of {x.measure.name}")
        df = self.base(list(dict.fromkeys(c for c in needed if self.known(c))), frozenset(i for c in members.values() for i in self.inputs_of(c)))

        def resolve(c: str) -> Column | None:
            return F.col(f"`{c}`") if self.known(c) else None

        if shared != fl.ALL:
            df = df.where(shared.on(resolve))
        made: list[Column] = []
        columns: dict[int, list[str]] = {}
        by_meaning: dict[tuple, list[str]] = {}
        for x in leaves:
            rest = fl.without(x.filter, shared)
            meaning = (x.measure.name, x.column, repr(rest), id(self.forest.get(x.measure.name)))
            if meaning in by_meaning:
                columns[id(x)] = by_meaning[meaning]
                continue
            if x.empty:
                states = [F.max(F.lit(1) if rest == fl.ALL else F.when(rest.on(resolve), F.lit(1)))]
            elif x.agg.opaque:
                if rest != fl.ALL:
                    raise ValueError(f"{x.measure.name} is SQL text and takes no condition of its own")
                states = [F.expr(x.column)]
            else:
                value = x.value()
                states = x.agg.states(value if rest == fl.ALL else F.when(rest.on(resolve), value))
            names = [f"__v{next(self.counter)}" for _ in states]
            made += [s.alias(n) for s, n in zip(states, names, strict=True)]
            columns[id(x)] = by_meaning[meaning] = names
        self.log.append(f"scan: group by {list(g)}, where {shared!r}, {len(made)} aggregates")
        known = [c for c in g if self.known(c)]
        out = df.groupBy(*(F.col(f"`{c}`") for c in known)).agg(*made)
        if members:
            # a member takes the name of the column that it extends
            out = out.select(*(F.col(f"`{c}`").alias(f"__of_{c}") for c in known), *(n for n in out.columns if n.startswith("__v")))
            for name, c in members.items():
                inner = CalculatedMembers(f"__of_{c.column}", tuple((label, _renamed(m, lambda x: f"__of_{x}")) for label, m in c.members))
                out = self.with_members(out, f"__to_{name}", inner)
            keys = [F.col(f"`__to_{c}`" if c in members else f"`__of_{c}`").alias(c) for c in asked if self.known(c)]
            seen: dict[tuple, Leaf] = {tuple(columns[id(x)]): x for x in leaves}
            merged = [m.alias(t) for names, x in seen.items() for m, t in zip([F.max(F.col(names[0]))] if x.empty else x.agg.merge([F.col(t) for t in names]), names, strict=True)]
            out = out.groupBy(*keys).agg(*merged)
        g = asked
        for c in g:
            if not self.known(c):
                if c not in self.generated:
                    raise ValueError(f"unknown column {c}")
                out = out.withColumn(c, F.lit(GENERATED))
        return out, columns

    def ranked(self, leaf: Leaf) -> Value:
        """The n-th distinct value by a window that keeps n rows of a group before it shuffles.

        Values are made distinct first, so that the ties of a top value meet on the map side; a window
        straight over the rows would send all of them to one task.
        """
        from pyspark.sql.window import Window

        if hasattr(self.table, "states"):
            df, columns = self.table.states(self, leaf.group_by, [leaf])
            return Value(Frame(df, leaf.group_by), leaf.agg.final([F.col(c) for c in columns[id(leaf)]]))
        n, down = leaf.agg.ranked
        g = [c for c in leaf.group_by if self.known(c)]
        df = self.base(list(dict.fromkeys([*g, leaf.column, *(c for c in leaf.filter.columns() if self.known(c))])))
        df = df.where(leaf.filter.on(lambda c: F.col(f"`{c}`") if self.known(c) else None))
        name = f"__v{next(self.counter)}"
        v = F.col(f"`{leaf.column}`")
        df = df.where(v.isNotNull()).select(*(F.col(f"`{c}`") for c in g), v.alias(name)).distinct()
        w = Window.partitionBy(*(F.col(f"`{c}`") for c in g)).orderBy(F.col(name).desc() if down else F.col(name))
        df = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).where(F.col("__n") == n).drop("__n")
        for c in leaf.group_by:
            if c not in g:
                df = df.withColumn(c, F.lit(GENERATED))
        return Value(Frame(df, leaf.group_by), F.col(name))

    def entrywise(self, leaf: Leaf) -> bool:
        return leaf.agg.entries is not None and not leaf.empty and not hasattr(self.table, "states")

    def united(self, leaf: Leaf) -> Value:
        """A collection out of its entries: those of a key are one, on the map side first, before a group's keys are gathered."""
        entries, g = leaf.agg.entries, [c for c in leaf.group_by if self.known(c)]
        df = self.base(list(dict.fromkeys([*g, *leaf.inputs(self.table), *(c for c in sorted(leaf.filter.columns()) if self.known(c))])))
        if leaf.filter != fl.ALL:
            df = df.where(leaf.filter.on(lambda c: F.col(f"`{c}`") if self.known(c) else None))
        keys = [F.col(f"`{c}`") for c in g]
        df = df.select(*keys, F.explode_outer(entries.of(leaf.value())).alias("__e"))
        df = df.groupBy(*keys, F.col("__e.key").alias("__k"), F.col("__e").isNotNull().alias("__there")).agg(entries.one(F.col("__e.value")).alias("__x"))
        name = f"__v{next(self.counter)}"
        df = df.groupBy(*keys).agg(entries.gather(F.collect_list(F.when(F.col("__there"), F.struct(F.col("__k").alias("key"), F.col("__x").alias("value"))))).alias(name))
        for c in leaf.group_by:
            if c not in g:
                df = df.withColumn(c, F.lit(GENERATED))
        return Value(Frame(df, leaf.group_by), F.col(name))

    def value(self, n: Node) -> Value:
        if id(n) not in self.values:
            self.values[id(n)] = self.evaluate(n)
        return self.values[id(n)]

    def evaluate(self, n: Node) -> Value:
        if isinstance(n, NoValue):
            return Value(None, F.lit(None))
        if isinstance(n, Leaf):
            self.settle(n.group_by, lambda x: x is n)
            return self.values[id(n)]
        if isinstance(n, Formula):
            of = [self.value(c) for c in n.of]
            frame = self.join([v.frame for v in of if v.frame is not None], n.group_by)
            try:
                made = n.make([v.column for v in of])
            except Exception as e:
                if not self.errors_as_values:
                    raise
                made = F.when(present([v.column for v in of]), F.lit(f"{type(e).__name__}: {e}"))
            if frame is None:
                return Value(None, F.lit(None))
            if self.uses.get(id(n), 1) > 1:
                name = f"__v{next(self.counter)}"
                frame.df, frame.version = frame.df.withColumn(name, made), frame.version + 1
                made = F.col(name)
            return Value(frame, made)
        if isinstance(n, Again):
            if id(n) not in self.registered:
                self.register(n)
            self.settle(n.group_by, lambda x: x is n)
            return self.values[id(n)]
        if isinstance(n, Spread):
            return self.spread(n)
        return self.shifted(n)

    def register(self, n: Again) -> None:
        """Put an aggregation of a finer frame among the pending ones."""
        self.registered.add(id(n))
        v = self.value(n.of)
        if v.frame is None:
            self.values[id(n)] = Value(None, F.lit(None))
            return
        name = f"__v{next(self.counter)}"
        v.frame.df, v.frame.version = v.frame.df.withColumn(name, v.column), v.frame.version + 1
        agg = n.agg.typed(v.frame.df.schema[name].dataType.simpleString()) if n.agg.by_type is not None else n.agg
        self.pending.setdefault((id(v.frame), frozenset(n.group_by)), (v.frame, n.group_by, []))[2].append((n, agg, name))

    def ready(self, n: Node) -> bool:
        """Whether a node is made of leaves and formulas alone, so that evaluating it now settles nothing else."""
        return isinstance(n, (Leaf, NoValue)) and (id(n) in self.values or isinstance(n, NoValue)) or isinstance(n, Formula) and all(self.ready(c) for c in n.of)

    def settle(self, g: tuple[str, ...], wanted: Callable[[Node], bool]) -> None:
        """Run the pending aggregation that has the wanted node, with all that share its frame and grouping."""
        for key, (frame, target, todo) in list(self.pending.items()):
            if frozenset(target) != frozenset(g) or not any(wanted(x) for x, _, _ in todo):
                continue
            del self.pending[key]
            made, finals = [], []
            for x, agg, columns in todo:
                if isinstance(columns, str):
                    states = agg.states(F.col(columns))
                else:
                    states = [F.max(columns[0])] if isinstance(x, Leaf) and x.empty else agg.merge([F.col(c) for c in columns])
                names = [f"__v{next(self.counter)}" for _ in states]
                made += [s.alias(k) for s, k in zip(states, names, strict=True)]
                finals.append((x, agg, names))
            out = Frame(frame.df.groupBy(*(F.col(f"`{c}`") for c in target)).agg(*made), tuple(target))
            for x, agg, names in finals:
                self.values[id(x)] = Value(out, agg.final([F.col(c) for c in names]))

    def spread(self, n: Spread) -> Value:
        child = self.value(n.of)
        if child.frame is None:
            return Value(None, F.lit(None))
        below = n.of.group_by
        df = child.frame.df.select(*(F.col(f"`{c}`") for c in below), child.column.alias("value")).where("value is not null")
        df = n.decomposition.spread(df, n.group_by, n.filter)
        agg = n.agg.typed(df.schema["value"].dataType.simpleString()) if n.agg.by_type is not None else n.agg
        names = [f"__v{next(self.counter)}" for _ in range(agg.size)]
        states = [s.alias(k) for s, k in zip(agg.states(F.col("value")), names, strict=True)]
        out = df.groupBy(*(F.col(f"`{c}`") for c in n.group_by)).agg(*states)
        return Value(Frame(out, n.group_by), agg.final([F.col(k) for k in names]))

    def shifted(self, n: Shifted) -> Value:
        read, write, g = self.value(n.read), self.value(n.write), n.group_by
        if read.frame is None:
            return Value(None, F.lit(None))
        s = n.shiftor
        pins = fl.pinned(n.filter)
        synthetic = None
        if all(c in pins for c in g):
            count = 1
            for c in g:
                count *= len(pins[c])
            if count >= CARTESIAN:
                raise ValueError(f"{s.name} would write {count} slices that only the filter names")
            synthetic = list(itertools.product(*(pins[c] for c in g)))
        # how the coordinates of a slice move
        moved: dict[str, Any] = {}
        if s.editor is not None:
            probe = fl.and_(*(fl.where(c, _Coordinate(c)) for c in g))
            edited = fl.pinned(s.editor(probe, n.marker))
            for c in g:
                v = edited.get(c, (None,))[0]
                if not (isinstance(v, _Coordinate) and v.column == c):
                    moved[c] = v
        elif s.column in g:
            moved[s.column] = s.value
        value_name = f"__v{next(self.counter)}"
        if not moved and synthetic is None:
            frame = self.join([read.frame, write.frame], g)
            return Value(frame, F.when(write.column.isNotNull(), read.column))
        if not moved and not g:
            return Value(read.frame, read.column)
        source = read.frame.df.select(*(F.col(f"`{c}`") for c in g), read.column.alias(value_name)).where(F.col(value_name).isNotNull())
        slices = write.frame.df.where(write.column.isNotNull()).select(*(F.col(f"`{c}`") for c in g))
        if synthetic:
            more = slices.sparkSession.createDataFrame([tuple(x) for x in synthetic], _schema_for(slices))
            slices = slices.unionByName(more).distinct()
        fixed = {c: v for c, v in moved.items() if not callable(v) and not isinstance(v, _Coordinate)}
        for c, v in fixed.items():
            source = source.where(F.col(f"`{c}`").isNull() if v is None else F.col(f"`{c}`") == F.lit(v)).drop(c)
        keys = [c for c in g if c not in fixed]
        left, right = slices.alias("__w"), source.select(*(F.col(f"`{c}`").alias(f"__r_{c}") for c in keys), F.lit(0).alias("__r_one"), value_name).alias("__r")
        on = [(moved[c](F.col(f"__w.`{c}`")) if callable(moved.get(c)) else F.col(f"__w.`{moved[c].column if isinstance(moved.get(c), _Coordinate) else c}`")).eqNullSafe(F.col(f"__r.`__r_{c}`")) for c in keys]
        if not on:
            left = slices.withColumn("__one", F.lit(0)).alias("__w")
            on = [F.col("__w.__one") == F.col("__r.__r_one")]
        out = left.join(right, on, "left").select(*(F.col(f"__w.`{c}`").alias(c) for c in g), F.col(f"__r.{value_name}").alias(value_name))
        return Value(Frame(out, g), F.col(value_name))

    def join(self, frames: list[Frame], g: tuple[str, ...]) -> Frame | None:
        """One frame with the columns of all, slices aligned null-safely; unmatched sides are null."""
        distinct = list({id(f): f for f in frames}.values())
        if not distinct:
            return None
        if len(distinct) == 1:
            return distinct[0]
        key = tuple(sorted((id(f), f.version) for f in distinct))
        if key in self.joined:
            return self.joined[key]
        out = distinct[0].df
        for i, f in enumerate(distinct[1:]):
            mine = {c for c in out.columns if c.startswith("__v")}
            right = f.df.select(*(F.col(f"`{c}`").alias(f"__j{i}_{c}") for c in g), *(c for c in f.df.columns if c.startswith("__v") and c not in mine), *([] if g else [F.lit(0).alias("__jone")]))
            if g:
                on = [F.col(f"`{c}`").eqNullSafe(F.col(f"`__j{i}_{c}`")) for c in g]
                # a slice that only the right side has shows by a mark, as a key may itself be null
                right = right.withColumn(f"__j{i}_here", F.lit(True))
                left = out.withColumn("__left_here", F.lit(True))
                both = left.join(right, on, "full")
                keys = [F.when(F.col("__left_here"), F.col(f"`{c}`")).otherwise(F.col(f"`__j{i}_{c}`")).alias(c) for c in g]
                out = both.select(*keys, *(c for c in both.columns if c.startswith("__v")))
            else:
                both = out.withColumn("__one", F.lit(0)).join(right, F.col("__one") == F.col("__jone"), "full")
                out = both.select(*(c for c in both.columns if c.startswith("__v")))
        self.joined[key] = Frame(out, g)
        return self.joined[key]


class _Coordinate:
    """Stands for a slice's own coordinate while a filter editor is asked what it changes."""

    def __init__(self, column: str):
        self.column = column

    def __eq__(self, other):
        return isinstance(other, _Coordinate) and other.column == self.column

    def __hash__(self):
        return hash(self.column)

    def __repr__(self):
        return f"<{self.column}>"


def _schema_for(df: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])


def _renamed(f: fl.Filter, name: Callable[[str], str]) -> fl.Filter:
    """The filter on other names of its columns."""
    if isinstance(f, fl.Where):
        return replace(f, column=name(f.column))
    if isinstance(f, (fl.And, fl.Or)):
        return (fl.and_ if isinstance(f, fl.And) else fl.or_)(*(_renamed(x, name) for x in f.of))
    return fl.not_(_renamed(f.of, name)) if isinstance(f, fl.Not) else f


def simple_call(sql: str) -> tuple[str, str] | None:
    """(key, argument) of SQL text that is one call of sum, min or max and nothing more."""
    m = re.fullmatch(r"\s*(sum|min|max)\s*\((.*)\)\s*", sql, re.I | re.S)
    if not m or re.match(r"\s*(distinct|all)\b", m[2], re.I) or "'" in m[2]:
        return None
    depth = 0
    for c in m[2]:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return None
    return (m[1].upper(), m[2]) if depth == 0 else None


def children(n: Node) -> list[Node]:
    if isinstance(n, Formula):
        return n.of
    if isinstance(n, (Again, Spread)):
        return [n.of]
    if isinstance(n, Shifted):
        return [n.read, n.write]
    return []


SLICES = ms.empty("__slices")
__all__ = ["Derived", "Planner", "Step"]
