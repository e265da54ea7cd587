"""Tables: what a cube reads. A base frame, LEFT joins that a query needs, names and derived columns.

Only the arms of the snowflake whose columns a query uses enter its plan, with the arms they hang
on (and arms marked ``prunable=False``); as a LEFT join to a key that is unique adds and drops no
rows, the rest can stay out. Name conflicts go to the left-most owner; ``alias.column`` reaches the
others.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import filters as fl
from tessera.functions.expressions import infix, names_of


@dataclass(frozen=True)
class SqlColumn:
    """A column given by Spark SQL text over the table's columns."""

    name: str
    sql: str


@dataclass(frozen=True)
class FormulaColumn:
    """A column given by a formula of the infix dialect."""

    name: str
    formula: str


@dataclass(frozen=True)
class FunctionColumn:
    """A column given by a function of other columns, which are named (a pandas UDF will do)."""

    name: str
    function: Callable[..., Column]
    inputs: tuple[str, ...]


@dataclass(frozen=True)
class CalculatedMembers:
    """A column with further members, each all rows that pass a filter; a row may fall in several."""

    column: str
    members: tuple[tuple[str, fl.Filter], ...]
    name: str = ""

    @classmethod
    def star(cls, column: str, label: str = "*") -> CalculatedMembers:
        return cls(column, ((label, fl.ALL),))


Derived = SqlColumn | FormulaColumn | FunctionColumn


@dataclass(frozen=True)
class Arm:
    """A LEFT join of ``frame`` under ``alias`` to ``parent`` (None: the base) on pairs (parent's, own)."""

    alias: str
    frame: DataFrame
    on: tuple[tuple[str, str], ...]
    parent: str | None = None
    aliases: tuple[tuple[str, str], ...] = ()
    prunable: bool = True


def normal(frame: DataFrame) -> DataFrame:
    """Whole numbers as bigint, floats as double; decimals stay, so that their sums are exact."""
    whole, other = (T.ByteType, T.ShortType, T.IntegerType), (T.FloatType,)
    casts = {f.name: "bigint" if isinstance(f.dataType, whole) else "double" for f in frame.schema.fields if isinstance(f.dataType, whole + other)}
    return frame.select(*(F.col(f"`{c}`").cast(casts[c]).alias(c) if c in casts else F.col(f"`{c}`") for c in frame.columns)) if casts else frame


@dataclass(frozen=True)
class Table:
    """A base frame with join arms, aliases (alias -> column), derived columns and value maps."""

    base: DataFrame
    alias: str = "base"
    arms: tuple[Arm, ...] = ()
    aliases: Mapping[str, str] = field(default_factory=dict)
    derived: Mapping[str, Derived] = field(default_factory=dict)
    values: Mapping[str, Mapping[Any, Any]] = field(default_factory=dict)

    def left_join(self, frame: DataFrame, alias: str, on: Iterable[tuple[str, str]] | str, parent: str | None = None, aliases: Mapping[str, str] | None = None, prunable: bool = True) -> Table:
        """Add an arm; ``on`` a name joins columns that are called alike, ``aliases`` is alias -> own column."""
        pairs = ((on, on),) if isinstance(on, str) else tuple(on)
        if parent is not None and parent not in {a.alias for a in self.arms}:
            raise ValueError(f"no arm {parent}")
        return replace(self, arms=(*self.arms, Arm(alias, frame, pairs, parent, tuple((aliases or {}).items()), prunable)))

    def with_alias(self, alias: str, column: str) -> Table:
        return replace(self, aliases={**self.aliases, alias: column})

    def with_aliases(self, aliases: Mapping[str, str]) -> Table:
        """Several aliases; each must lead to a column."""
        out = replace(self, aliases={**self.aliases, **aliases})
        for a in aliases:
            if not out.has(a):
                raise ValueError(f"alias {a} leads to no column")
        return out

    def with_column(self, column: Derived) -> Table:
        return replace(self, derived={**self.derived, column.name: column})

    def with_values(self, column: str, mapping: Mapping[Any, Any]) -> Table:
        """Show a column's values through a map (others stay); filters speak of the shown ones."""
        return replace(self, values={**self.values, column: dict(mapping)})

    def owners(self) -> dict[str, tuple[str | None, str]]:
        """name -> (arm's alias or None, column there), left-most owner first."""
        out: dict[str, tuple[str | None, str]] = {c: (None, c) for c in self.base.columns}
        out |= {f"{self.alias}.{c}": (None, c) for c in self.base.columns}
        for arm in self.arms:
            for alias, c in arm.aliases:
                out.setdefault(alias, (arm.alias, c))
            for c in arm.frame.columns:
                out.setdefault(c, (arm.alias, c))
                out.setdefault(f"{arm.alias}.{c}", (arm.alias, c))
        return out

    def physical(self, name: str, seen: tuple[str, ...] = ()) -> str:
        """The name after aliases, which may point at aliases."""
        if name in self.aliases and name not in seen:
            return self.physical(self.aliases[name], (*seen, name))
        return name

    def has(self, name: str) -> bool:
        return name in self.derived or self.physical(name) in self.derived or self.physical(name) in self.owners()

    def columns(self) -> dict[str, str]:
        """Name -> type of every column that a query may use."""
        owners, types = self.owners(), {None: dict(self.base.dtypes)} | {a.alias: dict(a.frame.dtypes) for a in self.arms}
        out = {n: types[a][c] for n, (a, c) in owners.items() if "." not in n}
        out |= {a: out.get(self.physical(a), "string") for a in self.aliases}
        if self.derived:
            out |= dict(self.frame(list(self.derived)).select(*(f"`{n}`" for n in self.derived)).dtypes)
        return out

    def inputs_of(self, c: Derived) -> list[str]:
        known = [*self.owners(), *self.aliases, *self.derived]
        if isinstance(c, FormulaColumn):
            return names_of(c.formula)
        if isinstance(c, FunctionColumn):
            return list(c.inputs)
        return self.in_sql(c.sql, known)

    def in_sql(self, sql: str, known: Iterable[str] | None = None) -> list[str]:
        """The table's columns that SQL text speaks of, found by its words."""
        bare = re.sub(r"'(?:[^']|'')*'", " ", sql)
        words = set(re.findall(r"`([^`]+)`", bare)) | set(re.findall(r"[A-Za-z_]\w*(?:\.\w+)*", bare))
        return [k for k in (known if known is not None else [*self.owners(), *self.aliases, *self.derived]) if k in words]

    def frame(self, names: Iterable[str]) -> DataFrame:
        """A frame with the columns of these names, made of the arms that they need."""
        owners = self.owners()
        wanted: list[str] = []
        todo = list(dict.fromkeys(names))
        while todo:
            n = todo.pop()
            if n in wanted:
                continue
            wanted.append(n)
            p = self.physical(n)
            if p in self.derived:
                if p != n:
                    todo.append(p)
                todo += self.inputs_of(self.derived[p])
            elif p not in owners:
                raise ValueError(f"unknown column {n}")
        stored = {n: owners[self.physical(n)] for n in wanted if self.physical(n) not in self.derived}
        by_alias = {a.alias: a for a in self.arms}
        used = {a for a, _ in stored.values() if a} | {a.alias for a in self.arms if not a.prunable}
        for a in list(used):
            while (a := by_alias[a].parent) is not None:
                used.add(a)
        keys: dict[str | None, set[str]] = {}
        for a in used:
            for theirs, _ in by_alias[a].on:
                keys.setdefault(by_alias[a].parent, set()).add(theirs)

        def part(frame: DataFrame, alias: str | None, own: Iterable[str] = ()) -> DataFrame:
            physical = {**dict.fromkeys(keys.get(alias, ())), **dict.fromkeys(own)}
            shown = [F.col(f"`{c}`").alias(n) for n, (a, c) in stored.items() if a == alias]
            return normal(frame.select(*shown, *(F.col(f"`{c}`").alias(f"__{alias or ''}.{c}") for c in physical)))

        out = part(self.base, None)
        for arm in self.arms:
            if arm.alias in used:
                side = part(arm.frame, arm.alias, [own for _, own in arm.on])
                conditions = [out[f"`__{arm.parent or ''}.{theirs}`"] == side[f"`__{arm.alias}.{own}`"] for theirs, own in arm.on]
                out = out.join(side, conditions, "left")
        for n in wanted:
            p = self.physical(n)
            if p in self.values and p not in self.derived or n in self.values and n in stored:
                out = out.withColumn(n, shown_value(F.col(f"`{n}`"), self.values.get(n) or self.values[p]))
        for n in self._in_order([n for n in wanted if self.physical(n) in self.derived]):
            out = out.withColumn(n, self._derive(self.derived[self.physical(n)]))
        return out.select(*(F.col(f"`{n}`") for n in wanted)) if wanted else out

    def _in_order(self, names: list[str]) -> list[str]:
        out: list[str] = []

        def visit(n: str, path: tuple[str, ...]) -> None:
            if n in path:
                raise ValueError(f"column {n} depends on itself")
            for i in self.inputs_of(self.derived[self.physical(n)]):
                if self.physical(i) in self.derived:
                    visit(i, (*path, n))
            if n not in out:
                out.append(n)

        for n in names:
            visit(n, ())
        return out

    def _derive(self, c: Derived) -> Column:
        if isinstance(c, SqlColumn):
            return F.expr(c.sql)
        if isinstance(c, FormulaColumn):
            return infix(c.formula, lambda n: F.col(f"`{n}`"))
        return c.function(*(F.col(f"`{i}`") for i in c.inputs))


def shown_value(c: Column, mapping: Mapping[Any, Any]) -> Column:
    """A column with its values mapped; values without an entry stay."""
    out = None
    for k, v in mapping.items():
        hit = c.isNull() if k is None else c == F.lit(k)
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    return c if out is None else out.otherwise(c)


# --- name maps -------------------------------------------------------------------------------------


def prefixed(prefix: str, names: Iterable[str]) -> dict[str, str]:
    """alias -> column for aliases that carry a prefix."""
    return {f"{prefix}{n}": n for n in names}


def by_function(function: Callable[[str], str], names: Iterable[str]) -> dict[str, str]:
    """alias -> column for the aliases that a function makes of columns."""
    return {function(n): n for n in names}


def chained(*maps: Mapping[str, str]) -> dict[str, str]:
    """Aliases resolved through several maps in turn."""
    out = {}
    for alias in {a for m in maps for a in m}:
        name = alias
        for m in maps:
            name = m.get(name, name)
        out[alias] = name
    return out


# --- sources ---------------------------------------------------------------------------------------


def in_memory(spark: SparkSession, rows: list[dict], schema: T.StructType | str | None = None) -> Table:
    """A table of Python rows; a key that a row lacks is null."""
    if schema is None:
        names = list(dict.fromkeys(k for r in rows for k in r))
        if not rows:
            return empty(spark, T.StructType([]))
        schema = T.StructType([T.StructField(n, _type_of([r[n] for r in rows if r.get(n) is not None])) for n in names])
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return Table(spark.createDataFrame([tuple(r.get(n) for n in struct.names) for r in rows], struct))


def _type_of(values: list) -> T.DataType:
    if not values:
        return T.StringType()
    if all(isinstance(v, bool) for v in values):
        return T.BooleanType()
    if all(isinstance(v, int) and not isinstance(v, bool) for v in values):
        return T.LongType()
    if all(isinstance(v, (int, float)) for v in values):
        return T.DoubleType()
    return T._infer_type(values[0])


def empty(spark: SparkSession, schema: T.StructType | str) -> Table:
    return Table(spark.createDataFrame([], schema))


def parquet(spark: SparkSession, path: str) -> Table:
    return Table(spark.read.parquet(path))


def files(spark: SparkSession, path: str, kind: str, **options: Any) -> Table:
    """Any format that Spark reads: csv, json, orc, text, avro where its package is there."""
    return Table(spark.read.format(kind).options(**options).load(path))


def query(spark: SparkSession, sql: str) -> Table:
    """A SQL text as the base, such as the latest row of each key by a window."""
    return Table(spark.sql(sql))


def jdbc(spark: SparkSession, url: str, dbtable: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, **options: Any) -> Table:
    """A database's table; with a key and its bounds it is read in ``partitions`` ranges at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return Table(reader.load())


def jdbc_modulo(spark: SparkSession, url: str, dbtable: str, key: str, partitions: int, **properties: str) -> Table:
    """A database's table read as ``partitions`` queries by the remainder of an integer key."""
    predicates = [f"MOD({key}, {partitions}) = {i}" + (f" OR {key} IS NULL" if i == 0 else "") for i in range(partitions)]
    return Table(spark.read.jdbc(url, dbtable, predicates=predicates, properties=properties))


# --- sinks -----------------------------------------------------------------------------------------


def to_arrow(result: DataFrame):
    """A result as an Arrow table with long, double, boolean, date and text columns."""
    result = result.select(*(F.col(f"`{c}`").cast("double").alias(c) if t.startswith("decimal") else F.col(f"`{c}`") for c, t in result.dtypes))
    plain = ("bigint", "double", "boolean", "date", "string")
    return normal(result).select(*(F.col(f"`{c}`") if t in plain else F.col(f"`{c}`").cast("string").alias(c) for c, t in normal(result).dtypes)).toArrow()


def to_ipc(result: DataFrame) -> bytes:
    """A result as an Arrow stream."""
    import pyarrow as pa

    t = to_arrow(result)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def write(result: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: Iterable[str] = ()) -> None:
    result.write.format(kind).mode(mode).partitionBy(*partition_by).save(path)
