"""Decompositions: one underlying slice becomes 0 to n entries with further columns.

``below`` says at which filter and grouping the underlying is read; ``spread`` turns its frame
(grouping columns and ``value``) into the entries. ``outputs`` are the columns that it generates.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import filters as fl


@dataclass(frozen=True)
class Decomposition:
    def outputs(self) -> tuple[str, ...]:
        return ()

    def below(self, group_by: tuple[str, ...], f: fl.Filter) -> tuple[tuple[str, ...], fl.Filter]:
        return group_by, f

    def spread(self, frame: DataFrame, group_by: tuple[str, ...], f: fl.Filter) -> DataFrame:
        return frame


def _finer(group_by: tuple[str, ...], outputs: tuple[str, ...], inputs: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys([*(g for g in group_by if g not in outputs), *inputs]))


def _matching(frame: DataFrame, f: fl.Filter, columns: tuple[str, ...]) -> DataFrame:
    """Rows of a bridge that pass the filter as far as it speaks of these columns alone (others count as passing)."""
    own = fl.suppress(f, f.columns() - set(columns))
    return frame.where(own.on(lambda c: F.col(f"`{c}`"))) if own != fl.ALL else frame


@dataclass(frozen=True)
class Linear(Decomposition):
    """Between two ends: at an end all goes there, else value * (input - min) / (max - min) to ``min`` and the rest to ``max``."""

    input: str
    output: str
    min: float
    max: float

    def outputs(self):
        return (self.output,)

    def below(self, group_by, f):
        if self.output not in group_by:
            return group_by, fl.suppress(f, [self.output])
        return _finer(group_by, (self.output,), (self.input,)), fl.suppress(f, [self.output])

    def spread(self, frame, group_by, f):
        if self.output not in group_by:
            return frame
        x, v = F.col(f"`{self.input}`").cast("double"), F.col("value").cast("double")
        low, high = F.lit(float(self.min)), F.lit(float(self.max))
        share = F.when(x <= low, 0.0).when(x >= high, v).otherwise(v * (x - low) / (high - low))

        def entry(at: Column, value: Column) -> Column:
            return F.struct(at.alias("at"), value.alias("value"))

        entries = F.when(x == low, F.array(entry(low, v))).when(x == high, F.array(entry(high, v))).otherwise(F.array(entry(low, share), entry(high, v - share)))
        return frame.withColumn("__e", F.explode(entries)).drop("value").select("*", F.col("__e.at").alias(self.output), F.col("__e.value").alias("value")).drop("__e")


@dataclass(frozen=True)
class ManyToMany(Decomposition):
    """Elements in groups by a bridge of (elements..., group): grouped by, a value counts in each group; only filtered, once.

    ``scale`` names a column of the bridge to multiply by. The bridge is any frame; Spark chooses
    how to join it.
    """

    elements: tuple[str, ...]
    group: str
    bridge: DataFrame = field(hash=False, compare=False)
    scale: str | None = None
    #: The bridge as (element, groups) pairs, where it was given so.
    members: tuple = ()

    def outputs(self):
        return (self.group,)

    def below(self, group_by, f):
        rest = fl.suppress(f, [self.group])
        if self.group not in group_by and self.group not in f.columns():
            return group_by, rest
        return _finer(group_by, (self.group,), self.elements), rest

    def spread(self, frame, group_by, f):
        if self.group not in group_by and self.group not in f.columns():
            return frame
        bridge = _matching(self.bridge, f, (self.group,))
        keys = {e: f"__m2m_{e}" for e in self.elements}
        bridge = bridge.select(*(F.col(f"`{e}`").alias(k) for e, k in keys.items()), F.col(f"`{self.group}`").alias("__m2m_group"), *([F.col(f"`{self.scale}`").alias("__m2m_scale")] if self.scale else []))
        on = [F.col(f"`{e}`") == F.col(f"`{k}`") for e, k in keys.items()]
        if self.group in group_by:
            out = frame.join(bridge, on, "inner").withColumn(self.group, F.col("__m2m_group"))
            return (out.withColumn("value", F.col("value") * F.col("__m2m_scale")) if self.scale else out).drop(*bridge.columns)
        return frame.join(bridge, on, "left_semi")


def many_to_many(spark: SparkSession, element: str, group: str, members: Mapping[Any, list]) -> ManyToMany:
    """A bridge out of element -> groups."""
    rows = [(e, g) for e, groups in members.items() for g in groups]
    return ManyToMany((element,), group, spark.createDataFrame(rows, [element, group]), members=tuple((e, tuple(g)) for e, g in members.items()))


@dataclass(frozen=True)
class LookupJoin(Decomposition):
    """Output columns looked up by input columns; a value without a match stays, with null outputs."""

    inputs: tuple[str, ...]
    lookup_outputs: tuple[str, ...]
    lookup: DataFrame = field(hash=False, compare=False)

    def outputs(self):
        return self.lookup_outputs

    def below(self, group_by, f):
        rest = fl.suppress(f, self.lookup_outputs)
        if not set(self.lookup_outputs) & (set(group_by) | f.columns()):
            return group_by, rest
        return _finer(group_by, self.lookup_outputs, self.inputs), rest

    def spread(self, frame, group_by, f):
        used = [o for o in self.lookup_outputs if o in set(group_by) | f.columns()]
        if not used:
            return frame
        side = self.lookup.select(*(F.col(f"`{i}`").alias(f"__in_{i}") for i in self.inputs), *(F.col(f"`{o}`") for o in used))
        out = frame.join(side, [F.col(f"`{i}`") == F.col(f"`__in_{i}`") for i in self.inputs], "left").drop(*(f"__in_{i}" for i in self.inputs))
        own = fl.suppress(f, f.columns() - set(used))
        return out.where(own.on(lambda c: F.col(f"`{c}`"))) if own != fl.ALL else out


@dataclass(frozen=True)
class Duplicating(Decomposition):
    """Each value at each of fixed coordinates of further columns."""

    coordinates: Mapping[str, tuple] = field(hash=False)

    def outputs(self):
        return tuple(self.coordinates)

    def below(self, group_by, f):
        return tuple(g for g in group_by if g not in self.coordinates), fl.suppress(f, self.coordinates)

    def spread(self, frame, group_by, f):
        for c, values in self.coordinates.items():
            kept = [v for v in values if fl.suppress(f, f.columns() - {c}).accepts({c: v})]
            if c in group_by:
                frame = frame.withColumn(c, F.explode(F.array(*map(F.lit, kept)))) if kept else frame.where(F.lit(False)).withColumn(c, F.lit(None).cast("string"))
            elif not kept:
                frame = frame.where(F.lit(False))
        return frame


@dataclass(frozen=True)
class Cumulating(Decomposition):
    """A running total along a column: each coordinate also has the values of those before it.

    The coordinates are those that occur under the query's filter without its conditions on the
    column; these conditions then choose which of the running totals are shown. Totals run over a
    pre-aggregated frame, one row for each coordinate and other slice.
    """

    column: str

    def below(self, group_by, f):
        return _finer(group_by, (), (self.column,)), fl.suppress(f, [self.column])

    def spread(self, frame, group_by, f):
        from pyspark.sql.window import Window

        others = [g for g in group_by if g != self.column]
        by_axis = Window.partitionBy(*(F.col(f"`{g}`") for g in others)).orderBy(F.col(f"`{self.column}`"))
        out = frame.withColumn("value", F.sum("value").over(by_axis.rowsBetween(Window.unboundedPreceding, 0)))
        if others:
            # a total holds from its coordinate to before the slice's next one: at each coordinate there that any slice has
            own_at = F.col(f"`{self.column}`")
            axis = frame.agg(F.sort_array(F.collect_set(own_at))).scalar()
            spans = out.withColumn("__next", F.lead(own_at).over(by_axis)).withColumn("__axis", axis)
            within = F.filter("__axis", lambda x: (own_at.isNull() | (x >= own_at)) & (F.col("__next").isNull() | (x < F.col("__next"))))
            shown = F.when(own_at.isNull(), F.concat(F.array(own_at), within)).otherwise(within)
            out = spans.withColumn(self.column, F.explode(shown)).drop("__next", "__axis")
        own = fl.suppress(f, f.columns() - {self.column})
        out = out.where(own.on(lambda c: F.col(f"`{c}`"))) if own != fl.ALL else out
        if self.column in group_by:
            return out
        # not grouped by: the total at the last coordinate shown
        last = Window.partitionBy(*(F.col(f"`{g}`") for g in others)).orderBy(F.col(f"`{self.column}`").desc())
        return out.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


@dataclass(frozen=True)
class Exploding(Decomposition):
    """The entries of a map-typed value: the key becomes a column, the map's value the value."""

    output: str

    def outputs(self):
        return (self.output,)

    def below(self, group_by, f):
        return tuple(g for g in group_by if g != self.output), fl.suppress(f, [self.output])

    def spread(self, frame, group_by, f):
        kept = [c for c in frame.columns if c != "value"]
        out = frame.select(*(F.col(f"`{c}`") for c in kept), F.explode("value").alias("__key", "value"))
        own = fl.suppress(f, f.columns() - {self.output})
        out = out.withColumn(self.output, F.col("__key")).drop("__key")
        return out.where(own.on(lambda c: F.col(f"`{c}`"))) if own != fl.ALL else out


#: Decompositions by the key that plain text gives them; their fields are the options.
KEYS: dict[str, Any] = {"linear": Linear, "duplicating": Duplicating, "cumulating": Cumulating, "exploding": Exploding}


def register(key: str, make: Any) -> None:
    """Add a decomposition under a key; ``make`` gets the options by name."""
    KEYS[key] = make


def from_plain(x: Mapping[str, Any]) -> Decomposition:
    """The decomposition of a key and its options."""
    options = {k: v for k, v in x.items() if k != "key"}
    if x["key"] == "many_to_many_1d":
        return many_to_many(SparkSession.active(), options["element"], options["group"], options["members"])
    if x["key"] not in KEYS:
        raise ValueError(f"unknown decomposition {x['key']}")
    return KEYS[x["key"]](**{k: {c: tuple(v) for c, v in o.items()} if k == "coordinates" else o for k, o in options.items()})


def to_plain(d: Decomposition) -> dict:
    """The key and options of a decomposition that plain text can hold."""
    if isinstance(d, ManyToMany) and d.members:
        return {"key": "many_to_many_1d", "element": d.elements[0], "group": d.group, "members": {k: list(v) for k, v in d.members}}
    for key, make in KEYS.items():
        if type(d) is make:
            return {"key": key, **{k.name: {c: list(v) for c, v in getattr(d, k.name).items()} if k.name == "coordinates" else getattr(d, k.name) for k in fields(d)}}
    raise ValueError(f"{type(d).__name__} has no plain form")


@dataclass(frozen=True)
class Lambda(Decomposition):
    """A function of the underlying's frame; ``inputs`` are grouped by besides, ``made`` are its columns."""

    function: Any
    inputs: tuple[str, ...] = ()
    made: tuple[str, ...] = ()

    def outputs(self):
        return self.made

    def below(self, group_by, f):
        return _finer(group_by, self.made, self.inputs), fl.suppress(f, self.made)

    def spread(self, frame, group_by, f):
        out = self.function(frame)
        own = fl.suppress(f, f.columns() - set(self.made))
        return out.where(own.on(lambda c: F.col(f"`{c}`"))) if own != fl.ALL else out
