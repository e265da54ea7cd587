"""Aggregations: how rows become a value, what state is kept, and how states merge.

Each has a state of one or more columns that partial results carry, so that a coarser result comes
out of a finer one and sub-cubes merge, also for averages and counts. NULL is neutral everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entries:
    """A collection key by key: an input's entries (structs of key and value), one value of a key's, and the result of a list of entries."""

    of: Callable[[Column], Column]
    one: Callable[[Column], Column]
    gather: Callable[[Column], Column]


@dataclass(frozen=True)
class Aggregation:
    """``states`` of an input column, ``merge`` of state columns, ``final`` value of a state.

    ``opaque`` ones are SQL text: they take no condition and do not merge. ``ranked`` ones need a
    frame of their own.
    """

    states: Callable[[Column], list[Column]]
    merge: Callable[[Sequence[Column]], list[Column]]
    final: Callable[[Sequence[Column]], Column]
    opaque: bool = False
    ranked: tuple[int, bool] | None = None
    size: int = 1
    #: The aggregation for inputs of a type, where that decides.
    by_type: Callable[[str], Aggregation] | None = None
    #: Collections over rows of a table meet key by key in a frame of their own, so that no task holds a group's inputs.
    entries: Entries | None = None

    def typed(self, kind: str) -> Aggregation:
        return self if self.by_type is None else self.by_type(kind)


def _one(make: Callable[[Column], Column], merge: Callable[[Column], Column] | None = None, final: Callable[[Column], Column] = lambda c: c, entries: Entries | None = None) -> Aggregation:
    return Aggregation(lambda c: [make(c)], lambda s: [(merge or make)(s[0])], lambda s: final(s[0]), entries=entries)


def _average(options):
    return Aggregation(lambda c: [F.sum(c), F.count(c)], lambda s: [F.sum(s[0]), F.sum(s[1])], lambda s: F.when(s[1] > 0, s[0].cast("double") / s[1]), size=2)


def _not_nan(c: Column) -> Column:
    return F.sum(F.nanvl(c.cast("double"), F.lit(0.0)))


def _coalesce(options):
    """One non-null value, the same on every run; with failIfDifferent an error where there are several.

    Values in Spark have no identity, so matchReferences compares them like others.
    """
    if not options.get("failIfDifferent"):
        return _one(lambda c: F.min_by(c, c.cast("string")))

    def final(s):
        return F.when(s[0].eqNullSafe(s[1]), s[0]).otherwise(F.raise_error(F.lit("values differ")))

    return Aggregation(lambda c: [F.min(c), F.max(c)], lambda s: [F.min(s[0]), F.max(s[1])], final, size=2)


def _flat(c: Column) -> Column:
    return F.flatten(F.collect_list(c))


def _nonempty(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def _sum_map(c: Column) -> Column:
    """Maps added key by key."""
    return F.aggregate(F.collect_list(c), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")), lambda a, b: F.map_zip_with(a, b.cast("map<string,bigint>"), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))))


def _merged_map(c: Column) -> Column:
    """Maps united; of equal keys the last entry in order of keys and values."""
    entries = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_list(c), F.map_entries))))
    last = F.filter(entries, lambda e, i: F.coalesce(F.get(entries, i + 1)["key"] != e["key"], F.lit(True)))
    return F.when(F.size(last) > 0, F.map_from_entries(last))


ELEMENTS = Entries(lambda c: F.transform(c, lambda x: F.struct(x.alias("key"), F.lit(1).alias("value"))), F.max, lambda x: _nonempty(F.array_sort(F.transform(x, lambda e: e["key"]))))
LAST_OF_KEY = Entries(F.map_entries, F.max, lambda x: F.when(F.size(x) > 0, F.map_from_entries(F.array_sort(x))))
SUM_OF_KEY = Entries(lambda c: F.map_entries(c.cast("map<string,bigint>")), lambda v: F.coalesce(F.sum(v), F.lit(0)), lambda x: F.map_from_entries(F.array_sort(x)))


def _union(options):
    """The union of sets or of maps, as the inputs are; of plain values, the set of them."""

    def by_type(kind: str) -> Aggregation:
        if kind.startswith("map<"):
            return KEYS["UNION_MAP"](options)
        if kind.startswith("array<"):
            return KEYS["UNION_SET"](options)
        return Aggregation(lambda c: [_nonempty(F.array_sort(F.collect_set(c)))], lambda s: [_nonempty(F.array_sort(F.array_distinct(_flat(s[0]))))], lambda s: s[0])

    sets = KEYS["UNION_SET"](options)
    return Aggregation(sets.states, sets.merge, sets.final, by_type=by_type)


def _sum_else(gather: Callable[[Column], Column]) -> Callable[[dict], Aggregation]:
    """The sum of what are numbers; where something is not, what it was instead, as text."""

    def make(options):
        def states(c):
            text = c.cast("string")
            number = text.try_cast("double")
            return [F.sum(number), F.collect_set(F.when(text.isNotNull() & number.isNull(), text))]

        def merge(s):
            return [F.sum(s[0]), F.array_distinct(_flat(s[1]))]

        return Aggregation(states, merge, lambda s: F.when(F.size(s[1]) > 0, gather(F.array_sort(s[1]))).otherwise(s[0].cast("string")), size=2)

    return make


def _rank(options):
    """The n-th distinct value, largest first unless order is ASC; null where there are fewer."""
    n, down = int(options["rank"]), str(options.get("order", "DESC")).upper() == "DESC"
    if n < 1:
        raise ValueError("rank counts from 1")

    def best(c):
        return F.slice(F.sort_array(F.array_distinct(c), not down), 1, n)

    return Aggregation(lambda c: [best(F.collect_set(c))], lambda s: [best(_flat(s[0]))], lambda s: F.get(s[0], F.lit(n - 1)), ranked=(n, down))


KEYS: dict[str, Callable[[dict], Aggregation]] = {
    "SUM": lambda o: _one(F.sum),
    "SUM_NOT_NAN": lambda o: _one(_not_nan),
    "SUM_ELSE_SET": _sum_else(lambda a: F.concat(F.lit("{"), F.array_join(a, ", "), F.lit("}"))),
    "SUM_ELSE_STRING": _sum_else(lambda a: F.array_join(a, ",")),
    "MAX": lambda o: _one(F.max),
    "MIN": lambda o: _one(F.min),
    "COUNT": lambda o: _one(F.count, F.sum, lambda c: F.nullif(c, F.lit(0))),
    "AVG": _average,
    "PRODUCT": lambda o: _one(F.product),
    "RANK": _rank,
    "COALESCE": _coalesce,
    "EMPTY": lambda o: _one(lambda c: F.max(F.lit(None)), F.max),
    "UNION": _union,
    "UNION_SET": lambda o: _one(lambda c: _nonempty(F.array_sort(F.array_distinct(_flat(c)))), entries=ELEMENTS),
    "UNION_LIST": lambda o: _one(lambda c: _nonempty(_flat(c))),
    "UNION_MAP": lambda o: _one(_merged_map, entries=LAST_OF_KEY),
    "ATOMIC_LONG_MAP": lambda o: _one(_sum_map, entries=SUM_OF_KEY),
    "APPROX_COUNT_DISTINCT": lambda o: Aggregation(lambda c: [F.hll_sketch_agg(c)], lambda s: [F.hll_union_agg(s[0])], lambda s: F.hll_sketch_estimate(s[0])),
    "expression": lambda o: Aggregation(lambda c: [c], lambda s: [F.raise_error(F.lit("an expression does not aggregate again"))], lambda s: s[0], opaque=True),
}


def register(key: str, make: Callable[[dict], Aggregation]) -> None:
    """Add an aggregation under a key; ``make`` gets the options."""
    KEYS[key] = make


def simple(make: Callable[[Column], Column], merge: Callable[[Column], Column] | None = None) -> Aggregation:
    """An aggregation with one state column, from a column function (a pandas grouped UDF will do)."""
    return _one(make, merge)


def aggregation(key: str | Aggregation | Callable, options: dict | None = None) -> Aggregation:
    if isinstance(key, Aggregation):
        return key
    if callable(key):
        return simple(key)
    if key not in KEYS:
        raise ValueError(f"unknown aggregation {key}")
    return KEYS[key](options or {})


def across(key: str, values: Sequence[Column], options: dict | None = None) -> Column:
    """An aggregation over the values of one row."""
    options = options or {}
    known = F.filter(F.array(*values), lambda x: x.isNotNull())
    if key in ("SUM", "PRODUCT"):
        op = (lambda a, b: a + b) if key == "SUM" else (lambda a, b: a * b)
        neutral = F.lit(0 if key == "SUM" else 1)
        return F.when(F.size(known) > 0, reduce(op, [F.coalesce(v, neutral) for v in values]))
    if key == "COUNT":
        return F.nullif(F.size(known).cast("long"), F.lit(0).cast("long"))
    if key == "AVG":
        return F.when(F.size(known) > 0, reduce(lambda a, b: a + b, [F.coalesce(v.cast("double"), F.lit(0.0)) for v in values]) / F.nullif(F.size(known), F.lit(0)))
    if key in ("MAX", "MIN"):
        return (F.array_max if key == "MAX" else F.array_min)(known)
    if key == "COALESCE":
        return F.coalesce(*values)
    if key == "RANK":
        down = str(options.get("order", "DESC")).upper() == "DESC"
        return F.get(F.sort_array(F.array_distinct(known), not down), F.lit(int(options["rank"]) - 1))
    if key in ("UNION_SET", "UNION"):
        return F.array_sort(F.array_distinct(F.flatten(known)))
    if key == "SUM_NOT_NAN":
        return F.when(F.size(known) > 0, reduce(lambda a, b: a + b, [F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)) for v in values]))
    if key in ("UNION_MAP", "ATOMIC_LONG_MAP"):
        if key == "UNION_MAP":
            both = lambda _, x, y: F.coalesce(y, x)
        else:
            both = lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
        return reduce(lambda a, b: F.coalesce(F.map_zip_with(a, b, both), a, b), values)
    if key in ("SUM_ELSE_SET", "SUM_ELSE_STRING"):
        texts = F.array_compact(F.array(*(v.cast("string") for v in values)))
        odd = F.array_sort(F.array_distinct(F.filter(texts, lambda t: t.try_cast("double").isNull())))
        shown = F.concat(F.lit("{"), F.array_join(odd, ", "), F.lit("}")) if key == "SUM_ELSE_SET" else F.array_join(odd, ",")
        added = F.aggregate(texts, F.lit(0.0), lambda a, t: a + F.coalesce(t.try_cast("double"), F.lit(0.0))).cast("string")
        return F.when(F.size(odd) > 0, shown).when(F.size(texts) > 0, added)
    if key == "EMPTY":
        return F.lit(None)
    if key == "UNION_LIST":
        return F.flatten(known)
    raise ValueError(f"{key} does not apply across measures")
