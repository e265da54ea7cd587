"""Measures: the named formulas of a forest. Each says what it needs; the planner compiles it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from tessera.functions import filters as fl
from tessera.operators.combinations import Combination
from tessera.operators.decompositions import Decomposition


@dataclass(frozen=True)
class Measure:
    name: str

    def underlying_names(self) -> tuple[str, ...]:
        return ()


def _frozen(x: Any) -> Any:
    return x


@dataclass(frozen=True)
class Aggregator(Measure):
    """A leaf: an aggregation of a column (``*`` for rows), of rows that pass ``filter`` if there is one."""

    column: str | None = None
    aggregation: Any = "SUM"
    options: Mapping[str, Any] = field(default_factory=dict, hash=False)
    filter: fl.Filter = fl.ALL
    tags: frozenset[str] = frozenset()

    @property
    def source(self) -> str:
        return self.column if self.column is not None else self.name


def sum_(column: str, name: str | None = None) -> Aggregator:
    return Aggregator(name or column, column)


def count_rows(name: str = "count(*)") -> Aggregator:
    return Aggregator(name, "*", "COUNT")


def empty(name: str = "empty") -> Aggregator:
    """Materialises slices, without a value."""
    return Aggregator(name, "*", "EMPTY")


@dataclass(frozen=True)
class Combinator(Measure):
    """A formula over measures at the same filter and grouping; without any, over the slices that exist."""

    underlyings: tuple[str, ...] = ()
    combination: str | Combination = "SUM"
    options: Mapping[str, Any] = field(default_factory=dict, hash=False)
    tags: frozenset[str] = frozenset()

    def underlying_names(self):
        return self.underlyings


@dataclass(frozen=True)
class Filtrator(Measure):
    """The underlying where the query's filter and this one hold."""

    underlying: str = ""
    filter: fl.Filter = fl.ALL
    tags: frozenset[str] = frozenset()

    def underlying_names(self):
        return (self.underlying,)


@dataclass(frozen=True)
class Unfiltrator(Measure):
    """The underlying without the query's conditions on ``columns``, or with ``retain`` with only these."""

    underlying: str = ""
    columns: tuple[str, ...] = ()
    retain: bool = False
    tags: frozenset[str] = frozenset()

    def underlying_names(self):
        return (self.underlying,)

    def edited(self, f: fl.Filter) -> fl.Filter:
        return (fl.retain if self.retain else fl.suppress)(f, self.columns)


@dataclass(frozen=True)
class Shiftor(Measure):
    """The underlying read where ``column`` has another value, written at the slice that was asked.

    ``value`` is the value, or a function of the coordinate that works on Python values and on
    Spark columns alike (a ``Moved`` where these differ); ``only_if_present`` leaves filters and
    slices without the column as they are. ``editor`` replaces all this by a function of filters.
    """

    underlying: str = ""
    column: str = ""
    value: Any = None
    only_if_present: bool = True
    editor: Callable[[fl.Filter, Any], fl.Filter] | None = None
    tags: frozenset[str] = frozenset()

    def underlying_names(self):
        return (self.underlying,)

    def edited(self, f: fl.Filter, marker: Any) -> fl.Filter:
        if self.editor is not None:
            return self.editor(f, marker)
        return fl.shift(f, self.column, self.value, self.only_if_present)


@dataclass(frozen=True)
class Moved:
    """A shift by function, in its Python and its Spark form."""

    python: Callable[[Any], Any]
    column: Callable[[Any], Any]

    def __call__(self, x: Any) -> Any:
        from pyspark.sql import Column

        return self.column(x) if isinstance(x, Column) else self.python(x)


@dataclass(frozen=True)
class Partitionor(Measure):
    """A formula at a finer grouping, then aggregated to the one that was asked."""

    underlyings: tuple[str, ...] = ()
    group_by: tuple[Any, ...] = ()
    combination: str | Combination = "SUM"
    options: Mapping[str, Any] = field(default_factory=dict, hash=False)
    aggregation: Any = "SUM"
    aggregation_options: Mapping[str, Any] = field(default_factory=dict, hash=False)
    tags: frozenset[str] = frozenset()

    def underlying_names(self):
        return self.underlyings


@dataclass(frozen=True)
class Dispatchor(Measure):
    """Each underlying slice spread over 0 to n entries by a decomposition, then aggregated."""

    underlying: str = ""
    decomposition: Decomposition | None = None
    aggregation: Any = "SUM"
    aggregation_options: Mapping[str, Any] = field(default_factory=dict, hash=False)
    tags: frozenset[str] = frozenset()

    def underlying_names(self):
        return (self.underlying,)


@dataclass(frozen=True)
class Columnator(Measure):
    """A formula that has no value if a column is missing (or, with ``hide_if_present``, present).

    Present means grouped by, or bound to one value by the filter.
    """

    underlyings: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    hide_if_present: bool = False
    combination: str | Combination = "IDENTITY"
    options: Mapping[str, Any] = field(default_factory=dict, hash=False)
    tags: frozenset[str] = frozenset()

    def underlying_names(self):
        return self.underlyings


@dataclass(frozen=True)
class Routing(Measure):
    """A function of the step chooses the steps to read, among declared underlyings; the first value counts."""

    underlyings: tuple[str, ...] = ()
    route: Callable[[Any], Iterable[Any]] | None = None
    tags: frozenset[str] = frozenset()

    def underlying_names(self):
        return self.underlyings


@dataclass(frozen=True)
class EmptyMeasure(Measure):
    """No value anywhere."""


def alias(name: str, of: str) -> Combinator:
    return Combinator(name, (of,), "IDENTITY")


def with_tags(m: Measure, *tags: str) -> Measure:
    return replace(m, tags=frozenset(tags) | m.tags)  # type: ignore[attr-defined]


#: Filter editors of shifts by name, as forests in plain text speak of them.
EDITORS: dict[str, Callable[[fl.Filter, Any], fl.Filter]] = {}


def register_editor(key: str, editor: Callable[[fl.Filter, Any], fl.Filter]) -> None:
    EDITORS[key] = editor


def bare(underlying: str, column: str) -> Unfiltrator:
    """The underlying under no other condition than the query's on one column."""
    return Unfiltrator(f"{underlying} by {column} alone", underlying, (column,), retain=True)


def share_at(column: str, value: Any, underlying: str) -> list[Measure]:
    """``<underlying> share at <value>``: of all that has the value in the column, what the query's conditions leave."""
    base, at = bare(underlying, column), fl.where(column, value)
    some, all_ = (Filtrator(f"{m} at {value}", m, at) for m in (underlying, base.name))
    return [base, some, all_, Combinator(f"{underlying} share at {value}", (some.name, all_.name), "DIVIDE")]


def share_of_own(column: str, underlying: str) -> list[Measure]:
    """``<underlying> share of own <column>``: the underlying over that of the slice's own value of the column; no value without one."""
    base = bare(underlying, column)
    return [base, Columnator(f"{underlying} share of own {column}", (underlying, base.name), (column,), combination="DIVIDE")]
