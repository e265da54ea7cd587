"""Combinations: row-wise formulas over the values of underlying measures at one slice."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Context:
    """What a formula may know of its step besides the values."""

    filter: Any = None
    group_by: tuple[str, ...] = ()
    marker: Any = None
    options: frozenset = frozenset()
    coordinate: Callable[[str], Column] | None = field(default=None, compare=False)


Combination = Callable[[Sequence[Column], dict, Context], Column]


def present(values: Sequence[Column]) -> Column:
    """Whether any value is not null."""
    return reduce(lambda a, b: a | b, [v.isNotNull() for v in values], F.lit(False))


def _fold(values, options, neutral, op):
    out = reduce(op, [F.coalesce(v, F.lit(neutral)) for v in values])
    if options.get("customIfAnyNullOperand"):
        return F.when(reduce(lambda a, b: a & b, [v.isNotNull() for v in values]), out)
    return F.when(present(values), out)


def total(values, options, ctx):
    return _fold(values, options, 0, lambda a, b: a + b) if values else F.lit(None)


def product(values, options, ctx):
    return _fold(values, options, 1, lambda a, b: a * b) if values else F.lit(None)


def divide(values, options, ctx):
    """null / x is null (0 with nullNumeratorIsZero), x / null is NaN, x / 0 follows IEEE."""
    a, b = (v.cast("double") for v in values[:2])
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    by_zero = F.when(F.isnan(a) | (a == 0), nan).when(a > 0, inf).otherwise(-inf)
    out = F.when(b.isNull(), nan).when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))
    empty = F.when(b.isNotNull(), F.lit(0.0)) if options.get("nullNumeratorIsZero") else F.lit(None).cast("double")
    return F.when(a.isNull(), empty).otherwise(out)


def subtract(values, options, ctx):
    """a - b; where one is missing, the other as if it were 0."""
    a, b = values[:2]
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))


def greatest(values, options, ctx):
    return F.greatest(*values) if len(values) > 1 else values[0]


def least(values, options, ctx):
    return F.least(*values) if len(values) > 1 else values[0]


def coalesce(values, options, ctx):
    return F.coalesce(*values)


def identity(values, options, ctx):
    return values[0]


def constant(values, options, ctx):
    """A literal wherever a slice exists; with underlyings, wherever one of them has a value."""
    c = F.lit(options["constant"])
    return F.when(present(values), c) if values else c


def throwing(values, options, ctx):
    """Fails wherever it has an input; under EXCEPTIONS_AS_MEASURE_VALUE the error is the value."""
    text = options.get("message", "this measure always fails")
    failed = F.lit(f"RuntimeError: {text}") if "EXCEPTIONS_AS_MEASURE_VALUE" in ctx.options else F.raise_error(F.lit(text))
    return F.when(present(values), failed)


def expression(values, options, ctx):
    from tessera.functions.expressions import infix

    by_name = dict(zip(options.get("names", ()), values, strict=False)) | {f"underlyings[{i}]": v for i, v in enumerate(values)}

    def resolve(name: str) -> Column:
        if name in by_name:
            return by_name[name]
        raise ValueError(f"unknown variable {name}")

    return infix(options["expression"], resolve)


def reverse_polish(values, options, ctx):
    from tessera.functions.expressions import polish

    return polish(options["notation"], values, options.get("twoOperandsPerOperator", False), options.get("nullIfNotASingleUnderlying", True))


def of_aggregation(values, options, ctx):
    """Any aggregation applied across the underlyings of one slice."""
    from tessera.operators.aggregations import across

    return across(options["aggregationKey"], values, options.get("aggregationOptions", {}))


def from_marker(values, options, ctx):
    """A literal read from the custom marker at a dotted path, else the default."""
    found: Any = ctx.marker
    for part in options["path"].split("."):
        found = found.get(part) if isinstance(found, dict) else getattr(found, part, None)
        if found is None:
            break
    c = F.lit(options.get("default") if found is None else found)
    return F.when(present(values), c) if values else c


KEYS: dict[str, Combination] = {
    "SUM": total, "+": total, "PRODUCT": product, "*": product, "DIVIDE": divide, "/": divide, "SUBSTRACTION": subtract, "-": subtract,
    "MAX": greatest, "MIN": least, "COALESCE": coalesce, "IDENTITY": identity, "CONSTANT": constant, "EXPRESSION": expression,
    "REVERSE_POLISH": reverse_polish, "AGGREGATION": of_aggregation, "THROWING": throwing, "CUSTOM_MARKER": from_marker,
}


def register(key: str, function: Combination) -> None:
    """Add a formula (values, options, context) -> Column under a key."""
    KEYS[key] = function


def combination(key: str | Combination) -> Combination:
    """The formula of a key; a function stands for itself."""
    if callable(key):
        return key
    if key not in KEYS:
        raise ValueError(f"unknown combination {key}")
    return KEYS[key]
