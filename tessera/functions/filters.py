"""Boolean filters over columns: an immutable tree, its algebra, and its translation to Spark.

NOT has two values: rows for which the operand is unknown pass. The exception is NOT of a
comparison, which is the opposite comparison and drops NULL, as SQL does. LIKE is case-sensitive
unless ``ignore_case``; a regular expression matches the whole text and ignores case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Matcher:
    """A condition on one value."""

    def on(self, c: Column) -> Column:
        raise NotImplementedError

    def accepts(self, value: Any) -> bool:
        """Whether a Python value passes (used for coordinates that are known while planning)."""
        raise NotImplementedError

    def negated(self) -> Matcher:
        return NotMatcher(self)


@dataclass(frozen=True)
class Equals(Matcher):
    operand: Any

    def on(self, c):
        return c == F.lit(self.operand)

    def accepts(self, value):
        return value == self.operand


@dataclass(frozen=True)
class IsNull(Matcher):
    def on(self, c):
        return c.isNull()

    def accepts(self, value):
        return value is None


@dataclass(frozen=True)
class In(Matcher):
    operands: tuple

    def on(self, c):
        return c.isin(*self.operands)

    def accepts(self, value):
        return value in self.operands


FLIPPED = {">": "<=", ">=": "<", "<": ">=", "<=": ">"}


@dataclass(frozen=True)
class Comparing(Matcher):
    """``match_if_null`` counts only for values that are known while planning, as SQL ignores it."""

    op: str
    operand: Any
    match_if_null: bool = False

    def on(self, c):
        x = F.lit(self.operand)
        return {">": c > x, ">=": c >= x, "<": c < x, "<=": c <= x}[self.op]

    def accepts(self, value):
        if value is None:
            return self.match_if_null
        try:
            return {">": value > self.operand, ">=": value >= self.operand, "<": value < self.operand, "<=": value <= self.operand}[self.op]
        except TypeError:
            return False

    def negated(self):
        return Comparing(FLIPPED[self.op], self.operand, not self.match_if_null)


@dataclass(frozen=True)
class Like(Matcher):
    pattern: str
    ignore_case: bool = False

    def on(self, c):
        c = c.cast("string")
        return c.ilike(self.pattern) if self.ignore_case else c.like(self.pattern)

    def accepts(self, value):
        parts = "".join("." if x == "_" else ".*" if x == "%" else re.escape(x) for x in self.pattern)
        return value is not None and re.fullmatch(parts, str(value), re.S | (re.I if self.ignore_case else 0)) is not None


@dataclass(frozen=True)
class Regex(Matcher):
    pattern: str

    def on(self, c):
        return c.cast("string").rlike(f"(?is)^(?:{self.pattern})$")

    def accepts(self, value):
        return value is not None and re.fullmatch(self.pattern, str(value), re.I | re.S) is not None


@dataclass(frozen=True)
class Text(Matcher):
    """Equality of the value as text."""

    operand: str
    ignore_case: bool = False

    def on(self, c):
        c = c.cast("string")
        return F.lower(c) == self.operand.lower() if self.ignore_case else c == self.operand

    def accepts(self, value):
        return value is not None and (str(value).lower() == self.operand.lower() if self.ignore_case else str(value) == self.operand)


@dataclass(frozen=True)
class Predicate(Matcher):
    """A function Column -> Column; for known values it needs ``python`` too."""

    function: Callable[[Column], Column]
    python: Callable[[Any], bool] | None = None

    def on(self, c):
        return self.function(c)

    def accepts(self, value):
        if self.python is None:
            raise ValueError("this predicate has no Python form")
        return self.python(value)


@dataclass(frozen=True)
class NotMatcher(Matcher):
    of: Matcher

    def on(self, c):
        return ~F.coalesce(self.of.on(c), F.lit(False))

    def accepts(self, value):
        return not self.of.accepts(value)

    def negated(self):
        return self.of


@dataclass(frozen=True)
class AllOf(Matcher):
    of: tuple[Matcher, ...]

    def on(self, c):
        return reduce(lambda a, b: a & b, [m.on(c) for m in self.of], F.lit(True))

    def accepts(self, value):
        return all(m.accepts(value) for m in self.of)


@dataclass(frozen=True)
class AnyOf(Matcher):
    of: tuple[Matcher, ...]

    def on(self, c):
        return reduce(lambda a, b: a | b, [F.coalesce(m.on(c), F.lit(False)) for m in self.of], F.lit(False))

    def accepts(self, value):
        return any(m.accepts(value) for m in self.of)


def matcher(x: Any) -> Matcher:
    """None is IS NULL, a collection IN (null members apart), a compiled pattern a regex, else equality."""
    if isinstance(x, Matcher):
        return x
    if x is None:
        return IsNull()
    if isinstance(x, re.Pattern):
        return Regex(x.pattern)
    if isinstance(x, (list, tuple, set, frozenset)):
        flat = list(dict.fromkeys(_flat(x)))
        known = tuple(v for v in flat if v is not None)
        found: list[Matcher] = [Equals(known[0])] if len(known) == 1 else [In(known)] if known else []
        found += [IsNull()] if len(known) < len(flat) else []
        return found[0] if len(found) == 1 else AnyOf(tuple(found))
    return Equals(x)


def _flat(x: Iterable) -> Iterable:
    for v in x:
        if isinstance(v, (list, tuple, set, frozenset)):
            yield from _flat(v)
        else:
            yield v


@dataclass(frozen=True)
class Filter:
    """A node of the tree."""

    def __and__(self, other: Filter) -> Filter:
        return and_(self, other)

    def __or__(self, other: Filter) -> Filter:
        return or_(self, other)

    def __invert__(self) -> Filter:
        return not_(self)

    def columns(self) -> frozenset[str]:
        raise NotImplementedError

    def on(self, resolve: Callable[[str], Column | None]) -> Column:
        """The condition; ``resolve`` gives a column, or None if there is none of the name."""
        raise NotImplementedError

    def accepts(self, slice_: dict, missing: bool | None = None) -> bool:
        """Whether a slice of known coordinates passes; a column it lacks counts as null, or as ``missing``."""
        raise NotImplementedError


@dataclass(frozen=True)
class All(Filter):
    def columns(self):
        return frozenset()

    def on(self, resolve):
        return F.lit(True)

    def accepts(self, slice_, missing=None):
        return True


@dataclass(frozen=True)
class Nothing(Filter):
    def columns(self):
        return frozenset()

    def on(self, resolve):
        return F.lit(False)

    def accepts(self, slice_, missing=None):
        return False


ALL, NONE = All(), Nothing()


@dataclass(frozen=True)
class Where(Filter):
    column: str
    matcher: Matcher
    null_if_absent: bool = True

    def columns(self):
        return frozenset([self.column])

    def on(self, resolve):
        c = resolve(self.column)
        if c is None:
            return F.lit(self.null_if_absent and self.matcher.accepts(None))
        return self.matcher.on(c)

    def accepts(self, slice_, missing=None):
        if self.column not in slice_:
            return missing if missing is not None else self.null_if_absent and self.matcher.accepts(None)
        return self.matcher.accepts(slice_[self.column])


@dataclass(frozen=True)
class And(Filter):
    of: frozenset[Filter]

    def columns(self):
        return frozenset().union(*(f.columns() for f in self.of))

    def on(self, resolve):
        return reduce(lambda a, b: a & b, [f.on(resolve) for f in ordered(self.of)])

    def accepts(self, slice_, missing=None):
        return all(f.accepts(slice_, missing) for f in self.of)


@dataclass(frozen=True)
class Or(Filter):
    of: frozenset[Filter]

    def columns(self):
        return frozenset().union(*(f.columns() for f in self.of))

    def on(self, resolve):
        return reduce(lambda a, b: a | b, [F.coalesce(f.on(resolve), F.lit(False)) for f in ordered(self.of)])

    def accepts(self, slice_, missing=None):
        return any(f.accepts(slice_, missing) for f in self.of)


@dataclass(frozen=True)
class Not(Filter):
    of: Filter

    def columns(self):
        return self.of.columns()

    def on(self, resolve):
        return ~F.coalesce(self.of.on(resolve), F.lit(False))

    def accepts(self, slice_, missing=None):
        return not self.of.accepts(slice_, missing)


def ordered(filters: Iterable[Filter]) -> list[Filter]:
    """A stable order, so that equal filters give equal plans."""
    return sorted(filters, key=repr)


def and_(*filters: Filter) -> Filter:
    flat = set()
    for f in filters:
        flat |= set(f.of) if isinstance(f, And) else {f}
    flat.discard(ALL)
    if NONE in flat:
        return NONE
    pinned: dict[str, Any] = {}
    for f in flat:
        if isinstance(f, Where) and isinstance(f.matcher, Equals):
            if f.column in pinned and pinned[f.column] != f.matcher.operand:
                return NONE
            pinned[f.column] = f.matcher.operand
    # what an equality implies or denies needs no test of its own
    for f in list(flat):
        if isinstance(f, Where) and f.column in pinned and isinstance(f.matcher, (In, Comparing, IsNull)):
            if not f.matcher.accepts(pinned[f.column]):
                return NONE
            flat.discard(f)
    return ALL if not flat else next(iter(flat)) if len(flat) == 1 else And(frozenset(flat))


def or_(*filters: Filter) -> Filter:
    flat = set()
    for f in filters:
        flat |= set(f.of) if isinstance(f, Or) else {f}
    flat.discard(NONE)
    if ALL in flat:
        return ALL
    return NONE if not flat else next(iter(flat)) if len(flat) == 1 else Or(frozenset(flat))


def not_(f: Filter) -> Filter:
    if f == ALL:
        return NONE
    if f == NONE:
        return ALL
    if isinstance(f, Not):
        return f.of
    if isinstance(f, Where) and isinstance(f.matcher, (Comparing, NotMatcher)):
        return replace(f, matcher=f.matcher.negated())
    return Not(f)


def where(column: str, value: Any, null_if_absent: bool = True) -> Filter:
    """A condition on one column, by ``matcher``; an empty collection matches nothing."""
    if isinstance(value, (list, tuple, set, frozenset)) and not list(_flat(value)):
        return NONE
    return Where(column, matcher(value), null_if_absent)


def compare(column: str, op: str, operand: Any, match_if_null: bool = False) -> Filter:
    return Where(column, Comparing(op, operand, match_if_null))


def like(column: str, pattern: str, ignore_case: bool = False) -> Filter:
    return Where(column, Like(pattern, ignore_case))


def conjuncts(f: Filter) -> frozenset[Filter]:
    return f.of if isinstance(f, And) else frozenset() if f == ALL else frozenset([f])


def common(filters: list[Filter]) -> Filter:
    """The conditions that all filters share."""
    return and_(*frozenset.intersection(*(conjuncts(f) for f in filters))) if filters else ALL


def without(f: Filter, shared: Filter) -> Filter:
    """``f`` given that ``shared`` holds."""
    return and_(*(conjuncts(f) - conjuncts(shared)))


def pinned(f: Filter) -> dict[str, tuple]:
    """Columns that the filter binds to values, by equality, IN or IS NULL."""
    out: dict[str, tuple] = {}
    for x in conjuncts(f):
        if isinstance(x, Where):
            if isinstance(x.matcher, Equals):
                out[x.column] = (x.matcher.operand,)
            elif isinstance(x.matcher, In):
                out[x.column] = x.matcher.operands
            elif isinstance(x.matcher, IsNull):
                out[x.column] = (None,)
    return out


def to_json(f: Filter) -> dict:
    """A filter as plain data."""
    if isinstance(f, All):
        return {"type": "all"}
    if isinstance(f, Nothing):
        return {"type": "none"}
    if isinstance(f, (And, Or)):
        return {"type": type(f).__name__.lower(), "filters": [to_json(x) for x in ordered(f.of)]}
    if isinstance(f, Not):
        return {"type": "not", "filter": to_json(f.of)}
    return {"type": "column", "column": f.column, "matcher": _matcher_json(f.matcher), **({} if f.null_if_absent else {"null_if_absent": False})}


def _matcher_json(m: Matcher) -> Any:
    if isinstance(m, Equals):
        return m.operand
    if isinstance(m, IsNull):
        return None
    if isinstance(m, In):
        return list(m.operands)
    if isinstance(m, (AllOf, AnyOf)):
        return {"type": "and" if isinstance(m, AllOf) else "or", "of": [_matcher_json(x) for x in m.of]}
    if isinstance(m, NotMatcher):
        return {"type": "not", "of": _matcher_json(m.of)}
    kinds = {Comparing: "compare", Like: "like", Regex: "regex", Text: "text"}
    if type(m) not in kinds:
        raise ValueError(f"no JSON form for {m!r}")
    return {"type": kinds[type(m)], **m.__dict__}


def from_json(x: dict) -> Filter:
    """The inverse of ``to_json``."""
    kind = x["type"]
    if kind in ("all", "none"):
        return ALL if kind == "all" else NONE
    if kind in ("and", "or"):
        return (and_ if kind == "and" else or_)(*map(from_json, x["filters"]))
    if kind == "not":
        return not_(from_json(x["filter"]))
    return Where(x["column"], _matcher_from(x.get("matcher")), x.get("null_if_absent", True))


def _matcher_from(x: Any) -> Matcher:
    if not isinstance(x, dict):
        return matcher(x)
    kind, rest = x["type"], {k: v for k, v in x.items() if k != "type"}
    if kind in ("and", "or"):
        return (AllOf if kind == "and" else AnyOf)(tuple(map(_matcher_from, rest["of"])))
    if kind == "not":
        return _matcher_from(rest["of"]).negated()
    return {"compare": Comparing, "like": Like, "regex": Regex, "text": Text}[kind](**rest)


TOKEN = re.compile(r"\s*(?:(\()|(\))|(;|\band\b)|(,|\bor\b)|([\w.~@\-]+)\s*(==|!=|=in=|=out=|=like=|=isnull=|=gt=|=ge=|=lt=|=le=|>=|<=|>|<)\s*(\([^)]*\)|'[^']*'|\"[^\"]*\"|[^\s;,()]+))")


def parse(text: str) -> Filter:
    """A filter out of RSQL text: ``a==b;c=in=(d,e),f>3`` (; is and, binding tighter than the comma's or)."""
    at, tokens = 0, []
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not understood from {text[at:]!r}")
        tokens.append(m.groups())
        at = m.end()

    def disjunction() -> Filter:
        out = [conjunction()]
        while tokens and tokens[0][3]:
            tokens.pop(0)
            out.append(conjunction())
        return or_(*out)

    def conjunction() -> Filter:
        out = [atom()]
        while tokens and tokens[0][2]:
            tokens.pop(0)
            out.append(atom())
        return and_(*out)

    def atom() -> Filter:
        if not tokens:
            raise ValueError("a condition is missing")
        t = tokens.pop(0)
        if t[0]:
            inner = disjunction()
            if not tokens or not tokens.pop(0)[1]:
                raise ValueError("a parenthesis is not closed")
            return inner
        if not t[4]:
            raise ValueError("a condition is missing")
        return _condition(t[4], t[5], t[6])

    out = disjunction()
    if tokens:
        raise ValueError("text after the filter")
    return out


def _literal(x: str) -> Any:
    x = x.strip()
    if x[:1] in "'\"" and x[-1:] == x[:1]:
        return x[1:-1]
    if re.fullmatch(r"-?\d+", x):
        return int(x)
    return float(x) if re.fullmatch(r"-?\d+\.\d+", x) else None if x == "null" else x


def _condition(column: str, op: str, raw: str) -> Filter:
    if op in ("=in=", "=out="):
        f = where(column, [_literal(x) for x in raw.strip("()").split(",")])
        return f if op == "=in=" else not_(f)
    value = _literal(raw)
    if op == "=isnull=":
        return where(column, None) if raw.lower() == "true" else not_(where(column, None))
    if op == "=like=":
        return like(column, str(value).replace("*", "%"))
    if op in ("==", "!="):
        f = like(column, value.replace("*", "%")) if isinstance(value, str) and "*" in value else where(column, value)
        return f if op == "==" else not_(f)
    return compare(column, {"=gt=": ">", "=ge=": ">=", "=lt=": "<", "=le=": "<="}.get(op, op), value)


# --- editors -------------------------------------------------------------------------------------


def suppress(f: Filter, columns: Iterable[str]) -> Filter:
    """``f`` with conditions on these columns left out; of an OR the other operands stay."""
    columns = frozenset(columns)
    if isinstance(f, Where):
        return ALL if f.column in columns else f
    if isinstance(f, And):
        return and_(*(suppress(x, columns) for x in f.of))
    if isinstance(f, Or):
        kept = [suppress(x, columns) for x in f.of]
        kept = [k for k, x in zip(kept, f.of, strict=True) if k != ALL or x == ALL]
        return or_(*kept) if kept else ALL
    if isinstance(f, Not):
        inner = suppress(f.of, columns)
        return ALL if inner == ALL and f.of != ALL else not_(inner)
    return f


def retain(f: Filter, columns: Iterable[str]) -> Filter:
    """``f`` with only the conditions on these columns; defined on conjunctions only."""
    columns = frozenset(columns)
    if isinstance(f, Where):
        return f if f.column in columns else ALL
    if isinstance(f, And):
        return and_(*(retain(x, columns) for x in f.of))
    if isinstance(f, (All, Nothing)):
        return f
    raise ValueError("only conjunctions can be reduced to some columns")


def shift(f: Filter, column: str, value: Any, only_if_present: bool = False) -> Filter:
    """``f`` with the column forced to a value, or its operands mapped where ``value`` is a function."""
    if callable(value):
        return _mapped(f, column, value)
    if column in f.columns():
        return and_(suppress(f, [column]), where(column, value))
    return f if only_if_present else and_(f, where(column, value))


def _mapped(f: Filter, column: str, function: Callable[[Any], Any]) -> Filter:
    if isinstance(f, Where) and f.column == column:
        m = f.matcher
        if isinstance(m, Equals):
            return where(column, function(m.operand))
        if isinstance(m, In):
            return where(column, [function(x) for x in m.operands])
        return f
    if isinstance(f, And):
        return and_(*(_mapped(x, column, function) for x in f.of))
    if isinstance(f, Or):
        return or_(*(_mapped(x, column, function) for x in f.of))
    return not_(_mapped(f.of, column, function)) if isinstance(f, Not) else f
