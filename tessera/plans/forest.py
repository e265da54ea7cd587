"""Forests: measures by name, forming a DAG; reading, writing, analysing, drawing and concealing them."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

from tessera.functions import filters as fl
from tessera.operators import decompositions as dc
from tessera.operators import measures as ms


@dataclass(frozen=True)
class Forest:
    """Measures by name. Forests are values: adding gives another."""

    measures: Mapping[str, ms.Measure] = field(default_factory=dict)
    name: str = "forest"

    @classmethod
    def of(cls, *measures: ms.Measure | Iterable[ms.Measure], name: str = "forest") -> Forest:
        return cls(name=name).add(*measures)

    def add(self, *measures: ms.Measure | Iterable[ms.Measure]) -> Forest:
        """With more measures; a name may come again only with an equal measure."""
        out = dict(self.measures)
        for m in measures:
            for one in [m] if isinstance(m, ms.Measure) else m:
                if one.name in out and out[one.name] != one:
                    raise ValueError(f"there is another measure {one.name}")
                out[one.name] = one
        return Forest(out, self.name)

    def get(self, name: str) -> ms.Measure | None:
        return self.measures.get(name)

    def all(self) -> dict[str, ms.Measure]:
        return dict(self.measures)

    def __len__(self) -> int:
        return len(self.measures)

    # --- analysis ---------------------------------------------------------------------------------

    def edges(self) -> Iterator[tuple[str, str]]:
        """(measure, underlying) pairs."""
        for m in self.measures.values():
            for u in m.underlying_names():
                yield m.name, u if isinstance(u, str) else u.name

    def roots(self) -> list[str]:
        """Measures that no other is made of."""
        used = {u for _, u in self.edges()}
        return sorted(n for n in self.measures if n not in used)

    def leaves(self) -> list[str]:
        return sorted(n for n, m in self.measures.items() if not m.underlying_names())

    def unknown(self) -> list[str]:
        """Names that measures speak of and that are none."""
        return sorted({u for _, u in self.edges()} - set(self.measures))

    def reachable(self, names: Iterable[str]) -> Forest:
        """The part of the forest that some measures need."""
        out: dict[str, ms.Measure] = {}
        todo = list(names)
        while todo:
            n = todo.pop()
            if n in self.measures and n not in out:
                out[n] = self.measures[n]
                todo += [u if isinstance(u, str) else u.name for u in out[n].underlying_names()]
        return Forest(out, self.name)

    def cycle(self) -> list[str] | None:
        """Measures that go round in a circle, if there are any."""
        below: dict[str, list[str]] = {}
        for a, b in self.edges():
            below.setdefault(a, []).append(b)
        state: dict[str, int] = {}
        for start in self.measures:
            path = [(start, iter(below.get(start, ())))]
            if state.get(start):
                continue
            state[start] = 1
            while path:
                n, rest = path[-1]
                for u in rest:
                    if state.get(u) == 1:
                        names = [p for p, _ in path]
                        return [*names[names.index(u) :], u]
                    if u not in state:
                        state[u] = 1
                        path.append((u, iter(below.get(u, ()))))
                        break
                else:
                    state[n] = 2
                    path.pop()
        return None

    def visit(self, visitor: Callable[[ms.Measure], Iterable[ms.Measure]]) -> Forest:
        """With the measures that a visitor makes of each."""
        return self.add(*(made for m in list(self.measures.values()) for made in visitor(m)))

    # --- drawings -----------------------------------------------------------------------------------

    def mermaid(self) -> str:
        ids = {n: f"m{i}" for i, n in enumerate(sorted({*self.measures, *self.unknown()}))}
        lines = ["graph TD"]
        lines += [f'    {ids[n]}["{n}<br/>{type(self.measures[n]).__name__ if n in self.measures else "unknown"}"]' for n in ids]
        return "\n".join(lines + [f"    {ids[a]} --> {ids[b]}" for a, b in self.edges()])

    def graphviz(self) -> str:
        quote = json.dumps
        lines = [f"  {quote(n)} [label={quote(f'{n} ({type(m).__name__})')}];" for n, m in self.measures.items()]
        return "\n".join(["digraph forest {", *lines, *(f"  {quote(a)} -> {quote(b)};" for a, b in self.edges()), "}"])

    # --- text -----------------------------------------------------------------------------------------

    def to_list(self) -> list[dict]:
        return [_to_dict(m) for m in self.measures.values()]

    def to_json(self) -> str:
        return json.dumps(self.to_list(), indent=2, default=_plain)

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(json.loads(self.to_json()), sort_keys=False, allow_unicode=True)

    @classmethod
    def from_list(cls, items: Iterable[Mapping[str, Any]], name: str = "forest") -> Forest:
        """Measures out of plain data; an underlying may itself be a measure, with or without a name."""
        counter = itertools.count()
        return cls.of(*(m for x in items for m in _from_dict(x, counter)), name=name)

    @classmethod
    def from_json(cls, text: str, name: str = "forest") -> Forest:
        return cls.from_list(json.loads(text), name)

    @classmethod
    def from_yaml(cls, text: str, name: str = "forest") -> Forest:
        import yaml

        return cls.from_list(yaml.safe_load(text), name)

    # --- sharing ----------------------------------------------------------------------------------------

    def concealed(self, salt: str) -> Forest:
        """The same forest with names of measures and columns, and values in filters, replaced by hashes."""

        def hide(x: str) -> str:
            return x if x == "*" else "h" + hashlib.sha256(f"{salt}:{x}".encode()).hexdigest()[:12]

        def matcher_of(m: fl.Matcher) -> fl.Matcher:
            if isinstance(m, fl.Equals):
                return fl.Equals(hide(str(m.operand)))
            if isinstance(m, fl.In):
                return fl.In(tuple(hide(str(v)) for v in m.operands))
            if isinstance(m, (fl.AnyOf, fl.AllOf)):
                return type(m)(tuple(map(matcher_of, m.of)))
            if isinstance(m, fl.NotMatcher):
                return fl.NotMatcher(matcher_of(m.of))
            if isinstance(m, fl.IsNull):
                return m
            raise ValueError(f"cannot conceal {m!r}")

        def filter_of(f: fl.Filter) -> fl.Filter:
            if isinstance(f, fl.Where):
                return fl.Where(hide(f.column), matcher_of(f.matcher), f.null_if_absent)
            if isinstance(f, (fl.And, fl.Or)):
                return (fl.and_ if isinstance(f, fl.And) else fl.or_)(*map(filter_of, f.of))
            return fl.not_(filter_of(f.of)) if isinstance(f, fl.Not) else f

        out = []
        for m in self.measures.values():
            changes: dict[str, Any] = {"name": hide(m.name)}
            for k in fields(m):
                v = getattr(m, k.name)
                if k.name == "underlying":
                    changes[k.name] = hide(v)
                elif k.name == "underlyings":
                    changes[k.name] = tuple(hide(u) for u in v)
                elif k.name == "filter":
                    changes[k.name] = filter_of(v)
                elif k.name == "columns" or k.name == "group_by":
                    changes[k.name] = tuple(hide(c) for c in v)
                elif k.name == "column":
                    if getattr(m, "aggregation", None) == "expression":
                        raise ValueError("cannot conceal SQL text")
                    changes[k.name] = hide(v if v is not None else m.name)
                elif k.name in ("decomposition", "route", "editor") and v is not None:
                    raise ValueError(f"cannot conceal {type(v).__name__}")
                elif k.name == "tags":
                    changes[k.name] = frozenset(hide(t) for t in v)
                elif k.name == "value" and isinstance(v, str):
                    changes[k.name] = hide(v)
            out.append(replace(m, **changes))
        return Forest.of(*out, name=hide(self.name))


TYPES = {t.__name__: t for t in (ms.Aggregator, ms.Combinator, ms.Filtrator, ms.Unfiltrator, ms.Shiftor, ms.Partitionor, ms.Dispatchor, ms.Columnator, ms.EmptyMeasure)}


def _plain(x: Any) -> Any:
    if isinstance(x, (set, frozenset, tuple)):
        return sorted(x) if isinstance(x, (set, frozenset)) else list(x)
    raise ValueError(f"{x!r} has no plain form")


def _to_dict(m: ms.Measure) -> dict:
    if type(m).__name__ not in TYPES:
        raise ValueError(f"{type(m).__name__} has no plain form")
    out: dict[str, Any] = {"name": m.name, "type": type(m).__name__}
    for k in fields(m):
        v = getattr(m, k.name)
        if k.name == "name" or v == _default(k):
            continue
        if k.name == "decomposition":
            out[k.name] = dc.to_plain(v)
            continue
        if k.name == "editor" and (key := next((e for e, f in ms.EDITORS.items() if f is v), None)):
            out[k.name] = key
            continue
        if callable(v):
            raise ValueError(f"{k.name} of {m.name} is a function")
        out[k.name] = fl.to_json(v) if isinstance(v, fl.Filter) else sorted(v) if isinstance(v, frozenset) else list(v) if isinstance(v, tuple) else dict(v) if isinstance(v, Mapping) else v
    return out


def _default(k: Any) -> Any:
    from dataclasses import MISSING

    return k.default if k.default is not MISSING else k.default_factory() if k.default_factory is not MISSING else MISSING


def _from_dict(x: Mapping[str, Any], counter: Iterator[int]) -> list[ms.Measure]:
    kind = TYPES.get(str(x.get("type", "")).lstrip("."))
    if kind is None:
        raise ValueError(f"unknown type of measure {x.get('type')!r}")
    nested: list[ms.Measure] = []

    def named(u: Any) -> str:
        if isinstance(u, str):
            return u
        made = _from_dict(u, counter)
        nested.extend(made)
        return made[0].name

    values: dict[str, Any] = {"name": x.get("name") or f"anonymous-{next(counter)}"}
    for k in fields(kind):
        if k.name in ("name",) or k.name not in x:
            continue
        v = x[k.name]
        if k.name in ("decomposition", "editor") and v is not None:
            values[k.name] = dc.from_plain(v) if k.name == "decomposition" else ms.EDITORS[v]
            continue
        values[k.name] = named(v) if k.name == "underlying" else tuple(map(named, v)) if k.name == "underlyings" else fl.from_json(v) if k.name == "filter" else frozenset(v) if k.name == "tags" else tuple(v) if isinstance(v, list) else v
    return [kind(**values), *nested]
