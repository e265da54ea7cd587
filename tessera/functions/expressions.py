"""Formulas as text: an infix dialect and reverse Polish notation, compiled to Spark columns.

The infix dialect has numbers, "strings", names (also with dots, and ``underlyings[i]``), the
operators + - * / % ^, comparisons (= == != <> > >= < <=), && and || and !, and the functions of
FUNCTIONS. ``+`` with a string joins texts. Unknown functions are errors, never guesses.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.combinations import Context, combination, present

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|\"([^\"]*)\"|(underlyings\[\d+\]|[A-Za-z_~][\w.~]*)|(&&|\|\||==|!=|<>|>=|<=|[-+*/%^=<>!(),]))")
LEVELS = [["||"], ["&&"], ["=", "==", "!=", "<>"], ["<", "<=", ">", ">="], ["+", "-"], ["*", "/", "%"], ["^"]]


def _double(c: Column) -> Column:
    return c.cast("double")


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "IF": lambda c, a, b: F.when(c, a).otherwise(b),
    "ABS": F.abs,
    "CEILING": F.ceil,
    "FLOOR": F.floor,
    "ROUND": lambda x, n=None: F.round(x, n if n is not None else F.lit(0)),
    "SQRT": F.sqrt,
    "LOG": F.log,
    "LOG10": F.log10,
    "MAX": lambda *x: F.greatest(*x) if len(x) > 1 else x[0],
    "MIN": lambda *x: F.least(*x) if len(x) > 1 else x[0],
    "SUM": lambda *x: sum(x[1:], x[0]),
    "NOT": lambda x: ~x,
    "COALESCE": F.coalesce,
    "STR_UPPER": F.upper,
    "STR_LOWER": F.lower,
    "STR_TRIM": F.trim,
    "STR_LENGTH": F.length,
    "STR_CONTAINS": lambda a, b: F.contains(F.lower(a), F.lower(b)),
    "STR_STARTS_WITH": F.startswith,
    "STR_ENDS_WITH": F.endswith,
    "STR_SUBSTRING": lambda x, a, b=None: F.substring(x, a + 1, (b - a) if b is not None else F.length(x)),
}


class _Parser:
    def __init__(self, text: str, resolve: Callable[[str], Column]):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not understood in {text!r} from {text[at:]!r}")
            kind = next(k for k, v in zip(("number", "string", "name", "op"), m.groups(), strict=True) if v is not None)
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.resolve = resolve
        self.names: list[str] = []

    def peek(self) -> str | None:
        return self.tokens[0][1] if self.tokens and self.tokens[0][0] == "op" else None

    def take(self, op: str) -> None:
        if self.peek() != op:
            raise ValueError(f"{op!r} is missing")
        self.tokens.pop(0)

    def binary(self, level: int) -> tuple[Column, bool]:
        if level == len(LEVELS):
            return self.unary()
        left, text = self.binary(level + 1)
        while (op := self.peek()) in LEVELS[level]:
            self.tokens.pop(0)
            right, also = self.binary(level if op == "^" else level + 1)
            left, text = self.apply(op, left, right, text or also)
        return left, text

    def apply(self, op: str, a: Column, b: Column, text: bool) -> tuple[Column, bool]:
        if op == "+" and text:
            return F.concat(a.cast("string"), b.cast("string")), True
        if op == "/":
            return F.try_divide(_double(a), _double(b)), False
        made = {
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b, "^": lambda: F.pow(a, b), "||": lambda: a | b, "&&": lambda: a & b,
            "=": lambda: a == b, "==": lambda: a == b, "!=": lambda: a != b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
        }
        return made[op](), False

    def unary(self) -> tuple[Column, bool]:
        if self.peek() in ("-", "+", "!"):
            op = self.tokens.pop(0)[1]
            x, _ = self.unary()
            return {"-": lambda: -x, "+": lambda: x, "!": lambda: ~x}[op](), False
        if self.peek() == "(":
            self.take("(")
            x = self.binary(0)
            self.take(")")
            return x
        if not self.tokens:
            raise ValueError("the formula ends too early")
        kind, value = self.tokens.pop(0)
        if kind == "number":
            return F.lit(float(value) if re.search(r"[.eE]", value) else int(value)), False
        if kind == "string":
            return F.lit(value), True
        if kind == "name" and self.peek() == "(":
            return self.call(value)
        if kind == "name":
            if value in ("TRUE", "FALSE", "true", "false"):
                return F.lit(value.lower() == "true"), False
            if value in ("NULL", "null"):
                return F.lit(None), False
            if value not in self.names:
                self.names.append(value)
            return self.resolve(value), False
        raise ValueError(f"{value!r} is out of place")

    def call(self, name: str) -> tuple[Column, bool]:
        if name.upper() not in FUNCTIONS:
            raise ValueError(f"unknown function {name}")
        self.take("(")
        args = []
        while self.peek() != ")":
            args.append(self.binary(0))
            if self.peek() == ",":
                self.take(",")
        self.take(")")
        text = name.upper() in ("STR_UPPER", "STR_LOWER", "STR_TRIM", "STR_SUBSTRING") or (name.upper() == "IF" and any(t for _, t in args[1:]))
        return FUNCTIONS[name.upper()](*(a for a, _ in args)), text


def infix(text: str, resolve: Callable[[str], Column]) -> Column:
    """Compile a formula; ``resolve`` gives the column of a name."""
    p = _Parser(text, resolve)
    out, _ = p.binary(0)
    if p.tokens:
        raise ValueError(f"text after the formula {text!r}")
    return out


def names_of(text: str) -> list[str]:
    """The names in a formula, in order of their first use."""
    p = _Parser(text, lambda _: F.lit(None))
    p.binary(0)
    return p.names


REFERENCE = re.compile(r"(?:aggregatedValue|underlyings)\[([^\]]+)\]")


def polish_names(notation: str) -> list[str]:
    """The measures of a reverse Polish formula, in order of their first use."""
    return list(dict.fromkeys(REFERENCE.findall(notation)))


def polish(notation: str, values: Sequence[Column], two_operands: bool = False, null_if_none: bool = True) -> Column:
    """Compile reverse Polish notation: ``underlyings[m],double[10000],*``.

    Operators take the whole stack unless ``two_operands`` or they have two by nature (- and /).
    Parentheses make a formula of their own. With ``null_if_none`` the result is null where all
    measures of the formula are.
    """
    by_name = dict(zip(polish_names(notation), values, strict=False))
    inner: list[Column | None] = []

    def evaluate(text: str) -> Column | None:
        stack: list[Column | None] = []
        for raw in text.split(","):
            s = raw.strip()
            if m := REFERENCE.fullmatch(s):
                stack.append(by_name[m[1]])
            elif m := re.fullmatch(r"double\[([^\]]+)\]", s):
                stack.append(F.lit(float(m[1])))
            elif m := re.fullmatch(r"int\[([^\]]+)\]", s):
                stack.append(F.lit(int(m[1])))
            elif s == "null":
                stack.append(None)
            elif s.startswith("$"):
                stack.append(inner[int(s[1:])])
            elif re.fullmatch(r"-?\d+", s):
                stack.append(F.lit(int(s)))
            elif re.fullmatch(r"-?\d+\.\d+(?:[Ee][+-]?\d+)?", s):
                stack.append(F.lit(float(s)))
            else:
                two = two_operands or s in ("-", "/", "SUBSTRACTION", "DIVIDE")
                operands = stack[-2:] if two else stack[:]
                if two and len(operands) < 2:
                    raise ValueError(f"{s} lacks an operand in {notation!r}")
                del stack[-len(operands) :]
                stack.append(combination(s)([F.lit(None) if x is None else x for x in operands], {}, Context()))
        if len(stack) != 1:
            return None
        return stack[0]

    text = notation
    while m := re.search(r"\(([^()]*)\)", text):
        inner.append(evaluate(m[1]))
        text = f"{text[: m.start()]}${len(inner) - 1}{text[m.end() :]}"
    out = evaluate(text)
    out = F.lit(None) if out is None else out
    if null_if_none:
        out = F.when(present(list(by_name.values())), out)
    return out
