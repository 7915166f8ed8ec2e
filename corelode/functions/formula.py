"""Formulas over columns, compiled to one Spark expression.

Grammar: ``+ - * / ^``, parentheses, numbers, ``{column name}`` or bare names, and nine functions.
``^`` associates to the left and a single unary minus binds tighter than it.  Arithmetic is
null-strict; division by zero, logarithms of non-positive and roots of negative values give null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.?\d*|\.\d+)|\{(?P<braced>[^}]+)\}|(?P<name>[A-Za-z_]\w*)|(?P<mark>[-+*/^(),]))")


def _guarded(fn, keep):
    return lambda x: F.when(keep(x), fn(x))


def _strict(fn):
    def call(*xs):
        if len(xs) < 2:
            raise ValueError("min and max take two or more arguments")
        every = xs[0].isNotNull()
        for x in xs[1:]:
            every = every & x.isNotNull()
        return F.when(every, fn(*xs))

    return call


FUNCTIONS = {
    "log": _guarded(F.log10, lambda x: x > 0),
    "log10": _guarded(F.log10, lambda x: x > 0),
    "ln": _guarded(F.ln, lambda x: x > 0),
    "sqrt": _guarded(F.sqrt, lambda x: x >= 0),
    "abs": F.abs,
    "exp": F.exp,
    "pow": F.pow,
    "min": _strict(F.least),
    "max": _strict(F.greatest),
}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:].strip()[0]!r} in formula")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str, resolve):
        self.rest, self.resolve, self.names = _tokens(text)[::-1], resolve, []

    def take(self, *marks: str) -> str | None:
        if self.rest and self.rest[-1][0] == "mark" and self.rest[-1][1] in marks:
            return self.rest.pop()[1]
        return None

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise ValueError(f"expected {mark!r} in formula")

    def sum(self) -> Column:
        left = self.product()
        while op := self.take("+", "-"):
            right = self.product()
            left = left + right if op == "+" else left - right
        return left

    def product(self) -> Column:
        left = self.power()
        while op := self.take("*", "/"):
            right = self.power()
            left = left * right if op == "*" else F.try_divide(left, right)
        return left

    def power(self) -> Column:
        left = self.unary()
        while self.take("^"):
            left = F.pow(left, self.unary())
        return left

    def unary(self) -> Column:
        return -self.atom() if self.take("-") else self.atom()

    def atom(self) -> Column:
        if self.take("("):
            inner = self.sum()
            self.need(")")
            return inner
        if not self.rest or self.rest[-1][0] == "mark":
            raise ValueError("formula ends or has an operator where a value is due")
        kind, text = self.rest.pop()
        if kind == "number":
            return F.lit(float(text))
        if kind == "name" and self.take("("):
            if text.lower() not in FUNCTIONS:
                raise ValueError(f"unknown function {text}")
            arguments = [self.sum()]
            while self.take(","):
                arguments.append(self.sum())
            self.need(")")
            return FUNCTIONS[text.lower()](*arguments)
        self.names.append(text)
        return self.resolve(text)


def compile_formula(text: str, resolve=lambda name: F.col(f"`{name}`").cast("double")) -> Column:
    """The formula as a Column; ``resolve`` maps a variable's name to one."""
    reader = _Reader(text, resolve)
    found = reader.sum()
    if reader.rest:
        raise ValueError("formula goes on after its end")
    return found


def variables(text: str) -> list[str]:
    """Names of the variables of a formula, each once, in order of appearance."""
    reader = _Reader(text, lambda name: F.lit(0.0))
    reader.sum()
    return list(dict.fromkeys(reader.names))


#: Texts that stand for a missing measurement, compared in upper case.
MISSING = ("", "-", "ND", "N/A", "NA", "NULL", "BDL")


def parse_censored(text: Column) -> Column:
    """``<x`` gives x/2, ``>x`` gives x, missing tokens null, else the leading number of the text."""
    trimmed = F.trim(text)
    number = lambda c: F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    rest = F.substring(trimmed, 2, 1_000_000)
    return (
        F.when(F.upper(trimmed).isin(*MISSING), None)
        .when(trimmed.startswith("<"), number(rest) / 2)
        .when(trimmed.startswith(">"), number(rest))
        .otherwise(number(trimmed))
    )
