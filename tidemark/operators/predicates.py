"""Predicates over a point's time and its device's values, compiled to Spark columns.

Truth has two values: a leaf on a null is false (``is_null`` apart), and ``Not`` of it is true.  No
leaf compares different types: a literal of another type than the column's equals nothing and
differs from everything that isn't null.  NaN is unequal to all, itself too, and in no order.

``condition`` compiles for a filter.  A tree without ``Not`` keeps bare comparisons, which Parquet can
push down; ``Not`` is moved to the leaves by De Morgan, where it reads "null or the opposite", which
can be pushed down too.  ``truth`` compiles to a column that is never null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import Unsupported
from tidemark.types import DataType, Lit

_OPPOSITE = {"gt": "lte", "lte": "gt", "gte": "lt", "lt": "gte", "eq": "ne", "ne": "eq", "in": "not_in", "not_in": "in"}


def _compare(op: str, col: Column, arg) -> Column:
    """A bare comparison: null for a null column."""
    if op == "in":
        return col.isin(*arg) if arg else F.lit(False)
    if op == "not_in":
        return ~col.isin(*arg) if arg else F.lit(True)
    if op == "between":
        return col.between(*arg)
    return {"gt": col.__gt__, "gte": col.__ge__, "lt": col.__lt__, "lte": col.__le__, "eq": col.__eq__, "ne": col.__ne__}[op](arg)


class _Node:
    def __and__(self, other: _Node) -> And:
        return And([self, other])

    def __or__(self, other: _Node) -> Or:
        return Or([self, other])

    def __invert__(self) -> Not:
        return Not(self)

    def simplify(self) -> _Node:
        """Single-child And and Or unwrapped, nested ones of a kind merged, double Not removed."""
        return self


# ---- leaves


@dataclass(frozen=True)
class Time(_Node):
    """A test of the time: gt, gte, lt, lte, eq, ne (a time), between (two, both inclusive), in, not_in."""

    op: str
    arg: object

    def matches(self, t: int) -> bool:
        a = self.arg
        return {
            "gt": lambda: t > a, "gte": lambda: t >= a, "lt": lambda: t < a, "lte": lambda: t <= a, "eq": lambda: t == a, "ne": lambda: t != a,
            "between": lambda: a[0] <= t <= a[1], "in": lambda: t in a, "not_in": lambda: t not in a,
        }[self.op]()

    def may_match(self, low, high) -> bool:
        """Whether a block with times from low to high can hold a match."""
        a = self.arg
        return {
            "gt": lambda: high > a, "gte": lambda: high >= a, "lt": lambda: low < a, "lte": lambda: low <= a, "eq": lambda: low <= a <= high, "ne": lambda: True,
            "between": lambda: low <= a[1] and high >= a[0], "in": lambda: any(low <= x <= high for x in a), "not_in": lambda: True,
        }[self.op]()

    def negate(self) -> Time:
        """The opposite test; ``between`` has none and stays (use Not)."""
        return self if self.op == "between" else Time(_OPPOSITE[self.op], self.arg)

    def block_condition(self, low: Column, high: Column) -> Column:
        a = self.arg
        return {
            "gt": lambda: high > a, "gte": lambda: high >= a, "lt": lambda: low < a, "lte": lambda: low <= a, "eq": lambda: (low <= a) & (high >= a), "ne": lambda: F.lit(True),
            "between": lambda: (low <= a[1]) & (high >= a[0]), "in": lambda: reduce(Column.__or__, [(low <= x) & (high >= x) for x in a], F.lit(False)), "not_in": lambda: F.lit(True),
        }[self.op]()


@dataclass(frozen=True)
class Value(_Node):
    """A test of a measurement: as Time's, without between, and is_null, is_not_null; literals are typed."""

    measurement: str
    op: str
    arg: object = None

    def negate(self) -> Value:
        """The opposite test, which isn't a logical Not where the value is null."""
        swap = {"is_null": "is_not_null", "is_not_null": "is_null"}
        return Value(self.measurement, swap.get(self.op) or _OPPOSITE[self.op], self.arg)

    def _literals(self, kind: DataType) -> tuple[list, bool]:
        """The literals that can equal a value of the column, and whether any is left out."""
        args = list(self.arg) if self.op in ("in", "not_in") else [self.arg]
        fit = [a.value for a in args if a.kind is kind]
        number = [v for v in fit if not (kind.floating and math.isnan(v))]
        return number, len(number) < len(args)

    def condition(self, col: Column | None, kind: DataType | None, negated: bool) -> Column:
        if self.op in ("is_null", "is_not_null"):
            wants_null = (self.op == "is_null") != negated
            if col is None:
                return F.lit(wants_null)
            return col.isNull() if wants_null else col.isNotNull()
        if col is None:  # absent: every comparison is false
            return F.lit(negated)
        fit, _ = self._literals(kind)
        differs = self.op in ("ne", "not_in")
        if not fit:  # nothing to equal or to be in order with
            out = col.isNotNull() if differs else F.lit(False)
            return (col.isNull() if differs else F.lit(True)) if negated else out
        bare = _compare(self.op, col, [_lit(v, kind) for v in fit] if self.op in ("in", "not_in") else _lit(fit[0], kind))
        if not negated:
            if kind.floating:
                return (col.isNotNull() & (F.isnan(col) | bare)) if differs else (bare & ~F.isnan(col))
            return col.isNotNull() & bare if differs else bare
        back = _compare(_OPPOSITE[self.op], col, [_lit(v, kind) for v in fit] if self.op in ("in", "not_in") else _lit(fit[0], kind))
        if kind.floating:
            return col.isNull() | (back & ~F.isnan(col)) if differs else col.isNull() | F.isnan(col) | back
        return col.isNull() | back

    def matches(self, v, kind: DataType | None) -> bool:
        if self.op in ("is_null", "is_not_null"):
            return (v is None) == (self.op == "is_null")
        if v is None:
            return False
        fit, _ = self._literals(kind)
        if self.op in ("eq", "in"):
            return v in fit
        if self.op in ("ne", "not_in"):
            return v not in fit
        if not fit:
            return False
        return {"gt": v > fit[0], "gte": v >= fit[0], "lt": v < fit[0], "lte": v <= fit[0]}[self.op]

    def may_match(self, low, high, kind: DataType) -> bool:
        if self.op in ("is_null", "is_not_null", "ne", "not_in") or low is None or high is None:
            return True
        fit, odd = self._literals(kind)
        if self.op in ("eq", "in"):
            return any(low <= x <= high for x in fit)
        if not fit:
            return False
        x = fit[0]
        return {"gt": high > x, "gte": high >= x, "lt": low < x, "lte": low <= x}[self.op]

    def block_condition(self, low: Column | None, high: Column | None, kind: DataType) -> Column:
        if low is None or self.op in ("is_null", "is_not_null", "ne", "not_in"):
            return F.lit(True)
        fit, _ = self._literals(kind)
        known = low.isNull() | high.isNull()
        if self.op in ("eq", "in"):
            return known | reduce(Column.__or__, [(low <= x) & (high >= x) for x in fit], F.lit(False))
        if not fit:
            return F.lit(False)
        x = fit[0]
        return known | {"gt": high > x, "gte": high >= x, "lt": low < x, "lte": low <= x}[self.op]


def _lit(v, kind: DataType) -> Column:
    return F.lit(v).cast(kind.spark)


# ---- inner nodes


@dataclass(frozen=True)
class And(_Node):
    """All of them; of none: true."""

    parts: list = field(default_factory=list)

    def simplify(self) -> _Node:
        return _merge(And, self.parts)


@dataclass(frozen=True)
class Or(_Node):
    """Any of them; of none: false."""

    parts: list = field(default_factory=list)

    def simplify(self) -> _Node:
        return _merge(Or, self.parts)


@dataclass(frozen=True)
class Not(_Node):
    """Two-valued: true wherever the part isn't."""

    part: _Node

    def simplify(self) -> _Node:
        inner = self.part.simplify()
        return inner.part if isinstance(inner, Not) else Not(inner)


def _merge(kind: type, parts: list) -> _Node:
    flat: list = []
    for p in (p.simplify() for p in parts):
        flat += p.parts if isinstance(p, kind) else [p]
    return flat[0] if len(flat) == 1 else kind(flat)


# ---- shorthands: time and value tests by name


def time_range(low, high) -> Time:
    return Time("between", (low, high))


class measurement:  # noqa: N801
    """``measurement("temperature") > Lit.float64(20)`` and the like."""

    def __init__(self, name: str):
        self.name = name

    def __gt__(self, v: Lit) -> Value:
        return Value(self.name, "gt", v)

    def __ge__(self, v: Lit) -> Value:
        return Value(self.name, "gte", v)

    def __lt__(self, v: Lit) -> Value:
        return Value(self.name, "lt", v)

    def __le__(self, v: Lit) -> Value:
        return Value(self.name, "lte", v)

    def __eq__(self, v: Lit) -> Value:  # type: ignore[override]
        return Value(self.name, "eq", v)

    def __ne__(self, v: Lit) -> Value:  # type: ignore[override]
        return Value(self.name, "ne", v)

    __hash__ = None  # type: ignore[assignment]

    def is_in(self, *v: Lit) -> Value:
        return Value(self.name, "in", tuple(v))

    def not_in(self, *v: Lit) -> Value:
        return Value(self.name, "not_in", tuple(v))

    def is_null(self) -> Value:
        return Value(self.name, "is_null")

    def is_not_null(self) -> Value:
        return Value(self.name, "is_not_null")


# ---- compiling


def condition(p: _Node, time: Column, values: dict[str, tuple[Column, DataType]], negated: bool = False) -> Column:
    """A column that is true exactly where ``p`` holds, and false or null elsewhere: for a filter."""
    if isinstance(p, And | Or):
        both = isinstance(p, And) != negated
        parts = [condition(x, time, values, negated) for x in p.parts]
        return reduce(Column.__and__ if both else Column.__or__, parts) if parts else F.lit(both)
    if isinstance(p, Not):
        return condition(p.part, time, values, not negated)
    if isinstance(p, Time):
        if negated and p.op == "between":
            return (time < p.arg[0]) | (time > p.arg[1])
        return _compare(_OPPOSITE[p.op] if negated else p.op, time, p.arg)
    if isinstance(p, Value):
        col, kind = values.get(p.measurement, (None, None))
        return p.condition(col, kind, negated)
    raise Unsupported(f"no predicate: {p!r}")


def truth(p: _Node, time: Column, values: dict[str, tuple[Column, DataType]]) -> Column:
    """As a Boolean column that is never null."""
    return F.coalesce(condition(p, time, values), F.lit(False))


def evaluate(p: _Node, t: int, row: dict[str, tuple[object, DataType]]) -> bool:
    """The truth for one point, in Python."""
    if isinstance(p, And):
        return all(evaluate(x, t, row) for x in p.parts)
    if isinstance(p, Or):
        return any(evaluate(x, t, row) for x in p.parts)
    if isinstance(p, Not):
        return not evaluate(p.part, t, row)
    if isinstance(p, Time):
        return p.matches(t)
    return p.matches(*row.get(p.measurement, (None, None)))


def may_match(p: _Node, low, high, stats: dict[str, tuple[object, object, DataType]]) -> bool:
    """Whether a block can hold a match, by its bounds of time and values; ``Not`` keeps every block."""
    if isinstance(p, And):
        return all(may_match(x, low, high, stats) for x in p.parts)
    if isinstance(p, Or):
        return any(may_match(x, low, high, stats) for x in p.parts)
    if isinstance(p, Time):
        return p.may_match(low, high)
    if isinstance(p, Value) and p.measurement in stats:
        return p.may_match(*stats[p.measurement])
    return True


def block_condition(p: _Node, low: Column, high: Column, stats: dict[str, tuple[Column, Column, DataType]]) -> Column:
    """``may_match`` as a column over a table of blocks."""
    if isinstance(p, And | Or):
        parts = [block_condition(x, low, high, stats) for x in p.parts]
        return reduce(Column.__and__ if isinstance(p, And) else Column.__or__, parts) if parts else F.lit(isinstance(p, And))
    if isinstance(p, Time):
        return p.block_condition(low, high)
    if isinstance(p, Value) and p.measurement in stats:
        return p.block_condition(*stats[p.measurement])
    return F.lit(True)
