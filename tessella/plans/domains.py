"""What a predicate says about a key: finite domains and ranges.

Three lattices share one shape: a leaf's knowledge, AND narrows, OR widens, and
anything else says nothing. Absence of knowledge (ANY) is always safe: the
predicate itself still filters the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from tessella.errors import InvalidArgument, NumericOutOfRange, TypeMismatch, Unsupported
from tessella.plans.syntax import Between, Binary, In, Literal, Name, Node, Param, Unary

ANY = None
INT64 = 1 << 63


def atom(x: Node, params: list) -> tuple[bool, object]:
    """(is it a constant?, its value): literals, bound parameters and signed numbers."""
    if isinstance(x, Literal):
        return True, x.value
    if isinstance(x, Param):
        return True, params[x.index - 1]
    if isinstance(x, Unary) and x.op in "+-" and isinstance(x.x, Literal) and type(x.x.value) in (int, float):
        return True, -x.x.value if x.op == "-" else x.x.value
    return False, None


def checked_key(value, kind: str):
    """A constant as a shard-key value, or the error it makes."""
    if kind == "int64":
        if type(value) is not int:
            raise TypeMismatch("the shard key is compared with a value of another type")
        if not -INT64 <= value < INT64:
            raise NumericOutOfRange("a shard-key value is out of the range of 64-bit integers")
        return value
    if kind == "text":
        if not isinstance(value, str):
            raise TypeMismatch("the shard key is compared with a value of another type")
        return value
    if not isinstance(value, (bytes, bytearray)):
        raise TypeMismatch("the shard key is compared with a value of another type")
    return bytes(value)


def meet(a: tuple | None, b: tuple | None) -> tuple | None:
    return b if a is ANY else a if b is ANY else tuple(x for x in a if x in b)


def join(a: tuple | None, b: tuple | None) -> tuple | None:
    return ANY if a is ANY or b is ANY else tuple(dict.fromkeys((*a, *b)))


def key_domain(x: Node | None, is_key: Callable[[Name], bool], kind: str, params: list) -> tuple | None:
    """Shard-key values a row must have for the predicate to hold; only ``=`` teaches.

    Errors of constants come out of every branch.
    """
    if not isinstance(x, Binary):
        return ANY
    if x.op in ("and", "or"):
        a, b = key_domain(x.a, is_key, kind, params), key_domain(x.b, is_key, kind, params)
        return meet(a, b) if x.op == "and" else join(a, b)
    if x.op == "=":
        for name, other in ((x.a, x.b), (x.b, x.a)):
            if isinstance(name, Name) and is_key(name):
                constant, value = atom(other, params)
                if constant:
                    return () if value is None else (checked_key(value, kind),)
    return ANY


#: How many keys an index lookup may expand to.
MAX_KEYS = 1024


def coerced(value, kind: str):
    """A constant as a value of an index part's kind; raises TypeMismatch where that cannot be told."""
    if kind == "int64" and type(value) is int and -INT64 <= value < INT64:
        return value
    if kind == "bool" and (isinstance(value, bool) or value in (0, 1) and type(value) is int):
        return bool(value)
    if kind == "float64" and type(value) in (int, float):
        return float(value)
    if kind == "text" and isinstance(value, str):
        return value
    if kind == "binary" and isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if kind in ("timestamp", "date") and type(value) is int:
        return value
    raise TypeMismatch("a constant is of another kind than the index part")


def value_domain(x: Node | None, is_column: Callable[[Name], bool], kind: str, params: list) -> tuple | None:
    """Values of a column that the predicate allows: ``=`` and IN teach, constants of another kind do not."""
    if isinstance(x, Binary) and x.op in ("and", "or"):
        a, b = value_domain(x.a, is_column, kind, params), value_domain(x.b, is_column, kind, params)
        return meet(a, b) if x.op == "and" else join(a, b)
    try:
        if isinstance(x, Binary) and x.op == "=":
            for name, other in ((x.a, x.b), (x.b, x.a)):
                if isinstance(name, Name) and is_column(name):
                    constant, value = atom(other, params)
                    if constant:
                        return () if value is None else (coerced(value, kind),)
        if isinstance(x, In) and not x.negated and isinstance(x.x, Name) and is_column(x.x):
            got = [atom(i, params) for i in x.items]
            if all(c for c, _ in got):
                return tuple(dict.fromkeys(coerced(v, kind) for _, v in got if v is not None))
    except TypeMismatch:
        return ANY
    return ANY


@dataclass(frozen=True)
class Range:
    """Values between two bounds; None is no bound, strict ones exclude it."""

    low: object = None
    high: object = None
    low_strict: bool = False
    high_strict: bool = False

    def meet(self, other: Range) -> Range:
        a, b = self, other
        if a.low is None or b.low is not None and (b.low, b.low_strict) > (a.low, a.low_strict):
            low, low_strict = b.low, b.low_strict
        else:
            low, low_strict = a.low, a.low_strict
        if a.high is None or b.high is not None and (b.high, not b.high_strict) < (a.high, not a.high_strict):
            high, high_strict = b.high, b.high_strict
        else:
            high, high_strict = a.high, a.high_strict
        return Range(low, high, low_strict, high_strict)

    def hull(self, other: Range) -> Range:
        a, b = self, other
        low, low_strict = (None, False) if a.low is None or b.low is None else min((a.low, a.low_strict), (b.low, b.low_strict))
        high, keep = (None, True) if a.high is None or b.high is None else max((a.high, not a.high_strict), (b.high, not b.high_strict))
        return Range(low, high, low_strict, not keep)

    @property
    def empty(self) -> bool:
        return self.low is not None and self.high is not None and (self.low > self.high or self.low == self.high and (self.low_strict or self.high_strict))


NOTHING = Range(1, 0)
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}


def range_domain(x: Node | None, is_column: Callable[[Name], bool], kind: str, params: list) -> Range | None:
    """The range of a column that the predicate allows; ANY says nothing, NOTHING excludes all rows."""
    if isinstance(x, Binary) and x.op in ("and", "or"):
        a, b = range_domain(x.a, is_column, kind, params), range_domain(x.b, is_column, kind, params)
        if x.op == "and":
            return b if a is ANY else a if b is ANY else NOTHING if NOTHING in (a, b) else a.meet(b)
        return ANY if a is ANY or b is ANY else b if a == NOTHING else a if b == NOTHING else a.hull(b)
    try:
        if isinstance(x, Binary) and x.op in _TURNED:
            for name, other, op in ((x.a, x.b, x.op), (x.b, x.a, _TURNED[x.op])):
                if isinstance(name, Name) and is_column(name):
                    constant, value = atom(other, params)
                    if constant:
                        if value is None:
                            return NOTHING
                        v = coerced(value, kind)
                        return {"=": Range(v, v), "<": Range(None, v, False, True), "<=": Range(None, v), ">": Range(v, None, True), ">=": Range(v, None)}[op]
        if isinstance(x, Between) and not x.negated and isinstance(x.x, Name) and is_column(x.x):
            (a, low), (b, high) = atom(x.low, params), atom(x.high, params)
            if a and b:
                return NOTHING if low is None or high is None else Range(coerced(low, kind), coerced(high, kind))
    except TypeMismatch:
        return ANY
    return ANY


def bindable(values: list, expected: int) -> list:
    """Parameters as the compiler takes them; their number must be as the statement needs."""
    if len(values) != expected:
        raise InvalidArgument(f"the statement takes {expected} parameters")
    out = []
    for v in values:
        if isinstance(v, float) and v != v:
            raise Unsupported("NaN cannot be bound")
        if type(v) is int and not -INT64 <= v < INT64:
            raise NumericOutOfRange("a parameter is out of the range of 64-bit integers")
        if v is not None and not isinstance(v, (bool, int, float, str, bytes, bytearray, memoryview)):
            raise TypeMismatch("a parameter is of a type that cannot be bound")
        out.append(bytes(v) if isinstance(v, (bytearray, memoryview)) else v)
    return out
