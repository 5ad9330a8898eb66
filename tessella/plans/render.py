"""Expressions back to text, for constraints that the catalog keeps."""

from __future__ import annotations

from tessella.errors import Unsupported
from tessella.plans.syntax import Between, Binary, Case, Ident, In, IsNull, IsTruth, Like, Literal, Name, Node, Unary


def name(x: Ident) -> str:
    return '"' + (x.text if x.quoted else x.folded()).replace('"', '""') + '"'


def rendered(x: Node) -> str:
    """SQLite text that parses to the same expression."""
    if isinstance(x, Literal):
        v = x.value
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    if isinstance(x, Name):
        return (name(x.table) + "." if x.table else "") + name(x.column)
    if isinstance(x, Unary):
        return f"({x.op.upper()} {rendered(x.x)})"
    if isinstance(x, Binary):
        return f"({rendered(x.a)} {x.op.upper()} {rendered(x.b)})"
    no = "NOT " if getattr(x, "negated", False) else ""
    if isinstance(x, IsNull):
        return f"({rendered(x.x)} IS {no}NULL)"
    if isinstance(x, IsTruth):
        return f"({rendered(x.x)} IS {no}{str(x.truth).upper()})"
    if isinstance(x, Between):
        return f"({rendered(x.x)} {no}BETWEEN {rendered(x.low)} AND {rendered(x.high)})"
    if isinstance(x, In):
        return f"({rendered(x.x)} {no}IN ({', '.join(map(rendered, x.items))}))"
    if isinstance(x, Like):
        return f"({rendered(x.x)} {no}LIKE {rendered(x.pattern)})"
    if isinstance(x, Case):
        whens = " ".join(f"WHEN {rendered(c)} THEN {rendered(r)}" for c, r in x.whens)
        return f"CASE {rendered(x.operand) + ' ' if x.operand else ''}{whens}{' ELSE ' + rendered(x.otherwise) if x.otherwise else ''} END"
    raise Unsupported("a constraint takes columns and literals only")
