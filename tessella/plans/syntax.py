"""Syntax trees of the accepted statements."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields


class Node:
    def children(self) -> Iterator[Node]:
        for f in fields(self):
            yield from _nodes(getattr(self, f.name))

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()


def _nodes(x) -> Iterator[Node]:
    if isinstance(x, Node):
        yield x
    elif isinstance(x, (list, tuple)):
        for y in x:
            yield from _nodes(y)


@dataclass(frozen=True)
class Ident:
    """A name as written; unquoted ones fold ASCII case."""

    text: str
    quoted: bool = False

    def folded(self) -> str:
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in self.text)

    def names(self, column: str) -> bool:
        return self.text == column if self.quoted else self.folded() == Ident(column).folded()


@dataclass(frozen=True)
class Literal(Node):
    """value: None, bool, int, float or str; literals of different types differ even where Python calls them equal."""

    value: object
    type: str = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "type", type(self.value).__name__)


@dataclass(frozen=True)
class Param(Node):
    """index counts from 1."""

    index: int


@dataclass(frozen=True)
class Name(Node):
    column: Ident
    table: Ident | None = None


@dataclass(frozen=True)
class Unary(Node):
    op: str
    x: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    a: Node
    b: Node


@dataclass(frozen=True)
class IsNull(Node):
    x: Node
    negated: bool = False


@dataclass(frozen=True)
class IsTruth(Node):
    x: Node
    truth: bool
    negated: bool = False


@dataclass(frozen=True)
class Between(Node):
    x: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class In(Node):
    x: Node
    items: tuple[Node, ...]
    negated: bool = False


@dataclass(frozen=True)
class Like(Node):
    x: Node
    pattern: Node
    negated: bool = False


@dataclass(frozen=True)
class Case(Node):
    operand: Node | None
    whens: tuple[tuple[Node, Node], ...]
    otherwise: Node | None = None


@dataclass(frozen=True)
class Aggregate(Node):
    """argument is None for COUNT(*)."""

    function: str
    argument: Node | None
    distinct: bool = False


@dataclass(frozen=True)
class Star(Node):
    table: Ident | None = None


@dataclass(frozen=True)
class Item(Node):
    expression: Node
    alias: Ident | None = None
    #: the expression as written, which names the column where there is no alias
    text: str = ""


@dataclass(frozen=True)
class Order(Node):
    expression: Node
    descending: bool = False


@dataclass(frozen=True)
class TableRef:
    name: Ident
    alias: Ident | None = None


@dataclass(frozen=True)
class Select(Node):
    items: tuple[Item | Star, ...]
    table: TableRef | None = None
    where: Node | None = None
    group: tuple[Node, ...] = ()
    having: Node | None = None
    order: tuple[Order, ...] = ()
    limit: Node | None = None
    offset: Node | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Insert(Node):
    table: TableRef
    columns: tuple[Ident, ...]
    rows: tuple[tuple[Node, ...], ...]
    #: '', 'abort', 'fail', 'ignore', 'replace' or 'rollback'
    conflict: str = ""


@dataclass(frozen=True)
class Update(Node):
    table: TableRef
    sets: tuple[tuple[Ident, Node], ...]
    where: Node | None = None


@dataclass(frozen=True)
class Delete(Node):
    table: TableRef
    where: Node | None = None


@dataclass(frozen=True)
class ColumnDef(Node):
    name: Ident
    #: upper-case type name as written, without arguments
    type: str
    not_null: bool = False
    primary: bool = False
    unique: bool = False
    default: Node | None = None
    check: Node | None = None
    #: '' or 'generated': the dialect's spelling of a generated key
    generated: str = ""


@dataclass(frozen=True)
class CreateTable(Node):
    name: Ident
    columns: tuple[ColumnDef, ...]
    primary: tuple[Ident, ...] = ()
    uniques: tuple[tuple[Ident, ...], ...] = ()
    checks: tuple[Node, ...] = ()
    if_not_exists: bool = False


@dataclass(frozen=True)
class CreateIndex(Node):
    name: Ident
    table: Ident
    columns: tuple[tuple[Ident, bool], ...]
    unique: bool = False
    if_not_exists: bool = False


@dataclass(frozen=True)
class Transaction(Node):
    #: 'begin', 'commit' or 'rollback'
    action: str


Statement = Select | Insert | Update | Delete | CreateTable | CreateIndex | Transaction


@dataclass
class Batch:
    """The statements of one source text."""

    dialect: str
    source: str
    statements: list[Statement] = field(default_factory=list)
    #: parameters that each statement needs
    parameters: list[int] = field(default_factory=list)

    def __repr__(self) -> str:
        return f"Batch(dialect={self.dialect!r}, source_bytes={len(self.source.encode())}, statement_count={len(self.statements)})"


AGGREGATES = ("count", "sum", "avg", "min", "max")


def has_aggregate(x: Node | None) -> bool:
    return x is not None and any(isinstance(n, Aggregate) for n in x.walk())


def kind_of(statement: Statement) -> str:
    """'read', 'write', 'schema' or 'session'."""
    if isinstance(statement, Select):
        return "read"
    if isinstance(statement, (Insert, Update, Delete)):
        return "write"
    return "session" if isinstance(statement, Transaction) else "schema"
