"""From a bound statement to the shards it can touch.

Order: the shard key's domain gives routes; a global index narrows them by its
candidates and adds every shard that it cannot speak for; summaries then take
out shards that hold no matching row, never one with a verified candidate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from tessella.errors import InvalidQuery, NotNullViolation, PermissionDenied, ReadOnly, Unsupported
from tessella.functions.routing import shard_of
from tessella.plans.compiler import row_local
from tessella.plans.domains import ANY, atom, checked_key, key_domain
from tessella.plans.syntax import Delete, Ident, Insert, Name, Select, Statement, Update, kind_of
from tessella.sources.catalog import Catalog, Table

NOT_APPLICABLE, NOT_SHARDED, UNCONSTRAINED, CONTRADICTION, EXACT, MULTIPLE = "not_applicable", "not_sharded", "unconstrained", "contradiction", "exact", "multiple"


@dataclass
class Plan:
    """What is known before a statement runs."""

    statement: Statement
    table: Table | None
    inference: str
    keys: tuple = ()
    #: shards to visit; None is all
    shards: list[int] | None = None
    #: 'not_applicable', 'empty', 'routed' or 'fallback'
    index: str = "not_applicable"
    index_name: str | None = None
    candidates: list[int] = field(default_factory=list)
    #: where the index finds the rows of its candidates; None where it names shards only
    locators: list[bytes] | None = None
    uncertain: list[int] = field(default_factory=list)
    #: shard -> why a summary excludes it
    pruned: dict[int, str] = field(default_factory=dict)
    generation: int = 0

    @property
    def kind(self) -> str:
        return kind_of(self.statement)

    @property
    def empty(self) -> bool:
        return self.inference == CONTRADICTION or self.shards == []

    def targets(self, total: int) -> list[int]:
        """The shards visited; a read that no row can answer still asks one for its columns."""
        if self.table is None or self.table.placement == "global":
            return [0]
        return list(range(total)) if self.shards is None else self.shards or [0]


def found(catalog: Catalog, name: Ident) -> Table:
    """The table a name means; statements cannot touch catalog-only ones."""
    table = next((t for t in catalog.tables.values() if name.names(t.name)), None)
    if table is None:
        raise InvalidQuery("a table is not known")
    if table.placement == "catalog":
        raise PermissionDenied("the table is metadata only")
    return table


def plan(statement: Statement, catalog: Catalog, params: list, shards: int, routing_key=None) -> Plan:
    """Routes by shard key; indexes and summaries come later and only for reads."""
    if isinstance(statement, Select) and statement.table is None:
        return Plan(statement, None, NOT_APPLICABLE, generation=catalog.generation)
    if not isinstance(statement, (Select, Insert, Update, Delete)):
        return Plan(statement, None, NOT_APPLICABLE, generation=catalog.generation)
    table = found(catalog, statement.table.name)
    if table.placement == "global":
        return Plan(statement, table, NOT_SHARDED, shards=[0], generation=catalog.generation)
    out = Plan(statement, table, UNCONSTRAINED, generation=catalog.generation)
    if isinstance(statement, Insert):
        keys = inserted_keys(statement, table, params)
        if keys is not ANY:
            out.inference, out.keys = (EXACT if len(set(keys)) == 1 else MULTIPLE), keys
    else:
        alias = statement.table.alias or statement.table.name
        is_key = lambda n: n.column.names(table.shard_key) and (n.table is None or n.table.names(alias.text if alias.quoted else alias.folded()))
        keys = key_domain(statement.where, is_key, table.key_type, params)
        if keys is not ANY:
            out.inference, out.keys = (CONTRADICTION if not keys else EXACT if len(keys) == 1 else MULTIPLE), keys
    if out.inference in (EXACT, MULTIPLE):
        out.shards = sorted({shard_of(k, shards) for k in out.keys})
    elif out.inference == CONTRADICTION:
        out.shards = []
    if routing_key is not None:
        explicit = shard_of(routing_key, shards)
        if out.shards and out.shards != [explicit]:
            raise InvalidQuery("the routing key's shard is not the one that the statement needs")
        if out.shards is None:
            out.shards = [explicit]
    return out


def inserted_keys(statement: Insert, table: Table, params: list) -> tuple | None:
    """Each row's shard-key value, in order; ANY where one cannot be told."""
    at = next((k for k, c in enumerate(statement.columns) if c.names(table.shard_key)), None)
    if at is None:
        if not table.generated:
            raise NotNullViolation("the shard key has no value")
        return ANY
    out = []
    for row in statement.rows:
        constant, value = atom(row[at], params)
        if not constant:
            return ANY
        if value is None:
            raise NotNullViolation("the shard key is null")
        out.append(checked_key(value, table.key_type))
    return tuple(out)


def checked_write(plan_: Plan) -> None:
    """A write of a sharded table must lie on one shard, and cannot move a row."""
    table, statement = plan_.table, plan_.statement
    if table.attached:
        raise ReadOnly("an attached table is read only")
    if table.placement != "sharded":
        return
    if isinstance(statement, Update) and any(c.names(table.shard_key) for c, _ in statement.sets):
        raise Unsupported("the shard key cannot be assigned")
    if isinstance(statement, Insert) and plan_.inference == UNCONSTRAINED and not table.generated:
        raise InvalidQuery("the inserted rows' shard cannot be told")
    if plan_.shards is None and not (isinstance(statement, Insert) and table.generated):
        raise InvalidQuery("a write needs a shard, by predicate or by routing key")
    if plan_.shards is not None and len(plan_.shards) > 1:
        raise InvalidQuery("a write touches one shard")


def checked_scatter(plan_: Plan, total: int, strict: bool) -> None:
    """In strict mode a read of several shards must be row-local."""
    if strict and isinstance(plan_.statement, Select) and len(plan_.targets(total)) > 1 and not row_local(plan_.statement):
        raise Unsupported("a read of several shards takes rows one by one")


def is_column(statement, column: str):
    """The test that a name means this column of the statement's table."""
    alias = statement.table.alias or statement.table.name
    text = alias.text if alias.quoted else alias.folded()

    def test(n: Name) -> bool:
        return n.column.names(column) and (n.table is None or n.table.names(text))

    return test
