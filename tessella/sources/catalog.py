"""Declared tables: placement, columns, keys, generated ids."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from tessella.errors import InvalidArgument, Unsupported
from tessella.functions.routing import KEY_TYPES

MAX_TABLES, MAX_IDENTIFIER = 4096, 63
HIDDEN = ("_shard", "_rid", "_load")
PLACEMENTS = ("sharded", "global", "catalog")
GENERATED = ("", "range", "block")
#: Spark types of a shard key's kind
KEY_SPARK = {"int64": ("bigint", "int", "smallint", "tinyint"), "text": ("string",), "binary": ("binary",)}


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    not_null: bool = False
    #: SQL text of a literal default
    default: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    """Columns that name a row of a parent: one on the same shard, or of a global table."""

    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class LocalIndex:
    """A declared index of a table's own shards: columns, each with whether it descends."""

    name: str
    columns: tuple[tuple[str, bool], ...]
    unique: bool = False


@dataclass(frozen=True)
class Table:
    """A table's declaration; columns may be filled in by a migration."""

    name: str
    placement: str
    shard_key: str | None = None
    key_type: str | None = None
    generated: str = ""
    generated_column: str | None = None
    columns: tuple[Column, ...] = ()
    primary: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    checks: tuple[str, ...] = ()
    foreign: tuple[ForeignKey, ...] = ()
    indexes: tuple[LocalIndex, ...] = ()
    #: path of a read-only table that others wrote
    attached: str | None = None

    def __post_init__(self) -> None:
        identifier(self.name)
        if self.placement not in PLACEMENTS:
            raise InvalidArgument("a placement is sharded, global or catalog")
        if (self.placement == "sharded") != (self.shard_key is not None):
            raise InvalidArgument("a sharded table, and no other, has a shard key")
        if self.placement == "sharded" and self.key_type not in KEY_TYPES:
            raise InvalidArgument("a shard key's type is int64, text or binary")
        if self.generated not in GENERATED:
            raise InvalidArgument("generated ids are of policy range or block")
        if self.generated and self.generated_column != self.shard_key:
            raise Unsupported("generated ids must be the shard key")

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def checked(self) -> Table:
        """Declared columns fit the placement, or InvalidArgument."""
        if len({n.lower() for n in self.names}) < len(self.columns):
            raise InvalidArgument("two columns have one name")
        if any(n in HIDDEN for n in self.names):
            raise InvalidArgument("a column has a reserved name")
        if self.placement == "sharded":
            key = self.column(self.shard_key)
            if key is None:
                raise InvalidArgument("the shard key is no column of the table")
            if key.type not in KEY_SPARK[self.key_type]:
                raise InvalidArgument("the shard key's column is of another type")
            for unique in (self.primary, *self.uniques):
                if unique and self.shard_key not in unique:
                    raise InvalidArgument("a unique key of a sharded table must hold the shard key")
        return self

    def as_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, x: dict) -> Table:
        x = dict(x, columns=tuple(Column(**c) for c in x["columns"]), primary=tuple(x["primary"]), uniques=tuple(map(tuple, x["uniques"])), checks=tuple(x["checks"]), foreign=tuple(ForeignKey(tuple(f["columns"]), f["parent"], tuple(f["parent_columns"])) for f in x.get("foreign", ())), indexes=tuple(LocalIndex(i["name"], tuple((c, down) for c, down in i["columns"]), i["unique"]) for i in x.get("indexes", ())))
        return cls(**x)


def identifier(name: str) -> str:
    if not 1 <= len(name.encode()) <= MAX_IDENTIFIER or name != name.lower():
        raise InvalidArgument(f"a table's name is lower-case and has 1 to {MAX_IDENTIFIER} bytes")
    return name


def sharded(name: str, shard_key: str, key_type: str, **more) -> Table:
    return Table(name, "sharded", shard_key, key_type, **more)


def global_(name: str, **more) -> Table:
    return Table(name, "global", **more)


def catalog_only(name: str) -> Table:
    return Table(name, "catalog")


@dataclass
class Catalog:
    """Tables by name and the schema generation, which every migration raises."""

    tables: dict[str, Table] = field(default_factory=dict)
    generation: int = 0
    migrations: list[str] = field(default_factory=list)

    def placed_foreign(self, table: Table) -> None:
        """A foreign key's parent must be global, or lie with its children: shard key to shard key."""
        for f in table.foreign:
            parent = self.tables.get(f.parent)
            if parent is None or len(f.columns) != len(f.parent_columns):
                raise InvalidArgument("a foreign key names no declared table or unequal columns")
            together = table.placement == parent.placement == "sharded" and (table.shard_key, parent.shard_key) in zip(f.columns, f.parent_columns)
            if parent.placement != "global" and not together:
                raise Unsupported("a foreign key's parent must lie on the same shard")

    def add(self, table: Table) -> None:
        if table.name in self.tables:
            raise InvalidArgument("the table is declared already")
        if len(self.tables) >= MAX_TABLES:
            raise InvalidArgument(f"a catalog holds {MAX_TABLES} tables")
        self.placed_foreign(table)
        self.tables[table.name] = table

    def put(self, table: Table) -> None:
        self.tables[table.name] = table

    def as_json(self) -> dict:
        return {"tables": [t.as_json() for t in self.tables.values()], "generation": self.generation, "migrations": self.migrations}

    @classmethod
    def from_json(cls, x: dict) -> Catalog:
        return cls({t["name"]: Table.from_json(t) for t in x["tables"]}, x["generation"], x["migrations"])

    def copy(self) -> Catalog:
        return Catalog(dict(self.tables), self.generation, list(self.migrations))


__all__ = ["Catalog", "Column", "ForeignKey", "LocalIndex", "Table", "catalog_only", "global_", "identifier", "replace", "sharded"]
