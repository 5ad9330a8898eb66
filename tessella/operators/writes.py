"""Row changes as copy-on-write of one shard.

Every check is a DataFrame over the one shard that a statement touches; the rows of
the files it touches are written anew beside the old files, and a new manifest
version makes them visible. A change that fails a check publishes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import CheckViolation, ForeignKeyViolation, InvalidQuery, NotNullViolation, TypeMismatch, UniqueViolation
from tessella.plans.compiler import Scope, as_truth, kind_of, literal, scope
from tessella.plans.parser import parse_one
from tessella.plans.syntax import Delete, Insert, Update
from tessella.sources.catalog import Table


@dataclass
class WriteResult:
    shard: int
    rows_affected: int
    generated_key: tuple[str, int] | None = None


def check_scope(table: Table, df: DataFrame, check: str):
    """A CHECK's condition: it fails where it is false, not where it is null."""
    statement, _ = parse_one(f"SELECT 1 FROM {table.name} WHERE {check}", "sqlite")
    return as_truth(scope(df, table.names, [], statement.table.name).of(statement.where))


def assigned(value, column_type: str):
    """A typed value as a column's type; kinds that do not convert raise TypeMismatch."""
    have, want = value.kind, kind_of(column_type)
    if have in ("null", want) or {have, want} <= {"int", "float", "bool"} or want == "text" or have == "text" and want in ("time", "int", "float"):
        if have == "float" and want == "int":
            # a whole float is an integer, any other value does not fit
            return F.when(value.column == F.floor(value.column), value.column.cast(column_type)).when(
                value.column.isNotNull(), F.raise_error(F.lit("type_mismatch")).cast(column_type)
            )
        return value.column.cast(column_type)
    raise TypeMismatch("a value does not fit its column")


def inserted_rows(spark, table: Table, statement: Insert, params: list, generated: int | None = None) -> DataFrame:
    """The rows of an INSERT, with defaults and the generated key filled in."""
    places = {}
    for k, c in enumerate(statement.columns):
        own = next((n for n in table.names if c.names(n)), None)
        if own is None:
            raise InvalidQuery("an inserted column is not known")
        places[own] = k
    at = Scope({}, params)
    rows = []
    for row in statement.rows:
        out = []
        for c in table.columns:
            if c.name in places:
                value = at.of(row[places[c.name]])
            elif generated is not None and c.name == table.generated_column:
                value = literal(generated)
            elif c.default is not None:
                value = at.of(parse_one(f"SELECT {c.default}")[0].items[0].expression)
            else:
                value = literal(None)
            out.append(assigned(value, c.type).alias(c.name))
        rows.append(F.struct(*out))
    return spark.range(1).select(F.inline(F.array(*rows)))


def broken_rows(table: Table, rows: DataFrame) -> None:
    """Raises the first NOT NULL or CHECK that new rows break; one pass over them."""
    bad = [(NotNullViolation("a column cannot be null"), F.col(f"`{c.name}`").isNull()) for c in table.columns if c.not_null or c.name in table.primary]
    bad += [(CheckViolation("a check failed"), ~check_scope(table, rows, check)) for check in table.checks]
    if bad:
        counts = rows.agg(*[F.count(F.when(c, 1)).alias(f"b{k}") for k, (_, c) in enumerate(bad)]).first()
        for (error, _), n in zip(bad, counts):
            if n:
                raise error


def unique_keys(table: Table) -> list[tuple[str, ...]]:
    return ([table.primary] if table.primary else []) + list(table.uniques)


def _known(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return rows.select(*key).where(" AND ".join(f"`{c}` IS NOT NULL" for c in key))


def doubled(table: Table, rows: DataFrame, keys: list[tuple[str, ...]]) -> None:
    """Raises UniqueViolation where a key stands twice among the rows."""
    for key in keys:
        if _known(rows, key).groupBy(*key).count().where("count > 1").limit(1).count():
            raise UniqueViolation("a unique key stands twice")


def checked_insert(table: Table, old: DataFrame, new: DataFrame) -> None:
    """Checks inserted rows, which the statement's length bounds, against themselves and the shard's keys.

    The new keys are few and go to the tasks; of the shard only key columns are read.
    """
    broken_rows(table, new)
    doubled(table, new, unique_keys(table))
    for key in unique_keys(table):
        if _known(old, key).join(F.broadcast(_known(new, key)), list(key), "left_semi").limit(1).count():
            raise UniqueViolation("a unique key stands twice")


def checked_update(table: Table, after: DataFrame, hit: DataFrame, assigned_columns: set[str]) -> None:
    """Checks changed rows, and of the unique keys only those that an assigned column is part of."""
    broken_rows(table, hit)
    doubled(table, after, [k for k in unique_keys(table) if assigned_columns & set(k)])


def checked_children(columns: tuple[str, ...], rows: DataFrame, parents: DataFrame, parent_columns: tuple[str, ...]) -> None:
    """Raises ForeignKeyViolation where a row with no null in the key has no parent."""
    parents = parents.select(*[F.col(f"`{p}`").alias(c) for c, p in zip(columns, parent_columns)])
    if _known(rows, columns).join(parents, list(columns), "left_anti").limit(1).count():
        raise ForeignKeyViolation("a row's parent does not exist")


def changed(table: Table, statement: Update | Delete, rows: DataFrame, params: list) -> tuple[DataFrame, DataFrame, DataFrame, set[str]]:
    """(the rows after the statement, those it touches as they become and as they were, the columns it assigns)."""
    at = scope(rows, table.names, params, statement.table.name, statement.table.alias)
    hit = F.coalesce(as_truth(at.of(statement.where)), F.lit(False)) if statement.where is not None else F.lit(True)
    if isinstance(statement, Delete):
        return rows.where(~hit), rows.where(hit), rows.where(hit), set()
    new = {}
    for ident, value in statement.sets:
        column = next((c for c in table.columns if ident.names(c.name)), None)
        if column is None:
            raise InvalidQuery("an assigned column is not known")
        new[column.name] = F.when(hit, assigned(at.of(value), column.type)).otherwise(F.col(f"`{column.name}`"))
    become = [new.get(c, F.col(f"`{c}`")).alias(c) for c in rows.columns]
    return rows.select(*become), rows.where(hit).select(*become), rows.where(hit), set(new)


def with_conflicts(table: Table, old: DataFrame, new: DataFrame, action: str) -> tuple[DataFrame, DataFrame]:
    """(kept old rows, accepted new rows) for INSERT OR IGNORE and OR REPLACE."""
    keys = unique_keys(table)
    if action not in ("ignore", "replace") or not keys:
        return old, new
    numbered = new.withColumn("_order", F.monotonically_increasing_id())
    if action == "ignore":
        for key in keys:
            numbered = numbered.join(old.select(*key).distinct(), list(key), "left_anti")
            first = numbered.groupBy(*key).agg(F.min("_order").alias("_order"))
            numbered = numbered.join(first, [*key, "_order"], "left_semi")
        for c in table.columns:
            if c.not_null or c.name in table.primary:
                numbered = numbered.where(F.col(f"`{c.name}`").isNotNull())
        return old, numbered.drop("_order")
    for key in keys:
        last = numbered.groupBy(*key).agg(F.max("_order").alias("_order"))
        numbered = numbered.join(last, [*key, "_order"], "left_semi")
        old = old.join(numbered.select(*key).distinct(), list(key), "left_anti")
    return old, numbered.drop("_order")
