"""The engine: catalog, routed reads and writes, sessions."""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import (
    Busy, Cancelled, DataCorruption, DeadlineExceeded, EngineError, FailedPrecondition, InvalidArgument, InvalidQuery, LimitExceeded, NumericOutOfRange,
    ReadOnly, ShuttingDown, StorageUnavailable, TransactionAborted, TypeMismatch, Unsupported,
)
from tessella.functions import generated_id
from tessella.functions.routing import checked_shards, shard_of
from tessella.operators import pages, writes
from tessella.operators.results import Budget, Executed, Result
from tessella.operators.writes import WriteResult
from tessella.plans import planner
from tessella.plans.compiler import select
from tessella.plans.domains import bindable
from tessella.plans.parser import parse, parse_one
from tessella.plans.planner import Plan
from tessella.plans.syntax import CreateIndex, CreateTable, Delete, Insert, Select, Statement, Transaction, Update, kind_of
from tessella.sources.catalog import Catalog, Column, LocalIndex, Table, replace
from tessella.sources.files import State
from tessella.sources.storage import Snapshot, Store

MAX_PREPARED, MAX_PORTALS, MAX_BOUND_BYTES = 128, 128, 16 << 20
DEFAULT_TIMEOUT = 30.0

#: Declared type names of the dialects and their Spark types.
TYPES = {
    **dict.fromkeys(("INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT", "MEDIUMINT", "INT2", "INT4", "INT8", "BIGSERIAL", "SERIAL8"), "bigint"),
    **dict.fromkeys(("BOOL", "BOOLEAN"), "boolean"),
    **dict.fromkeys(("REAL", "FLOAT", "DOUBLE", "FLOAT4", "FLOAT8"), "double"),
    **dict.fromkeys(("TEXT", "VARCHAR", "CHAR", "CLOB", "CHARACTER", "STRING"), "string"),
    **dict.fromkeys(("BLOB", "BYTEA", "BINARY", "VARBINARY"), "binary"),
    "DATE": "date", "TIMESTAMP": "timestamp", "DATETIME": "timestamp",
}


def declared_type(name: str) -> str:
    """A declared type's Spark type: by name, else by what the name holds, else text."""
    name = name.upper()
    if name in TYPES:
        return TYPES[name]
    for part, kind in (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("DEC", "decimal(38,18)")):
        if part in name:
            return kind
    return "string"


def failure(e: Exception) -> EngineError:
    """A Spark failure as one of the engine's kinds."""
    said = str(e)
    if "type_mismatch" in said or "CAST_INVALID_INPUT" in said:
        return TypeMismatch("a value does not convert")
    if "OVERFLOW" in said or "overflow" in said or "OUT_OF_RANGE" in said:
        return NumericOutOfRange("a number is out of range")
    if "cancelled" in said.lower() or "canceled" in said.lower():
        return Cancelled("the request was cancelled")
    if "DATATYPE_MISMATCH" in said or "DIFFERENT_TYPES" in said:
        return TypeMismatch("values are of types that do not go together")
    return StorageUnavailable(f"the statement could not run: {type(e).__name__}")


class CancellationToken:
    def __init__(self) -> None:
        self._event = threading.Event()

    @property
    def cancelled(self) -> bool:
        return self._event.is_set()

    def cancel(self) -> bool:
        first = not self._event.is_set()
        self._event.set()
        return first

    def wait(self, seconds: float) -> bool:
        return self._event.wait(seconds)


class Engine:
    """A logical database over one Spark session.

    root holds managed tables; without it, only attached ones can be read.
    strict_scatter refuses reads of several shards that are not row by row.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, shards: int = 4, strict_scatter: bool = False, budget: Budget = Budget()) -> None:
        self.spark, self.shards, self.strict_scatter, self.budget = spark, checked_shards(shards), strict_scatter, budget
        self.store = Store(spark, root, shards) if root else None
        self.state = "open"
        self.attached: dict[str, Table] = {}
        self.indexes = None
        self._leases: dict[str, tuple[int, int]] = {}
        if self.store:
            from tessella.operators.global_index import Indexes

            self._catalog = State(self.store.files, f"{self.store.root}/catalog")
            version, x = self._catalog.read()
            if version and x["shards"] != shards:
                raise FailedPrecondition("the database was made with another number of shards")
            self.indexes = Indexes(self)

    # -- catalog
    @property
    def catalog(self) -> Catalog:
        if not self.store:
            return Catalog(dict(self.attached))
        version, x = self._catalog.read()
        out = Catalog.from_json(x["catalog"]) if version else Catalog()
        out.tables |= self.attached
        return out

    @contextmanager
    def _changing(self):
        if not self.store:
            raise FailedPrecondition("the engine has no root for managed tables")
        version, x = self._catalog.read()
        catalog = Catalog.from_json(x["catalog"]) if version else Catalog()
        yield catalog
        self._catalog.write(version, {"shards": self.shards, "catalog": catalog.as_json()})

    def attach(self, table: Table, path: str) -> Table:
        """Declares a Parquet table that others wrote; it is read where it lies."""
        schema = self.spark.read.parquet(path).schema
        columns = tuple(Column(f.name, f.dataType.simpleString(), not f.nullable) for f in schema.fields)
        out = replace(table, columns=columns, attached=path).checked()
        if out.name in self.catalog.tables:
            raise InvalidArgument("the table is declared already")
        self.attached[out.name] = out
        return out

    def register_tables(self, tables: list[Table]) -> None:
        """Declares placements; each once, before the table has columns."""
        with self._changing() as catalog:
            for t in tables:
                catalog.add(t.checked() if t.columns else t)

    def migrate(self, sql: str, dialect: str = "sqlite") -> list[int]:
        """Runs schema statements once; a source that ran before does nothing more."""
        self._usable()
        batch = parse(sql, dialect)
        if not batch.statements or any(not isinstance(s, (CreateTable, CreateIndex)) for s in batch.statements):
            raise InvalidQuery("a migration takes schema statements only")
        mark = hashlib.sha256(f"{dialect}\n{sql}".encode()).hexdigest()
        with self._changing() as catalog:
            if mark in catalog.migrations:
                return list(range(self.shards))
            for s in batch.statements:
                (self._create_table if isinstance(s, CreateTable) else self._create_index)(catalog, s, sql)
            catalog.migrations.append(mark)
            catalog.generation += 1
        return list(range(self.shards))

    def _create_table(self, catalog: Catalog, s: CreateTable, source: str) -> None:
        name = s.name.text if s.name.quoted else s.name.folded()
        known = catalog.tables.get(name)
        if known is None:
            raise FailedPrecondition("the table's placement is not declared")
        if known.placement == "catalog":
            raise FailedPrecondition("the table is metadata only")
        if known.columns:
            if s.if_not_exists:
                return
            raise InvalidQuery("the table exists already")
        text = lambda i: i.text if i.quoted else i.folded()
        from tessella.plans.render import rendered

        columns = tuple(
            Column(text(c.name), declared_type(c.type), c.not_null or bool(c.generated), rendered(c.default) if c.default is not None else None) for c in s.columns
        )
        own = {c.name for c in columns}
        primary, uniques = tuple(map(text, s.primary)), tuple(tuple(map(text, u)) for u in s.uniques)
        if not {*primary, *(c for u in uniques for c in u)} <= own:
            raise InvalidQuery("a key names a column that is not declared")
        declared = [text(c.name) for c in s.columns if c.generated]
        if bool(declared) != bool(known.generated) or declared and declared[0] != known.generated_column:
            raise FailedPrecondition("the generated-key declaration does not fit the table's policy")
        catalog.put(replace(known, columns=columns, primary=primary, uniques=uniques, checks=tuple(rendered(c) for c in s.checks)).checked())

    def _create_index(self, catalog: Catalog, s: CreateIndex, source: str) -> None:
        """An index of a table's own shards: kept by name; a unique one is a key that every write checks."""
        table = planner.found(catalog, s.table)
        text = lambda i: i.text if i.quoted else i.folded()
        name, columns = text(s.name), [text(c) for c, _ in s.columns]
        if any(i.name == name for t in catalog.tables.values() for i in t.indexes):
            if s.if_not_exists:
                return
            raise InvalidQuery("the index exists already")
        if any(table.column(c) is None for c in columns):
            raise InvalidQuery("an index names a column that is not declared")
        if s.unique:
            if table.placement == "sharded" and table.shard_key not in columns:
                raise FailedPrecondition("a unique index of a sharded table must hold the shard key")
            table = replace(table, uniques=(*table.uniques, tuple(columns)))
        catalog.put(replace(table, indexes=(*table.indexes, LocalIndex(name, tuple((text(c), down) for c, down in s.columns), s.unique))))

    # -- reads
    def _usable(self) -> None:
        if self.state != "open":
            raise ShuttingDown("the engine is closed")

    def plan(self, sql: str, params: list = (), dialect: str = "sqlite", routing_key=None) -> Plan:
        statement, needed = parse_one(sql, dialect)
        return self._plan(statement, bindable(list(params), needed), routing_key)

    def _plan(self, statement: Statement, params: list, routing_key=None) -> Plan:
        out = planner.plan(statement, self.catalog, params, self.shards, routing_key)
        if isinstance(statement, Select) and out.table is not None and out.table.placement == "sharded" and not out.table.attached and self.indexes:
            self.indexes.narrow(out, params)
        return out

    def rows(self, table: Table, shards: list[int] | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        if table.attached:
            return self.spark.read.parquet(table.attached)
        if not self.store:
            raise FailedPrecondition("the engine has no root for managed tables")
        return self.store.read(table, shards, snapshot)

    def query(self, sql: str, params: list = (), dialect: str = "sqlite", routing_key=None) -> Executed:
        """A read, planned but not run: the shards it visits and its DataFrame."""
        self._usable()
        statement, needed = parse_one(sql, dialect)
        return self._read(statement, bindable(list(params), needed), routing_key)

    def _read(self, statement: Statement, params: list, routing_key=None, overlay: dict[str, Snapshot] | None = None) -> Executed:
        if not isinstance(statement, Select):
            raise InvalidQuery("a query must be a read")
        plan = self._plan(statement, params, routing_key)
        planner.checked_scatter(plan, self.shards, self.strict_scatter)
        targets = plan.targets(self.shards)
        try:
            if plan.table is None:
                frame = select(statement, None, [], params, self.spark)
            else:
                snapshot = (overlay or {}).get(plan.table.name)
                if plan.index == "routed" and plan.locators is not None and snapshot is None:
                    rows = self.indexes.located_rows(plan.table, plan.shards, plan.locators, [k for k in plan.uncertain if k in plan.shards])
                else:
                    rows = self.rows(plan.table, None if plan.table.placement == "global" or plan.shards is None else plan.shards, snapshot)
                if plan.empty:
                    rows = rows.where(F.lit(False))
                frame = select(statement, rows, plan.table.names, params, self.spark)
        except PySparkException as e:
            raise failure(e) from None
        return Executed(targets, frame)

    def collect(self, executed: Executed, budget: Budget | None = None, timeout: float | None = None, token: CancellationToken | None = None) -> Result:
        """Runs a read within a budget, a deadline and a cancellation token."""
        tag, done, why = f"q-{uuid.uuid4().hex}", threading.Event(), []
        context = self.spark.sparkContext
        token = token or CancellationToken()
        limit = DEFAULT_TIMEOUT if timeout is None else timeout
        if token.cancelled:
            raise Cancelled("the request was cancelled")
        if limit <= 0:
            raise DeadlineExceeded("the request's time is over")

        def watch() -> None:
            end = time.monotonic() + limit
            while not done.wait(0.02):
                if token.cancelled or time.monotonic() > end:
                    why.append(Cancelled("the request was cancelled") if token.cancelled else DeadlineExceeded("the request's time is over"))
                    context.cancelJobsWithTag(tag)
                    return

        context.addJobTag(tag)
        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            return executed.collect(budget or self.budget)
        except EngineError:
            raise
        except Exception as e:
            raise (why[0] if why else failure(e)) from None
        finally:
            done.set()
            watcher.join()
            context.removeJobTag(tag)

    # -- writes
    def execute(self, sql: str, params: list = (), dialect: str = "sqlite", routing_key=None) -> WriteResult:
        """A write of one shard, published at once."""
        self._usable()
        statement, needed = parse_one(sql, dialect)
        return self._write(statement, bindable(list(params), needed), routing_key)

    def _write(self, statement: Statement, params: list, routing_key=None, staged: dict | None = None) -> WriteResult:
        if kind_of(statement) != "write":
            raise InvalidQuery("a write is an INSERT, UPDATE or DELETE")
        plan = self._plan(statement, params, routing_key)
        if not plan.table.columns:
            raise InvalidQuery("a table has no columns yet")
        planner.checked_write(plan)
        if plan.table.placement == "global" and not self.store:
            raise ReadOnly("the engine has no root for managed tables")
        try:
            return self._change(plan, statement, params, staged)
        except PySparkException as e:
            raise failure(e) from None

    def _change(self, plan: Plan, statement, params: list, staged: dict | None) -> WriteResult:
        table, generated = plan.table, None
        if isinstance(statement, Insert) and table.generated:
            named = any(c.names(table.generated_column) for c in statement.columns)
            if named and table.generated == "block":
                raise Unsupported("a block-sequence id cannot be supplied")
            if not named:
                if len(statement.rows) != 1:
                    raise Unsupported("a generated key takes one row")
                generated, plan.shards = self.next_id(table, plan.shards)
        if plan.empty:
            return WriteResult(0, 0)
        shard = plan.shards[0]
        before = (staged or {}).get(table.name, {}).get("now") or self.store.snapshot(table)
        old, own = self.store.read(table, [shard], before), before.folders.get(shard, [])
        follow = self.indexes is not None and staged is None
        gone, new, claims = None, None, []
        if isinstance(statement, Insert):
            rows = writes.inserted_rows(self.spark, table, statement, params, generated).withColumn("_shard", F.lit(shard))
            kept, rows = writes.with_conflicts(table, old, rows, statement.conflict)
            if follow and statement.conflict == "ignore":
                rows = self.indexes.without_doubles(table, before, rows)
            affected = rows.count()
            writes.checked_insert(table, kept, rows)
            self._with_parents(table, shard, rows, staged)
            if statement.conflict == "replace":
                gone = old.join(kept.select(*self._locator(table)), self._locator(table), "left_anti")
            if follow:
                self.indexes.room(table)
                claims = self.indexes.refuse_doubles(table, before, rows, gone)
            added = self.store.write(table, rows).get(shard, [])
            new = self.store.read(table, [shard], Snapshot(0, {shard: added}))
            folders = (self.store.write(table, kept).get(shard, []) if statement.conflict == "replace" else own) + added
        else:
            after, touched, gone, columns = writes.changed(table, statement, old, params)
            files = self.store.files_of(gone)
            affected = sum(files.values())
            if not affected:
                return WriteResult(shard, 0)
            new = touched if isinstance(statement, Update) else None
            if new is not None:
                writes.checked_update(table, after, touched, columns)
                self._with_parents(table, shard, touched, staged, columns)
            self._with_children(table, shard, old, after, staged, columns)
            if follow:
                self.indexes.room(table)
                claims = self.indexes.refuse_doubles(table, before, new, gone) if new is not None else []
            part = self.store.read(table, [shard], Snapshot(0, {shard: sorted(files)}))
            folders = self.store.without(table, own, list(files)) + self.store.write(table, writes.changed(table, statement, part, params)[0]).get(shard, [])
        now = {**before.folders, shard: folders}
        result = WriteResult(shard, affected, (table.generated_column, generated) if generated is not None else None)
        if staged is not None:
            entry = staged.setdefault(table.name, {"table": table, "base": before})
            entry["now"] = Snapshot(before.version, now)
        elif follow:
            with self.indexes.claimed(claims, shard):
                snapshot = self.store.publish(table, before, now)
            self.indexes.changed(table, [shard], before, snapshot, gone, new)
        else:
            self.store.publish(table, before, now)
        return result

    @staticmethod
    def _locator(table: Table) -> list[str]:
        return list(table.primary) or ["_rid"]

    def _now(self, table: Table, shard: int, staged: dict | None) -> DataFrame:
        snapshot = (staged or {}).get(table.name, {}).get("now")
        return self.rows(table, [shard] if table.placement == "sharded" else None, snapshot)

    def _with_parents(self, table: Table, shard: int, rows: DataFrame, staged: dict | None, columns: set[str] | None = None) -> None:
        """New rows, and rows whose foreign key was assigned, have parents."""
        catalog = self.catalog
        for f in table.foreign:
            if columns is None or columns & set(f.columns):
                writes.checked_children(f.columns, rows, self._now(catalog.tables[f.parent], shard, staged), f.parent_columns)

    def _with_children(self, table: Table, shard: int, old: DataFrame, after: DataFrame, staged: dict | None, columns: set[str]) -> None:
        """Rows that were deleted, or lost their key by an update, have no children left."""
        for child in self.catalog.tables.values():
            for f in child.foreign:
                if child.columns and f.parent == table.name and (not columns or columns & set(f.parent_columns)):
                    every = None if table.placement == "global" else [shard]
                    children = self.rows(child, every, (staged or {}).get(child.name, {}).get("now"))
                    gone = old.select(*f.parent_columns).distinct().join(after.select(*f.parent_columns), list(f.parent_columns), "left_anti")
                    lost = children.join(gone.toDF(*f.columns), list(f.columns), "left_semi")
                    writes.checked_children(f.columns, lost, after, f.parent_columns)

    def next_id(self, table: Table, shards: list[int] | None) -> tuple[int, list[int]]:
        """A new id of the table's policy, and the shard that it lives on.

        Block sequences are leased BLOCK numbers at a time; what an engine does
        not use of its lease is a gap, and no number is given out twice.
        """
        state = State(self.store.files, f"{self.store.root}/ids/{table.name}")
        if table.generated == "block":
            first, last = self._leases.get(table.name, (1, 0))
            if first > last:
                first = self._leased(state, "next", generated_id.BLOCK)
                last = first + generated_id.BLOCK - 1
            self._leases[table.name] = (first + 1, last)
            value = generated_id.encode_block(first)
            return value, [shard_of(value, self.shards)]
        owner = shards[0] if shards else state.read()[0] % self.shards
        return generated_id.encode_range(owner, self._leased(state, str(owner), 1)), [owner]

    def _leased(self, state: State, name: str, count: int) -> int:
        """The first of count numbers that nobody else has."""
        for _ in range(20):
            version, x = state.read({})
            first = x.get(name, 1)
            try:
                state.write(version, {**x, name: first + count})
                return first
            except Busy:
                continue
        raise Busy("ids are in demand")

    def load(self, name: str, rows: DataFrame) -> int:
        """Bulk insert of rows of any shards; returns their number."""
        self._usable()
        table = self.catalog.tables[name]
        if table.attached:
            raise ReadOnly("an attached table is read only")
        before = self.store.snapshot(table)
        shaped = rows.select(*[F.col(f"`{c.name}`").cast(c.type).alias(c.name) for c in table.columns])
        if self.indexes:
            self.indexes.room(table)
        after, loaded = self.store.load(table, shaped, (lambda new, base: self.indexes.refuse_doubles(table, base, new)) if self.indexes else None)
        if self.indexes:
            self.indexes.changed(table, sorted(after.folders), before, after)
        return loaded

    # -- inspection
    def inspect(self, shard: int, sql: str, params: list = (), dialect: str = "sqlite") -> Executed:
        """A read of one chosen shard."""
        if not 0 <= shard < self.shards:
            raise InvalidArgument("a shard is out of range")
        statement, needed = parse_one(sql, dialect)
        if not isinstance(statement, Select):
            raise InvalidQuery("a query must be a read")
        values, table = bindable(list(params), needed), planner.found(self.catalog, statement.table.name)
        rows = self.placed(table).where(F.col("_shard") == shard) if table.placement == "sharded" else self.rows(table)
        return Executed([shard], select(statement, rows, table.names, values, self.spark))

    def placed(self, table: Table) -> DataFrame:
        """All rows with their ``_shard``."""
        rows = self.rows(table)
        if "_shard" in rows.columns:
            return rows
        from tessella.functions.routing import shard_column

        return rows.withColumn("_shard", shard_column(F.col(table.shard_key), table.key_type, self.shards) if table.placement == "sharded" else F.lit(0))

    def count(self, name: str) -> int:
        """Exact rows over all shards, checked against 64 bits."""
        table = self.catalog.tables[name]
        n = self.rows(table).count()
        if n >= 1 << 63:
            raise NumericOutOfRange("a count is out of range")
        return n

    def shard_counts(self, name: str) -> DataFrame:
        return pages.shard_counts(self.placed(self.catalog.tables[name]))

    def page(self, name: str, offset: int = 0, limit: int = pages.DEFAULT_PAGE) -> DataFrame:
        table = self.catalog.tables[name]
        pages.checked_page(offset, limit)
        if table.placement != "sharded" or table.attached or not self.store:
            return pages.page(table, self.placed(table), offset, limit)
        snapshot = self.store.snapshot(table)
        counts = {r["shard"]: r["rows"] for r in pages.shard_counts(self.store.read(table, None, snapshot)).collect()}  # one row a shard
        return pages.sliced_page(table, lambda k: self.store.read(table, [k], snapshot), [counts.get(k, 0) for k in range(self.shards)], offset, limit)

    def compact(self, name: str) -> dict:
        return self.store.compact(self.catalog.tables[name])

    def vacuum(self, name: str, older_than: float = 86_400.0) -> int:
        """Deletes what no retained version of a table names any more."""
        return self.store.vacuum(self.catalog.tables[name], older_than)

    def status(self) -> DataFrame:
        """A row for each table: placement, version, folders."""
        rows = []
        for t in self.catalog.tables.values():
            snap = self.store.snapshot(t) if self.store and not t.attached and t.columns else None
            rows.append((t.name, t.placement, self.shards, snap.version if snap else 0, sum(map(len, snap.folders.values())) if snap else 0, self.state))
        return self.spark.createDataFrame(rows, "table_name string, placement string, shards int, version int, folders int, state string")

    def session(self, routing_key=None) -> Session:
        self._usable()
        return Session(self, routing_key)

    def close(self) -> dict:
        again, self.state = self.state == "closed", "closed"
        return {"already_closed": again}

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()


# fixed values: what clients of the wire protocol expect of a server of this family
SERVER_VERSION, SERVER_VERSION_NUM, USER = "14.0-tessella", "140000", "tessella"
FUNCTIONS = {"version": f"PostgreSQL 14.0 (Tessella {SERVER_VERSION})", "current_database": "default", "current_schema": "public"}
USERS = {"current_user": USER, "session_user": USER}
SHOWN = {
    "server_version": SERVER_VERSION, "server_version_num": SERVER_VERSION_NUM, "server_encoding": "UTF8", "client_encoding": "UTF8", "standard_conforming_strings": "on", "integer_datetimes": "on", "TimeZone": "UTC",
    "transaction_isolation": "serializable", "transaction_read_only": "off", "search_path": "public", "DateStyle": "ISO, MDY", "IntervalStyle": "postgres", "extra_float_digits": "1",
    "default_transaction_isolation": "serializable", "default_transaction_read_only": "off", "session_authorization": USER,
}
SETTINGS = ("server_version", "server_version_num", "standard_conforming_strings", "timezone")


def system_probe(spark: SparkSession, sql: str) -> DataFrame:
    """What clients of a wire protocol ask about the server, by exact form; anything else is Unsupported."""
    text = " ".join(sql.strip().rstrip(";").lower().split())
    shown = {k.lower(): (k, v) for k, v in SHOWN.items()} | {"transaction isolation level": ("transaction_isolation", SHOWN["transaction_isolation"])}
    shown.pop("transaction_isolation")  # asked by its long name only
    known = {f"select {prefix}{k}()": (k, v) for k, v in FUNCTIONS.items() for prefix in ("", "pg_catalog.")}
    known |= {f"select {k}": (k, v) for k, v in USERS.items()} | {f"show {k}": x for k, x in shown.items()}
    known |= {f"select current_setting('{k}')": ("current_setting", shown[k][1]) for k in SETTINGS}
    if text not in known:
        raise Unsupported("this probe is not known")
    name, value = known[text]
    return spark.createDataFrame([(value,)], f"`{name}` string")


@dataclass
class Prepared:
    owner: Session
    statement: Statement
    parameters: int


@dataclass
class Portal:
    owner: Session
    prepared: Prepared
    params: list
    routing_key: object


@dataclass
class Session:
    """One client's state: routing key, prepared statements, portals, a transaction on one shard."""

    engine: Engine
    routing_key: object = None
    state: str = "ready"
    prepared: dict[str, Prepared] = field(default_factory=dict)
    portals: dict[str, Portal] = field(default_factory=dict)
    _staged: dict = field(default_factory=dict)
    _pinned: int | None = None

    def set_routing_key(self, key) -> None:
        shard_of(key, self.engine.shards)
        self.routing_key = key

    def clear_routing_key(self) -> None:
        self.routing_key = None

    # -- statements
    def query(self, sql: str, params: list = (), dialect: str = "sqlite", **limits) -> Result:
        return self._run(*self._bound(sql, params, dialect), self.routing_key, limits)

    def execute(self, sql: str, params: list = (), dialect: str = "sqlite"):
        return self._run(*self._bound(sql, params, dialect), self.routing_key, {})

    def cursor(self, sql: str, params: list = (), dialect: str = "sqlite"):
        return self.query(sql, params, dialect).cursor()

    def run_batch(self, sql: str, dialect: str = "sqlite") -> list[Result]:
        """Several statements at once; all of them must be reads."""
        batch = parse(sql, dialect)
        if len(batch.statements) > 1 and any(kind_of(s) != "read" for s in batch.statements):
            raise InvalidQuery("a batch takes reads only")
        return [self._run(s, bindable([], n), self.routing_key, {}) for s, n in zip(batch.statements, batch.parameters)]

    def _bound(self, sql: str, params: list, dialect: str) -> tuple[Statement, list]:
        statement, needed = parse_one(sql, dialect)
        return statement, bindable(list(params), needed)

    def _run(self, statement: Statement, params: list, routing_key, limits: dict):
        if self.state == "closed":
            raise FailedPrecondition("the session is closed")
        self.engine._usable()
        if isinstance(statement, Transaction):
            return self._transaction(statement.action)
        if self.state == "failed":
            raise TransactionAborted("the transaction failed and must be rolled back")
        try:
            if self.state == "transaction":
                return self._inside(statement, params, routing_key, limits)
            if isinstance(statement, Select):
                return self.engine.collect(self.engine._read(statement, params, routing_key), **limits)
            if isinstance(statement, (Insert, Update, Delete)):
                return self.engine._write(statement, params, routing_key)
            raise InvalidQuery("schema statements are run as migrations")
        except Exception:
            if self.state == "transaction":
                self.state = "failed"
            raise

    # -- transactions
    def _transaction(self, action: str) -> None:
        if action == "begin":
            if self.state != "ready":
                raise FailedPrecondition("a transaction is open already")
            self.state, self._staged, self._pinned = "transaction", {}, None
            return
        if self.state == "ready":
            raise FailedPrecondition("no transaction is open")
        failed, staged = self.state == "failed", self._staged
        self.state, self._staged, self._pinned = "ready", {}, None
        if action == "commit":
            if failed:
                raise TransactionAborted("the transaction failed and was rolled back")
            for entry in staged.values():
                if self.engine.store.snapshot(entry["table"]).version != entry["base"].version:
                    raise Busy("another writer changed a table of the transaction")
            engine, claims = self.engine, {}
            for name, entry in staged.items():
                table, base, now = entry["table"], entry["base"], entry["now"]
                entry["changed"] = [k for k in now.folders if now.folders[k] != base.folders.get(k)]
                if engine.indexes and entry["changed"]:
                    engine.indexes.room(table)
                    new, gone = (engine.store.read(table, entry["changed"], x) for x in (now, base))
                    claims[name] = engine.indexes.refuse_doubles(table, base, new, gone)
            for name, entry in staged.items():
                table, base, changed = entry["table"], entry["base"], entry["changed"]
                if not (engine.indexes and changed):
                    engine.store.publish(table, base, entry["now"].folders)
                    continue
                with engine.indexes.claimed(claims[name], changed[0]):
                    after = engine.store.publish(table, base, entry["now"].folders)
                engine.indexes.changed(table, changed, base, after)

    def _inside(self, statement: Statement, params: list, routing_key, limits: dict):
        if not isinstance(statement, (Select, Insert, Update, Delete)):
            raise InvalidQuery("schema statements are run as migrations")
        plan = planner.plan(statement, self.engine.catalog, params, self.engine.shards, routing_key)
        if plan.table is not None and plan.table.placement == "sharded":
            targets = plan.shards if plan.shards is not None else None
            if targets is None and self._pinned is not None:
                plan.shards = targets = [self._pinned]
                routing_key = None
            if targets is None or len(targets) > 1:
                raise FailedPrecondition("a statement of a transaction touches one shard")
            if targets and self._pinned is None:
                self._pinned = targets[0]
            if targets and targets[0] != self._pinned:
                raise FailedPrecondition("the transaction lies on another shard")
        if isinstance(statement, Select):
            overlay = {n: e["now"] for n, e in self._staged.items() if "now" in e}
            if plan.table is not None and plan.shards is not None and plan.table.placement == "sharded":
                rows = self.engine.rows(plan.table, plan.shards, overlay.get(plan.table.name))
                frame = select(statement, rows.where(F.lit(False)) if plan.empty else rows, plan.table.names, params, self.engine.spark)
                return self.engine.collect(Executed(plan.targets(self.engine.shards), frame), **limits)
            return self.engine.collect(self.engine._read(statement, params, None, overlay), **limits)
        planner.checked_write(plan)
        return self.engine._change(plan, statement, params, self._staged)

    # -- prepared statements
    def prepare(self, name: str, sql: str, dialect: str = "sqlite") -> Prepared:
        """Keeps one parsed statement; planning waits for each execution."""
        statement, needed = parse_one(sql, dialect)
        if name not in self.prepared and len(self.prepared) >= MAX_PREPARED:
            raise LimitExceeded("too many prepared statements")
        if isinstance(statement, (CreateTable, CreateIndex)):
            raise Unsupported("schema statements cannot be prepared")
        self.prepared[name] = Prepared(self, statement, needed)
        return self.prepared[name]

    def describe(self, prepared: Prepared) -> list[dict]:
        """Columns of a prepared read, without running it."""
        self._own(prepared)
        if not isinstance(prepared.statement, Select):
            return []
        frame = self.engine._read(prepared.statement, [None] * prepared.parameters).frame
        return [{"name": n, "type": t} for n, t in frame.dtypes]

    def bind(self, name: str, prepared: Prepared, params: list = ()) -> Portal:
        """Snapshots parameters and routing key."""
        self._own(prepared)
        values = bindable(list(params), prepared.parameters)
        held = sum(len(v.encode()) if isinstance(v, str) else len(v) if isinstance(v, bytes) else 8 for p in self.portals.values() for v in p.params if v is not None)
        if name not in self.portals and len(self.portals) >= MAX_PORTALS or held + sum(len(v) for v in values if isinstance(v, (str, bytes))) > MAX_BOUND_BYTES:
            raise LimitExceeded("too many or too large bound statements")
        if not isinstance(prepared.statement, Transaction):
            self.engine._plan(prepared.statement, values, self.routing_key)
        self.portals[name] = Portal(self, prepared, values, self.routing_key)
        return self.portals[name]

    def execute_portal(self, portal: Portal, **limits):
        """Plans anew, under the schema and data of now, and runs."""
        self._own(portal)
        return self._run(portal.prepared.statement, portal.params, portal.routing_key, limits)

    def _own(self, handle: Prepared | Portal) -> None:
        if handle.owner is not self:
            raise InvalidArgument("the handle belongs to another session")

    def close(self) -> None:
        self._staged, self.state = {}, "closed"
        self.prepared.clear()
        self.portals.clear()

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.close()


__all__ = ["CancellationToken", "DataCorruption", "Engine", "Session", "system_probe"]
