"""Secondary indexes over all shards of a table.

Entries are (key, shard, locator): the order-preserving key, where the row
lies, and its encoded primary key or row id. They are Parquet by shard, sorted by
key, so a lookup reads few row groups. Each shard's entries remember which
folders of the table they were made from; a shard whose folders differ is
uncertain, and a lookup always adds uncertain shards to its candidates.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import FailedPrecondition, InvalidArgument, UniqueViolation, Unsupported
from tessella.functions.blake3 import digests
from tessella.functions.index_key import MAX_PARTS, Part, decode, encode, encode_unique, key_column, part_for
from tessella.operators.authority import Authority
from tessella.operators.summary import SHAPE, Summary, collected, exclusion, numbered, summarised
from tessella.plans import planner
from tessella.plans.compiler import as_truth, scope
from tessella.plans.domains import ANY, MAX_KEYS, range_domain, value_domain
from tessella.plans.parser import parse_one
from tessella.plans.planner import Plan
from tessella.plans.syntax import has_aggregate
from tessella.sources.catalog import Table
from tessella.sources.files import State
from tessella.sources.storage import Snapshot

#: shards noted for repair by reads, at most
MAX_REPAIRS = 64
#: located rows that a read names one by one, at most; beyond, it reads the candidates' shards by its condition alone
MAX_LOCATED = 4096
#: new keys that a write reserves by name; beyond, the table's version alone decides between two writers
MAX_RESERVED = 4096
PARTITION_DOMAIN = b"tessella index partition 1\0"
ENTRY = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("locator", T.BinaryType())])
#: lifecycle: what each state may become
STATES = {
    "declared": {"building", "dropped"}, "building": {"validating", "failed", "dropped"}, "validating": {"ready", "failed", "dropped"}, "ready": {"rebuilding", "failed", "dropping"},
    "rebuilding": {"validating", "failed", "dropping"}, "failed": {"rebuilding", "building", "dropping"}, "dropping": {"dropped"}, "dropped": set(),
}


@dataclass(frozen=True)
class IndexPart:
    """A column, or an expression over the table's columns; an index with an expression is kept and read by name, but routes no query."""

    column: str = ""
    descending: bool = False
    nulls_last: bool | None = None
    expression: str | None = None

    def __post_init__(self) -> None:
        if bool(self.column) == bool(self.expression):
            raise InvalidArgument("an index part is a column or an expression")


#: Spark types of an expression's kinds
EXPRESSION_TYPES = {"int": "bigint", "float": "double", "bool": "boolean", "text": "string", "blob": "binary", "binary": "binary"}


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    parts: tuple[IndexPart, ...]
    unique: bool = False
    nulls_distinct: bool = True
    #: SQL condition; rows that do not meet it have no entry
    predicate: str | None = None
    #: 'sync' entries follow each write, 'async' ones the change log
    mode: str = "sync"
    #: entries of one shard lie in this many hash partitions of keys: 1 or a power of two
    partitions: int = 1

    @property
    def computed(self) -> bool:
        return any(p.expression for p in self.parts)

    def __post_init__(self) -> None:
        if not 1 <= len(self.parts) <= MAX_PARTS:
            raise InvalidArgument(f"an index has 1 to {MAX_PARTS} parts")
        if self.mode not in ("sync", "async") or self.partitions < 1 or self.partitions & (self.partitions - 1):
            raise InvalidArgument("an index is sync or async and has a power of two partitions")


def partitions_of(index: Index, keys: list[bytes]) -> list[int]:
    """The partition of each key: the low bits of a digest of the index's name and the key."""
    if index.partitions == 1 or not keys:
        return [0] * len(keys)
    low = digests([PARTITION_DOMAIN + index.name.encode() + b"\0" + k for k in keys])[:, 0]
    return [int(x) & (index.partitions - 1) for x in low]


def partition_column(index: Index, key: Column) -> Column:
    if index.partitions == 1:
        return F.lit(0)

    @F.arrow_udf("int")
    def run(keys: pa.Array) -> pa.Array:
        return pa.array(partitions_of(index, [bytes(k) for k in keys.to_pylist()]), pa.int32())

    return run(key)


@dataclass
class IndexState:
    index: Index
    state: str = "declared"
    #: entries' folder of each shard
    entries: dict[int, str] = field(default_factory=dict)
    #: the table's folders that the entries of each shard were made from
    applied: dict[int, list[str]] = field(default_factory=dict)
    summaries: str | None = None
    version: int = 0

    def as_json(self) -> dict:
        return {"index": asdict(self.index), "state": self.state, "entries": self.entries, "applied": self.applied, "summaries": self.summaries}

    @classmethod
    def from_json(cls, version: int, x: dict) -> IndexState:
        index = Index(**{**x["index"], "parts": tuple(IndexPart(**p) for p in x["index"]["parts"])})
        return cls(index, x["state"], {int(k): v for k, v in x["entries"].items()}, {int(k): v for k, v in x["applied"].items()}, x["summaries"], version)

    def moved(self, to: str) -> None:
        if to not in STATES[self.state]:
            raise FailedPrecondition(f"an index that is {self.state} cannot become {to}")
        self.state = to


class Indexes:
    """The indexes of one engine."""

    def __init__(self, engine) -> None:
        self.engine, self.spark = engine, engine.spark
        self.root, self.files = f"{engine.store.root}/indexes", engine.store.files
        self._summaries: dict[str, dict[int, Summary]] = {}

    # -- state
    def _at(self, name: str) -> State:
        return State(self.files, f"{self.root}/{name}/versions")

    def get(self, name: str) -> IndexState:
        version, x = self._at(name).read()
        if not version or x["state"] == "dropped":
            raise InvalidArgument("the index is not known")
        return IndexState.from_json(version, x)

    def _put(self, s: IndexState) -> None:
        s.version = self._at(s.index.name).write(s.version, s.as_json())

    def all(self, table: str | None = None) -> list[IndexState]:
        out = []
        for name in self.files.names(self.root):
            version, x = self._at(name).read()
            if version and x["state"] != "dropped" and (table is None or x["index"]["table"] == table):
                out.append(IndexState.from_json(version, x))
        return out

    def _table(self, index: Index) -> Table:
        return self.engine.catalog.tables[index.table]

    # -- keys
    def _expression(self, table: Table, rows: DataFrame, text: str):
        """The typed value of an expression over rows of the table."""
        statement, _ = parse_one(f"SELECT {text} FROM {table.name}")
        if len(statement.items) != 1 or has_aggregate(statement.items[0].expression):
            raise InvalidArgument("an index part is one expression of a row")
        return scope(rows, table.names, [], statement.table.name).of(statement.items[0].expression)

    def parts(self, index: Index) -> list[Part]:
        table, rows = self._table(index), None
        out = []
        for p in index.parts:
            if p.expression:
                rows = self.engine.store.read(table, [], Snapshot(0, {})) if rows is None else rows
                kind = self._expression(table, rows, p.expression).kind
                if kind not in EXPRESSION_TYPES:
                    raise Unsupported("an index expression is of a type that has no key")
                out.append(part_for(EXPRESSION_TYPES[kind], p.descending, p.nulls_last))
                continue
            column = table.column(p.column)
            if column is None:
                raise InvalidArgument("an index part is no column of its table")
            out.append(part_for(column.type, p.descending, p.nulls_last))
        return out

    def _key(self, index: Index, rows: DataFrame) -> Column:
        table = self._table(index)
        values = [self._expression(table, rows, p.expression).column if p.expression else F.col(f"`{p.column}`") for p in index.parts]
        return key_column(list(zip(values, self.parts(index))), index.unique, index.nulls_distinct)

    def keyed(self, index: Index, rows: DataFrame) -> DataFrame:
        """(_shard, key, locator) of the rows that the index covers."""
        table = self._table(index)
        if index.predicate:
            statement, _ = parse_one(f"SELECT 1 FROM {table.name} WHERE {index.predicate}")
            rows = rows.where(as_truth(scope(rows, table.names, [], statement.table.name).of(statement.where)))
        kinds, key = dict(rows.dtypes), self._key(index, rows)
        if table.primary:
            locator = key_column([(F.col(f"`{c}`"), part_for(kinds[c])) for c in table.primary])
        else:
            locator = (F.col("_rid") if "_rid" in kinds else F.lit(None)).cast("binary")
        return rows.select("_shard", key.alias("key"), locator.alias("locator")).where(F.col("key").isNotNull())

    # -- lifecycle
    def create(self, index: Index) -> IndexState:
        """Declares, builds and validates an index."""
        if self._at(index.name).read()[0] and index.name in [s.index.name for s in self.all()]:
            raise InvalidArgument("the index exists already")
        if self._table(index).placement != "sharded":
            raise FailedPrecondition("only sharded tables have global indexes")
        self.parts(index)
        s = IndexState(index, version=self._at(index.name).read()[0])
        s.moved("building")
        self._put(s)
        return self._build(s)

    def rebuild(self, name: str) -> IndexState:
        s = self.get(name)
        s.moved("rebuilding")
        s.entries, s.applied = {}, {}
        self._put(s)
        return self._build(s)

    def _build(self, s: IndexState) -> IndexState:
        """Builds the shards that have no entries yet, so a build that stopped goes on where it was."""
        table = self._table(s.index)
        snapshot = self.engine.store.snapshot(table)
        missing = [k for k in range(self.engine.shards) if s.applied.get(k) != snapshot.folders.get(k, [])]
        try:
            self._apply(s, table, snapshot, missing)
            s.moved("validating")
            if s.index.unique and self._doubles(s).limit(1).count():
                raise UniqueViolation("the index's key stands twice")
            s.moved("ready")
        except Exception:
            s.moved("failed")
            self._put(s)
            raise
        self._put(s)
        return s

    def _doubles(self, s: IndexState) -> DataFrame:
        return self.entries(s).groupBy("key").count().where("count > 1")

    def _apply(self, s: IndexState, table: Table, snapshot: Snapshot, shards: list[int]) -> None:
        """Makes the entries and summaries of shards from one snapshot; other shards keep theirs."""
        if shards:
            self.write(s, self.keyed(s.index, self.engine.store.read(table, shards, snapshot)), shards)
            for k in shards:
                s.applied[k] = list(snapshot.folders.get(k, []))
        self.summarise(s, shards)

    def write(self, s: IndexState, entries: DataFrame, shards: list[int]) -> None:
        """Writes all entries (_shard, key, locator) of the shards; adaptive execution splits a large shard."""
        base = f"{self.root}/{s.index.name}/data/{uuid.uuid4().hex}"
        dealt = entries.select("_shard", "key", "locator").hint("rebalance", F.col("_shard")).withColumn("_part", partition_column(s.index, F.col("key")))
        dealt.sortWithinPartitions("_shard", "_part", "key").write.partitionBy("_shard", "_part").parquet(base)
        found = {int(n[7:]) for n in self.files.names(base) if n.startswith("_shard=")}
        for k in shards:
            s.entries.pop(k, None)
            if k in found:
                s.entries[k] = f"{base}/_shard={k}"

    def _merge(self, s: IndexState, after: Snapshot, shards: list[int], gone: DataFrame | None, new: DataFrame | None) -> None:
        """Entries and summaries of shards that one statement changed: no other row's key is encoded again.

        Summaries only gain: bits and bounds of rows that are gone stay until a rebuild, which excludes less, never more.
        """
        kept, lost, added = self.entries(s, shards), 0, None
        if gone is not None:
            out = self.keyed(s.index, gone).select("_shard", "locator")
            lost = out.count()
            kept = kept.join(out, ["_shard", "locator"], "left_anti")
        if new is not None:
            added = self.keyed(s.index, new)
            kept = kept.select("_shard", "key", "locator").unionByName(added)
        self.write(s, kept, shards)
        for k in shards:
            s.applied[k] = list(after.folders.get(k, []))
        known = dict(self.summaries(s))
        more = collected(summarised(added)) if added is not None else {}
        for k in shards:
            x = known.pop(k, None)
            if x is None and k in more:
                known[k] = more[k]
            elif x is not None:
                y = x.merged(more[k]) if k in more else x
                known[k] = replace(y, keys=max(0, y.keys - lost)) if len(shards) == 1 else y
        rows = [(x.shard, x.keys, x.words.view("int64").tolist(), x.least, x.greatest) for x in known.values()]
        path = f"{self.root}/{s.index.name}/summaries/{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(path)
        s.summaries = path
        self._summaries.pop(s.index.name, None)

    def summarise(self, s: IndexState, shards: list[int]) -> None:
        """Writes the summaries of the shards' entries beside those of all other shards."""
        rows = summarised(self.entries(s, shards))
        if s.summaries:
            rows = rows.unionByName(self.spark.read.schema(SHAPE).parquet(s.summaries).where(~F.col("shard").isin(shards)))
        path = f"{self.root}/{s.index.name}/summaries/{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(path)
        s.summaries = path
        self._summaries.pop(s.index.name, None)

    # -- writes
    def unique(self, table: Table) -> list[IndexState]:
        return [s for s in self.all(table.name) if s.index.unique and s.state == "ready"]

    def _others(self, s: IndexState, table: Table, before: Snapshot, gone: DataFrame | None) -> DataFrame:
        """(key, locator, _shard) of all rows of the version but those that are gone, uncertain shards from the rows themselves."""
        late = [k for k in range(self.engine.shards) if s.applied.get(k, []) != before.folders.get(k, [])]
        out = self.entries(s, [k for k in range(self.engine.shards) if k not in late]).select("_shard", "key", "locator")
        if late:
            out = out.unionByName(self.keyed(s.index, self.engine.store.read(table, late, before)))
        if gone is not None:
            out = out.join(self.keyed(s.index, gone).select("_shard", "locator"), ["_shard", "locator"], "left_anti")
        return out

    def refuse_doubles(self, table: Table, before: Snapshot, new: DataFrame, gone: DataFrame | None = None) -> list[tuple[str, list[bytes]]]:
        """Raises UniqueViolation where new rows repeat a unique key, among themselves or of any shard; else the new keys by index.

        Rows without a key (nulls that are distinct, or outside a partial index) claim nothing.
        """
        out = []
        for s in self.unique(table):
            fresh = self.keyed(s.index, new).select("key")
            some = [bytes(r["key"]) for r in fresh.limit(MAX_RESERVED + 1).collect()]
            few = len(some) <= MAX_RESERVED
            doubled = len(set(some)) < len(some) if few else fresh.groupBy("key").count().where("count > 1").limit(1).count()
            others = self._others(s, table, before, gone)
            met = others.where(F.col("key").isin([bytearray(k) for k in some])) if few else others.join(fresh, "key", "left_semi")
            if doubled or some and met.limit(1).count():
                raise UniqueViolation("a key of a unique index stands twice")
            out.append((s.index.name, some if few else []))
        return out

    def without_doubles(self, table: Table, before: Snapshot, new: DataFrame) -> DataFrame:
        """The new rows of an INSERT OR IGNORE whose unique keys no row has yet."""
        for s in self.unique(table):
            keyed = self._with_key(s.index, new)
            some = [bytearray(r["_key"]) for r in keyed.select("_key").where(F.col("_key").isNotNull()).collect()]  # bounded by the statement's length
            taken = [bytearray(r["key"]) for r in self._others(s, table, before, None).where(F.col("key").isin(some)).select("key").distinct().collect()] if some else []
            if taken:
                new = keyed.where(F.col("_key").isNull() | ~F.col("_key").isin(taken)).drop("_key")
        return new

    @contextmanager
    def claimed(self, claims: list[tuple[str, list[bytes]]], shard: int) -> Iterator[None]:
        """Reserves the keys while the block publishes; what fails leaves no reservation."""
        held = []
        try:
            for name, keys in claims:
                if keys:
                    operation = uuid.uuid4().bytes
                    Authority(self.engine, name).reserve(operation, keys, shard)
                    held.append((name, operation))
            yield
        except BaseException:
            for name, operation in held:
                Authority(self.engine, name).rollback(operation)
            raise
        for name, operation in held:
            Authority(self.engine, name).finalize(operation)

    def room(self, table: Table) -> None:
        """Raises Busy, before anything is published, where a change log of the table is full."""
        from tessella.streaming.outbox import Outbox

        for s in self.all(table.name):
            if s.index.mode == "async":
                Outbox(self.engine, s.index.name).room()

    def changed(self, table: Table, shards: list[int], before: Snapshot, after: Snapshot, gone: DataFrame | None = None, new: DataFrame | None = None) -> None:
        """Called after each commit: sync indexes follow, async ones have their change log.

        gone, new: the rows that one statement took out and put in; without both, whole versions are compared.
        """
        from tessella.streaming.outbox import Outbox

        told = gone is not None or new is not None
        for s in self.all(table.name):
            if s.index.mode == "async":
                Outbox(self.engine, s.index.name).append(table, shards, before, after, gone, new)
            elif s.state == "ready":
                certain = all(s.applied.get(k, []) == before.folders.get(k, []) for k in shards)
                if told and certain and len(shards) == 1:
                    self._merge(s, after, shards, gone, new)
                else:
                    self._apply(s, table, after, shards)
                self._put(s)

    def drop(self, name: str) -> None:
        s = self.get(name)
        s.moved("dropping") if s.state != "declared" else None
        s.moved("dropped")
        self._put(s)
        for folder in ("data", "summaries", "orders"):
            self.files.delete(f"{self.root}/{name}/{folder}")

    # -- entries
    def entries(self, s: IndexState, shards: list[int] | None = None, keys: list[bytes] | None = None) -> DataFrame:
        """(key, locator, _shard) of the shards, all by default; of the keys, all by default, only their partitions are read."""
        out = None
        for base, folders in itertools.groupby(sorted((p.rsplit("/", 1)[0], k) for k, p in s.entries.items() if shards is None or k in shards), key=lambda x: x[0]):
            paths = [s.entries[k] for _, k in folders]
            shape = T.StructType([*ENTRY.fields, T.StructField("_shard", T.IntegerType()), T.StructField("_part", T.IntegerType())])
            part = self.spark.read.schema(shape).option("basePath", base).parquet(*paths)
            if keys is not None:
                part = part.where(F.col("_part").isin(sorted(set(partitions_of(s.index, keys)))) & F.col("key").isin([bytearray(k) for k in keys]))
            part = part.drop("_part")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], T.StructType([*ENTRY.fields, T.StructField("_shard", T.IntegerType())]))

    def uncertain(self, s: IndexState) -> list[int]:
        """Shards that the entries cannot speak for: changed since, paused or broken."""
        now = self.engine.store.snapshot(self._table(s.index)).folders
        if s.state != "ready":
            return list(range(self.engine.shards))
        late = [k for k in range(self.engine.shards) if s.applied.get(k, []) != now.get(k, [])]
        if s.index.mode == "async":
            from tessella.streaming.outbox import Outbox

            late = sorted({*late, *Outbox(self.engine, s.index.name).behind()})
        return late

    def keys(self, index: Index, values: list[tuple]) -> list[bytes]:
        parts = self.parts(index)
        got = (encode_unique(parts, list(v), index.nulls_distinct) if index.unique else encode(parts, list(v)) for v in values)
        return sorted({k for k in got if k is not None})

    def candidates(self, s: IndexState, values: list[tuple]) -> DataFrame:
        """Entries of the keys; the filter reaches the Parquet scan."""
        keys = self.keys(s.index, values)
        return self.entries(s, keys=keys) if keys else self.entries(s).where(F.lit(False))

    def located(self, s: IndexState, values: list[tuple]) -> tuple[list[int], list[bytes] | None]:
        """Shards of the candidates, and their locators; None in place of more than MAX_LOCATED."""
        found = self.candidates(s, values)
        some = found.select("_shard", "locator").limit(MAX_LOCATED + 1).collect()
        if len(some) > MAX_LOCATED:
            return sorted(r["_shard"] for r in found.select("_shard").distinct().collect()), None
        return sorted({r["_shard"] for r in some}), [bytes(r["locator"]) for r in some if r["locator"] is not None]

    def located_rows(self, table: Table, shards: list[int], locators: list[bytes] | None, late: list[int], snapshot: Snapshot | None = None) -> DataFrame:
        """Rows of the shards that the locators name, and all rows of the shards that are late.

        Locators become values of the primary key's columns, or row ids, in a filter that the scan takes; files are sorted
        by the shard key, so it reads few row groups. The caller's own condition decides between what the filter lets in.
        """
        store, snapshot = self.engine.store, snapshot or self.engine.store.snapshot(table)
        sure = [k for k in shards if k not in late]
        if locators is None or not sure:
            return store.read(table, sorted({*shards, *late}), snapshot)
        rows = store.read(table, sure, snapshot)
        if table.primary:
            found = [[v for _, v in decode(x)] for x in locators]
            for i, c in enumerate(table.primary):
                kind = table.column(c).type
                if kind in ("bigint", "int", "smallint", "tinyint", "string", "binary", "boolean"):
                    rows = rows.where(F.col(f"`{c}`").isin(sorted({x[i] for x in found if x[i] is not None})) if found else F.lit(False))
        else:
            rows = rows.where(F.col("_rid").isin(sorted({x.decode() for x in locators})) if locators else F.lit(False))
        return rows.unionByName(store.read(table, late, snapshot)) if late else rows

    def lookup(self, name: str, values: list[tuple]) -> DataFrame:
        """The table's rows that the index finds, uncertain shards read whole and filtered by key."""
        s = self.get(name)
        table, keys = self._table(s.index), self.keys(s.index, values)
        late = self.uncertain(s)
        rows = self.located_rows(table, *self.located(s, values), late)
        return self._with_key(s.index, rows).where(F.col("_key").isin([bytearray(k) for k in keys]) if keys else F.lit(False)).select(*table.names)

    def _with_key(self, index: Index, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_key", self._key(index, rows))

    # -- planning
    def narrow(self, plan: Plan, params: list) -> None:
        """Routes a read by the best index, then takes out shards that summaries exclude."""
        statement, table = plan.statement, plan.table
        if statement.where is None or plan.shards == []:
            return
        found = self.all(table.name)
        choices = []
        for s in found:
            if s.state != "ready" or s.index.predicate or s.index.computed:
                continue
            parts = self.parts(s.index)
            domains = [value_domain(statement.where, planner.is_column(statement, p.column), q.kind, params) for p, q in zip(s.index.parts, parts)]
            if any(d is ANY for d in domains):
                continue
            size = 1
            for d in domains:
                size *= len(d)
            if size > MAX_KEYS:
                plan.index = "fallback"
                continue
            choices.append((not s.index.unique, size, -len(parts), s.index.name, s, domains))
        keys = None
        if choices:
            *_, s, domains = min(choices, key=lambda c: c[:4])
            values = list(itertools.product(*domains))
            keys = self.keys(s.index, values)
            # what is uncertain is read before the entries, so a commit between the two is not missed
            # and shards of pending reservations may get the key at any time
            plan.uncertain = sorted({*self.uncertain(s), *Authority(self.engine, s.index.name).shards(keys)})
            plan.candidates, plan.locators = self.located(s, values) if keys else ([], [])
            plan.index_name = s.index.name
            routed = {*plan.candidates, *plan.uncertain}
            plan.shards = sorted(k for k in routed if plan.shards is None or k in plan.shards)
            plan.index = "routed" if plan.shards else "empty"
        for s in found:
            if s.state != "ready" or s.index.predicate or s.index.computed or plan.shards == []:
                continue
            own = keys if s.index.name == plan.index_name else None
            part = self.parts(s.index)[0]
            bounds = range_domain(statement.where, planner.is_column(statement, s.index.parts[0].column), part.kind, params)
            if own is None and bounds is ANY:
                continue
            late, summaries = self.uncertain(s), self.summaries(s)
            now = plan.shards if plan.shards is not None else list(range(self.engine.shards))
            for k in now:
                if k in late or k in plan.candidates or k in plan.uncertain:
                    continue
                why = exclusion(summaries[k], own, part, bounds) if k in summaries else ("empty_summary" if k in s.applied and k not in s.entries else None)
                if why:
                    plan.pruned[k] = why
            if any(k in plan.pruned for k in now):
                plan.shards = [k for k in now if k not in plan.pruned]

    def summaries(self, s: IndexState) -> dict[int, Summary]:
        """One row a shard; a summary that cannot be read excludes nothing."""
        if s.index.name not in self._summaries or self._summaries[s.index.name][0] != s.summaries:
            try:
                got = collected(self.spark.read.schema(SHAPE).parquet(s.summaries)) if s.summaries else {}
            except Exception:
                got = {}
            self._summaries[s.index.name] = (s.summaries, got)
        return self._summaries[s.index.name][1]

    # -- checks
    def verify(self, name: str, values: list[tuple]) -> DataFrame:
        """(key, _shard, locator, outcome) of each candidate.

        verified: its row has the key; mismatched_key: its row has another;
        missing_row: the shard has no such row; invalid_locator: it names none.
        The rows' side is read only on the candidates' shards.
        """
        s = self.get(name)
        table = self._table(s.index)
        found = self.candidates(s, values)
        shards = sorted(r["_shard"] for r in found.select("_shard").distinct().collect())
        now = self.keyed(s.index, self.engine.store.read(table, shards)).select("_shard", "locator", F.col("key").alias("now"))
        met = found.join(now, ["_shard", "locator"], "left")
        valid = F.substring("locator", 1, 4) == F.lit(b"BIDX") if table.primary else F.length("locator") > 0
        outcome = F.when(~F.coalesce(valid, F.lit(False)), "invalid_locator").when(F.col("now").isNull(), "missing_row").when(F.col("now") != F.col("key"), "mismatched_key").otherwise("verified")
        return met.select("key", "_shard", "locator", outcome.alias("outcome"))

    def checked_lookup(self, name: str, values: list[tuple]) -> DataFrame:
        """lookup, after verification: stale candidates are noted for repair, and then no shard is taken as known."""
        s = self.get(name)
        stale = self.verify(name, values).where(F.col("outcome") != "verified").select("_shard").distinct().collect()
        if not stale:
            return self.lookup(name, values)
        queue = State(self.files, f"{self.root}/{name}/repairs")
        version, x = queue.read({"shards": []})
        queue.write(version, {"shards": sorted({*x["shards"], *(r["_shard"] for r in stale)})[:MAX_REPAIRS]})
        rows = self.engine.store.read(self._table(s.index))
        keys = self.keys(s.index, values)
        return self._with_key(s.index, rows).where(F.col("_key").isin([bytearray(k) for k in keys]) if keys else F.lit(False)).select(*self._table(s.index).names)

    def repair_noted(self, name: str) -> int:
        """Makes the entries of the noted shards anew; returns their number."""
        queue = State(self.files, f"{self.root}/{name}/repairs")
        version, x = queue.read({"shards": []})
        if x["shards"]:
            s = self.get(name)
            table = self._table(s.index)
            self._apply(s, table, self.engine.store.snapshot(table), x["shards"])
            self._put(s)
            queue.write(version, {"shards": []})
        return len(x["shards"])

    def validate(self, name: str, sample: int | None = None) -> DataFrame:
        """(issue, _shard, key, locator): entries against keys recomputed from the rows, all or a sample of entries."""
        s = self.get(name)
        want = self.keyed(s.index, self.engine.store.read(self._table(s.index))).select("_shard", "key", "locator", F.lit(True).alias("want"))
        have = self.entries(s).select("_shard", "key", "locator", F.lit(True).alias("have"))
        if sample is not None:
            total = have.count()
            picked = sample_ordinals(total, sample)
            return numbered(have, "key", "_shard", "locator", path=f"{self.root}/{name}/orders/{uuid.uuid4().hex}").where(F.col("n").isin(picked)).drop("n").join(want, ["_shard", "key", "locator"], "left").where(F.col("want").isNull()).select(F.lit("stale_entry").alias("issue"), "_shard", "key", "locator")
        met = want.join(have, ["_shard", "key", "locator"], "full")
        return met.where(F.col("want").isNull() | F.col("have").isNull()).select(F.when(F.col("have").isNull(), "missing_entry").otherwise("stale_entry").alias("issue"), "_shard", "key", "locator")

    def repair(self, name: str) -> int:
        """Makes the entries of every shard with an issue anew; unique indexes are rebuilt instead."""
        s = self.get(name)
        if s.index.unique:
            raise FailedPrecondition("a unique index is rebuilt, not repaired")
        broken = sorted(r["_shard"] for r in self.validate(name).select("_shard").distinct().collect())
        table = self._table(s.index)
        self._apply(s, table, self.engine.store.snapshot(table), broken)
        self._put(s)
        return len(broken)

    def status(self) -> DataFrame:
        """A row for each index: state, entries, freshness, filter figures."""
        from tessella.functions import bloom

        rows = []
        for s in self.all():
            found, late = self.summaries(s), self.uncertain(s)
            ppm = max([bloom.false_positive_ppm(x.words) for x in found.values()], default=0)
            health = "unavailable" if s.state == "failed" else "degraded" if late or s.state != "ready" else "healthy"
            rows.append((s.index.name, s.index.table, s.state, sum(x.keys for x in found.values()), late, ppm, health))
        return self.spark.createDataFrame(rows, "index_name string, table_name string, state string, entries long, uncertain array<int>, false_positive_ppm int, health string")


def sample_ordinals(total: int, most: int) -> list[int]:
    """Evenly spread ordinals, first and last among them."""
    if total <= most:
        return list(range(total))
    return [0] if most == 1 else [i * (total - 1) // (most - 1) for i in range(most)]
