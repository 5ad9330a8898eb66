"""The change log of an asynchronous index, and the stream that applies it.

A commit appends one segment of events: ordinal, shard, kind, old and new key,
locator. The state document names each segment and its first cursor; a segment
that it does not name was never committed. It is written aside, named, and only
then moved into the log, so a Structured Streaming query that reads the log as a
file source sees committed events alone, applies each batch to the index's entries
and moves the durable cursor; its checkpoint and the cursor make a batch that runs
twice apply once. A commit whose events were lost with its writer leaves its shard
uncertain, which costs pruning but hides no row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import Busy, DataCorruption, FailedPrecondition, InvalidArgument
from tessella.operators.summary import numbered
from tessella.sources.catalog import Table
from tessella.sources.files import State
from tessella.sources.storage import Snapshot

MAX_BATCH, MAX_EVENTS = 4096, 1_000_000
EVENT = "cursor long, shard int, kind string, old_key binary, new_key binary, locator binary"
STORED = "n long, shard int, kind string, old_key binary, new_key binary, locator binary, seg string"


EVENT_COLUMNS = ["shard", "kind", "old_key", "new_key", "locator"]


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, shard, old_key, new_key, locator) between two sets of entries (_shard, key, locator)."""
    a = old.select(F.col("_shard").alias("shard"), "locator", F.col("key").alias("old_key"))
    b = new.select(F.col("_shard").alias("shard"), "locator", F.col("key").alias("new_key"))
    met = a.join(b, ["shard", "locator"], "full").where(~F.col("old_key").eqNullSafe(F.col("new_key")))
    kind = F.when(F.col("old_key").isNull(), "insert").when(F.col("new_key").isNull(), "delete").otherwise("update")
    return met.select("shard", kind.alias("kind"), "old_key", "new_key", "locator")


class Outbox:
    def __init__(self, engine, index: str) -> None:
        self.engine, self.index = engine, index
        self.root = f"{engine.store.root}/outbox/{index}"
        self.state = State(engine.store.files, f"{self.root}/versions")

    def _read(self) -> tuple[int, dict]:
        return self.state.read({"high": {}, "applied": {}, "base": {}, "paused": False, "poison": {}, "fence": 0, "owner": None, "pruned": 0, "next": 1, "segments": []})

    # -- writers
    def room(self) -> None:
        """Raises Busy where the log is full; asked before a write is published, so that none is refused afterwards."""
        _, x = self._read()
        if x["next"] - x["pruned"] > MAX_EVENTS:
            raise Busy("the change log is full")

    def append(self, table: Table, shards: list[int], before: Snapshot, after: Snapshot, gone: DataFrame | None = None, new: DataFrame | None = None) -> int:
        """Logs what a commit changed in the shards; returns the last cursor.

        gone, new: the rows that the write took out and put in; without both, the shards' versions are compared.
        """
        indexes, store = self.engine.indexes, self.engine.store
        s = indexes.get(self.index)
        if gone is None and new is None:
            gone, new = store.read(table, shards, before), store.read(table, shards, after)
        empty = store.read(table, [], Snapshot(0, {}))
        made = changes(*(indexes.keyed(s.index, empty if x is None else x) for x in (gone, new)))
        name = uuid.uuid4().hex
        aside = f"{self.root}/aside/seg={name}"
        order = f"{self.root}/orders/{name}"
        numbered(made, "shard", "locator", path=order).select("n", "shard", "kind", "old_key", "new_key", "locator").write.parquet(aside)
        store.files.delete(order)
        n = self.engine.spark.read.schema(STORED.rsplit(",", 1)[0]).parquet(aside).count()  # from the footers
        for _ in range(20):
            version, x = self._read()
            first = x["next"]
            for k in shards:
                x["base"][str(k)] = after.folders.get(k, [])
                if n:
                    x["high"][str(k)] = first + n - 1
            if n:
                x["segments"].append({"name": name, "first": first, "n": n})
            x["next"] = first + n
            try:
                self.state.write(version, x)
                break
            except Busy:
                continue
        else:
            raise Busy("the change log is in demand")
        self._settle(x)
        return first + n - 1

    def _settle(self, x: dict) -> None:
        """Moves named segments into the log; also those whose writer ended in between."""
        files = self.engine.store.files
        waiting = set(files.names(f"{self.root}/aside"))
        for g in x["segments"]:
            if f"seg={g['name']}" in waiting:
                files.make(f"{self.root}/log")
                files.rename(f"{self.root}/aside/seg={g['name']}", f"{self.root}/log/seg={g['name']}")

    def _placed(self, events: DataFrame, x: dict) -> DataFrame:
        """Stored events with their cursors; segments that the state does not name are left out."""
        first = [F.lit(v) for g in x["segments"] for v in (g["name"], g["first"])]
        if not first:
            return events.where(F.lit(False)).select(F.col("n").alias("cursor"), *EVENT_COLUMNS)
        at = F.create_map(*first)[F.col("seg")]
        return events.where(at.isNotNull()).select((at + F.col("n")).alias("cursor"), *EVENT_COLUMNS)

    def log(self) -> DataFrame:
        spark = self.engine.spark
        _, x = self._read()
        self._settle(x)
        if not x["segments"]:
            return spark.createDataFrame([], EVENT)
        paths = [f"{self.root}/log/seg={g['name']}" for g in x["segments"]]
        return self._placed(spark.read.schema(STORED).option("basePath", f"{self.root}/log").parquet(*paths), x)

    def read(self, after: int, limit: int = MAX_BATCH) -> DataFrame:
        """Events past a cursor, in order."""
        if not 1 <= limit <= MAX_BATCH:
            raise InvalidArgument(f"a batch has 1 to {MAX_BATCH} events")
        _, x = self._read()
        if after < x["pruned"]:
            raise FailedPrecondition("events past the cursor were pruned")
        return self.log().where(F.col("cursor") > after).orderBy("cursor").limit(limit)

    # -- freshness
    def behind(self) -> list[int]:
        """Shards whose applied cursor is not the newest, or all of them while paused or poisoned."""
        _, x = self._read()
        if x["paused"]:
            return list(range(self.engine.shards))
        late = [int(k) for k, high in x["high"].items() if x["applied"].get(k, 0) < high]
        return sorted({*late, *(int(k) for k in x["poison"])})

    def pause(self, paused: bool = True) -> None:
        version, x = self._read()
        self.state.write(version, x | {"paused": paused})

    def acquire(self, owner: str) -> int:
        """Takes the applier's lease; the fence of an earlier owner is no longer valid."""
        version, x = self._read()
        x["owner"], x["fence"] = owner, x["fence"] + 1
        self.state.write(version, x)
        return x["fence"]

    # -- the applier
    def process(self, owner: str = "applier", checkpoint: str | None = None) -> int:
        """Applies what the log has now, by an available-now stream; returns the events applied."""
        files = self.engine.store.files
        self._settle(self._read()[1])
        if not files.exists(f"{self.root}/log"):
            return 0
        fence, applied = self.acquire(owner), []
        stream = self.engine.spark.readStream.schema(STORED).option("maxFilesPerTrigger", 16).parquet(f"{self.root}/log")
        query = (
            stream.writeStream.foreachBatch(lambda batch, n: applied.append(self.apply(self._placed(batch, self._read()[1]), fence)))
            .option("checkpointLocation", checkpoint or f"{self.root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return sum(applied)

    def apply(self, batch: DataFrame, fence: int) -> int:
        """Merges one batch into the entries; events at or under a shard's cursor were applied before."""
        version, x = self._read()
        if x["fence"] != fence:
            raise FailedPrecondition("another applier holds the lease")
        if x["paused"]:
            return 0
        indexes = self.engine.indexes
        s = indexes.get(self.index)
        reach = {r["shard"]: (r["n"], r["high"]) for r in batch.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("cursor").alias("high")).collect()}
        shards = sorted(k for k, (_, high) in reach.items() if high > x["applied"].get(str(k), 0))
        bad = batch.where(F.col("locator").isNull() | F.col("kind").isin("insert", "update", "delete", "tombstone").eqNullSafe(False)).limit(1).count()
        if bad:
            for k in shards:
                x["poison"][str(k)] = reach[k][1]
            self.state.write(version, x)
            raise DataCorruption("the change log has a broken event")
        done = 0
        if shards:
            since = F.create_map(*[F.lit(v) for k in shards for v in (k, x["applied"].get(str(k), 0))])
            fresh = batch.where(F.col("shard").isin(shards) & (F.col("cursor") > since[F.col("shard")]))
            last = fresh.groupBy("shard", "locator").agg(F.max(F.struct("cursor", "new_key"))["new_key"].alias("new_key"), F.count(F.lit(1)).alias("n"))
            entries = indexes.entries(s, shards)
            kept = entries.join(last.select(F.col("shard").alias("_shard"), "locator"), ["_shard", "locator"], "left_anti").select("key", "locator", "_shard")
            added = last.where(F.col("new_key").isNotNull()).select(F.col("new_key").alias("key"), "locator", F.col("shard").alias("_shard"))
            done = fresh.count()
            self._write(s, kept.unionByName(added), shards, x)
        for k in shards:
            x["applied"][str(k)] = reach[k][1]
        self.state.write(version, x)
        return done

    def _write(self, s, entries: DataFrame, shards: list[int], x: dict) -> None:
        indexes = self.engine.indexes
        indexes.write(s, entries, shards)
        for k in shards:
            s.applied[k] = x["base"].get(str(k), [])
        indexes.summarise(s, shards)
        indexes._put(s)

    def prune(self) -> int:
        """Deletes the segments that every shard has applied; returns the new lowest cursor."""
        version, x = self._read()
        reached = [x["applied"].get(k, 0) for k in x["high"] if x["applied"].get(k, 0) < x["high"][k]]
        x["pruned"] = max(x["pruned"], min(reached, default=x["next"] - 1))
        gone = [g for g in x["segments"] if g["first"] + g["n"] - 1 <= x["pruned"]]
        x["segments"] = [g for g in x["segments"] if g not in gone]
        self.state.write(version, x)
        for g in gone:
            self.engine.store.files.delete(f"{self.root}/log/seg={g['name']}")
        return x["pruned"]

    def status(self) -> DataFrame:
        _, x = self._read()
        rows = [(k, x["high"].get(str(k), 0), x["applied"].get(str(k), 0), str(k) in x["poison"], x["paused"]) for k in range(self.engine.shards)]
        return self.engine.spark.createDataFrame(rows, "shard int, high long, applied long, poisoned boolean, paused boolean")
