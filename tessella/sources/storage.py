"""Tables as versioned Parquet: a manifest names each shard's folders.

Data lies under ``data/_load=<id>/_shard=<k>/``. A reader takes one manifest
version, so it sees one committed state of all shards; a writer adds folders
and publishes the next version. Shards that a plan excludes are not even listed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import StorageUnavailable
from tessella.functions.routing import shard_column
from tessella.sources.catalog import Table
from tessella.sources.files import Files, State

ROW_ID = "_rid"


@dataclass
class Snapshot:
    """One version: folders, or single files, of each shard, relative to the table's folder."""

    version: int
    folders: dict[int, list[str]]

    def as_json(self) -> dict:
        return {"folders": {str(k): v for k, v in self.folders.items()}}


class Store:
    def __init__(self, spark: SparkSession, root: str, shards: int) -> None:
        self.spark, self.root, self.shards, self.files = spark, root.rstrip("/"), shards, Files(spark)

    def folder(self, table: Table) -> str:
        return f"{self.root}/tables/{table.name}"

    def state(self, table: Table) -> State:
        return State(self.files, f"{self.folder(table)}/versions")

    def snapshot(self, table: Table) -> Snapshot:
        version, x = self.state(table).read({"folders": {}})
        return Snapshot(version, {int(k): v for k, v in x["folders"].items()})

    def publish(self, table: Table, before: Snapshot, folders: dict[int, list[str]]) -> Snapshot:
        new = Snapshot(before.version + 1, folders)
        self.state(table).write(before.version, new.as_json())
        return new

    def keyless(self, table: Table) -> bool:
        return not table.primary

    def schema(self, table: Table) -> T.StructType:
        shape = T.StructType([T.StructField(c.name, T._parse_datatype_string(c.type)) for c in table.columns])
        if self.keyless(table):
            shape = shape.add(ROW_ID, T.StringType())
        return shape

    def read(self, table: Table, shards: list[int] | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """Rows of the shards (all by default), with ``_shard`` and, for tables without a key, ``_rid``."""
        if table.attached:
            return self.spark.read.parquet(table.attached)
        snapshot = snapshot or self.snapshot(table)
        base = self.folder(table)
        paths = [f"{base}/{f}" for k, fs in sorted(snapshot.folders.items()) if shards is None or k in shards for f in fs]
        shape = self.schema(table)
        if not paths:
            return self.spark.createDataFrame([], shape.add("_shard", T.IntegerType()))
        whole = T.StructType([*shape.fields, T.StructField("_load", T.StringType()), T.StructField("_shard", T.IntegerType())])
        return self.spark.read.schema(whole).option("basePath", f"{base}/data").parquet(*paths).drop("_load")

    def placed(self, table: Table, rows: DataFrame) -> DataFrame:
        """rows with their shard; a key that is not known to one shard is hashed, each distinct one once a batch."""
        if table.placement == "global":
            return rows.withColumn("_shard", F.lit(0))
        return rows.withColumn("_shard", shard_column(F.col(table.shard_key), table.key_type, self.shards))

    def write(self, table: Table, placed: DataFrame, spread: bool = False) -> dict[int, list[str]]:
        """Writes rows that have ``_shard``; returns the new folders by shard.

        spread: a bulk load; the rows are dealt by shard in pieces that adaptive
        execution splits, so a shard gets as many files as its size needs. Files
        are sorted by key, which lets a point read skip most row groups.
        """
        load = uuid.uuid4().hex
        if self.keyless(table) and ROW_ID not in placed.columns:
            placed = placed.withColumn(ROW_ID, F.concat(F.lit(f"{load[:12]}:"), F.monotonically_increasing_id().cast("string")))
        if spread:
            order = [table.shard_key] if table.shard_key else list(table.primary)
            placed = placed.hint("rebalance", F.col("_shard")).sortWithinPartitions("_shard", *order)
        base = f"{self.folder(table)}/data/_load={load}"
        placed.select(*[f.name for f in self.schema(table).fields], "_shard").write.partitionBy("_shard").parquet(base)
        out: dict[int, list[str]] = {}
        for name in self.files.names(base):
            if name.startswith("_shard="):
                out.setdefault(int(name[7:]), []).append(f"data/_load={load}/{name}")
            elif name not in ("_SUCCESS",) and not name.startswith("."):
                raise StorageUnavailable("a write left files outside its shards")
        return out

    def files_of(self, rows: DataFrame) -> dict[str, int]:
        """Rows by the file that holds them, relative to the table's folder."""
        found = rows.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a file of a shard
        return {"data/" + r["f"].rsplit("/data/", 1)[1]: r["n"] for r in found}

    def without(self, table: Table, folders: list[str], files: list[str]) -> list[str]:
        """A shard's folders less some files; a folder that holds one of them is named by its other files."""
        gone, out = set(files), []
        for f in folders:
            if f in gone:
                continue
            if any(g.startswith(f + "/") for g in gone):
                out += [x for n in self.files.names(f"{self.folder(table)}/{f}") if n.endswith(".parquet") and (x := f"{f}/{n}") not in gone]
            else:
                out.append(f)
        return out

    def load(self, table: Table, rows: DataFrame, checked: Callable[[DataFrame, Snapshot], None] | None = None) -> tuple[Snapshot, int]:
        """Appends rows of any shards, as one version; also tells how many, from the footers of the new files.

        checked: is asked, with the new rows as written, before they are published.
        """
        before = self.snapshot(table)
        new = self.write(table, self.placed(table, rows), spread=True)
        if checked and new:
            checked(self.read(table, snapshot=Snapshot(0, new)), before)
        after = self.publish(table, before, {k: before.folders.get(k, []) + new.get(k, []) for k in {*before.folders, *new}})
        return after, self.read(table, snapshot=Snapshot(0, new)).count() if new else 0

    def compact(self, table: Table) -> dict:
        """Rewrites every shard that has several folders into one; reports what was done."""
        before = self.snapshot(table)
        many = sorted(k for k, fs in before.folders.items() if len(fs) > 1)
        report = {"shards": sorted(before.folders), "compacted": many, "folders_before": sum(map(len, before.folders.values())), "complete": True}
        if many:
            new = self.write(table, self.read(table, many, before), spread=True)
            self.publish(table, before, {**{k: fs for k, fs in before.folders.items() if k not in many}, **new})
            report["folders_after"] = sum(len(fs) for k, fs in before.folders.items() if k not in many) + sum(map(len, new.values()))
        else:
            report["folders_after"] = report["folders_before"]
        return report

    def vacuum(self, table: Table, older_than: float = 86_400.0) -> int:
        """Deletes the loads that no retained version names and that were written so many seconds ago; returns their number.

        A writer that takes longer to publish, or a reader that keeps a version for longer than the versions are retained,
        needs a greater age.
        """
        named = {f.split("/")[1] for x in self.state(table).retained() for fs in x["folders"].values() for f in fs}
        gone = [n for n, age in self.files.ages(f"{self.folder(table)}/data").items() if n.startswith("_load=") and n not in named and age >= older_than]
        for n in gone:
            self.files.delete(f"{self.folder(table)}/data/{n}")
        return len(gone)
