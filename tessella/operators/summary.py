"""Shard summaries of an index: Bloom filter, least and greatest key.

A summary can only exclude. One that is missing, stale or unreadable excludes
nothing, a saturated filter answers no equality, and shards that hold a
verified candidate are never asked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import bloom
from tessella.functions.index_key import Part, encode
from tessella.plans.domains import NOTHING, Range


@dataclass
class Summary:
    shard: int
    keys: int
    words: np.ndarray
    least: bytes | None
    greatest: bytes | None

    def merged(self, other: Summary) -> Summary:
        """What holds for the keys of both; additions by different writers meet this way."""
        some = lambda f, a, b: b if a is None else a if b is None else f(a, b)
        return Summary(self.shard, self.keys + other.keys, self.words | other.words, some(min, self.least, other.least), some(max, self.greatest, other.greatest))


SHAPE = "shard int, keys long, words array<long>, least binary, greatest binary"


def summarised(entries: DataFrame) -> DataFrame:
    """A summary row for each shard of (_shard, key) rows.

    Each task folds its keys into words of the filter; words meet by bit_or, so
    what is shuffled is at most WORDS rows a shard and task, not the keys.
    """

    def fold(batches):
        words: dict[int, np.ndarray] = {}
        for batch in batches:
            shards, keys = batch.column("_shard").to_numpy(), batch.column("key").to_pylist()
            for s in np.unique(shards):
                own = bloom.bitmap([keys[i] for i in np.flatnonzero(shards == s)])
                words[int(s)] = words[int(s)] | own if int(s) in words else own
        for s, w in words.items():
            some = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s, np.int32)), pa.array(some.astype(np.int32)), pa.array(w[some].view(np.int64))], ["shard", "at", "word"])

    bits = entries.select("_shard", "key").mapInArrow(fold, "shard int, at int, word long").groupBy("shard", "at").agg(F.bit_or("word").alias("word"))
    filters = bits.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("m"))
    words = F.transform(F.sequence(F.lit(0), F.lit(bloom.WORDS - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)))
    bounds = entries.groupBy(F.col("_shard").alias("shard")).agg(F.count(F.lit(1)).alias("keys"), F.min("key").alias("least"), F.max("key").alias("greatest"))
    return bounds.join(filters, "shard").select("shard", "keys", words.alias("words"), "least", "greatest")


def numbered(rows: DataFrame, *order: str, path: str, first: int = 0) -> DataFrame:
    """rows with ``n``, their ordinal in the order, from first.

    A range partitioning and a count for each partition give it; no task sees
    more than its partition, and the driver holds one number for each. The dealt
    rows are written at path, as a second sampling of the ranges could deal them otherwise.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    start, at = [], first
    for r in sorted(dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("least")).collect(), key=lambda r: r["_p"]):
        start += [F.lit(r["_p"]), F.lit(at - r["least"])]
        at += r["n"]
    offsets = F.create_map(*start) if start else F.create_map(F.lit(0), F.lit(0))
    return dealt.withColumn("n", F.col("_i") + offsets[F.col("_p")]).drop("_p", "_i")


def collected(rows: DataFrame) -> dict[int, Summary]:
    """At most one small row a shard."""
    return {
        r["shard"]: Summary(r["shard"], r["keys"], np.array(r["words"], np.int64).view(np.uint64), bytes(r["least"]) if r["least"] is not None else None, bytes(r["greatest"]) if r["greatest"] is not None else None)
        for r in rows.collect()
    }


def exclusion(s: Summary, keys: list[bytes] | None, part: Part, bounds: Range | None) -> str | None:
    """Why the shard holds no matching row; None where it may. keys: all encoded keys an equality allows."""
    if s.keys == 0 or s.least is None:
        return "empty_summary"
    if keys is not None and not bloom.saturated(s.words) and not bloom.holds(s.words, keys).any():
        return "bloom_miss"
    if bounds is not None and bounds != NOTHING and part.kind != "float64":
        low, low_strict, high, high_strict = bounds.low, bounds.low_strict, bounds.high, bounds.high_strict
        if part.descending:
            low, low_strict, high, high_strict = high, high_strict, low, low_strict
        if low is not None:
            edge = encode([part], [low])
            greatest = s.greatest[: len(edge)]
            if greatest < edge or low_strict and greatest == edge:
                return "maximum_below_lower_bound"
        if high is not None:
            edge = encode([part], [high])
            least = s.least[: len(edge)]
            if least > edge or high_strict and least == edge:
                return "minimum_above_upper_bound"
    return None
