"""What the corpus operators share: word rules, folds, shared tables.

Word rules are stated on UTF-8 bytes, because every separator they name is
ASCII and every byte of a longer code point is 0x80 or above.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark regular expression of a plain word; the same pattern serves DuckDB.
PLAIN_WORD = r"[^\x20\x09-\x0D]+"

#: Bytes that belong to a letter-or-digit word, lower-cased; all others become a blank.
FOLDED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: bytes) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+``; ``bytes.split`` cuts at exactly those bytes."""
    return text.split()


def folded_words(text: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters after lower-casing A-Z."""
    return text.translate(FOLDED).split()


def utf8(column: pa.Array, step: int = 500) -> Iterator[bytes | None]:
    """The column's texts as UTF-8 bytes, None where null; few are copied out of the batch at a time."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for at in range(0, len(column), step):
        yield from column.slice(at, step).cast(kind).to_pylist()


def strings(column: pa.Array, step: int = 500) -> Iterator[str | None]:
    """The column's texts as str, likewise; bytes that are not UTF-8 become replacement characters."""
    for text in utf8(column, step):
        yield text if text is None else text.decode("utf-8", "replace")


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it; only where that is unset and driver and
    executors are one process, as in tests, a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return root or "file://" + os.path.join(tempfile.gettempdir(), "tessella-shared")


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    It cuts the lineage, and what is written once is neither computed again for
    a second reader nor lost with an executor. What a result still reads is
    deleted when the application ends; all else by ``dropped``. codec: Parquet's
    compression, where it is not the session's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path, compression=codec)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files of written tables that nobody reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for frame in frames:
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished frames that nobody holds any more.

    Its cleaner learns of them when the driver's garbage is collected; a driver that has memory to spare may not do so
    the application ends, and all of its shuffles stay on disk at once. Those of the last job may stay until the next call.
    """
    gc.collect()  # frames in Python hold theirs in the JVM
    spark.sparkContext._jvm.System.gc()


#: Bits of a sieve, at most: 8 MB travel to the tasks.
SIEVE_BITS = 1 << 26


def sieve(ids: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that all values of the column pass, and few others: a set of hashed bits of bounded size.

    It saves an exact join most of the rows that have no partner. The more values there are beyond SIEVE_BITS, the
    fewer it saves; it never refuses a value of the column.
    """
    spark = ids.sparkSession
    bits = 1 << min(SIEVE_BITS.bit_length() - 1, max(10, (16 * ids.count()).bit_length()))
    at = ids.select(F.pmod(F.xxhash64(column), F.lit(bits)).alias("at"))
    words = at.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits")).toArrow()  # at most SIEVE_BITS / 64 rows
    own = np.zeros(bits // 64, np.int64)
    own[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    held = spark.sparkContext.broadcast(own.view(np.uint64))

    @F.arrow_udf("boolean")
    def passes(hashed: pa.Array) -> pa.Array:
        at = hashed.to_numpy(zero_copy_only=False)
        return pa.array((held.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return lambda value: passes(F.pmod(F.xxhash64(value), F.lit(bits)))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x
