"""Keys to virtual buckets to shards.

A key's canonical bytes are hashed; the first eight digest bytes, little-endian,
give the hash. 4,096 virtual buckets spread evenly over the shards, and a
bucket's shard is fixed, so a key's shard equals hash modulo shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.errors import InvalidArgument, TypeMismatch
from tessella.functions.blake3 import digests

BUCKETS = 4096
MIN_SHARDS, MAX_SHARDS = 2, 64
KEY_TYPES = ("int64", "text", "binary")


def checked_shards(n: int) -> int:
    if not isinstance(n, int) or not MIN_SHARDS <= n <= MAX_SHARDS:
        raise InvalidArgument(f"the number of shards must lie between {MIN_SHARDS} and {MAX_SHARDS}")
    return n


def canonical(value: int | str | bytes) -> bytes:
    """A key's bytes: shortest decimal, UTF-8 or the bytes themselves."""
    if isinstance(value, bool):
        raise TypeMismatch("a shard key cannot be boolean")
    if isinstance(value, int):
        return str(value).encode()
    if isinstance(value, str):
        return value.encode()
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value)
    raise TypeMismatch("a shard key must be an integer, a text or a byte string")


def hashes(keys: list[bytes]) -> np.ndarray:
    words = digests(keys)[:, :2].astype(np.uint64)
    return words[:, 0] | (words[:, 1] << np.uint64(32))


def buckets(hashed: np.ndarray, shards: int) -> np.ndarray:
    """The virtual bucket of each hash."""
    n = np.uint64(shards)
    narrow, wide = np.uint64(BUCKETS // shards), np.uint64(BUCKETS % shards)
    shard = hashed % n
    width = narrow + (shard < wide)
    first = shard * narrow + np.minimum(shard, wide)
    return (first + (hashed // n) % width).astype(np.int64)


def shard_of_bucket(bucket, shards: int):
    """The shard that owns a bucket: the first ``4096 % shards`` shards own one bucket more."""
    narrow, wide = divmod(BUCKETS, shards)
    edge = wide * (narrow + 1)
    bucket = np.asarray(bucket)
    return np.where(bucket < edge, bucket // (narrow + 1), wide + (bucket - edge) // narrow)


def shard_of(value: int | str | bytes, shards: int) -> int:
    return int(shard_of_bucket(buckets(hashes([canonical(value)]), shards)[0], shards))


def shard_column(key: Column, kind: str, shards: int) -> Column:
    """The shard of each row's key, as an int column; null for a null key.

    A batch hashes each distinct key once.
    """
    checked_shards(shards)
    if kind not in KEY_TYPES:
        raise InvalidArgument("a shard key's type must be int64, text or binary")

    @F.arrow_udf("int")
    def run(keys: pa.Array) -> pa.Array:
        distinct = keys.dictionary_encode()
        raw = [b"" if k is None else bytes(k) for k in distinct.dictionary.to_pylist()]
        owner = shard_of_bucket(buckets(hashes(raw), shards), shards) if raw else np.empty(0, np.int64)
        return pa.array(owner, pa.int32()).take(distinct.indices)

    return run((key.cast("long").cast("string") if kind == "int64" else key).cast("binary"))
