import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella import errors
from tessella.functions import blake3, bloom, generated_id, index_key, routing
from tessella.functions.index_key import Part


@pytest.mark.parametrize(
    "key, shards, hashed, bucket, shard",
    [
        (b"", 3, "a6a1f9f5b94913af", 1730, 1), (bytes([0, 1, 2]), 6, "0a56b58a7a4dbee1", 2460, 3), (bytes([0, 1, 2]), 10, "0a56b58a7a4dbee1", 3754, 9), (b"abc", 4, "33514638acb33764", 473, 0),
        (b"customer-42", 6, "d23621a7fc619d57", 768, 1), (b"tenant/alpha", 10, "6e1e114884b71a21", 1283, 3), (bytes([0, 1, 2, 255]), 63, "65f5b46e9347f810", 1546, 23),
        ("snowman-☃".encode(), 64, "f3613ce900a23681", 90, 1), (b"a\0b", 6, "4622f0c6a488ebfd", 1310, 1),
    ],
)
def test_routing_vectors(key, shards, hashed, bucket, shard):
    h = routing.hashes([key])
    assert f"{int(h[0]):016x}" == hashed
    assert routing.buckets(h, shards)[0] == bucket
    assert routing.shard_of_bucket(bucket, shards) == shard


@pytest.mark.parametrize("shards, hashed, bucket, shard", [(6, 0, 0, 0), (6, 3, 2049, 3), (6, 4, 2732, 4), (6, 5, 3414, 5), (6, 6, 1, 0), (6, 2**64 - 1, 2646, 3), (64, 63, 4032, 63), (64, 64, 1, 0), (64, 2**64 - 1, 4095, 63)])
def test_bucket_arithmetic(shards, hashed, bucket, shard):
    assert routing.buckets(np.array([hashed], np.uint64), shards)[0] == bucket
    assert routing.shard_of_bucket(bucket, shards) == shard


def test_blake3_of_several_chunks_and_lanes():
    # the digest of no bytes, from the specification's test vectors
    assert blake3.digest(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3.digest(bytes(i % 251 for i in range(1025))).hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    data = [bytes(i % 251 for i in range(n)) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 5000)]
    assert [d.tobytes() for d in blake3.digests(data).astype("<u4")] == [blake3.digest(x) for x in data]


def test_shard_column_equals_the_scalar(spark):
    df = spark.createDataFrame([(k,) for k in [1, -5, 2**62, 0, None, 1]], "k long")
    got = df.withColumn("s", routing.shard_column(F.col("k"), "int64", 6)).collect()
    assert all((r.s is None) if r.k is None else r.s == routing.shard_of(r.k, 6) for r in got)


@pytest.mark.parametrize(
    "part, value, payload",
    [
        (Part("int64"), None, "100100"), (Part("bool"), True, "1001011001"), (Part("int64"), -1, "100101207fffffffffffffff"), (Part("uint64"), 1, "100101210000000000000001"),
        (Part("float64"), 0.0, "100101308000000000000000"), (Part("date"), 0, "1001014080000000"), (Part("timestamp"), 0, "100101418000000000000000"), (Part("text"), "A\0", "100101504100ff0000"),
        (Part("binary"), b"\0\xff", "1001015100ffff0000"), (Part("text", True), "a", "130100af9effff"),
    ],
)
def test_index_key_vectors(part, value, payload):
    key = index_key.encode([part], [value])
    assert key.hex() == "4249445800000001" + payload
    assert [v for _, v in index_key.decode(key)] == [value]


VALUES = {"int64": st.integers(-(2**63), 2**63 - 1), "float64": st.floats(allow_nan=False), "text": st.text(max_size=6).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s)), "binary": st.binary(max_size=6), "bool": st.booleans()}


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_index_key_order_is_the_values_order(data):
    kinds = data.draw(st.lists(st.sampled_from(sorted(VALUES)), min_size=1, max_size=3))
    parts = [Part(k, data.draw(st.booleans()), data.draw(st.booleans())) for k in kinds]
    rows = [[data.draw(st.none() | VALUES[k]) for k in kinds] for _ in range(2)]

    def rank(row):
        out = []
        for p, v in zip(parts, row):
            v = v.encode() if isinstance(v, str) else v
            out.append((int((v is None) == p.last), p, v))
        return out

    def less(a, b):
        for (ra, p, x), (rb, _, y) in zip(rank(a), rank(b)):
            if ra != rb:
                return ra < rb
            if x is not None and x != y:
                return (x > y) if p.descending else (x < y)
        return None

    a, b = (index_key.encode(parts, r) for r in rows)
    want = less(*rows)
    assert (a == b) if want is None else (a < b) == want
    assert [v for _, v in index_key.decode(a)] == [0.0 if v == 0 and p.kind == "float64" else v for p, v in zip(parts, rows[0])]


def test_key_columns_equal_the_codec(spark):
    import datetime as dt

    rows = [(i, t, b, f, d, o, s) for i, t, b, f, d, o, s in [
        (0, "", b"", 0.0, dt.date(1970, 1, 1), True, dt.datetime(1970, 1, 1)), (-1, "a\0b", b"\0\0\xff", -0.0, dt.date(1900, 2, 3), False, dt.datetime(1950, 5, 6, 7, 8, 9, 10)),
        (2**63 - 1, "é☃", b"\x10\x00\x01", float("nan"), dt.date(2100, 1, 1), None, None), (-(2**63), None, None, None, None, True, dt.datetime(2030, 1, 1)), (None, "x" * 100, bytes(range(256)), 1.5, dt.date(1969, 12, 31), False, None)]]
    df = spark.createDataFrame(rows, "i long, t string, b binary, f double, d date, o boolean, s timestamp")
    kinds = {"i": "int64", "t": "text", "b": "binary", "f": "float64", "d": "date", "o": "bool", "s": "timestamp"}
    day, second = dt.date(1970, 1, 1), dt.datetime(1970, 1, 1)
    plain = lambda v: (v - second) // dt.timedelta(microseconds=1) if isinstance(v, dt.datetime) else (v - day).days if isinstance(v, dt.date) else bytes(v) if isinstance(v, bytearray) else v
    for names in (["i"], ["t"], ["b"], ["f"], ["d"], ["o"], ["s"], ["t", "i"], ["d", "o", "s", "b"], ["f", "i"]):
        for down in (False, True):
            for last in (None, False, True):
                parts = [Part(kinds[n], down, last) for n in names]
                pairs = [(F.col(n), p) for n, p in zip(names, parts)]
                got = df.select(index_key.key_column(pairs).alias("k"), index_key.key_column(pairs, unique=True).alias("u"), *names).collect()
                for r in got:
                    values = [plain(r[n]) for n in names]
                    assert bytes(r.k) == index_key.encode(parts, values), (names, values)
                    assert (None if r.u is None else bytes(r.u)) == index_key.encode_unique(parts, values)


def test_index_key_nan_nulls_and_corruption():
    nan = index_key.encode([Part("float64")], [float("nan")])
    assert nan > index_key.encode([Part("float64")], [float("inf")])
    assert index_key.encode_unique([Part("text")], [None]) is None
    assert index_key.encode_unique([Part("text")], [None], nulls_distinct=False) is not None
    for bad in (b"", b"BIDX", nan[:-1], nan[:-8] + b"\x99", index_key.encode([Part("text")], ["abc"])[:-2]):
        with pytest.raises(errors.DataCorruption):
            index_key.decode(bad)
    with pytest.raises(errors.TypeMismatch):
        index_key.encode([Part("text")], [1])
    with pytest.raises(errors.NumericOutOfRange):
        index_key.encode([Part("int64")], [2**63])


def test_generated_ids():
    v = generated_id.encode_range(3, 9)
    assert v == 1 << 62 | 3 << 52 | 9 and generated_id.decode_range(v) == generated_id.RangeId(3, 9)
    assert generated_id.decode_range(-1) is None and generated_id.decode_range(5) is None
    with pytest.raises(errors.InvalidArgument):
        generated_id.decode_range(1 << 62)
    with pytest.raises(errors.DataCorruption):
        generated_id.decode_range(1 << 62, stored=True)
    assert generated_id.decode_block(generated_id.encode_block(7)) == generated_id.BlockId(7)
    assert generated_id.decode_block(7) is None
    with pytest.raises(errors.InvalidArgument):
        generated_id.decode_block(1 << 62)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=8), max_size=30), st.lists(st.binary(max_size=8), max_size=10))
def test_bloom_has_no_false_negatives(keys, others):
    words = bloom.bitmap(keys)
    assert bloom.holds(words, keys).all()
    assert not bloom.saturated(words) and bloom.false_positive_ppm(words) == 0
    assert bloom.saturated(np.full(bloom.WORDS, 2**64 - 1, np.uint64))
