"""The order-preserving index-key codec.

Encoded keys compare as unsigned bytes in the order of their values, part by
part, with each part's direction and place of nulls. A key is the header,
then for each part: options, collation, null rank and,
unless null, tag and payload. A descending part has tag and payload complemented.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.errors import DataCorruption, InvalidArgument, NumericOutOfRange, TypeMismatch, Unsupported

HEADER = b"BIDX" + struct.pack(">I", 1)
OPTIONS, DESCENDING, NULLS_LAST = 0x10, 1, 2
BINARY_COLLATION = 1
MAX_PARTS = 16
# fixed values of the format
TAGS = {"bool": 0x10, "int64": 0x20, "uint64": 0x21, "float64": 0x30, "date": 0x40, "timestamp": 0x41, "text": 0x50, "binary": 0x51}
KINDS = {tag: kind for kind, tag in TAGS.items()}
SIGN, NAN = 1 << 63, 0x7FF8000000000000
_FLIP = bytes(255 - b for b in range(256))


@dataclass(frozen=True)
class Part:
    """A key part: its kind, direction and place of nulls (by default nulls come first ascending, last descending)."""

    kind: str
    descending: bool = False
    nulls_last: bool | None = None

    @property
    def last(self) -> bool:
        return self.descending if self.nulls_last is None else self.nulls_last

    @property
    def options(self) -> int:
        return OPTIONS | DESCENDING * self.descending | NULLS_LAST * self.last


def _payload(kind: str, value) -> bytes:
    try:
        if kind == "bool":
            return bytes([1 if value else 0])
        if kind == "int64":
            return struct.pack(">Q", (int(value) + SIGN) & (2 * SIGN - 1)) if -SIGN <= value < SIGN else struct.pack(">q", value)
        if kind == "uint64":
            return struct.pack(">Q", value)
        if kind == "float64":
            raw = NAN if math.isnan(value) else 0 if value == 0 else struct.unpack(">Q", struct.pack(">d", value))[0]
            return struct.pack(">Q", raw ^ SIGN if raw < SIGN else raw ^ (2 * SIGN - 1))
        if kind == "date":
            return struct.pack(">I", value + (1 << 31))
        if kind == "timestamp":
            return struct.pack(">Q", value + SIGN)
        raw = value.encode() if kind == "text" else bytes(value)
        return raw.replace(b"\0", b"\0\xff") + b"\0\0"
    except struct.error:
        raise NumericOutOfRange(f"a value is out of the range of {kind}") from None
    except (TypeError, AttributeError, ValueError):
        raise TypeMismatch(f"a value is not of kind {kind}") from None


def encode(parts: list[Part], values: list) -> bytes:
    if not 1 <= len(parts) <= MAX_PARTS or len(parts) != len(values):
        raise InvalidArgument(f"an index key has 1 to {MAX_PARTS} parts and a value for each")
    out = [HEADER]
    for part, value in zip(parts, values):
        if part.kind not in TAGS:
            raise InvalidArgument("an index-key part is of an unknown kind")
        null = value is None
        out.append(bytes([part.options, BINARY_COLLATION, int(null == part.last)]))
        if not null:
            body = bytes([TAGS[part.kind]]) + _payload(part.kind, value)
            out.append(body.translate(_FLIP) if part.descending else body)
    return b"".join(out)


def encode_unique(parts: list[Part], values: list, nulls_distinct: bool = True) -> bytes | None:
    """None where a null keeps the row out of a unique index whose nulls are distinct."""
    return None if nulls_distinct and any(v is None for v in values) else encode(parts, values)


_FIXED = {"bool": 1, "int64": 8, "uint64": 8, "float64": 8, "date": 4, "timestamp": 8}


def _value(kind: str, raw: bytes):
    if kind == "bool":
        return raw == b"\1"
    n = int.from_bytes(raw, "big")
    if kind in ("int64", "timestamp"):
        return n - SIGN
    if kind == "uint64":
        return n
    if kind == "date":
        return n - (1 << 31)
    return struct.unpack(">d", struct.pack(">Q", n ^ SIGN if n & SIGN else n ^ (2 * SIGN - 1)))[0]


def decode(key: bytes) -> list[tuple[Part, object]]:
    """Parts and values of a key; DataCorruption where the bytes are not one."""
    if not key.startswith(HEADER):
        raise DataCorruption("an index key has a foreign header")
    at, out = len(HEADER), []
    try:
        while at < len(key):
            options, collation, rank = key[at : at + 3]
            if options & ~(OPTIONS | DESCENDING | NULLS_LAST) or not options & OPTIONS or collation != BINARY_COLLATION or rank > 1:
                raise DataCorruption("an index-key part has unknown options")
            down, last = bool(options & DESCENDING), bool(options & NULLS_LAST)
            at += 3
            if bool(rank) == last:
                out.append((Part("null", down, last), None))
                continue
            turn = (lambda b: b.translate(_FLIP)) if down else bytes
            kind = KINDS[turn(key[at : at + 1])[0]]
            at += 1
            if kind in _FIXED:
                raw = turn(key[at : at + _FIXED[kind]])
                if len(raw) < _FIXED[kind]:
                    raise DataCorruption("an index key ends inside a part")
                value, at = _value(kind, raw), at + _FIXED[kind]
            else:
                body, raw = turn(key[at:]), bytearray()
                k = 0
                while True:
                    if body[k] or body[k + 1] == 0xFF:
                        raw.append(body[k])
                        k += 1 if body[k] else 2
                    elif body[k + 1] == 0:
                        break
                    else:
                        raise DataCorruption("an index key has a broken escape")
                value, at = (raw.decode() if kind == "text" else bytes(raw)), at + k + 2
            out.append((Part(kind, down, last), value))
    except (IndexError, KeyError, ValueError):
        raise DataCorruption("an index key is broken") from None
    if not out:
        raise DataCorruption("an index key has no part")
    return out


def part_for(spark_type: str, descending: bool = False, nulls_last: bool | None = None) -> Part:
    """The part of a column of this Spark type."""
    kinds = {
        "boolean": "bool", "tinyint": "int64", "smallint": "int64", "int": "int64", "bigint": "int64", "float": "float64", "double": "float64",
        "string": "text", "binary": "binary", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp",
    }
    if spark_type not in kinds:
        raise Unsupported(f"a column of type {spark_type} cannot be part of an index")
    return Part(kinds[spark_type], descending, nulls_last)


HEX, COMPLEMENT = "0123456789ABCDEF", "FEDCBA9876543210"


def _hex_payload(c: Column, kind: str) -> Column:
    """A payload as hexadecimal text; zero bytes of texts are escaped pair by pair."""
    if kind in ("int64", "timestamp"):
        return F.lpad(F.hex(c.bitwiseXOR(F.lit(-SIGN))), 16, "0")
    if kind == "date":
        return F.lpad(F.hex(c + F.lit(1 << 31)), 8, "0")
    if kind == "bool":
        return F.when(c, "01").otherwise("00")
    raw = F.hex(c)
    pairs = F.replace(F.regexp_replace(raw, "(..)", "$1,"), F.lit("00,"), F.lit("00FF,"))
    return F.concat(F.when(raw.contains("00"), F.replace(pairs, F.lit(","), F.lit(""))).otherwise(raw), F.lit("0000"))


def _hex_part(c: Column, part: Part) -> Column:
    head, value_rank = f"{part.options:02X}{BINARY_COLLATION:02X}", f"{int(not part.last):02X}"
    body = F.concat(F.lit(f"{TAGS[part.kind]:02X}"), _hex_payload(c, part.kind))
    if part.descending:
        body = F.translate(body, HEX, COMPLEMENT)
    return F.when(c.isNull(), f"{head}{int(part.last):02X}").otherwise(F.concat(F.lit(head + value_rank), body))


def key_column(columns: list[tuple[Column, Part]], unique: bool = False, nulls_distinct: bool = True) -> Column:
    """The encoded key of each row; null where ``encode_unique`` gives none.

    Built-in functions make it, but for floats, whose bits no built-in function tells: then a batch encodes each distinct key once.
    """
    parts = [p for _, p in columns]
    plain = {"bool": "boolean", "int64": "bigint", "float64": "double", "text": "string", "binary": "binary"}

    def plain_value(c: Column, p: Part) -> Column:
        if p.kind == "date":
            return F.unix_date(c).cast("bigint")
        if p.kind == "timestamp":
            return F.unix_micros(c.cast("timestamp"))
        return c.cast(plain.get(p.kind, "bigint"))

    values = [plain_value(c, p) for c, p in columns]
    if all(p.kind not in ("float64", "uint64") for p in parts):
        key = F.unhex(F.concat(F.lit(HEADER.hex().upper()), *(_hex_part(c, p) for c, p in zip(values, parts))))
        if unique and nulls_distinct:
            whole = F.lit(True)
            for c in values:
                whole = whole & c.isNotNull()
            key = F.when(whole, key)
        return key

    @F.arrow_udf("binary")
    def run(*arrays: pa.Array) -> pa.Array:
        known: dict[tuple, bytes | None] = {}
        out = []
        for row in zip(*(a.to_pylist() for a in arrays)):
            # -0.0 and 0.0 are equal keys and encode alike; NaN never equals itself and is encoded each time
            if row not in known:
                if len(known) > 100_000:
                    known.clear()
                known[row] = encode_unique(parts, list(row), nulls_distinct) if unique else encode(parts, list(row))
            out.append(known[row])
        return pa.array(out, pa.binary())

    return run(*values)


ARROW = {"bool": ("boolean", pa.bool_()), "int64": ("bigint", pa.int64()), "float64": ("double", pa.float64()), "date": ("bigint", pa.int64()), "timestamp": ("bigint", pa.int64()), "text": ("string", pa.string()), "binary": ("binary", pa.binary())}


def value_column(key: Column, ordinal: int, kind: str) -> Column:
    """The value of one part of encoded keys, a batch at a time; dates are days and timestamps microseconds."""
    spark_type, arrow_type = ARROW[kind]

    @F.arrow_udf(spark_type)
    def run(keys: pa.Array) -> pa.Array:
        return pa.array([None if k is None else decode(k)[ordinal][1] for k in keys.to_pylist()], arrow_type)

    return run(key)
