"""Generated identifiers: owner-range ids and block-sequence ids.

An owner-range id has bit 62 set, ten bits of owner and 52 bits of sequence; a
block-sequence id has bit 61 set and 61 bits of sequence. Which of the two a
column holds is the table's policy; bits alone never decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.errors import DataCorruption, InvalidArgument, NumericOutOfRange

RANGE_MARK, RANGE_OWNER_BITS, RANGE_SEQUENCE_BITS = 1 << 62, 10, 52
BLOCK_MARK, BLOCK_SEQUENCE_BITS = 1 << 61, 61
BLOCK = 4096
MAX_OWNER, MAX_RANGE_SEQUENCE = (1 << RANGE_OWNER_BITS) - 1, (1 << RANGE_SEQUENCE_BITS) - 1
MAX_BLOCK_SEQUENCE = (1 << BLOCK_SEQUENCE_BITS) - 1


@dataclass(frozen=True)
class RangeId:
    owner: int
    sequence: int


@dataclass(frozen=True)
class BlockId:
    sequence: int


def encode_range(owner: int, sequence: int) -> int:
    if not 0 <= owner <= MAX_OWNER:
        raise InvalidArgument("an owner must lie between 0 and 1023")
    if not 1 <= sequence <= MAX_RANGE_SEQUENCE:
        raise NumericOutOfRange("a sequence must lie between 1 and 2^52 - 1")
    return RANGE_MARK | owner << RANGE_SEQUENCE_BITS | sequence


def decode_range(value: int, stored: bool = False) -> RangeId | None:
    """None for an id of the time before the policy; sequence 0 is reserved."""
    if value < 0 or not value & RANGE_MARK:
        return None
    if not value & MAX_RANGE_SEQUENCE:
        raise (DataCorruption if stored else InvalidArgument)("an owner-range id has the reserved sequence 0")
    return RangeId(value >> RANGE_SEQUENCE_BITS & MAX_OWNER, value & MAX_RANGE_SEQUENCE)


def encode_block(sequence: int) -> int:
    if not 1 <= sequence <= MAX_BLOCK_SEQUENCE:
        raise NumericOutOfRange("a sequence must lie between 1 and 2^61 - 1")
    return BLOCK_MARK | sequence


def decode_block(value: int, stored: bool = False) -> BlockId | None:
    if value < BLOCK_MARK:
        return None
    bad = DataCorruption if stored else InvalidArgument
    if value >= BLOCK_MARK << 1:
        raise bad("an id lies above the block-sequence range")
    if value == BLOCK_MARK:
        raise bad("a block-sequence id has the reserved sequence 0")
    return BlockId(value - BLOCK_MARK)


def range_columns(value: Column) -> tuple[Column, Column, Column]:
    """(kind, owner, sequence): kind is 'range' or 'legacy', the others null for legacy ids."""
    is_range = (value >= 0) & (value.bitwiseAND(F.lit(RANGE_MARK)) != 0)
    owner = F.shiftright(value, RANGE_SEQUENCE_BITS).bitwiseAND(F.lit(MAX_OWNER)).cast("int")
    return F.when(is_range, "range").otherwise("legacy"), F.when(is_range, owner), F.when(is_range, value.bitwiseAND(F.lit(MAX_RANGE_SEQUENCE)))


def block_columns(value: Column) -> tuple[Column, Column]:
    """(kind, sequence): kind is 'block' or 'legacy'."""
    is_block = (value >= F.lit(BLOCK_MARK)) & (value < F.lit(RANGE_MARK))
    return F.when(is_block, "block").otherwise("legacy"), F.when(is_block, value - F.lit(BLOCK_MARK))
