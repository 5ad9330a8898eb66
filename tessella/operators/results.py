"""Results at the edge of the engine: budgets, cursors, JSON."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessella.errors import InvalidArgument, LimitExceeded

DEFAULT_ROWS, DEFAULT_BYTES = 10_000, 16 << 20
MOST_ROWS, MOST_BYTES = 1_000_000, 1 << 30


@dataclass(frozen=True)
class Budget:
    rows: int = DEFAULT_ROWS
    bytes: int = DEFAULT_BYTES

    def __post_init__(self) -> None:
        if not 1 <= self.rows <= MOST_ROWS or not 1 <= self.bytes <= MOST_BYTES:
            raise InvalidArgument("a result budget is out of range")


def value_bytes(v) -> int:
    """A value's logical payload."""
    if v is None:
        return 0
    if isinstance(v, bool):
        return 1
    if isinstance(v, (int, float)):
        return 8
    return len(v.encode()) if isinstance(v, str) else len(v) if isinstance(v, (bytes, bytearray)) else len(str(v))


@dataclass
class Executed:
    """The shards that a read visits and its rows, not yet computed."""

    shards: list[int]
    frame: DataFrame

    def collect(self, budget: Budget = Budget()) -> Result:
        """All rows, or LimitExceeded and none. One row over the limit is read to tell."""
        names = self.frame.columns
        used = 16 + sum(1 + 8 + len(n.encode()) for n in names)
        if used > budget.bytes:
            raise LimitExceeded("the result is over its logical byte limit")
        rows = []
        for row in self.frame.limit(budget.rows + 1).toLocalIterator():
            if len(rows) >= budget.rows:
                raise LimitExceeded("the result is over its row limit")
            used += 8 + sum(9 + value_bytes(v) for v in row)
            if used > budget.bytes:
                raise LimitExceeded("the result is over its logical byte limit")
            rows.append(tuple(row))
        return Result(self.shards, [{"name": n, "type": t} for n, t in zip(names, (t for _, t in self.frame.dtypes))], rows)

    def stream(self) -> Iterator[tuple]:
        """Rows partition by partition; at most one partition is held."""
        for row in self.frame.toLocalIterator(prefetchPartitions=False):
            yield tuple(row)


@dataclass
class Result:
    shards: list[int]
    columns: list[dict]
    rows: list[tuple]

    def as_json(self) -> dict:
        """What a JSON service answers: one shard by number, several as a list."""
        at = {"shard": self.shards[0]} if len(self.shards) == 1 else {"shards": self.shards}
        return {**at, "columns": [c["name"] for c in self.columns], "rows": [[json_value(v) for v in r] for r in self.rows]}

    def cursor(self) -> Cursor:
        return Cursor(self)


def json_value(v):
    """Floats that are not finite become null, bytes a list of numbers."""
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, (bytes, bytearray)):
        return list(v)
    return v if v is None or isinstance(v, (bool, int, float, str)) else str(v)


def bound_json(v):
    """A JSON parameter as the engine binds it: lists and objects become compact text."""
    import json

    return json.dumps(v, separators=(",", ":"), ensure_ascii=False) if isinstance(v, (list, dict)) else v


class Cursor:
    """Rows of a finished result, in pieces."""

    def __init__(self, result: Result) -> None:
        self.shards, self.columns, self._rows, self._at, self.closed = result.shards, result.columns, result.rows, 0, False

    @property
    def remaining(self) -> int:
        return 0 if self.closed else len(self._rows) - self._at

    def fetchone(self) -> tuple | None:
        got = self.fetchmany(1)
        return got[0] if got else None

    def fetchmany(self, size: int = 1000) -> list[tuple]:
        if self.closed:
            raise InvalidArgument("the cursor is closed")
        if size < 1:
            raise InvalidArgument("a cursor fetches one row or more")
        got = self._rows[self._at : self._at + size]
        self._at += len(got)
        return got

    def fetchall(self) -> list[tuple]:
        return self.fetchmany(max(1, len(self._rows)))

    def close(self) -> None:
        self.closed, self._rows = True, []

    def __iter__(self) -> Iterator[tuple]:
        return self

    def __next__(self) -> tuple:
        row = None if self.closed else self.fetchone()
        if row is None:
            raise StopIteration
        return row

    def __enter__(self) -> Cursor:
        return self

    def __exit__(self, *_) -> None:
        self.close()
