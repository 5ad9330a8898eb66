"""Counts and pages of a table, shard by shard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import InvalidArgument
from tessella.sources.catalog import HIDDEN, Table

DEFAULT_PAGE, MOST_PAGE, MOST_OFFSET = 50, 200, 1_000_000


def shard_counts(rows: DataFrame) -> DataFrame:
    """(shard, rows) of rows with ``_shard``."""
    return rows.groupBy(F.col("_shard").alias("shard")).agg(F.count(F.lit(1)).alias("rows"))


def slices(counts: list[int], offset: int, limit: int) -> list[tuple[int, int, int]]:
    """(shard, offset, limit) of each shard that a page over shard-major rows touches."""
    out = []
    for shard, n in enumerate(counts):
        if limit and offset < n:
            take = min(limit, n - offset)
            out.append((shard, offset, take))
            limit -= take
            offset = 0
        else:
            offset = max(0, offset - n)
    return out


def local_order(table: Table, rows: DataFrame) -> list[str]:
    """The primary key, else the row id, else all columns."""
    if table.primary:
        return list(table.primary)
    return ["_rid"] if "_rid" in rows.columns else [c for c, t in rows.dtypes if c not in HIDDEN and not t.startswith(("map", "struct<", "variant"))]


def checked_page(offset: int, limit: int) -> None:
    if not 1 <= limit <= MOST_PAGE or not 0 <= offset <= MOST_OFFSET:
        raise InvalidArgument("a page is out of range")


def page(table: Table, rows: DataFrame, offset: int = 0, limit: int = DEFAULT_PAGE) -> DataFrame:
    """Rows of a page with ``_shard``, ordered by shard and local order; one row more tells that there are more.

    The order needs no full sort: offset and limit turn it into a top-k.
    """
    checked_page(offset, limit)
    return rows.orderBy("_shard", *local_order(table, rows)).offset(offset).limit(limit + 1)


def sliced_page(table: Table, rows_of: Callable[[int], DataFrame], counts: list[int], offset: int = 0, limit: int = DEFAULT_PAGE) -> DataFrame:
    """The same page from the counts of each shard: only the shards that it touches are read, each up to its own slice."""
    checked_page(offset, limit)
    out = None
    for shard, start, n in slices(counts, offset, limit + 1):
        rows = rows_of(shard)
        part = rows.orderBy(*local_order(table, rows)).offset(start).limit(n)
        out = part if out is None else out.unionByName(part)
    return rows_of(0).limit(0) if out is None else out.orderBy("_shard", *local_order(table, out))
