"""Connected components of a link table, by alternating large and small stars.

Every round maps each node's larger neighbours to its smallest one, which
halves long paths; it ends when a round leaves the links as they are. All
state lies in written tables, only two numbers a round reach the driver, and
a hub's links meet their minimum in a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import dropped, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: distinct (u, v) with u > v. Returns distinct (u, v) with u > v."""
    ways = links.select("u", "v")
    if large:
        ways = ways.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    met = ways.join(least, "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    got = written(out.where(F.col("u") != F.col("v")).distinct(), "links")
    dropped(links.sparkSession, least)
    return got


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the component's smallest node.

    links: (u, v) in any order, repeated or not; links of a node to itself and
    links with a null end are ignored.
    """
    ends = links.where(F.col("u") != F.col("v"))
    now = written(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _state(now)
    while before[0]:
        wide = _star(now, large=True)
        dropped(links.sparkSession, now)
        now = _star(wide, large=False)
        dropped(links.sparkSession, wide)
        after = _state(now)
        if after == before:
            break
        before = after
    # at the end every link leads to a root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
