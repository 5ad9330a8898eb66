"""Mixing sources to target weights, in DataFrame operations only.

Tokens are summed per source, each source's target over its tokens is its
repetition rate, and a document is emitted floor(rate) times, and once more
with probability equal to the fraction. The coin is a hash of seed, id and
text, so reruns agree. Rows of a source with equal id and text would all have one
coin: n of them take floor(n * fraction) more copies for certain, and the coin
decides on one further copy only.

Targets: sources take weights 1, 2, 3 in turn by name (null last) and share
all tokens by weight; none goes over CAP times its own tokens, and what is over
is shared again. That fixed point is ``min(CAP * size, level * weight)``, and
the level follows from running sums over sources ordered by ``size / weight``.

Defined results: a null text has size 0; texts are read whole at any length. A
source without tokens has target 0 and its documents are not taken. A null source
is a source of its own. Equal rows get equal answers but for the further copies,
which some of them take; which ones is not defined, as they are equal. Sources
that are equally full when shared out are taken in order of their names. An empty
table gives no rows. Extra columns are not read, and are kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import PLAIN_WORD, table, written

CAP = 3
SEED = "mix-1"


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(PLAIN_WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) of each source, from (source, size) rows.

    The window runs over one row a source, not over documents.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = sums.withColumn("weight", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % 3 + 1)
    # exact order by source_size / weight: weights are 1, 2 or 3, so 6 / weight is whole
    by_ratio = Window.orderBy((F.col("source_size") * 6 / F.col("weight")).cast("long"), F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = (
        weighed.withColumn("total", F.sum("source_size").over(every))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("spent", CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("rest", F.col("total") - F.col("spent"))
        .withColumn("open", F.col("all_weight") - F.col("gone"))
    )
    # the first source whose share does not go over its cap, and all after it, take the level
    fits = F.col("weight") * F.col("rest") <= CAP * F.col("source_size") * F.col("open")
    level = run.withColumn("fits", fits).withColumn("first", F.min(F.when(F.col("fits"), F.struct("gone", "rest", "open"))).over(every))
    capped = F.col("first").isNull() | (F.col("gone") < F.col("first.gone"))
    target = F.when(capped, (CAP * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.col("first.rest")).cast("double") / F.col("first.open").cast("double"))
    return level.select("source", "source_size", target.alias("target"))


def digest(doc_id: str = "doc_id", text: str = "text"):
    """An md5, in hex, of seed, id and text."""
    said = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.md5(said.cast("binary"))


def coin(digest_: str):
    """A uniform number in [0, 1): 52 bits of the digest."""
    return F.conv(F.substring(digest_, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


#: A table of at most this many rows is broadcast; a larger one is joined by shuffle.
SMALL = 10_000
#: Columns that are added to a row.
OWN = ["__mix_digest", "__mix_size", "__mix_target", "__mix_copies"]


def held(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, __mix_digest) of each row of docs, written once: the only pass that counts words."""
    return written(docs.select("doc_id", "source", word_count().alias("size"), digest().alias("__mix_digest")), "mix-facts")


def with_copies(rows: DataFrame, facts_: DataFrame) -> DataFrame:
    """rows of (source, __mix_digest, ...) with OWN: its source's figures and how often the mix takes the row."""
    goal = held(written(targets(facts_).select(F.col("source").alias("__mix_source"), F.col("source_size").alias("__mix_size"), F.col("target").alias("__mix_target")), "mix-targets"))
    met = rows.join(goal, rows["source"].eqNullSafe(goal["__mix_source"]))
    rate = F.when(F.col("__mix_size") > 0, F.col("__mix_target") / F.col("__mix_size")).otherwise(F.lit(0.0))
    names, whole = [*rows.columns, *OWN[1:3]], F.floor(rate)
    more = (coin("__mix_digest") < rate - whole).cast("long")
    again = facts_.groupBy(F.col("source").alias("__mix_from"), F.col("__mix_digest").alias("__mix_twin")).agg(F.count(F.lit(1)).alias("__mix_n")).where(F.col("__mix_n") > 1)
    again = held(written(again, "mix-again"))
    if again.isEmpty():
        return met.select(*names, (whole + more).cast("long").alias("__mix_copies"))
    same = met["source"].eqNullSafe(again["__mix_from"]) & (met["__mix_digest"] == again["__mix_twin"])
    alone = met.join(again, same, "left_anti").select(*names, (whole + more).cast("long").alias("__mix_copies"))
    # equal rows are numbered within each part of the table they were written in, and the parts one after the other, so a group of any size is dealt out
    twins = written(met.join(again, same).select(*names, "__mix_n", F.spark_partition_id().alias("__mix_part")), "mix-twins")
    group = ["source", "__mix_digest"]
    before = F.sum("__mix_c").over(Window.partitionBy(*group).orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = twins.groupBy(*group, "__mix_part").agg(F.count(F.lit(1)).alias("__mix_c")).withColumn("__mix_before", F.coalesce(before, F.lit(0)))
    parts = parts.select(F.col("source").alias("__mix_s"), F.col("__mix_digest").alias("__mix_d"), F.col("__mix_part").alias("__mix_p"), "__mix_before")
    at = F.row_number().over(Window.partitionBy(*group, "__mix_part").orderBy("__mix_digest")) + F.col("__mix_before")
    numbered = twins.join(parts, twins["source"].eqNullSafe(parts["__mix_s"]) & (twins["__mix_digest"] == parts["__mix_d"]) & (twins["__mix_part"] == parts["__mix_p"])).withColumn("__mix_at", at)
    share = F.col("__mix_n") * (rate - whole)
    sure = F.floor(share)
    more = ((F.col("__mix_at") <= sure) | ((F.col("__mix_at") == sure + 1) & (coin("__mix_digest") < share - sure))).cast("long")
    return alone.unionByName(numbered.select(*names, (whole + more).cast("long").alias("__mix_copies")))


def planned(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of each row of (doc_id, text, source)."""
    rows = facts(docs)
    met = with_copies(rows, rows)
    return met.select("doc_id", "size", F.col("__mix_size").alias("source_size"), F.col("__mix_target").alias("target"), F.col("__mix_copies").alias("copies"), (F.col("__mix_copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """Every row of docs as often as the mix takes it, with all its columns and the number of the copy."""
    at = "__mix_copy" if "copy" in docs.columns else "copy"
    taken = with_copies(docs.withColumn("__mix_digest", digest()), facts(docs)).where(F.col("__mix_copies") > 0)
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int"))).alias(at))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{PLAIN_WORD}')) END AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest
  FROM documents
), sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sums
), run AS (
  SELECT source, source_size, weight, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS all_weight,
         3 * coalesce(CAST(sum(source_size) OVER before AS BIGINT), 0) AS spent, coalesce(CAST(sum(weight) OVER before AS BIGINT), 0) AS gone
  FROM weighed WINDOW before AS (ORDER BY source_size * (6 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT gone, total - spent AS rest, all_weight - gone AS open FROM run
  WHERE weight * (total - spent) <= 3 * source_size * (all_weight - gone) ORDER BY gone LIMIT 1
), goal AS (
  SELECT source, source_size,
         CASE WHEN (SELECT gone FROM level) IS NULL OR run.gone < (SELECT gone FROM level) THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(weight * (SELECT rest FROM level) AS DOUBLE) / CAST((SELECT open FROM level) AS DOUBLE) END AS target
  FROM run
), rated AS (
  SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, g.source_size, g.target, CAST('0x' || substr(d.digest, 1, 13) AS BIGINT) / 4503599627370496.0 AS coin,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
         count(*) OVER same AS n, row_number() OVER (same ORDER BY d.doc_id) AS place
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source WINDOW same AS (PARTITION BY d.source, d.digest)
), shared AS (SELECT *, n * (rate - floor(rate)) AS share FROM rated
)
SELECT doc_id, size, source_size, target,
       CAST((CAST(floor(rate) AS BIGINT) + CASE WHEN place <= floor(share) OR place = floor(share) + 1 AND coin < share - floor(share) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM shared
"""
