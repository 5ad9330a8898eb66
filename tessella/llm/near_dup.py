"""Near duplicates by b-bit MinHash.

Texts with the same shingle set form one class. Of each class, minima of
BANDS * ROWS hash functions give band keys; the low bits of LANES of them are
packed into words. Classes that share a band key are candidates, the packed
words give a collision-corrected estimate of their similarity, and what the
estimate cannot rule out is confirmed on the full sets of 64-bit shingle hashes.

Candidates are never all pairs of a bucket. First every member is held against
the bucket's centre, the class that meets most others, and components are
formed. Where a bucket still lies in several components its members are open,
and pairs of open classes in different components are found by a prefix filter on
their full sets: shingles stand from rare to common, two sets that are similar
enough share one among the first few of each, and its places bound what the sets
can share at all. What sizes, places and estimate leave is confirmed. So a bucket
of n near copies costs about n confirmations, members that share only a template
with each other cost nothing, and no pair that could join two components goes
unseen. With the default bands a pair of similarity 0.8 shares no band key with
probability (1 - 0.8^5)^32 = 3e-6; the estimate wrongly rules it out with
probability 3e-7 (five standard deviations).

Defined results: a text without words (null and empty ones too) has an empty set,
links with nothing and is its own component. Texts are read whole at any length.
A null doc_id takes part in links, and its rows' component_id is the smallest id
reachable, else null. Rows with the same set share a component. Of equally met
classes the one with the greatest set key is the centre; links do not depend on
it but for the chances above. An empty table gives no rows. Extra columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import dropped, mixed, plain_words, sieve, table, utf8, written
from tessella.llm.components import components

ROWS, BANDS, LANES, BITS = 5, 32, 128, 2
#: Members of a candidate centre that one group of the confirmation holds.
CHUNK = 32
#: Counters in which open classes' shingles are counted to tell rare from common; a number too small costs candidates, not links.
SLOTS = 1 << 20
_PERMUTE = mixed(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = plain_words(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(h))
    s = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        s *= _STEP
        s += h[k : len(h) - size + 1 + k]
    return np.unique(mixed(s + np.uint64(size)))


def minima(shingles: np.ndarray) -> np.ndarray:
    out = np.full(len(_PERMUTE), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        np.minimum(out, np.multiply.outer(_PERMUTE, shingles[at : at + 4096]).min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mixed(key * _STEP + m.reshape(BANDS, ROWS)[:, r])
    return key.view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """Low BITS bits of LANES minima, 64 / BITS lanes a word."""
    low = (m[:LANES] >> np.uint64(20)) & np.uint64((1 << BITS) - 1)
    lanes = low.reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


WORDS = LANES * BITS // 64


def signed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, k, bands, sig) of each row; the last three null for an empty set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, keys, bands, sigs, known = [], [], [], [], {}
            for text in utf8(batch.column("text")):
                s = shingle_set(text, width)
                n.append(len(s))
                if not len(s):
                    keys.append(None), bands.append(None), sigs.append(None)
                    continue
                keys.append(key := set_key(s))
                if key not in known:
                    m = minima(s)
                    known[key] = band_keys(m), packed(m)
                bands.append(known[key][0]), sigs.append(known[key][1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "k", "bands", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, k binary, bands array<long>, sig array<long>")


def least_agreement(threshold: float, deviations: float = 5.0) -> int:
    """Lanes that agree at least, but for so many standard deviations, at a similarity of threshold."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * threshold
    return int(np.floor(LANES * p - deviations * np.sqrt(LANES * p * (1 - p))))


def agreement(a: Column, b: Column) -> Column:
    """Lanes on which two packed signatures agree, by bit counts (lanes of two bits)."""
    lane = F.lit(0x5555555555555555)
    differ = F.lit(0)
    for i in range(WORDS):
        x = a[i].bitwiseXOR(b[i])
        differ = differ + F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(lane))
    return F.lit(LANES) - differ


def similar(a: str, b: str, threshold: float) -> Column:
    """What sizes and estimate do not rule out. a, b: prefixes of columns n and sig."""
    na, nb = F.col(a + "n"), F.col(b + "n")
    percent = round(100 * threshold)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (agreement(F.col(a + "sig"), F.col(b + "sig")) >= least_agreement(threshold))


def key_column(text: Column, width: int) -> Column:
    """The set key of a text; null where it has no word."""

    @F.arrow_udf("binary")
    def key(text: pa.Array) -> pa.Array:
        return pa.array([set_key(s) if len(s := shingle_set(t, width)) else None for t in utf8(text)], pa.binary())

    # not deterministic to the optimizer: else it would look for null keys before other filters, and shingle every text
    return key.asNondeterministic()(text)


def texts_of(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(k, text) of the classes (k, id); texts of ids that no class has are neither shingled again nor moved."""
    passes = sieve(classes, "id")
    texts = docs.where(passes(F.col("doc_id"))).select(F.col("doc_id").alias("row"), "text")
    texts = texts.withColumn("tk", key_column(texts["text"], width))
    met = texts.join(classes.hint("merge"), (F.col("tk") == F.col("k")) & F.col("row").eqNullSafe(F.col("id")))
    return met.select("k", "text").dropDuplicates(["k"])


def compared(pairs: DataFrame, held: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (x, y) of classes that are linked, held against each other on their full sets.

    Texts are dealt by y in groups of at most CHUNK members, each with y's own
    text in front.
    """
    percent = round(100 * threshold)
    last = F.floor((F.col("n") - 1) / CHUNK).cast("int")
    sizes = written(pairs.groupBy("y").agg(F.count(F.lit(1)).alias("n")), "centre-sizes")
    centres = sizes.select(F.col("y").alias("k"), F.col("y").alias("c"), F.explode(F.sequence(F.lit(0), last)).alias("part"))
    members = pairs.join(sizes.select("y", last.alias("last")), "y").select(F.col("x").alias("k"), F.col("y").alias("c"), F.pmod(F.xxhash64("x", "y"), F.col("last") + 1).cast("int").alias("part"))
    dealt = held.join(centres.unionByName(members), "k").select("c", "part", "k", "text", (F.col("k") != F.col("c")).cast("int").alias("after"))
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "c", "part").sortWithinPartitions("c", "part", "after", "k").select("c", "part", "k", "text")

    def run(batches):
        centre, own = None, None
        for batch in batches:
            rows = []
            for c, part, k, text in zip(batch.column("c").to_pylist(), batch.column("part").to_pylist(), batch.column("k").to_pylist(), utf8(batch.column("text"))):
                s = shingle_set(text, width)
                if k == c:
                    if (c, part) != centre:
                        centre, own = (c, part), s
                    continue
                both = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                if 100 * both >= percent * (len(own) + len(s) - both):
                    rows.append((k, c))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in range(2)], ["x", "y"])

    got = written(dealt.mapInArrow(run, "x binary, y binary"), "linked")
    dropped(pairs.sparkSession, sizes)
    return got


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """Of a set of n shingles from rare to common, how many stand for it towards sets as large at most, and as large at least."""
    return n + (-percent * n) // 100 + 1, n + (-2 * percent * n) // (100 + percent) + 1


def prefixes(texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """(token, k, root, n, i, short) of the first shingles of each class's set, from rare to common; i: place, short: also towards larger sets.

    Shingles are counted over all of the texts (k, root, text), in SLOTS counters; equal counts stand by their hash.
    """
    spark, percent = texts.sparkSession, round(100 * threshold)

    def count(batches):
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in utf8(batch.column("text")):
                np.add.at(n, (shingle_set(text, width) & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["slot", "n"])

    counted = texts.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
    counts = np.zeros(SLOTS, np.int64)
    counts[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    held = spark.sparkContext.broadcast(counts)
    names, kinds = ["token", "k", "root", "n", "i", "short"], [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches):
        counts = held.value
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for k, root, text in zip(batch.column("k").to_pylist(), batch.column("root").to_pylist(), utf8(batch.column("text"))):
                s = shingle_set(text, width)
                long, short = prefix_lengths(len(s), percent)
                first = s[np.lexsort((s, counts[(s & np.uint64(SLOTS - 1)).astype(np.int64)]))[:long]].view(np.int64).tolist()
                for c, x in zip(cols, (first, [k] * long, [root] * long, [len(s)] * long, range(long), [i < short for i in range(long)])):
                    c.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return written(texts.select("k", "root", "text").mapInArrow(run, "token long, k binary, root binary, n long, i long, short boolean"), "prefixes")


def torn_pairs(texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """(x, y) of the classes (k, root, text) that lie in different components and may be similar, by a prefix filter.

    Of each shingle the component with the most classes is set apart: a pair of different components has a
    class outside it, so classes of one large component never meet each other here.
    """
    spark, percent = texts.sparkSession, round(100 * threshold)
    rows = prefixes(texts, width, threshold)
    roots = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("token")
    main = written(roots.agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1).select("token", "main"), "main-roots")
    met = written(rows.join(main, "token"), "met")
    own = ["k", "root", "n", "i"]
    side = lambda df, name: df.select("token", *[F.col(c).alias(f"{name}_{c}") for c in own])
    larger, smaller = met, met.where("short")
    apart = F.col("root") != F.col("main")
    order = (F.col("y_n") < F.col("x_n")) | ((F.col("y_n") == F.col("x_n")) & (F.col("y_k") < F.col("x_k")))
    # the places of a shared shingle bound what two sets can share from there on; of their first one, at all
    bound = (100 + percent) * F.least(F.col("x_n") - F.col("x_i"), F.col("y_n") - F.col("y_i")) >= percent * (F.col("x_n") + F.col("y_n"))
    possible = (F.col("x_root") != F.col("y_root")) & order & (100 * F.col("y_n") >= percent * F.col("x_n")) & bound
    pairs = None
    for x, y in ((larger.where(apart), smaller), (larger.where(~apart), smaller.where(apart))):
        part = side(x, "x").join(side(y, "y"), "token").where(possible).select(F.col("x_k").alias("x"), F.col("y_k").alias("y"))
        pairs = part if pairs is None else pairs.unionByName(part)
    got = written(pairs.distinct(), "torn-pairs")
    dropped(spark, rows, main, met)
    return got


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, keys: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs.

    With ``keys`` also the set key k, and whether the row's set is the one that stands for its component.
    """
    spark, percent = docs.sparkSession, round(100 * threshold)
    rows = written(signed(docs, width), "signed")
    classes = written(
        rows.where(F.col("k").isNotNull()).groupBy("k").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")),
        "classes",
    )
    members = classes.select("k", F.explode("bands").alias("band"))
    sizes = written(members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1), "sizes")
    buckets = written(members.join(sizes, "band"), "buckets")
    # the class that meets most others is the centre of its buckets: an original meets its copies more often than they meet each other
    weight = written(buckets.groupBy("k").agg(F.sum("size").alias("weight")), "weights")
    weighed = written(buckets.join(weight, "k").select("band", "k", "weight"), "weighed")
    centre = written(weighed.groupBy("band").agg(F.max(F.struct("weight", "k"))["k"].alias("y")), "centres")
    around = written(weighed.join(centre, "band").select("k", "y").distinct(), "around")
    held = written(texts_of(docs, weight.select("k").join(classes.select("k", "id"), "k"), width), "texts")
    facts = written(weight.select("k").join(classes.select("k", "n", "sig"), "k"), "facts")
    dropped(spark, sizes, buckets, weight, weighed, centre)

    def side(name: str) -> DataFrame:
        return facts.select(F.col("k").alias(name), F.col("n").alias(f"{name}_n"), F.col("sig").alias(f"{name}_sig"))

    stars = around.where(F.col("k") != F.col("y")).select(F.col("k").alias("x"), "y")
    stars = written(stars.join(side("x"), "x").join(side("y"), "y").where(similar("x_", "y_", threshold)).select("x", "y"), "stars")
    told = compared(stars, held, width, threshold)
    links = told.select(F.col("x").alias("u"), F.col("y").alias("v"))

    roots = written(components(links), "roots")
    rooted = written(around.join(roots, around["k"] == roots["node"], "left").select("k", "y", F.coalesce("root", "k").alias("root")), "rooted")
    home = rooted.where(F.col("k") == F.col("y")).select("y", F.col("root").alias("home"))
    placed = written(rooted.join(written(home, "home"), "y"), "placed")
    torn = placed.where(F.col("root") != F.col("home")).select("y").distinct()
    open_ = placed.join(torn, "y").select("k", "root").distinct()
    open_ = written(open_.join(held, "k"), "open")
    joined = roots
    if not open_.isEmpty():
        late = torn_pairs(open_, width, threshold)
        likely = written(late.join(side("x"), "x").join(side("y"), "y").where(similar("x_", "y_", threshold)).select("x", "y"), "late")
        late_links = compared(likely, held, width, threshold).select(F.col("x").alias("u"), F.col("y").alias("v"))
        if not late_links.isEmpty():
            ways = roots.where(F.col("node") != F.col("root")).select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(late_links)
            joined = written(components(ways), "joined")
        dropped(spark, late, likely)
    named = written(classes.select("k", "id").join(joined, classes["k"] == joined["node"], "left").select("k", "id", F.coalesce("root", "k").alias("root")), "named")
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "k")))["k"]
    least = written(named.groupBy("root").agg(F.min("id").alias("component_id"), first.alias("first")), "least-ids")
    of_class = written(named.join(least, "root").select("k", "component_id", (F.col("k") == F.col("first")).alias("first")), "of-class")
    dropped(spark, classes, around, held, facts, stars, told, roots, rooted, placed, open_, joined, named, least)
    out = rows.select("doc_id", "n_shingles", "k").join(of_class if keys else of_class.drop("first"), "k", "left")
    component = F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    more = ["k", (F.col("k").isNull() | F.coalesce("first", F.lit(False))).alias("stands")] if keys else []
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), *more)


def one_of_each(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that stand for their near-duplicate groups: one of each group, that with the smallest id.

    Rows are told apart by id and set of shingles, so each text of an id that repeats is judged by itself. Of rows
    with equal id and set the smallest one stays, by text and then the other columns that have an order. Rows without
    an id cannot stand for a group by name; they all stay. Texts of ids that keep their only row are not moved.
    """
    key, own = "__near_key", "__near_id"
    judged = written(near_duplicates(docs.select("doc_id", "text"), width, threshold, keys=True).where(F.col("doc_id").isNotNull()).select("doc_id", "k", (F.col("kept") & F.col("stands")).alias("stands")), "judged")
    doubt = judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("stands").alias("stay")).where((F.col("n") > 1) | ~F.col("stay")).select("doc_id")
    doubt = written(doubt, "doubt")
    passes = sieve(doubt, "doc_id")
    known = F.col("doc_id").isNotNull()
    sure, maybe = docs.where(~known | ~passes(F.col("doc_id"))), docs.where(known & passes(F.col("doc_id")))
    stand = judged.where("stands").select(F.col("doc_id").alias(own), F.col("k").alias(f"{own}_k")).distinct()
    maybe = maybe.withColumn(key, key_column(F.col("text"), width))
    stay = maybe.join(stand, (F.col("doc_id") == F.col(own)) & F.col(key).eqNullSafe(F.col(f"{own}_k")))
    names = [f.name for f in docs.schema.fields]
    ordered = ["text", *(f.name for f in docs.schema.fields if f.name != "text" and isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType))]
    row, order = F.struct(*[F.col(f"`{c}`") for c in names]), F.struct(*[F.col(f"`{c}`") for c in ordered])
    once = stay.groupBy(own, key).agg(F.min_by(row, order).alias("__near_row")).select("__near_row.*")
    return sure.unionByName(once)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2, threshold=0.8)


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM pairs JOIN sizes s ON s.doc_id = u JOIN sizes t ON t.doc_id = v WHERE 100 * c >= 80 * (s.n + t.n - c)
), ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links
), reach AS (
  SELECT doc_id AS u, doc_id AS r FROM documents UNION SELECT w.v, reach.r FROM reach JOIN ways w ON w.u = reach.u
), least AS (SELECT u, min(r) AS r FROM reach GROUP BY u)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, l.r AS component_id, d.doc_id = l.r AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.u = d.doc_id
"""
