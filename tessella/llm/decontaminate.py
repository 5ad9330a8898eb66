"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are sets of word shingles, ordered from rare to common by
how many documents hold each. A document can hold a whole window only if it
holds its prefix; for full containment the necessary prefix is the single
rarest shingle. Where a document has it, the position inside the window fixes
where the window would begin (positional bound), begin and end must lie in the
text (length bound), and the window's words are then compared one by one.

Items go in blocks of bounded size, long ones in pieces that overlap by all but
one word of a window: a block's windows are broadcast, every document is read
whole against it, and the findings of earlier blocks travel with the row, so the
method holds at any number and length of items.

Defined results: a null or wordless text has no words and no hits; an item
without words has no window. Texts are read whole at any length. Windows of an
item with a null id mark words but are listed under no id; repeated ids count
once. Of a window's equally rare shingles the one first numbered, then the
leftmost, is its prefix; the result does not depend on it. Without items nothing
is hit; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import dropped, folded_words, table, utf8, written

WINDOW = 10
SHINGLE = 3
#: UTF-8 bytes of item texts that one block holds, as an expectation of a hashed split.
BLOCK_BYTES = 8_000_000
#: Windows that begin in one piece of an item.
PIECE = 50_000


@dataclass
class Index:
    """A block's windows over the ids of its own words.

    A window is a stretch of ``flat``. Shingles are numbered step by step: of n words, ``levels[n]`` has for each
    further word the sorted codes (number so far, word); a code's place is the next number, so none outgrows 64 bits.
    """

    words: dict[bytes, int] = field(default_factory=dict)
    flat: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    starts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    lengths: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    owners: list[set[str]] = field(default_factory=list)
    levels: dict[int, list[np.ndarray]] = field(default_factory=dict)
    #: of each shingle size: the prefix's number, sorted, and the window and the prefix's place in it
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def build(cls, items: list[tuple[str | None, bytes | None]], window: int) -> Index:
        self, at, texts, starts, lengths, total = cls(), {}, [], [], [], 0
        for item, text in items:
            ids = np.array([self.words.setdefault(w, len(self.words)) for w in folded_words(text or b"")], dtype=np.int64)
            if not len(ids):
                continue
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                k = at.setdefault(ids[i : i + size].tobytes(), len(starts))
                if k == len(starts):
                    starts.append(total + i)
                    lengths.append(size)
                    self.owners.append(set())
                if item is not None:
                    self.owners[k].add(item)
            texts.append(ids)
            total += len(ids)
        self.flat = np.concatenate([np.empty(0, np.int64), *texts])
        self.starts, self.lengths = np.array(starts, dtype=np.int64), np.array(lengths, dtype=np.int64)
        for n in sorted({min(SHINGLE, x) for x in lengths}):
            own = [w for _, w in self.stacked() if min(SHINGLE, w.shape[1]) == n]
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(w, n, axis=1).reshape(-1, n) for w in own])
            self.levels[n], number = [], rows[:, 0]
            for k in range(1, n):
                known, number = np.unique(number * (len(self.words) + 1) + rows[:, k], return_inverse=True)
                self.levels[n].append(known)
        return self

    def stacked(self):
        """(window numbers, their words as a matrix) of each length."""
        for size in np.unique(self.lengths).tolist():
            k = np.flatnonzero(self.lengths == size)
            yield k, self.flat[self.starts[k][:, None] + np.arange(size)]

    def kinds(self, n: int) -> int:
        return len(self.levels[n][-1]) if n > 1 else len(self.words)

    def numbers(self, ids: np.ndarray, n: int) -> np.ndarray:
        """The number of each n-word shingle along the last axis; -1 where the block has it not."""
        size = ids.shape[-1] - n + 1
        if size < 1:
            return np.empty((*ids.shape[:-1], 0), np.int64)
        out = ids[..., :size]
        for k, known in enumerate(self.levels[n], 1):
            word = ids[..., k : k + size]
            code = out * (len(self.words) + 1) + word
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            out = np.where((out >= 0) & (word >= 0) & (known[at] == code), at, -1)
        return out

    def arm(self, found_in: dict[int, np.ndarray]) -> None:
        """Picks each window's prefix. found_in: documents that hold each shingle, by size and number."""
        parts: dict[int, list] = {}
        for k, words in self.stacked():
            n = min(SHINGLE, words.shape[1])
            each = self.numbers(words, n)
            often = found_in[n][each]
            place = np.where(often == often.min(axis=1, keepdims=True), each, np.iinfo(np.int64).max).argmin(axis=1)
            parts.setdefault(n, []).append((each[np.arange(len(k)), place], k, place))
        for n, some in parts.items():
            number, k, place = (np.concatenate([p[i] for p in some]) for i in range(3))
            order = np.argsort(number, kind="stable")
            self.prefix[n] = number[order], k[order], place[order]

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.words.get
        return np.array([get(w, -1) for w in words], dtype=np.int64)

    def spans(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(begin, end, window) of each verified occurrence."""
        out = []
        for n, (number, windows, places) in self.prefix.items():
            got = self.numbers(ids, n)
            first, last = np.searchsorted(number, got, "left"), np.searchsorted(number, got, "right")
            for p in np.flatnonzero((got >= 0) & (first < last)):
                for j in range(first[p], last[p]):
                    k = int(windows[j])
                    begin, size, start = int(p - places[j]), int(self.lengths[k]), int(self.starts[k])
                    if begin >= 0 and begin + size <= len(ids) and np.array_equal(ids[begin : begin + size], self.flat[start : start + size]):
                        out.append((begin, begin + size, k))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces(items: DataFrame, window: int) -> DataFrame:
    """(i, t) of the items (item_id, text): stretches of at most PIECE windows; the windows of an item are those of its stretches."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column("i").to_pylist(), utf8(batch.column("t"))):
                words = folded_words(text or b"")
                at = range(0, max(1, len(words) - window + 1), PIECE) if words else ()
                said = [b" ".join(words[a : a + PIECE + window - 1]) for a in at]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(said), pa.string()), pa.array(said, pa.binary())], ["i", "t"])

    return items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "i string, t binary")


def blocks(items: DataFrame, window: int, block_bytes: int = BLOCK_BYTES):
    """Indexes over all of (item_id, text), each of a bounded share of the items' pieces."""
    rows = written(pieces(items, window), "pieces")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows
        got = sorted(((r["i"], bytes(r["t"])) for r in part.collect()), key=lambda x: (x[0] or "", x[1]))
        yield Index.build(got, window)
    dropped(items.sparkSession, rows)


def rarity(docs: DataFrame, index: Index) -> dict[int, np.ndarray]:
    """Documents that hold each of the index's shingles, counted over all documents."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = held.value
        counts = {n: np.zeros(index.kinds(n), np.int64) for n in index.levels}
        for batch in batches:
            for text in utf8(batch.column("text")):
                ids = index.ids(folded_words(text or b""))
                for n, c in counts.items():
                    got = np.unique(index.numbers(ids, n))
                    c[got[got >= 0]] += 1
        for n, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int32)), pa.array(some), pa.array(c[some])], ["size", "shingle", "n"])

    out = {n: np.zeros(index.kinds(n), np.int64) for n in index.levels}
    summed = docs.select("text").mapInArrow(run, "size int, shingle long, n long").groupBy("size", "shingle").agg(F.sum("n").alias("n"))
    for r in summed.toLocalIterator():
        out[r["size"]][r["shingle"]] = r["n"]
    return out


FOUND = "struct<n_words:bigint,spans:array<int>,items:array<string>>"


def with_hits(docs: DataFrame, items: DataFrame, name: str, window: int = WINDOW) -> DataFrame:
    """docs with a struct column ``name`` of n_words, spans (begin, end, begin, ...) and item ids."""
    spark, out, first = docs.sparkSession, docs, True
    for index in blocks(items, window):
        if index.owners:
            index.arm(rarity(docs, index))
        held = spark.sparkContext.broadcast(index)

        def found(text: pa.Array, before: pa.Array | None = None, held=held) -> pa.Array:
            index, words_, spans_, items_ = held.value, [], [], []
            for k, t in enumerate(utf8(text)):
                words = folded_words(t or b"")
                spans, owners = [], set()
                if before is not None:
                    old = before[k].as_py()
                    spans += zip(old["spans"][::2], old["spans"][1::2])
                    owners.update(old["items"])
                if index.owners and words:
                    for a, b, w in index.spans(index.ids(words)):
                        spans.append((a, b))
                        owners.update(index.owners[w])
                words_.append(len(words))
                spans_.append([x for s in merged(spans) for x in s])
                items_.append(sorted(owners))
            return pa.StructArray.from_arrays([pa.array(words_, pa.int64()), pa.array(spans_, pa.list_(pa.int32())), pa.array(items_, pa.list_(pa.string()))], ["n_words", "spans", "items"])

        if first:

            @F.arrow_udf(FOUND)
            def run(text: pa.Array) -> pa.Array:
                return found(text)

            out = out.withColumn(name, run.asNondeterministic()(out["text"]))
        else:
            out = written(out, "hits")

            @F.arrow_udf(FOUND)
            def run(text: pa.Array, before: pa.Array) -> pa.Array:
                return found(text, before)

            out = out.withColumn(name, run.asNondeterministic()(out["text"], out[name]))
        first = False
    return out


def hit_words(spans: str):
    """Words inside spans, which are disjoint."""
    x = F.col(spans)
    return F.coalesce(
        F.aggregate(F.transform(x, lambda v, i: F.when(i % 2 == 1, v.cast("long")).otherwise(-v.cast("long"))), F.lit(0).cast("long"), lambda a, v: a + v),
        F.lit(0).cast("long"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = with_hits(docs, table(spark, sf_dir, "benchmark"), "found").select("doc_id", "found.*")
    return got.select(
        "doc_id",
        "n_words",
        hit_words("spans").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT size FROM windows
), places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, lengths WHERE len(w) >= size)
), hits AS (SELECT p.doc_id, p.i, p.size, x.item FROM places p JOIN windows x ON x.g = p.g AND x.size = p.size
), hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN hit_items t ON t.doc_id = d.doc_id
"""
