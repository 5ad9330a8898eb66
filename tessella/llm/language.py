"""Language identification by language-bitmask n-gram filters.

Each language's characteristic character trigrams go into one bit-sliced Bloom
filter: a table of bit masks, one bit per language. Reading the masks at a
trigram's positions and AND-ing them returns every language that contains it.
A text's verdict comes from the number of trigrams whose mask has a language's
bit, less the share that false positives add.

Defined results: a null text, or one without a letter, is ``und`` with score 0.
Without any training row every text is ``und``. Texts are read whole at any
length, window by window. Bytes that are not UTF-8 become replacement characters,
which are no letters. Ties go to the language with more training rows, then to the
smaller name. Repeated rows get equal answers; an empty table gives no rows. Extra
columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import fold_of, mixed, strings, table

UNDETERMINED = "und"
ORDER = 3
#: Characters that are worked on at once; longer texts go through in overlapping windows.
WINDOW = 1 << 20
#: Documents of a language that its profile is fitted on, at most, as an expectation of a hashed draw.
SAMPLE_PER_LANGUAGE = 2000
GRAMS_PER_LANGUAGE = 6000
SLOTS = 1 << 17
HASHES = 3

_fold_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> code point of its lower-case letter, or a blank."""
    global _fold_table
    if _fold_table is None:
        out = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _fold_table = out
    return _fold_table


def grams(text: str):
    """Hashed trigrams of the text's words, each with a blank on both sides; window by window."""
    table_, last = _letters(), np.array([32], dtype=np.uint32)
    for at in range(0, max(len(text), 1), WINDOW):
        cp = table_[np.frombuffer(text[at : at + WINDOW].encode("utf-32-le", "replace"), dtype=np.uint32)]
        edge = np.array([32] if at + WINDOW >= len(text) else [], dtype=np.uint32)
        cp = np.concatenate([last, cp, edge])
        blank = cp == 32
        keep = np.ones(len(cp), dtype=bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        cp = cp[keep]
        last = cp[-2:]  # what a trigram over the windows' edge begins with, runs of blanks being one
        if len(cp) < ORDER:
            continue
        cp = cp.astype(np.uint64)
        yield (cp[:-2] << np.uint64(42)) | (cp[1:-1] << np.uint64(21)) | cp[2:]


def _slots(g: np.ndarray) -> list[np.ndarray]:
    h = mixed(g)
    bits = np.uint64(21)
    return [((h >> (bits * np.uint64(k))) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Profiles:
    """Languages, bit-sliced filter (slots x words of 64 languages) and false-positive rates."""

    languages: list[str]
    masks: np.ndarray
    false_positive: np.ndarray

    @classmethod
    def build(cls, members: dict[str, np.ndarray]) -> Profiles:
        """members: a language's trigrams, in order of preference among languages."""
        names = list(members)
        masks = np.zeros((SLOTS, max(1, (len(names) + 63) // 64)), dtype=np.uint64)
        fpr = np.zeros(len(names))
        for k, name in enumerate(names):
            filled = np.zeros(SLOTS, dtype=bool)
            for s in _slots(members[name]):
                filled[s] = True
            masks[filled, k // 64] |= np.uint64(1) << np.uint64(k % 64)
            fpr[k] = filled.mean() ** HASHES
        return cls(names, masks, fpr)

    def lookup(self, g: np.ndarray) -> np.ndarray:
        """Masks of all languages that contain each trigram."""
        first, *rest = _slots(g)
        found = self.masks[first]
        for s in rest:
            found &= self.masks[s]
        return found

    def judge(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNDETERMINED, 0.0
        total, counts = 0, np.zeros(len(self.languages))
        letter = False
        for g in grams(text):
            total += len(g)
            letter = True
            found = self.lookup(g)
            if len(self.languages) <= 8:
                seen = np.bincount(found[:, 0].astype(np.int64), minlength=256)
                for k in range(len(self.languages)):
                    counts[k] += seen[(np.arange(len(seen)) >> k) & 1 == 1].sum()
            else:
                for k in range(len(self.languages)):
                    counts[k] += int(((found[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).sum())
        if not letter:
            return UNDETERMINED, 0.0
        true = np.clip((counts - self.false_positive * total) / (1 - self.false_positive), 0, None)
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / true.sum()) if true.sum() > 0 else 0.0


def fit(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Profiles:
    """Profiles from rows of (doc_id, text, lang).

    The draw of at most about ``sample_per_language`` documents a language, by a
    hash of id and text, bounds the work at any corpus size.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Profiles.build({})
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    limit = F.create_map(*[F.lit(v) for n, c in sizes.items() for v in (n, int(min(1.0, sample_per_language / c) * (1 << 30)))])
    drawn = known.where(part < limit[F.col("lang")])

    def count(batches):
        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), strings(batch.column("text"))):
                own = by.setdefault(lang, Counter())
                for g in grams(text):
                    u, n = np.unique(g, return_counts=True)
                    own.update(dict(zip(u.tolist(), n.tolist())))
            for lang, own in by.items():
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([lang] * len(own), pa.string()), "g": pa.array(list(own), pa.int64()), "n": pa.array(list(own.values()), pa.int64())}
                )

    from pyspark.sql import Window

    counted = drawn.select("text", "lang").mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g"))).where(F.col("r") <= GRAMS_PER_LANGUAGE)
    seen = top.toPandas()
    share = seen["n"] / seen.groupby("lang")["n"].transform("sum")
    seen = seen.assign(share=share)
    seen = seen.assign(most=seen.groupby("g")["share"].transform("max"))
    seen = seen[seen["share"] >= 0.25 * seen["most"]]
    names = sorted(sizes, key=lambda x: (-sizes[x], x))
    return Profiles.build({x: np.sort(seen.loc[seen["lang"] == x, "g"].to_numpy(np.uint64)) for x in names})


def identified(docs: DataFrame, profiles: Profiles, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., lang_pred, score) of each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)
    kept = docs.select(*keep, "text")

    def run(batches):
        for batch in batches:
            said = [held.value.judge(t) for t in strings(batch.column("text"))]
            cols = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())],
                [*keep, "lang_pred", "score"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in keep)
    return kept.mapInArrow(run, f"{fields}{', ' if fields else ''}lang_pred string, score double")


def with_language(docs: DataFrame, profiles: Profiles, name: str) -> DataFrame:
    """docs with a struct column ``name`` of (lang_pred, score); all other columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judge(text: pa.Array) -> pa.Array:
        said = [held.value.judge(t) for t in strings(text)]
        return pa.StructArray.from_arrays(
            [pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], ["lang_pred", "score"]
        )

    return docs.withColumn(name, judge.asNondeterministic()(docs["text"]))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold_of(F.col("doc_id"), 3) != 1)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = fit(training_rows(docs))
    out = identified(docs, profiles, keep=("doc_id",))
    return out.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
