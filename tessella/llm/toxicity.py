"""Toxicity by FTRL-proximal logistic regression.

Features are hashed word n-grams (one and two words) and skip-grams (two words
with one between), present or absent in a text. Each coordinate has its own
learning rate, and L1 leaves few weights, so the model travels as a short list
of (feature, weight).

Defined results: a null or wordless text scores as the bias alone. Texts are read
whole at any length. Documents labelled more than once are toxic if any label says
so, and of rows that repeat an id the one with the smallest list of features
teaches; null labels teach nothing, and without any training row every score is
next to 0. Repeated rows get equal scores; an empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import dropped, fold_of, folded_words, mixed, table, utf8, written

DIMENSIONS = 1 << 20
#: Labelled rows of each class that the model is fitted on, at most, as an expectation of a hashed draw.
SAMPLE_PER_CLASS = 5000
#: Bytes of text of the training rows of each class, at most, as an expectation of the same draw.
SAMPLE_BYTES = 64_000_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 10.0, 1.0, 6
THRESHOLD = 0.3
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: bytes | None) -> np.ndarray:
    """Hashed features with repeats."""
    words = folded_words(text) if text else []
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    parts = [h, h[:-1] * _A + h[1:], h[:-2] * _B + h[2:]]
    return (mixed(np.concatenate(parts)) & np.uint64(DIMENSIONS - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: bytes | None) -> float:
        f = features(text)
        f = np.unique(f[self.weights[f] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.weights[f].sum() + self.bias, -30, 30))))


class Ftrl:
    """FTRL-proximal state; the last coordinate is the bias, which L1 spares."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == DIMENSIONS, 0.0, L1)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int, importance: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = importance * (p - label)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic).

    The draw by a hash of the id bounds rows and bytes of the training rows at
    any corpus size; classes drawn at different rates are weighed back to their
    shares. The updates are sequential: each epoch one task reads this bounded
    table row by row, in hash order, and hands the state on.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {int(r["toxic"]): r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model(np.zeros(DIMENSIONS), -30.0)
    mean = docs.agg(F.avg(F.octet_length("text")).alias("b")).first()["b"] or 1.0
    rates = {c: min(1.0, sample_per_class / n, sample_bytes / (mean * n)) for c, n in sizes.items()}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limit = F.create_map(*[F.lit(x) for c, r in rates.items() for x in (c, int(r * (1 << 30)))])
    # at most about 2 * sample_per_class rows of two numbers: small by the parameter, so it may be broadcast
    drawn = F.broadcast(known.where(share < limit[F.col("toxic")]))
    scale = sum(n * rates[c] for c, n in sizes.items()) / sum(sizes.values())
    importance = {c: scale / r for c, r in rates.items()}

    def hashed(batches):
        for batch in batches:
            rows = [np.unique(features(t)).astype(np.int32) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "toxic", "f"])

    kinds = dict(docs.select("doc_id").dtypes) | dict(labels.select("toxic").dtypes)
    rows = docs.select("doc_id", "text").join(drawn, "doc_id").select("doc_id", "toxic", "text").mapInArrow(hashed, f"doc_id {kinds['doc_id']}, toxic {kinds['toxic']}, f array<int>")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("f").alias("f")).withColumn("o", F.xxhash64("doc_id", F.lit(7)))
    rows = written(rows.repartition(1).sortWithinPartitions("o", "doc_id").select("o", "doc_id", "toxic", "f"), "toxic-rows")
    state = Ftrl()
    for _ in range(EPOCHS):
        state = epoch(rows, state, importance)
    dropped(docs.sparkSession, rows)
    weights = state.weights(np.arange(DIMENSIONS + 1))
    return Model(weights[:DIMENSIONS], float(weights[DIMENSIONS]))


def epoch(rows: DataFrame, state: Ftrl, importance: dict[int, float]) -> Ftrl:
    """The state after one pass over the rows, in their order; what travels are the coordinates met so far."""
    some = np.flatnonzero(state.n)
    held = rows.sparkSession.sparkContext.broadcast((some, state.z[some], state.n[some]))

    def run(batches):
        at, z, n = held.value
        state = Ftrl()
        state.z[at], state.n[at] = z, n
        for batch in batches:
            for y, f in zip(batch.column("toxic").to_pylist(), batch.column("f")):
                state.learn(np.append(f.values.to_numpy().astype(np.int64), DIMENSIONS), int(y > 0), importance[y])
        at = np.flatnonzero(state.n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(state.z[at]), pa.array(state.n[at])], ["at", "z", "n"])

    got = rows.coalesce(1).sortWithinPartitions("o", "doc_id").select("toxic", "f").mapInArrow(run, "at long, z double, n double").toArrow()  # at most DIMENSIONS + 1 rows
    out, at = Ftrl(), got.column("at").to_numpy()
    out.z[at], out.n[at] = got.column("z").to_numpy(), got.column("n").to_numpy()
    held.unpersist()
    return out


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., score) of each row."""
    some = np.flatnonzero(model.weights)
    held = docs.sparkSession.sparkContext.broadcast((some.astype(np.int32), model.weights[some], model.bias))
    rows = docs.select(*keep, "text")

    def run(batches):
        at, w, bias = held.value
        weights = np.zeros(DIMENSIONS)
        weights[at] = w
        own = Model(weights, bias)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([own.score(t) for t in utf8(batch.column("text"))], pa.float64())], [*keep, "score"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in keep)
    return rows.mapInArrow(run, fields + "score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs, labels.where(fold_of(F.col("doc_id"), 4) != 2))
    out = scored(docs, model, keep=("doc_id",))
    return out.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
