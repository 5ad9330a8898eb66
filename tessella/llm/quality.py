"""Quality rules: base measures and a learned decision list.

Sequential covering grows threshold conjunctions on two thirds of the labelled
statistics, prunes each on the other third, and keeps those that are precise.
The list becomes one ordered Spark conditional expression; a text that no rule
rejects is kept.

Defined results: a null or wordless text has measures of 0, fails the base
rules and is not kept. Texts are read whole at any length. Null labels and labels
of unknown documents teach nothing; of rows that repeat an id the one with the
smallest statistics teaches, and the worst of its labels counts. Of conditions
that gain equally the first one grows a rule: statistics in their order, then
lower cuts. Without labels the list is empty; an empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import plain_words, table, utf8, written

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct"]
REPEAT_WINDOW = 5
#: Labelled rows that the list is learned from, at most, as an expectation of a hashed draw.
SAMPLE = 20_000
#: What a rule must reach on the rows that grow and prune it, its own wrong rejections counted.
PRECISION = 0.97
MAX_RULES, MAX_CONDITIONS, CUTS, LEAST_COVERED = 16, 3, 24, 8

_WS = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
_SYMBOLS = list(b"#*$%&|<>")
_MARKS = list(b"!?.,;:")


def measures(text: bytes | None) -> tuple[int, ...]:
    """The values of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = plain_words(text)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(len(text) - seen[0x80:0xC0].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    vocabulary: dict[bytes, int] = {}
    ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int64)
    return (
        len(words),
        chars - int(seen[_WS].sum()),
        int(seen[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        int(seen[0x41:0x5B].sum()),
        int(seen[0x30:0x3A].sum()),
        int(seen[_MARKS].sum()),
        len(vocabulary),
    )


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows that occur twice or more; windows are compared exactly, by ranks."""
    n = len(ids) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    base, rank = int(ids.max()) + 1, ids
    for k in range(1, REPEAT_WINDOW):
        if int(rank.max()) >= 2**62 // base:
            rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        rank = rank[:-1] * base + ids[k:]
    _, rank, times = np.unique(rank, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[rank] > 1)
    if not len(twice):
        return 0
    edge = np.bincount(twice, minlength=len(ids) + 1) - np.bincount(twice + REPEAT_WINDOW, minlength=len(ids) + 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measured(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., MEASURES...) of each row, whole texts read."""
    rows = docs.select(*keep, "text")

    def run(batches):
        for batch in batches:
            got = np.array([measures(t) for t in utf8(batch.column("text"))], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array(got[:, k]) for k in range(len(MEASURES)))], [*keep, *MEASURES]
            )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in keep)
    return rows.mapInArrow(run, fields + ", ".join(f"{m} long" for m in MEASURES))


def with_measures(docs: DataFrame, name: str) -> DataFrame:
    """docs with a struct column ``name`` of MEASURES; all other columns as they are."""

    @F.arrow_udf(f"struct<{','.join(f'{m}:bigint' for m in MEASURES)}>")
    def run(text: pa.Array) -> pa.Array:
        got = np.array([measures(t) for t in utf8(text)], dtype=np.int64).reshape(-1, len(MEASURES))
        return pa.StructArray.from_arrays([pa.array(got[:, k]) for k in range(len(MEASURES))], MEASURES)

    return docs.withColumn(name, run.asNondeterministic()(docs["text"]))


def base_failed(at: str = "") -> Column:
    c = lambda m: F.col(at + m)
    return (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))


def statistics(at: str = "") -> dict[str, Column]:
    """What rules set thresholds on, from the measures; shares are of words, characters or lines."""
    c = lambda m: F.col(at + m).cast("double")
    part = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))
    return {
        "words": c("n_words"),
        "mean_word": part(c("word_chars"), c("n_words")),
        "symbol_share": part(c("n_symbols"), c("n_words")),
        "dup_line_share": part(c("n_dup_lines"), c("n_lines")),
        "repeat_share": part(c("n_repeat_words"), c("n_words")),
        "upper_share": part(c("n_upper"), c("word_chars")),
        "digit_share": part(c("n_digits"), c("word_chars")),
        "mark_share": part(c("n_marks"), c("n_words")),
        "distinct_share": part(c("n_distinct"), c("n_words")),
        "line_words": part(c("n_words"), c("n_lines")),
    }


@dataclass(frozen=True)
class Rule:
    """Rejects where every (statistic, at_least?, threshold) holds."""

    conditions: tuple[tuple[str, bool, float], ...]
    rejected: int
    wrong: int

    def __str__(self) -> str:
        return " and ".join(f"{s} {'>=' if up else '<='} {t:g}" for s, up, t in self.conditions)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, grow: np.ndarray) -> list[Rule]:
    """Ordered rules for the bad rows. grow: rows that grow rules; the others prune them."""
    left, rules = np.ones(len(bad), dtype=bool), []
    cuts = {s: np.unique(np.quantile(v, np.linspace(0.005, 0.995, CUTS))) if len(v) else [] for s, v in x.items()}
    for s, v in x.items():
        if bad.any():
            cuts[s] = np.unique(np.concatenate([cuts[s], np.quantile(v[bad], np.linspace(0.02, 0.98, CUTS))]))
    holds = {(s, up, float(t)): (x[s] >= t if up else x[s] <= t) for s in x for t in cuts[s] for up in (True, False)}
    while len(rules) < MAX_RULES and (bad & left & grow).any():
        conditions, now = [], left & grow
        while len(conditions) < MAX_CONDITIONS and (now & ~bad).any():
            p0, n0 = int((now & bad).sum()), int((now & ~bad).sum())
            before, best = np.log2(p0 / (p0 + n0)) if p0 else -99, (0.0, None)
            for key, h in holds.items():
                p = int((now & bad & h).sum())
                if p >= LEAST_COVERED:
                    n = int((now & ~bad & h).sum())
                    if (gain := p * (np.log2(p / (p + n)) - before)) > best[0] + 1e-9:
                        best = (gain, key)
            if best[1] is None:
                break
            conditions.append(best[1])
            now = now & holds[best[1]]
        if not conditions:
            break
        prune, value = left & ~grow, []
        for k in range(1, len(conditions) + 1):
            h = np.logical_and.reduce([holds[c] for c in conditions[:k]])
            p, n = int((prune & bad & h).sum()), int((prune & ~bad & h).sum())
            value.append(((p - n) / (p + n) if p + n else -1.0, -k))
        conditions = conditions[: -max(value)[1]]
        h = np.logical_and.reduce([holds[c] for c in conditions]) & left
        p, n = int((h & bad).sum()), int((h & ~bad).sum())
        if p < LEAST_COVERED or p < PRECISION * (p + n):
            break
        rules.append(Rule(tuple(conditions), p + n, n))
        left &= ~h
    return rules


def decision(rules: list[Rule], at: str = "") -> Column:
    """The list as one conditional expression: true where the text is kept."""
    stats, out = statistics(at), F
    for r in rules:
        held = F.lit(True)
        for s, up, t in r.conditions:
            held = held & ((stats[s] >= t) if up else (stats[s] <= t))
        out = out.when(held, F.lit(False))
    return F.lit(True) if out is F else out.otherwise(F.lit(True))


def drawn_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality) of about ``sample`` labelled documents at most, by a hash of the id; the worst label counts."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rate = min(1.0, sample / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rate * (1 << 30)))


def fit(measures_: DataFrame, drawn: DataFrame) -> list[Rule]:
    """Rules from (doc_id, MEASURES...) and the drawn labels; base failures teach nothing."""
    names = list(statistics())
    once = measures_.select("doc_id", *(c.alias(s) for s, c in statistics().items()), base_failed().alias("failed"))
    # the draw is small by its parameter, so it may be broadcast; an id that repeats is one row of the draw
    met = once.join(F.broadcast(drawn), "doc_id").where(~F.col("failed")).groupBy("doc_id", "quality").agg(F.min(F.struct(*names)).alias("x"))
    rows = met.select("quality", "x.*", F.xxhash64("doc_id", F.lit(5)).alias("o"), F.col("doc_id").cast("string").alias("i")).toPandas().sort_values(["o", "i"])
    return learn({s: rows[s].to_numpy() for s in names}, rows["quality"].to_numpy() == 0, rows["o"].to_numpy(np.int64) % 3 != 0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = written(measured(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",)), "measures")
    rules = fit(got, drawn_labels(table(spark, sf_dir, "labels").select("doc_id", "quality")))
    failed = base_failed()
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & decision(rules)).alias("kept"))
