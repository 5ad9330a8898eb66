"""The training-data pipeline: five stages, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, also extra ones that the input has, whatever
their names.

Defined results: a null or empty text has no letter and leaves at the first
stage. A null lang, source or n_chars is carried along; null sources are a
source of their own in the mix. Rows with a null id stay through the
near-duplicate stage. Rows that repeat an id are judged by their own texts: unlike
texts stay side by side, and of rows with equal id and equal set of shingles the
smallest one stays, by text and then by the other columns. Texts are read whole at
any length; ties are settled as each operator states. Tables without rows give a
result without rows, tables without labels no learned rule, and without benchmark
items nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, language, mixing, near_dup, quality
from tessella.llm.common import dropped, table, written

OWN = "__corpus_stage"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: no text, no letter, or no known n-gram."""
    told = language.with_language(docs, language.fit(language.training_rows(docs)), OWN)
    return told.where((F.col(f"{OWN}.lang_pred") != language.UNDETERMINED) & (F.col(f"{OWN}.score") > 0)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the learned decision list reject."""
    drawn = quality.drawn_labels(table(spark, sf_dir, "labels").select("doc_id", "quality"))
    labelled = docs.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi")
    rules = quality.fit(quality.measured(labelled, keep=("doc_id",)), drawn)
    told = quality.with_measures(docs, OWN)
    return told.where(~quality.base_failed(f"{OWN}.") & quality.decision(rules, f"{OWN}.")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the one with the smallest id.

    Rows without an id cannot stand for a group by name; they all stay. Rows that repeat an id are told apart by
    their sets of shingles, so each is judged by its own text, and only one of those with equal id and set stays.
    """
    return near_dup.one_of_each(docs, width=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    told = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"), OWN)
    return told.where(F.size(f"{OWN}.spans") == 0).select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins documents to their sources' targets; ``copy`` numbers the copies of one."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing_sources", mixing_sources),
]

#: Learned models decide two stages, which SQL cannot express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
