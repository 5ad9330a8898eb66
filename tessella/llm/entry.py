"""Queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import class_lm, decontaminate, language, license_scan, mixing, near_dup, quality, toxicity, url_filter, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_near_dup": near_dup.op3_near_dup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_warc": warc.op6_warc,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_class_lm": class_lm.op9_class_lm,
    "op10_license_scan": license_scan.op10_license_scan,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op2_url_filter": url_filter.ORACLE_SQL,
    "op3_near_dup": near_dup.ORACLE_SQL,
    "op5_decontaminate": decontaminate.ORACLE_SQL,
    "op8_mixing": mixing.ORACLE_SQL,
}
