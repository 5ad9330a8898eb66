import re

import duckdb
import pytest

import __spark_entry__ as entry
from tessella.llm.entry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    text = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    rows = lambda cols, x: sorted(tuple(text(r[cols.index(c)]) for c in sorted(cols)) for r in x)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_ten_queries_and_the_pipeline_are_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert len(names) == 11 and set(names) == set(QUERIES)
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    from tessella.llm import language

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    r = language.op1_language_id(spark, sf).where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert r.right > 0.97
