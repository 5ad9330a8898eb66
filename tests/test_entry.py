import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return db


def rows(columns, got):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[k]) for k in at) for r in got)


@pytest.mark.parametrize("name", sorted(entry.engine.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["o_orderkey", "o_totalprice"]


def test_import_takes_every_row(spark, tmp_path):
    spark.range(1500).selectExpr("CAST(id AS INT) AS n_nationkey", "concat('n', id) AS n_name", "CAST(id % 5 AS INT) AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    got = entry.queries()["sqlite_import"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(i, f"n{i}", i % 5) for i in range(1500)]
