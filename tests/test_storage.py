import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella import errors
from tessella.functions.index_key import Part, encode
from tessella.operators.summary import Summary, exclusion, numbered
from tessella.functions import bloom
from tessella.plans.domains import Range
from tessella.sources.catalog import Column, Table, sharded
from tessella.sources.files import Files, State
from tessella.sources.storage import Store


def test_two_writers_of_one_state(spark, tmp_path):
    state = State(Files(spark), str(tmp_path / "s"), keep=5)
    assert state.read({"a": 1}) == (0, {"a": 1})
    assert state.write(0, {"a": 2}) == 1
    with pytest.raises(errors.Busy):
        state.write(0, {"a": 3})
    assert state.read() == (1, {"a": 2})
    for k in range(1, 20):
        state.write(k, {"a": k})
    assert state.read() == (20, {"a": 19}) and len(state.versions()) < 15


def test_a_reader_keeps_its_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), 4)
    table = Table("t", "sharded", "k", "int64", columns=(Column("k", "bigint"), Column("v", "string")))
    first, n = store.load(table, spark.createDataFrame([(i, "a") for i in range(50)], "k long, v string"))
    assert n == 50
    old = store.read(table, snapshot=first)
    store.load(table, spark.createDataFrame([(i, "b") for i in range(50)], "k long, v string"))
    assert old.count() == 50 and store.read(table).count() == 100
    ids = store.read(table).select("_rid").distinct().count()
    assert ids == 100
    report = store.compact(table)
    assert report["compacted"] == [0, 1, 2, 3] and store.read(table).select("_rid").distinct().count() == 100 and old.count() == 50
    with pytest.raises(errors.Busy):
        store.publish(table, first, {})


def test_declarations_are_checked():
    with pytest.raises(errors.InvalidArgument):
        sharded("Upper", "k", "int64")
    with pytest.raises(errors.InvalidArgument):
        sharded("t", "k", "decimal")
    with pytest.raises(errors.Unsupported):
        sharded("t", "k", "int64", generated="block", generated_column="other")
    for bad in (Table("t", "sharded", "k", "int64", columns=(Column("k", "string"),)), Table("t", "sharded", "k", "int64", columns=(Column("v", "bigint"),)), Table("t", "sharded", "k", "int64", columns=(Column("k", "bigint"), Column("u", "bigint")), uniques=(("u",),)), Table("t", "global", columns=(Column("_shard", "int"),))):
        with pytest.raises(errors.InvalidArgument):
            bad.checked()


def test_ordinals_without_a_global_window(spark, tmp_path):
    df = spark.range(1000).selectExpr("1000 - id AS k")
    got = {r.k: r.n for r in numbered(df, "k", path=f"{tmp_path}/a", first=5).collect()}
    assert got == {k: k + 4 for k in range(1, 1001)}
    assert numbered(df.limit(0), "k", path=f"{tmp_path}/b").count() == 0


BOUND = st.none() | st.integers(-20, 20)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-20, 20), max_size=12), BOUND, BOUND, st.booleans(), st.booleans(), st.booleans())
def test_a_summary_never_excludes_a_matching_shard(values, low, high, low_strict, high_strict, descending):
    part = Part("int64", descending)
    keys = sorted(encode([part], [v]) for v in values)
    s = Summary(0, len(keys), bloom.bitmap(keys), keys[0] if keys else None, keys[-1] if keys else None)
    bounds = Range(low, high, low is not None and low_strict, high is not None and high_strict)
    matches = [v for v in values if (low is None or v > low or v == low and not low_strict) and (high is None or v < high or v == high and not high_strict)]
    if matches:
        assert exclusion(s, None, part, bounds) is None
        assert exclusion(s, [encode([part], [matches[0]])], part, None) is None
    if not values:
        assert exclusion(s, None, part, bounds) == "empty_summary"
    both = s.merged(s)
    assert both.least == s.least and (both.words == s.words).all()
