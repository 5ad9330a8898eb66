import random
import sys

import pytest

import corpus_pipeline
from tessella.llm import decontaminate, language, mixing, quality
from tests.llm.corpus import EN, documents, frame, sentence, tables
from tests.llm.test_operators import LABELS, brute_components, brute_hits


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = documents()
    item = sentence(EN, 12, rng)
    rows += [(900 + i, sentence(EN, 30, rng) + " " + item + " " + sentence(EN, 30, rng), "en", "s1", 1, 0.1, "c", "c") for i in range(3)]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0, "x") for i in range(100)], LABELS)
    return tables(spark, tmp_path_factory.mktemp("sf"), documents=frame(spark, rows), benchmark=items, labels=labels)


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema if k < 4 else stage(spark, docs, sf).schema)
        after = sorted(map(str, docs.collect()))
        if k < 4:
            assert docs.columns == columns
        if name == "language_id":
            profiles = language.fit(language.training_rows(spark.createDataFrame(before, docs.schema)))
            want = [r for r in before if (j := profiles.judge(r.text))[0] != "und" and j[1] > 0]
        elif name == "quality_rules":
            frame_ = spark.createDataFrame(before, docs.schema)
            rules = quality.fit(quality.measured(frame_, keep=("doc_id",)), quality.drawn_labels(labels))
            assert rules == []
            want = [r for r in before if (m := quality.measures(r.text.encode()))[0] >= 10 and 100 * m[4] <= 20 * m[0]]
        elif name == "near_duplicates":
            judged = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
            keep, seen = [], set()
            for r, (_, _, component) in zip(before, judged):
                if r.doc_id is None or r.doc_id == component and r.doc_id not in seen:
                    keep.append(r)
                    seen.add(r.doc_id)
            assert len(after) == len(keep) and sorted(str(r.doc_id) for r in docs.collect()) == sorted(str(r.doc_id) for r in keep)
            continue
        elif name == "decontamination":
            want = [r for r in before if not brute_hits(r.text, benchmark)[-1]]
            assert len(want) < len(before)
        else:
            plan = mixing.planned(spark.createDataFrame(before, frame(spark, []).schema))
            assert len(after) == sum(r.copies for r in plan.collect())
            continue
        assert after == sorted(map(str, want)), name


def test_run_equals_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, docs.collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "decontamination", "mixing_sources"]


def test_an_empty_table(spark, tmp_path):
    sf = tables(spark, tmp_path, documents=frame(spark, []), benchmark=spark.createDataFrame([], "item_id long, text string"), labels=spark.createDataFrame([], LABELS))
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent / "tessella"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "tessella.llm" not in f.read_text()
    assert decontaminate and sys.modules["tessella.llm"]


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    text = lambda x: " ".join(f"{x}{k}" for k in range(60))
    a, b, c = text("a"), text("b"), text("c")
    told = [(3, a), (5, a + " end"), (5, b), (5, b), (7, c), (7, c + " end"), (8, c), (9, text("d")), (9, text("e"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.0, "c", "c") for i, t in told], frame(spark, []).schema)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(x for x in got if x[0] != 7) == [(3, a), (5, b), (9, text("d")), (9, text("e"))]
    assert [i for i, _ in got].count(7) == 1
