"""Odd inputs, skew and growth: what the plain tests of each operator leave out."""

import math
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import class_lm, common, decontaminate, language, license_scan, mixing, near_dup, quality, toxicity, url_filter, warc
from tests.llm.corpus import EN, documents, frame, sentence, tables
from tests.llm.test_operators import LABELS, brute_components, fold

BROKEN = bytearray(b"caf\xe9 \xff\xfe the end of it all and more \x80 words here to read")


def broken(spark):
    """Rows whose text is not valid UTF-8."""
    return spark.createDataFrame([(1, BROKEN), (2, bytearray(b"plain the and of to in"))], "doc_id long, raw binary").select(
        "doc_id", F.col("raw").cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("toxic"), F.lit(1).alias("quality")
    )


def test_texts_that_are_not_utf8(spark, tmp_path):
    df = broken(spark)
    labels = df.select("doc_id", "quality", "toxic", "text")
    sf = tables(spark, tmp_path, documents=df, labels=labels, benchmark=spark.createDataFrame([(1, "plain the and of to in")], "item_id long, text string"))
    for f in (language.op1_language_id, near_dup.op3_near_dup, quality.op4_quality_rules, decontaminate.op5_decontaminate, toxicity.op7_toxicity, mixing.op8_mixing, class_lm.op9_class_lm, license_scan.op10_license_scan):
        assert sorted(r.doc_id for r in f(spark, sf).collect()) == [1, 2]
    assert {r.doc_id: r.n_hit for r in decontaminate.op5_decontaminate(spark, sf).collect()} == {1: 0, 2: 6}
    pages = df.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    assert warc.records(pages).count() == 6 and url_filter.filtered_urls(pages.select("page_id", "url"), keep=("page_id",)).count() == 2
    assert corpus_pipeline.run(spark, sf).count() >= 0


# -- language ID
def test_windows_of_a_long_text_give_the_grams_of_the_whole(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab c\n  é") for _ in range(n)) for n in range(60)] + ["a" + " " * 30 + "b", " " * 25, "ab", "a  b"]
    whole = [np.concatenate([np.empty(0, np.uint64), *language.grams(t)]).tolist() for t in texts]
    for window in (1, 2, 3, 5, 8):
        monkeypatch.setattr(language, "WINDOW", window)
        assert [np.concatenate([np.empty(0, np.uint64), *language.grams(t)]).tolist() for t in texts] == whole


# -- near duplicates
def rows_that_stand(rows, width):
    """By brute force: of each row whether its text stands for a group; one of those with equal id and set."""
    component = brute_components(rows, width, 80)
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        size = min(width, len(w))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if w else None)
    # where several rows have the group's smallest id, one of their sets stands: any of them, but one
    stands = [r[0] is None or r[0] == c[2] for r, c in zip(rows, component)]
    return stands, sets, [c[2] for c in component]


@pytest.mark.parametrize("parts", [2, 8])
def test_one_id_with_several_texts_through_the_stage(spark, parts):
    rng = random.Random(parts)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(40))
    base = [text() for _ in range(30)]
    rows = [(5, "A unique " + base[0]), (5, base[1] + " end"), (3, base[1]), (7, base[2]), (7, "E unique " + base[3]), (None, base[4]), (None, base[4]), (8, ""), (8, None), (9, "one"), (9, "One")]
    rows += [(20 + i, base[5 + i % 12] + (" more" if i % 3 else "")) for i in range(60)] + [(20 + i, base[18 + i % 10]) for i in range(0, 60, 4)]
    docs = spark.createDataFrame([(i, t, "en", "s", n, 0.0, "c", "c") for n, (i, t) in enumerate(rows)], frame(spark, []).schema).repartition(parts)
    got = [(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    stands, sets, component = rows_that_stand(rows, 5)
    assert len({n for *_, n in got}) == len(got) and all((i, t) == rows[n] for i, t, n in got)
    assert all(stands[n] for *_, n in got)
    kept = {n for *_, n in got}
    for n, (i, _) in enumerate(rows):
        if i is None:
            assert n in kept
        elif stands[n]:
            alike = [m for m in range(len(rows)) if rows[m][0] == i and (sets[m] == sets[n] if sets[n] is None else component[m] == i and sets[m] is not None and linked(rows, sets, m, n))]
            assert sum(m in kept for m in alike) == 1, (n, rows[n])
    again = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(3), "").collect()]
    assert sorted(map(str, again)) == sorted(str((i, t)) for i, t, _ in got)


def linked(rows, sets, a, b):
    """Do two rows lie in one group?"""
    reached, new = {a}, {a}
    while new:
        new = {m for m in range(len(rows)) if m not in reached and sets[m] and any(100 * len(sets[m] & sets[x]) >= 80 * len(sets[m] | sets[x]) for x in new)}
        reached |= new
    return b in reached


def test_prefix_filter_loses_no_pair():
    rng = np.random.default_rng(4)
    for _ in range(300):
        size = int(rng.integers(2, 120))
        a = rng.choice(4000, size, replace=False)
        b = np.unique(np.concatenate([rng.choice(a, max(1, int(size * rng.uniform(0.7, 1))), replace=False), rng.integers(4000, 8000, int(rng.integers(0, size // 3 + 1)))]))
        x, y = sorted((np.sort(a), np.sort(b)), key=len, reverse=True)  # any one order of shingles will do
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            long, short = near_dup.prefix_lengths(len(x), 80)[0], near_dup.prefix_lengths(len(y), 80)[1]
            first = np.intersect1d(x[:long], y[:short])
            assert len(first)
            i, j = np.searchsorted(x, first[0]), np.searchsorted(y, first[0])
            assert 180 * min(len(x) - i, len(y) - j) >= 80 * (len(x) + len(y))


def template(rng, n, share):
    """Texts that have a template in common with each other, and else words of their own."""
    base = [f"t{k}" for k in range(60)]
    return [" ".join([*base, *(f"o{i}x{k}" for k in range(int(60 * (1 - share) / share)))]) for i in range(n)]


def test_members_of_a_template_cost_no_pairs(spark):
    rng = random.Random(1)
    texts = template(rng, 1500, 0.62) + [template(rng, 1500, 0.62)[7] + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, 2, 0.8).collect()}
    assert got[1500] == 7 and sum(i != c for i, c in got.items()) == 1


# -- decontamination
def test_long_items_and_large_vocabularies(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 40)
    rng = random.Random(6)
    words = [f"w{rng.randrange(100_000)}" for _ in range(400)]
    items = spark.createDataFrame([("long", " ".join(words)), ("other", " ".join(words[100:130])), (None, "a b c")], "item_id string, text string")
    texts = [" ".join(words[k : k + 10]) for k in range(391)] + [" ".join(words[k : k + 9]) for k in range(0, 391, 30)] + ["x a b c", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.f for r in decontaminate.with_hits(docs, items, "f").collect()}
    for k, t in enumerate(texts):
        want = ["long"] * (k < 391) + ["other"] * (100 <= k <= 120)
        assert got[k]["items"] == want and bool(got[k]["spans"]) == (k < 391 or t == "x a b c")
    many = decontaminate.Index.build([(None, " ".join(f"v{k}" for k in range(2_200_000)).encode())], 3)
    numbers = many.numbers(np.arange(2_200_000), 3)
    assert len(np.unique(numbers)) == 2_200_000 - 2 and many.numbers(np.array([5, 7, 9]), 3).tolist() == [-1]


def test_a_window_of_many_items_is_quick():
    began = time.time()
    index = decontaminate.Index.build([(str(k), b"a b c d e f g h i j") for k in range(20_000)], 10)
    assert len(index.owners) == 1 and len(index.owners[0]) == 20_000 and time.time() - began < 5


# -- WARC
class Extractor(HTMLParser):
    """Title, links and shown text by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.hidden, self.links, self.title, self.text, self.at = 0, [], [], [], None

    def handle_starttag(self, tag, attrs):
        self.at = tag
        self.hidden += tag in ("script", "style", "noscript", "template", "head")
        self.links += [v for k, v in attrs if tag == "a" and k == "href"]

    def handle_endtag(self, tag):
        self.at = None
        self.hidden -= tag in ("script", "style", "noscript", "template", "head")

    def handle_data(self, data):
        if self.at == "title":
            self.title.append(data)
        elif not self.hidden:
            self.text.append(data)


def test_records_against_another_extractor(spark):
    rng = random.Random(4)

    def page(n):
        body = "".join(rng.choice([f"<p>{sentence(EN, 5, rng)} &amp; more</p>", f"<a href='/x{rng.random()}'>go on</a> ", "<script>if (a < b) { x() }</script>", "<!-- note -->", "<b>bold</b> ", "<style>p {}</style>", "<br>"]) for _ in range(n))
        return f"<html lang=en><head><title>Page {n} &lt;x&gt;</title></head><body>{body}</body></html>"

    pages = [(n, f"http://h/{n}", page(n)) for n in range(40)]
    got = {(r.page_id, r.kind): r for r in warc.records(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == 120
    for n, url, html in pages:
        want = Extractor()
        want.feed(html)
        want.close()
        meta, said = got[n, "metadata"], got[n, "conversion"]
        fields = [x.split(": ", 1) for x in meta.content.split("\r\n") if x]
        assert [v for k, v in fields if k == "title"] == ["".join(want.title)] and [v for k, v in fields if k == "outlink"] == want.links and ["language", "en"] in fields
        assert "".join(said.content.split()) == "".join("".join(want.text).split())
        source = got[n, "response"]
        assert meta.refers_to == said.refers_to == source.record_id and meta.target_uri == url and f"WARC-Refers-To: {source.record_id}\r\n" in said.headers
        assert said.payload_digest == warc.digest(said.content.encode()) and f"WARC-Source-Payload-Digest: {source.payload_digest}" in said.headers
        assert source.payload_digest == warc.digest(html.encode())


@pytest.mark.parametrize("part", ["<script>", "<!--", "<script", "<a href='", '<a href="x', "<a ", "<title>", "<html ", "<p", "<", "&", " \n", "</title ", "<style><head><!--<script", "<a href=x <title>"])
def test_pages_with_unclosed_parts_take_linear_time(part):
    began = time.time()
    record = warc.derived(warc.response(1, "u", part * 100_000))
    assert len(record) == 2 and time.time() - began < 10
    warc.derived(warc.response(1, "u", part * 100_000 + ">"))
    assert time.time() - began < 20


def test_hidden_parts():
    assert warc.plain_text("a<script>x</script>b<!-- c -->d<style >y</style\n>e") == "a b d e"
    assert warc.plain_text("a<script>x") == "ax" and warc.plain_text("a<!-- b") == "a<!-- b" and warc.plain_text("<script <b>x</script>y") == "y"
    assert warc.links_of('<a href="x>y">1</a><a class=a href=\'z\'><a href=q><abbr href=no><a>') == ["x>y", "z", "q"]


# -- toxicity
def test_model_against_plain_ftrl(spark):
    rng = random.Random(3)
    rows = [(i, sentence(EN, 12, rng) + (" vile slur" if i % 5 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame([*rows, (7, "x a second text of one id"), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0), "") for i in range(200)] + [(3, 1, None, ""), (999, 1, 1, "")], LABELS)
    model = toxicity.fit(docs, labels)
    order = {r.doc_id: r.o for r in spark.range(200).select(F.col("id").alias("doc_id"), F.xxhash64("id", F.lit(7)).alias("o")).collect()}
    texts = {}
    for i, t in [*rows, (7, "x a second text of one id")]:
        f = sorted(set(toxicity.features(t.encode()).tolist()))
        texts[i] = min(texts.get(i, f), f)
    z, n, bias = {}, {}, toxicity.DIMENSIONS

    def weight(k):
        zk, l1 = z.get(k, 0.0), 0.0 if k == bias else toxicity.L1
        return 0.0 if abs(zk) <= l1 else -(zk - math.copysign(l1, zk)) / ((toxicity.BETA + math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for i in sorted(texts, key=lambda i: (order[i], i)):
            f = [*texts[i], bias]
            w = {k: weight(k) for k in f}
            g = 1 / (1 + math.exp(-sum(w.values()))) - (i % 5 == 0)
            for k in f:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * w[k]
                n[k] = old + g * g
    assert abs(model.bias - weight(bias)) < 1e-6 and np.any(model.weights)
    assert all(abs(model.weights[k] - weight(k)) < 1e-6 for k in z if k != bias) and {*np.flatnonzero(model.weights).tolist()} <= set(z)


def test_training_rows_are_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * 200) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2, "") for i in range(400)], LABELS)
    assert np.count_nonzero(toxicity.fit(docs, labels, sample_bytes=1).weights) == 0


# -- mixing
def test_equal_rows_come_near_their_target(spark):
    rows = [(1, "a b", "x")] * 1000 + [(i, "c d e", "y") for i in range(3000)] + [(2, "f g", "z"), (2, "f g", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for parts in (1, 7):
        got = mixing.planned(df.repartition(parts)).collect()
        assert len(got) == len(rows)
        x = [r for r in got if r.doc_id == 1 and r.size == 2 and r.source_size == 2000]
        assert len(x) == 1000 and abs(sum(r.taken for r in x) - x[0].target) <= 2 and {r.taken % 2 for r in x} == {0}
        assert all(r.taken <= 3 * r.size for r in got)
    assert mixing.mixed(df).count() == sum(r.copies for r in got)


# -- licenses
def plainly_kept(found):
    kept = []
    for d in found:
        if not any(a <= d[0] and d[1] <= b for a, b in kept):
            kept.append(d)
    return kept


def test_suppression_against_all_pairs():
    rng = random.Random(5)
    for _ in range(200):
        found = [(a := rng.randrange(60), a + rng.randint(1, 25)) for _ in range(40)]
        outer, got = license_scan.Kept(), []
        for a, b in found:
            if not outer.covers(a, b):
                got.append((a, b))
                outer.add(a, b)
        assert got == plainly_kept(found)


@pytest.mark.parametrize(
    "text, has",
    [
        ("GPLv3", "gpl-3"), ("LGPLv2.1+", "lgpl-2.1"), ("MPLv2", "mpl-2.0"), ("AGPLv3 only", "agpl-3-only"), ("the Beer-Ware License", "beerware"), ("mpl 2.0", "mpl-2.0"),
        ("Redistribution and use in source and binary forms, with or without modification", "bsd"), ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause"),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "gpl-2-or-later"),
        ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS", "apache-2.0"),
    ],
)
def test_license_spellings(text, has):
    assert has in license_scan.Scanner(license_scan.signatures()).scan(text.encode())[5].split(",")


def test_labels_against_rules_without_gate_or_sweep():
    """Every rule on every text, and each detection against all that are taken."""
    rng, rules = random.Random(9), license_scan.signatures()
    scanner = license_scan.Scanner(rules)
    parts = ["the MIT License", "Apache License, Version 2.0", "GNU GPL v3 or later", "bsd", "3-clause BSD license", "creative commons attribution 4.0", "all rights reserved", "permission is hereby granted", "GNU General Public License version 2", "free of charge to any person obtaining a copy", "zlib license", "word", "of the", "MPLv2"]
    for _ in range(60):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))).encode()
        joined = b" " + b" ".join(common.folded_words(text)) + b" "
        found = sorted(((r, m.start(), m.end()) for r in rules for m in re.finditer(r.pattern, joined)), key=lambda d: (-d[0].priority, d[1] - d[2], d[1], d[0].label))
        kept = []
        for d in found:
            if not any(a <= d[1] and d[2] <= b for _, a, b in kept):
                kept.append(d)
        got = scanner.scan(text)
        assert {r.label for r, _, _ in kept} | set(filter(None, got[4].split(","))) == set(filter(None, got[5].split(",")))
        assert got[6] == max([r.confidence for r, _, _ in kept], default=0.6 if got[4] else 0.0)


def test_long_license_texts_take_linear_time():
    scanner, began = license_scan.Scanner(license_scan.signatures()), time.time()
    got = scanner.scan(b"mit license apache license gpl v3 all rights reserved " * 20_000)
    assert got[0] == 180_000 and got[1] == 40_000 and time.time() - began < 20


# -- quality
def test_verdicts_against_the_rules_by_hand(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, sentence(EN, 40, rng) if i % 3 else " ".join(rng.choice(["##", "BUY!!", "$$$", "win"]) for _ in range(40)) + sentence(EN, 12, rng), "en", "s", 1, 0.0, "c", "c") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "") for i in range(400)], LABELS)
    sf = tables(spark, tmp_path, documents=frame(spark, [*rows, rows[5], (5, "tiny", *rows[5][2:])]), labels=labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality.fit(quality.measured(docs.select("doc_id", "text"), keep=("doc_id",)), quality.drawn_labels(labels))
    assert rules and quality.fit(quality.measured(docs.repartition(5).select("doc_id", "text"), keep=("doc_id",)), quality.drawn_labels(labels)) == rules
    part = lambda a, b: a / b if b else 0.0

    def kept(text):
        m = dict(zip(quality.MEASURES, quality.measures(text.encode())))
        x = {
            "words": m["n_words"], "mean_word": part(m["word_chars"], m["n_words"]), "symbol_share": part(m["n_symbols"], m["n_words"]), "dup_line_share": part(m["n_dup_lines"], m["n_lines"]), "repeat_share": part(m["n_repeat_words"], m["n_words"]),
            "upper_share": part(m["n_upper"], m["word_chars"]), "digit_share": part(m["n_digits"], m["word_chars"]), "mark_share": part(m["n_marks"], m["n_words"]), "distinct_share": part(m["n_distinct"], m["n_words"]), "line_words": part(m["n_words"], m["n_lines"]),
        }
        if m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]:
            return False
        return not any(all(x[s] >= t if up else x[s] <= t for s, up, t in r.conditions) for r in rules)

    got = Counter((r.doc_id, r.kept) for r in quality.op4_quality_rules(spark, sf).collect())
    assert got == Counter((r.doc_id, kept(r.text)) for r in docs.collect()) and len({k for _, k in got}) == 2


def test_labels_of_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([(f"d{i}", "word " * 30) for i in range(30)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(30)], "doc_id string, quality int")
    assert isinstance(quality.fit(quality.measured(docs, keep=("doc_id",)), quality.drawn_labels(labels)), list)


def test_sieve_refuses_no_value(spark):
    ids = spark.createDataFrame([(i,) for i in range(0, 5000, 5)] + [(None,)], "id long")
    passes = common.sieve(ids, "id")
    got = {r.id for r in spark.range(5000).where(passes(F.col("id"))).collect()}
    assert set(range(0, 5000, 5)) <= got and len(got) < 1600
    assert common.sieve(ids.limit(0), "id")(F.col("id")) is not None and spark.range(9).where(common.sieve(ids.where("id < 0"), "id")(F.col("id"))).count() == 0
    assert fold(None, 3) == 0


# -- language model
def test_class_lm_keeps_on_disk_what_its_scores_read(spark, tmp_path):
    root = Path(common.shared_dir(spark).removeprefix("file://")) / spark.sparkContext.applicationId
    there = lambda: set(root.iterdir()) if root.exists() else set()
    before, rows = there(), documents(60)
    got = class_lm.op9_class_lm(spark, tables(spark, tmp_path, documents=frame(spark, rows)))
    left = {p.name.rsplit("-", 1)[0]: p for p in there() - before}
    assert "parts" in left and not {"hashed", "passed", "counts"} & set(left)
    files = list(left["parts"].glob("*.parquet"))
    assert files and all(parquet.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD" for f in files)
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r[0]) for r in rows)


def test_shuffles_of_finished_frames_leave_the_disk(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    names = lambda: set(re.findall(r"shuffle_\d+_", disk.getAllFiles().mkString(" ")))
    before = names()
    assert spark.range(1000).repartition(3, "id").groupBy(F.col("id") % 7).count().count() == 7
    made = names() - before
    assert made and spark.sparkContext.parallelize([1], 1).count() == 1  # Spark may hold the last job's frame
    common.swept(spark)
    until = time.time() + 30
    while names() & made and time.time() < until:
        time.sleep(0.1)
    assert not names() & made
