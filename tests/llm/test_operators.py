import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import class_lm, common, components, decontaminate, language, license_scan, mixing, near_dup, quality, toxicity, url_filter, warc
from tests.llm.corpus import SCHEMA, documents, extras, frame, sentence, tables, EN

LABELS = "doc_id long, quality int, toxic int, text string"


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


# -- language ID
def exact_judge(members, text):
    """Sets in place of Bloom filters: what the filters approximate."""
    total, counts = 0, Counter()
    for g in language.grams(text or ""):
        total += len(g)
        for name, own in members.items():
            counts[name] += int(np.isin(g, own).sum())
    if not total or not members:
        return "und"
    return max(members, key=lambda m: (counts[m], -list(members).index(m)))


def test_language_filters_agree_with_sets_and_labels(spark):
    docs = frame(spark)
    profiles = language.fit(docs)
    members = {}
    for name in profiles.languages:
        grams = np.unique(np.concatenate([g for d in documents() if d[2] == name and d[1] for g in language.grams(d[1])]))
        bit = np.uint64(1) << np.uint64(profiles.languages.index(name))
        members[name] = grams[(profiles.lookup(grams)[:, 0] & bit) != 0]
    got = language.identified(docs.withColumn("t", F.col("text")), profiles, keep=("doc_id", "t", "lang")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in r.t or ""))
        if r.t and len(r.t) > 100 and len(set(r.t)) > 5:
            assert r.lang_pred == exact_judge(members, r.t)
            assert r.lang is None or r.lang_pred == r.lang
    assert language.fit(docs.limit(0)).judge("some words") == ("und", 0.0)
    long = "der die das " * 200_000
    assert profiles.judge(long)[0] == "de" and sum(len(g) for g in language.grams(long)) == len(long) - 1


def test_language_query_columns(spark, tmp_path):
    got = language.op1_language_id(spark, tables(spark, tmp_path, documents=frame(spark)))
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) for r in got.collect())
    assert language.op1_language_id(spark, tables(spark, tmp_path / "none", documents=frame(spark, []))).count() == 0


def test_more_than_64_languages_take_more_words():
    members = {f"l{k}": np.arange(k * 50, k * 50 + 50, dtype=np.uint64) for k in range(70)}
    p = language.Profiles.build(members)
    found = p.lookup(members["l69"])
    assert p.masks.shape[1] == 2 and (found[:, 1] >> np.uint64(5) & np.uint64(1)).all()


# -- URL filter
URLS = [
    "http://com/", "https://a.b.com/x", "http://EXAMPLE.com/en/x?q#f", "http://sub.www.example.com/en/", "http://www.example.com/de/", "http://x.net/es/y", "http://net/fr/", "http://x.net/es", "http://notexample.com/en/", "no scheme", "", None,
    "http://example.com", "http://a.org/x.com/en/", "ftp://ads.site.org/x", "http://h.org/a/wp-login.php", "http://h.org/file.exe", "http://h.org/file.exe?x", "http://é.org/ü.exe", "http://a.net/es/\n.exe", "//://x.com/", "http://h.org/" + "a" * 30_000 + ".zip",
]


def glob_fits(glob, text):
    p = "".join({"any": "(?s:.)*", "run": "[^/]*", "one": "[^/]"}.get(k) or re.escape(b.decode("latin-1")) for k, b in url_filter.tokens(glob))
    return re.fullmatch(p, text.encode().decode("latin-1")) is not None


def test_url_rules_against_regular_expressions(spark):
    pages = spark.createDataFrame([(i, u, "<p>", "clash") for i, u in enumerate(URLS)], "page_id long, url string, html string, rule string")
    for r in url_filter.filtered_urls(pages.select("page_id", "url"), keep=("page_id",)).collect():
        url = URLS[r.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(h + p, v) for h, p, v in url_filter.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda f: len(f[0]), default=None)
        own = any(glob_fits(g if g.startswith("*") else "*." + g, f".{host}{path}") for g in url_filter.BLOCKED_GLOBS)
        assert (r.host, r.path, r.rule) == (host, path, best[0] if best else None), url
        assert r.verdict == (best[1] if best else "block" if own else "allow"), url
    assert url_filter.filtered_urls(pages.limit(0), keep=("page_id",)).count() == 0


PLAIN = {
    "block": "foo.xxx foo.xxx?q foo.xxx/ foo.xxx:8080 foo.xxx:8080/a foo.casino foo.casino/a ads.h.org ads.h.org#f ads.h.org/a adserver.h.org tracker.h.org a.tracker.h.org doubleclick.net.org "
    "h.org/wp-login.php h.org/a/wp-login.php h.org/a/wp-login/b h.org/wp-admin/ h.org/wp-admin h.org/a/wp-admin/x h.org/cgi-bin/x h.org/adclick?x h.org/adclick/1 h.org/a/adclick/1 h.org/banner/1 h.org/cart/1 h.org/cart h.org/a/cart "
    "h.org/checkout/ h.org/login/ h.org/login h.org/signup/a h.org/a/b/signup h.org/a.exe h.org/a.zip h.org/a.tar.gz h.org/a.iso h.org/a.apk h.org/a.dmg h.org/porn h.org/porn.html h.org/a/porn/b h.org/viagra h.org/viagra/buy h.org/casino/a/b",
    "allow": "h.org h.org/ h.org/a h.org/cartoon h.org/carts/1 h.org/relogin h.org/logins h.org/exe h.org/a.xxx h.org/a?u=/login/ xxx.org loads.h.org h.org/ads.x/ tracker h.org/bannered/1 h.org/bad-wp-admin/",
}


def test_own_globs_fit_the_plain_cases(spark):
    told = [(verdict, f"http://{u}") for verdict, urls in PLAIN.items() for u in urls.split()]
    got = url_filter.filtered_urls(spark.createDataFrame(told, "said string, url string"), keep=("said", "url")).collect()
    assert [(r.said, r.url) for r in got if r.verdict != r.said] == [] and len(got) == len(told)


def test_automaton_of_many_words_against_regular_expressions():
    rng = random.Random(1)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    automaton = url_filter.GlobAutomaton.build(globs)
    assert automaton.start.shape[0] > 4
    got = automaton.fits([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for k, g in enumerate(globs):
            assert got[i, k] == glob_fits(g, t), (g, t)


# -- near duplicates
def brute_components(rows, width, percent):
    sets = []
    for doc_id, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        size = min(width, len(w))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * union:
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return out


def family(rng, n, words, most):
    base = [rng.choice(words) for _ in range(60)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_all_pairs(spark, width):
    rng = random.Random(width)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [t for _ in range(4) for t in family(rng, 40, vocabulary, 7)] + [t for t in family(rng, 5, vocabulary, 2) for _ in range(4)]
    texts += ["A b", "a B", "one", "", None, " \t", "a b c d"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, "lonely text without an id"), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit("clash")).withColumn("bands", F.lit(1))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dup.near_duplicates(df, width, 0.8).collect())
    want = sorted((str(d), n, str(c), d is not None and d == c) for d, n, c in brute_components(rows, width, 80))
    assert got == want
    assert len({c for _, _, c, _ in got}) < len(rows)


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_is_collision_corrected():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        common_ = rng.integers(0, 1 << 62, 2000).astype(np.uint64)
        k = int(2000 * 2 * share / (1 + share))
        a, b = common_, np.concatenate([common_[:k], rng.integers(0, 1 << 62, 2000 - k).astype(np.uint64)])
        pa, pb = near_dup.packed(near_dup.minima(a)).view(np.uint64), near_dup.packed(near_dup.minima(b)).view(np.uint64)
        x = pa ^ pb
        agree = near_dup.LANES - int(np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum())
        assert abs((agree / near_dup.LANES - 0.25) / 0.75 - share) < 0.2
        assert share < 0.8 or agree >= near_dup.least_agreement(0.8)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (5, 5)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- quality rules
def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    hit = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("text", [None, "", " \n ", "a b c d e a b c d e", "ü # é\nü # é\n\nx", "x " * 300, "a\x0bb c|<d>", "w1 w2 w3 w4 w5 w1 w2 w3 w4 w6 " * 3, "one\none\ntwo \n two"])
def test_measures_against_brute_force(text):
    assert quality.measures(text.encode() if text is not None else None)[:5] == brute_measures(text)


def test_rules_learn_and_spare_clean_rows():
    rng = np.random.default_rng(0)
    n = 3000
    x = {"a": rng.random(n), "b": rng.random(n), "c": rng.random(n)}
    bad = (x["a"] > 0.8) & (x["b"] < 0.5) | (x["c"] > 0.97)
    rules = quality.learn(x, bad, rng.random(n) < 0.67)
    hit = np.zeros(n, bool)
    for r in rules:
        h = np.ones(n, bool)
        for s, up, t in r.conditions:
            h &= x[s] >= t if up else x[s] <= t
        hit |= h
    assert (hit & bad).sum() >= 0.8 * bad.sum() and (hit & ~bad).sum() <= 0.03 * hit.sum()
    assert quality.learn(x, np.zeros(n, bool), np.ones(n, bool)) == []


def test_quality_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, sentence(EN, 40, rng) if i % 4 else " ".join(f"{w}%%%" for w in sentence(EN, 40, rng).split()), "en", "s", 1, 0.1, "c", "c") for i in range(400)]
    rows += extras()
    labels = [(i, int(i % 4 != 0), 0, "clash") for i in range(400)] + [(7, None, None, None), (None, 0, 0, None), (99999, 0, 0, None)]
    sf = tables(spark, tmp_path, documents=frame(spark, rows), labels=spark.createDataFrame(labels, LABELS))
    got = quality.op4_quality_rules(spark, sf).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], r[1])
    for r in got:
        if r.doc_id is not None and r.doc_id < 10_000:
            want = brute_measures(texts[r.doc_id])
            assert tuple(r)[1:6] == want
            failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
            assert r.base_failed == failed and not (failed and r.kept)
            if r.doc_id < 400:
                assert r.kept == (r.doc_id % 4 != 0 and not failed)
    none = tables(spark, tmp_path / "none", documents=frame(spark, rows[:20]), labels=spark.createDataFrame([], LABELS))
    assert all(r.kept != r.base_failed for r in quality.op4_quality_rules(spark, none).collect())


# -- decontamination
def brute_hits(text, items, window=10):
    folded = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = folded(text), set(), set()
    for item, t in items:
        w = folded(t)
        if not w:
            continue
        size = min(window, len(w))
        for i in range(len(w) - size + 1):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [10**6, 60])
def test_decontamination_against_brute_force(spark, tmp_path, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (block_bytes,))
    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 9, 10, 14])))) for i in range(12)] + [(100, None), (101, "  ..."), (None, "null id words here"), (3, "again w1 w2"), (10, "x y")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += ["Before, " + (items[k][1] or "").upper().replace(" ", ", ") + " after" for k in range(12)] + [None, "", "null ID words here!", "x y " * 50]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], "c"), (1, texts[1], "c")], "doc_id long, text string, spans string")
    sf = tables(spark, tmp_path, documents=docs, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = by_id(decontaminate.op5_decontaminate(spark, sf).collect())
    for i, t in enumerate(texts):
        assert tuple(got[i][0])[1:] == brute_hits(t, items), t
    assert len(got[1]) == 2 and tuple(got[None][0])[1:] == tuple(got[0][0])[1:]
    empty = tables(spark, tmp_path / "none", documents=docs, benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert not any(r.contaminated for r in decontaminate.op5_decontaminate(spark, empty).collect())


# -- toxicity
def test_toxicity_learns_words_and_orders(spark, tmp_path):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        words = sentence(EN, 40, rng).split()
        if toxic:
            words[rng.randrange(40)] = rng.choice(["Idiot.", "scum", "MORON,"])
        rows.append((i, " ".join(words), "en", "s", 1, 0.0, "c", "c"))
        labels.append((i, 1, int(toxic), "clash"))
    rows += extras()
    labels += [(3, 1, None, None), (None, 1, 1, None), (77777, 1, 1, None)]
    sf = tables(spark, tmp_path, documents=frame(spark, rows), labels=spark.createDataFrame(labels, LABELS))
    got = toxicity.op7_toxicity(spark, sf).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (fold(r.doc_id, 4) == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame([], LABELS))
    assert model.score(b"anything") < 1e-9 and model.score(None) < 1e-9


def test_ftrl_weights_stay_sparse():
    state = toxicity.Ftrl()
    rng = np.random.default_rng(0)
    for _ in range(400):
        y = int(rng.random() < 0.5)
        state.learn(np.array([*([7] if y else []), *rng.integers(100, 100_000, 20), toxicity.DIMENSIONS]), y, 1.0)
    w = state.weights(np.flatnonzero(state.n))
    assert state.weights(np.array([7]))[0] > 0.5 and (w != 0).sum() < 20


# -- mixing
def brute_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[2] for r in rows if r[2] is not None}) + ([None] if any(r[2] is None for r in rows) else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    own = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in sources}
    total, capped = sum(own.values()), set()
    while True:
        rest, open_ = total - 3 * sum(own[s] for s in capped), [s for s in sources if s not in capped]
        target = {s: weight[s] * rest / sum(weight[x] for x in open_) for s in open_} if open_ else {}
        over = {s for s in open_ if target[s] > 3 * own[s]}
        if not over:
            return {s: (own[s], target.get(s, 3.0 * own[s])) for s in sources}
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_mixing_against_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    rows = [(i if i % 50 else None, "w " * rng.randint(0, 40) if i % 11 else None, rng.choice(["a", "b", "c", "é", None, "", "zz"]) if i < 150 else "big") for i in range(600)]
    rows += [(1, None, "empty"), (1, "  ", "empty"), (2, "one", "tiny"), (2, "one", "tiny")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, copies string")
    goal = brute_mix(rows)
    got = mixing.planned(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.source_size, round(r.target, 6)) for r in mixing.targets(df.select("source", mixing.word_count().alias("size"))).collect()) == sorted((a, round(b, 6)) for a, b in goal.values())
    for r in got:
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken in (math.floor(rate) * r.size, math.ceil(rate) * r.size) and r.taken <= 3 * r.size
    emitted = mixing.mixed(df)
    assert emitted.count() == sum(r.copies for r in got) and emitted.columns == [*df.columns, "copy"]
    again = sorted(map(str, mixing.mixed(df.repartition(3)).collect()))
    assert again == sorted(map(str, emitted.collect()))


def test_mixing_comes_near_its_targets(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"))
    for r in mixing.planned(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.05 * r.target
    assert mixing.planned(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


# -- language model
def test_class_lm_counts_and_base_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(class_lm, "HEAD", 40)
    monkeypatch.setattr(class_lm, "TOKENS", 50)
    rows = documents()
    sf = tables(spark, tmp_path, documents=frame(spark, rows))
    got = class_lm.op9_class_lm(spark, sf).collect()
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), "</s>"]
    counts = Counter(w for r in rows if fold(r[0], 5) != 1 for w in split(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), fold(r[0], 5) == 1, len(split(r[1])), sum(counts[w] > 0 for w in split(r[1])), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(r[1])), 6)) for r in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert class_lm.op9_class_lm(spark, tables(spark, tmp_path / "none", documents=frame(spark, []))).count() == 0


def test_class_lm_beats_its_base_on_structured_text(spark, tmp_path):
    rng = random.Random(3)
    one, two = [f"na{k}" for k in range(60)], [f"ve{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(two if j % 2 else one) for j in range(40)), "en", "s", 1, 0.0, "c", "c") for i in range(400)]
    got = class_lm.op9_class_lm(spark, tables(spark, tmp_path, documents=frame(spark, rows))).where("held_out").collect()
    assert sum(r.score for r in got) > 0.95 * sum(r.base_score for r in got)


def classes_of(model, rare, words):
    """(class of each training word, class of any other word) by the words themselves; the end is the empty word."""
    named = {int(class_lm.hashes(w)[0][0]): w for w in words if w}
    of = {named[int(h)]: int(model.classes[k]) for h, k in zip(model.symbols.keys, model.symbols.order)} | {b"": class_lm.CLASSES}
    of |= {named[r.h]: r.k for r in rare.collect()}
    return of, lambda w: int(model.classes[model.symbols.end + 1 + int(class_lm.hashes(w)[1][0])])


def test_class_lm_score_against_plain_counting(spark, tmp_path, monkeypatch):
    """Classes taken from the model; bigrams, masses, interpolation and every score counted anew in plain Python."""
    monkeypatch.setattr(class_lm, "HEAD", 30)
    rows = documents(60)
    train = [r for r in rows if fold(r[0], 5) != 1]
    split = lambda t: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]
    counts, pairs = Counter(), Counter()
    for r in train:
        counts.update([*split(r[1]), b""])
    model, rare = class_lm.fit(class_lm.hashed(frame(spark, train)))
    of, unseen = classes_of(model, rare, counts)
    assert set(counts) == set(of)
    for r in train:
        words = [b"", *split(r[1]), b""]
        pairs.update((of[a], of[b]) for a, b in zip(words, words[1:]))
    total, classes = sum(pairs.values()), range(class_lm.ALL)
    before, after = Counter(), Counter()
    for (a, b), c in pairs.items():
        before[a] += c
        after[b] += c
    kinds = Counter(a for a, _ in pairs)
    single = {b: (after[b] + 0.5) / (total + 0.5 * class_lm.ALL) for b in classes}
    step = lambda a, b: (pairs[a, b] + kinds[a] * single[b]) / (before[a] + kinds[a]) if before[a] else single[b]
    groups = Counter(int(k) for k in model.classes[model.symbols.end + 1 :])
    mass = {k: sum(c + 0.5 for w, c in counts.items() if of[w] == k) + 0.5 * groups[k] for k in classes}
    got = Counter()
    for r in class_lm.scored(class_lm.hashed(frame(spark, rows), ("doc_id",)), model, rare).collect():
        got[r.doc_id, r.n_tokens, round(r.score, 6)] += 1
    want = Counter()
    for r in rows:
        words = split(r[1])
        k = [of[b""], *(of[w] if w in of else unseen(w) for w in words), of[b""]]
        want[r[0], len(words) + 1, round(sum(math.log10(step(a, b) * (counts[w] + 0.5) / mass[b]) for a, b, w in zip(k, k[1:], [*words, b""])), 6)] += 1
    assert got == want


def test_class_lm_is_a_distribution(spark):
    rows = [(i, " ".join(random.Random(i).choice(["a", "b", "c"]) for _ in range(20)), "en", "s", 1, 0.0, "c", "c") for i in range(50)]
    model, rare = class_lm.fit(class_lm.hashed(frame(spark, rows)))
    assert rare.count() == 0 and np.allclose((10**model.step).sum(axis=1), 1)
    for c in set(model.classes):
        assert np.isclose((10 ** model.emit[model.classes == c]).sum(), 1)


@pytest.mark.parametrize("head", [100_000, 1_200])
def test_class_lm_clusters_every_word(spark, tmp_path, monkeypatch, head):
    """Two kinds of 1,200 words that alternate and end alike: suffixes tell nothing, most words are beyond the OWN first."""
    monkeypatch.setattr(class_lm, "HEAD", head)
    rng = random.Random(5)
    kinds = [[f"{x}{k}same" for k in range(1200)] for x in "pq"]
    rows = [(i, " ".join(rng.choice(kinds[j % 2]) for j in range(i % 2, 80)) + (" " if i % 9 else " never%dseen X X %s" % (i, "y" * 70)), "en", "s", 1, 0.0, "c", "c") for i in range(500)]
    train = [r for r in rows if fold(r[0], 5) != 1]
    split = lambda t: t.lower().encode().split()
    counts = Counter(w for r in train for w in [*split(r[1]), b""])
    df = frame(spark, rows)
    model, rare = class_lm.fit(class_lm.hashed(frame(spark, train)))
    of, unseen = classes_of(model, rare, counts)
    assert set(of) == set(counts) and (rare.count() > 1000) == (head == 1_200)
    alike = Counter((k, w[:1]) for w, k in of.items() if w.endswith(b"same"))
    assert sum(max(alike[k, b"p"], alike[k, b"q"]) for k in set(of.values())) > 0.95 * sum(alike.values())
    assert len(model.told) > 1 and max(model.told) > model.told[0]

    m = np.zeros((class_lm.ALL, class_lm.ALL))
    for r in train:
        chain = [of[w] for w in [b"", *split(r[1]), b""]]
        np.add.at(m, (chain[:-1], chain[1:]), 1)
    assert np.allclose(model.step, np.log10(class_lm.transitions(m)))
    mass = Counter(model.classes[model.symbols.end + 1 :].tolist())
    mass = {k: sum(c + 0.5 for w, c in counts.items() if of[w] == k) + 0.5 * mass[k] for k in set(of.values()) | set(mass)}
    got = {r.doc_id: r for r in class_lm.scored(class_lm.hashed(df, ("doc_id",)), model, rare).collect()}
    for r in rows:
        words = [b"", *split(r[1]), b""]
        k = [of[w] if w in of else unseen(w) for w in words]
        want = sum(model.step[a, b] + math.log10((counts[w] + 0.5) / mass[b]) for a, b, w in zip(k, k[1:], words[1:]))
        assert abs(got[r[0]].score - want) < 1e-6 and got[r[0]].n_known == sum(counts[w] > 0 for w in words[1:])
    told = class_lm.op9_class_lm(spark, tables(spark, tmp_path, documents=df)).where("held_out").collect()
    assert sum(r.score - r.base_score for r in told) > 0.2 * sum(r.n_tokens for r in told)


def test_exchange_separates_what_alternates():
    size = 41
    pairs = np.zeros((size, size), np.int64)
    rng = np.random.default_rng(0)
    for _ in range(20_000):
        a, b = rng.integers(0, 20), rng.integers(20, 40)
        pairs[a, b] += 1
        pairs[b, rng.integers(0, 20)] += 1
    of = class_lm.exchange(pairs, classes=2)
    assert len(set(of[:20])) == 1 and len(set(of[20:40])) == 1 and of[0] != of[20] and of[40] == 2


# -- licenses
@pytest.mark.parametrize(
    "text, base, has",
    [
        (None, (0, 0, None, None, ""), set()), ("", (0, 0, None, None, ""), set()), ("The MIT License. mit, license", (5, 2, 1, 3, "mit"), {"mit"}),
        ("Licensed under the Apache License, Version 2.0", (8, 1, 3, 3, "apache"), {"apache", "apache-2.0"}),
        ("GNU General Public License version 3 or later", (8, 1, 1, 1, "gpl"), {"gpl", "gpl-3-or-later"}),
        ("Creative Commons Attribution-ShareAlike 4.0 International", (7, 0, None, None, ""), {"cc-by-sa-4.0"}), ("mit licenses; smit license", (4, 0, None, None, ""), set()),
        ("GNU Lesser General Public License v2.1", (7, 1, 2, 2, "gpl"), {"gpl", "lgpl-2.1"}), ("BSD 3-Clause License, SPDX-License-Identifier: MIT", (8, 0, None, None, ""), {"bsd-3-clause", "mit"}),
    ],
)
def test_license_scan(text, base, has):
    got = license_scan.Scanner(license_scan.signatures()).scan(text.encode() if text is not None else None)
    assert got[:5] == base and has <= set(filter(None, got[5].split(","))) and 0 <= got[6] <= 1
    assert set(filter(None, base[4].split(","))) <= set(got[5].split(","))


def test_license_base_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    parts = ["mit", "license", "apache", "general", "public", "Foo", "MIT", "License,"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(150)] + [None, "mit license " * 4000]
    sf = tables(spark, tmp_path, documents=spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, labels string"))
    got = {r.doc_id: r for r in license_scan.op10_license_scan(spark, sf).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        at = [(k, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
        starts = [k for k, _ in at]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
    assert len(license_scan.signatures()) > 300


def wording(parsed, rng):
    """A random text that the parsed pattern fits, without what it looks at around itself."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            out += "7" if "CATEGORY_DIGIT" in str(arg) else "x" if "CATEGORY" in str(arg) else chr(rng.choice(arg)[1])
        elif op == "BRANCH":
            out += wording(rng.choice(arg[1]), rng)
        elif op == "SUBPATTERN":
            out += wording(arg[3], rng)
        elif op == "MAX_REPEAT":
            out += "".join(wording(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
    return out


def test_keywords_are_in_all_that_their_patterns_fit():
    rng = random.Random(1)
    for r in license_scan.signatures():
        parsed = re._parser.parse(r.pattern.decode())
        for _ in range(20):
            text = b" " + wording(parsed, rng).encode() + b" "
            assert re.search(r.pattern, text), (r, text)
            assert r.keyword in text, (r, text)
            told, plain = (license_scan.Scanner([x]).detections(text) for x in (r, license_scan.Rule(r.label, b"", r.pattern, r.priority, r.confidence)))
            assert [d[1:] for d in told] == [d[1:] for d in plain] != []
    assert "beerware" in license_scan.Scanner(license_scan.signatures()).scan(b"The Beer-Ware License (Revision 42)")[5]


def test_contained_detections_are_suppressed():
    scanner = license_scan.Scanner(license_scan.signatures())
    kept = scanner.detections(b" under the apache license version 2 0 ")
    assert [r.label for r, _, _ in kept] == ["apache-2.0"]


# -- WARC
PAGES = [
    (1, "http://a.b/c", "<!DOCTYPE html><html lang='DE'><head><title>Ein &amp; Titel</title><style>p{}</style></head><body><script>var x='<p>';</script><p>Hallo &lt;Welt&gt;</p><a href=\"/x\">x</a><a class=q href=y>y</a><!-- no --></body></html>"),
    (2, None, None), (3, "http://a.b/ü", "plain < text & more"), (4, "u\nv", "<p>a</p>" * 5000), (None, "", ""), (1, "http://a.b/c", "<p>again"),
]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, kind string")
    rows = warc.records(pages)
    out = str(tmp_path / "warc")
    warc.write_warc(rows, out)
    got = [r for f in sorted((tmp_path / "warc").glob("part-*")) for r in warc.parsed(f.read_bytes())]
    assert len(got) == 3 * len(PAGES)
    responses = {r.id: r for r in got if r.fields["WARC-Type"] == "response"}
    for r in got:
        assert warc.digest(r.block) == r.fields["WARC-Block-Digest"] and int(r.fields["Content-Length"]) == len(r.block)
        assert warc.parsed(r.serialized())[0] == r
        if r.fields["WARC-Type"] != "response":
            source = responses[r.fields["WARC-Refers-To"]]
            assert r.fields.get("WARC-Target-URI") == source.fields.get("WARC-Target-URI")
            assert warc.derived(source)[r.fields["WARC-Type"] == "conversion"] == r
    first = warc.derived(warc.response(*PAGES[0]))
    assert first[1].block.decode() == "Hallo <Welt>\nxy" and b"title: Ein & Titel\r\nlanguage: de\r\n" in first[0].block and first[0].block.count(b"outlink: ") == 2
    assert first[1].fields["WARC-Source-Payload-Digest"] == warc.response(*PAGES[0]).fields["WARC-Payload-Digest"]
    sf = tables(spark, tmp_path, pages=pages)
    assert warc.op6_warc(spark, sf).count() == 2 * len(PAGES)
    assert warc.op6_warc(spark, tables(spark, tmp_path / "none", pages=pages.limit(0))).count() == 0
    assert json.dumps(sorted(map(str, rows.collect()))) == json.dumps(sorted(map(str, warc.records(pages.repartition(3)).collect())))


def test_folds_and_words():
    assert common.plain_words("a\x0bb c\x1cd".encode()) == [b"a", "b c\x1cd".encode()]
    assert common.folded_words("MIT-Lizenz, Größe 3".encode()) == [b"mit", b"lizenz", "größe".encode(), b"3"]


def test_schema_has_clashing_columns():
    assert {"score", "kept", "k"} <= {c.split()[0] for c in SCHEMA.split(", ")}
