"""A small corpus with nulls, empty and long texts, copies and clashing columns."""

import random

EN = "the of and to in is that for with as was on are this by be from or have an they which one you had not but what all were when we there can said".split()
DE = "der die das und ist nicht von mit dem sich auf für eine auch als nach wie über aber noch einen wird zur bei oder wenn schon können müssen".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, k string"


def sentence(words, n, rng):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "er", "ing", "en"]) for _ in range(n))


def documents(n=120, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words, lang = (EN, "en") if i % 2 else (DE, "de")
        out.append([i, sentence(words, rng.randint(15, 120), rng), lang, f"s{i % 3}" if i % 7 else None])
    base = out[10][1].split()
    for j in range(6):
        w = list(base)
        for _ in range(j):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(999)}"
        out.append([n + j, " ".join(w), "de", "s0"])
    out += [[n + 10, None, "en", "s1"], [n + 11, "", None, "s1"], [n + 12, " \n\t ", "de", None], [None, "no id here at all, only words", "en", "s2"], [None, None, None, None]]
    out += [[n + 13, "a", "en", "s1"], [n + 14, "1234 !!", "en", "s1"], [n + 15, sentence(EN, 9000, rng), "en", "s2"], [5, out[5][1], "en", "s2"], [n + 16, out[5][1].upper(), None, "s2"], [n + 17, "x" * 50_000, "en", "s0"]]
    return [(i, t, l, s, len(t) if t is not None else None, 0.5, "clash", "clash") for i, t, l, s in out]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def tables(spark, folder, **frames):
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def extras():
    """The odd rows of documents, under ids of their own."""
    return [(None if r[0] is None else r[0] + 10_000, *r[1:]) for r in documents()[120:]]
