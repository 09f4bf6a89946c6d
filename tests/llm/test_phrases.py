import random
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tarn.llm import phrases
from tests.llm.texts import EDGE, frame

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least=10, longest=3, overlap=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in regex.split(r"[.,;:!?\x0A-\x0D]", low):
            w = regex.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                f.update((("und" if lang is None else lang), *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {}
    for (lang, *w), a in f.items():
        if len(w) > 1 and a >= least:
            cuts = [(1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            s, k = min(cuts)
            found[lang, *w] = (a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], s)
    out = []
    kept = dict(found)
    for (lang, *w), v in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                part = (lang, *w[i : i + m])
                if 100 * v[0] >= overlap * found[part][0]:
                    kept.pop(part, None)
    for lang in {k[0] for k in kept}:
        own = sorted(((-v[4], -v[0], " ".join(w).encode()), " ".join(w), v) for (x, *w), v in kept.items() if x == lang)
        out += [(lang, i, w, *v) for i, (_, w, v) in enumerate(own[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def some(seed, docs=120):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "The", "the", "É", "é", "longerthaneightbytes", "longerthaneightbytez", "x" * 80, "x" * 79 + "y", "#", "\x00"]
    joints = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", "! "]
    return [(i % 50, "".join(rng.choice(vocabulary) + rng.choice(joints) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "de", None, "", "und"])) for i in range(docs)]


@pytest.mark.parametrize(("least", "longest", "overlap", "top"), [(10, 3, 50, 2000), (3, 4, 90, 7), (1, 2, 50, 50)])
def test_equals_brute_force(spark, least, longest, overlap, top):
    rows = [*some(least), (None, None, "en"), (None, "the b a " * 40, None)]
    docs = frame(spark, rows, SCHEMA).withColumn("gram", F.lit("x")).withColumn("n", F.lit(1)).repartition(5)
    assert rows_of(phrases.mine(docs, least=least, longest=longest, overlap=overlap, top=top)) == brute(rows, least, longest, overlap, top)


def test_edge_texts_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_ROWS", 3)
    got = [r for b in phrases._count(*columns(EDGE), 1, None) for r in b.to_pylist()]
    assert {(r["lang"], r["gram"]): r["n"] for r in got if r["gram"] == "the"} == {("a", "the"): 54, ("c", "the"): 1}
    assert rows_of(phrases.mine(frame(spark, EDGE, SCHEMA))) == brute(EDGE)
    assert phrases.mine(frame(spark, [], SCHEMA)).collect() == []
    assert phrases.mine(frame(spark, [(1, None, None)], SCHEMA)).collect() == []


def columns(rows):
    import pyarrow as pa

    return pa.array([r[2] or "und" for r in rows]), pa.array([r[1] for r in rows], pa.string()).cast(pa.binary())


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    """Where the bitmap is too small to tell phrases apart, all of them are counted."""
    monkeypatch.setattr(phrases, "MIN_BITS", 6)
    monkeypatch.setattr(phrases, "MAX_BITS", 6)
    rows = some(4)
    assert rows_of(phrases.mine(frame(spark, rows, SCHEMA), least=4)) == brute(rows, 4)


def test_marks(spark):
    h = np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64)
    marks = phrases.bitmap(spark.createDataFrame([(int(x),) for x in h[:300].view(np.int64)], "h long"))
    assert phrases.marked(marks, h[:300]).all() and phrases.marked(marks, h[300:]).mean() < 0.1


def test_scores_are_exact(spark):
    rng = random.Random(2)
    rows = [(a, a + rng.randrange(9), a * rng.randrange(1, 4)) for a in [10, 999, 2**31 + 1, 10**15 + 7, 10**15 - 1] * 20]
    got = spark.createDataFrame(rows, "a long, l long, r long").withColumn("score", phrases.score("a", "l", "r")).collect()
    assert all(r["score"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in got)


def test_long_text(spark):
    rows = [(1, "ab cd. " * 100_000 + "z" * 200_000, "en"), (2, " " * 300_000, "en"), (3, "q " * 150_000, "de")]
    assert rows_of(phrases.mine(frame(spark, rows, SCHEMA))) == brute(rows)
