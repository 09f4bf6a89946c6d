import re
import zlib
from collections import Counter, defaultdict
from functools import cache
from math import exp, lgamma, log, log10, pi

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import lm
from tests.llm.texts import EDGE, frame


def brute(docs, depth):
    """Base score, and context-tree weighting by recursion over a dictionary of nodes."""
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [None]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in docs]
    c, nodes = Counter(), defaultdict(lambda: [0, 0])

    def walk(text):
        data = bytes(depth) + text
        for i in range(depth, len(data)):
            for k in range(8):
                yield (1 << k) | data[i] >> (8 - k), data[i] >> (7 - k) & 1, tuple(data[i - d] for d in range(1, depth + 1))

    for (_, t), h in zip(docs, held, strict=True):
        if not h:
            c.update(split(t))
            for q, bit, past in walk((t or "").encode()):
                for d in range(depth + 1):
                    nodes[past[:d], q][bit] += 1
    kids = defaultdict(list)
    for ctx, q in nodes:
        if ctx:
            kids[ctx[:-1], q].append((ctx, q))
    own = lambda n: lgamma(n[0] + 0.5) + lgamma(n[1] + 0.5) - log(pi) - lgamma(sum(n) + 1)

    @cache
    def weighted(node):
        if len(node[0]) == depth:
            return own(nodes[node])
        return np.logaddexp(log(0.5) + own(nodes[node]), log(0.5) + sum(map(weighted, kids[node])))

    known = {}

    def one(ctx, q):
        if (ctx, q) not in known:
            n = nodes[ctx, q] if (ctx, q) in nodes else [0, 0]
            kt = (n[1] + 0.5) / (sum(n) + 1)
            stay = exp(log(0.5) + own(n) - weighted((ctx, q))) if len(ctx) < depth and sum(n) else 0.5
            known[ctx, q] = kt, stay
        return known[ctx, q]

    n, v, out = sum(c.values()), len(c), []
    for (i, t), h in zip(docs, held, strict=True):
        toks, s = split(t), 0.0
        for q, bit, past in walk((t or "").encode()):
            p = one(past, q)[0]
            for d in range(depth - 1, -1, -1):
                kt, stay = one(past[:d], q)
                p = stay * kt + (1 - stay) * p
            s += log10(p if bit else 1 - p)
        out.append((str(i), h, len(toks), sum(c[w] > 0 for w in toks), n, sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks), s))
    return sorted(out)


def compare(got, want):
    got = sorted(tuple(str(x) if k == 0 else x for k, x in enumerate(r)) for r in got)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], rel=2e-7, abs=1e-6)  # bits are kept as 32-bit floats


@pytest.mark.parametrize(("frequent", "depth"), [(0, 5), (3, 3), (1 << 20, 5), (50, 2)])
def test_edge_texts(spark, monkeypatch, frequent, depth):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "FREQUENT_GRAMS", frequent)
    rows = [(i, t[:1500] if t else t, s) for i, t, s in EDGE]
    df = frame(spark, rows).withColumn("word", F.lit("clash")).withColumn("row", F.lit(1))
    compare(lm.scores(df, depth=depth).collect(), brute([r[:2] for r in rows], depth))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 800")
    compare(lm.scores(docs).collect(), brute([(r["doc_id"], r["text"]) for r in docs.collect()], lm.DEPTH))


def test_small_pieces_and_parts(spark):
    rows = [(i, t[:600] if t else t, s) for i, t, s in EDGE]
    want = sorted(str(r) for r in lm.scores(frame(spark, rows)).collect())
    scores = {r["doc_id"]: r["score"] for r in lm.scores(frame(spark, rows)).collect()}
    got = lm.scores(frame(spark, rows), limits=(3, 20, 7)).collect()
    assert len(got) == len(want) and all(r["score"] == pytest.approx(scores[r["doc_id"]]) for r in got)


def test_empty_and_untrained(spark):
    assert lm.scores(frame(spark, [])).collect() == []
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [(i, "ab c", "x") for i in ids]
    got = lm.scores(frame(spark, rows)).collect()
    assert [r["train_tokens"] for r in got] == [0, 0] and got[0]["score"] == pytest.approx(4 * 8 * log10(0.5))


def test_slots():
    rnd = np.random.default_rng(2)
    keys = np.unique(rnd.integers(0, 1 << 48, 5000))
    slots = lm.Slots(keys, np.arange(len(keys)) + 1.0)
    asked = np.concatenate((keys, keys + 1, [0]))
    got, left = slots.get(asked)
    known = {int(k): i + 1.0 for i, k in enumerate(keys)}
    assert got.tolist() == [known.get(int(a), 0.0) for a in asked] and left.tolist() == [i for i, a in enumerate(asked) if int(a) not in known]
    assert lm.Slots(keys[:0], np.zeros(0)).get(asked)[1].tolist() == list(range(len(asked)))


def test_better_than_the_base_on_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    rows = lm.scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]
