import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import repeats
from tarn.llm.suffix import suffix_array
from tests.llm.texts import EDGE, frame


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(symbols):
    s = [*symbols, 0]
    assert suffix_array(np.array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_of_long_texts():
    rnd = random.Random(5)
    for text in ([1] * 3000, [1, 2] * 1500, [rnd.randint(1, 4) for _ in range(3000)], ([rnd.randint(1, 9) for _ in range(70)] * 40)):
        s = [*text, 0]
        assert suffix_array(np.array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows, span):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, b in data:
        seen.update(b[i : i + span] for i in range(len(b) - span + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                gone[k : k + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i), len(b), sum(gone), spans, sha256(kept).hexdigest(), kept))
    return sorted(out)


def compare(spark, rows, span):
    df = frame(spark, rows).withColumn("kept", F.lit("clash")).withColumn("ck", F.lit(1))
    want = brute(rows, span)
    got = repeats.repeats(df, span=span).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == [w[:5] for w in want]
    kept = repeats.without_repeats(df, span=span).collect()
    assert sorted((str(r["doc_id"]), bytes(r["kept"])) for r in kept) == sorted((w[0], w[5]) for w in want)


def planted(seed, n=40, span=24):
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice("abcdeé ") for _ in range(k))
    shared = [word(rnd.randint(span - 6, 3 * span)) for _ in range(5)]
    rows = []
    for i in range(n):
        t = word(rnd.randint(0, 90))
        for _ in range(rnd.randint(0, 3)):
            t += rnd.choice(shared)[rnd.randint(0, 4) :] + word(rnd.randint(0, 20))
        rows.append((i, t, "x"))
    for i in range(6):  # near copies
        t = list(rows[i][1])
        if t:
            t[rnd.randrange(len(t))] = "#"
        rows.append((100 + i, "".join(t), "x"))
    return [*rows, (200, rows[3][1], "x"), (201, "ab" * 60, "x"), (202, "q" * 100, "x"), (203, None, "x"), (204, "", "x")]


@pytest.mark.parametrize("seed", range(3))
def test_planted(spark, seed):
    compare(spark, planted(seed), 24)


def test_hot_anchors_are_counted_instead(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 1)
    compare(spark, planted(9), 24)


@pytest.mark.parametrize("text", ["ab" * 200, "".join(random.Random(8).choice("abcd") for _ in range(700)), "x" * 300])
def test_segments_select_the_same_anchors(monkeypatch, text):
    b = text.encode()
    spread = lambda: {p: (h, a) for h, a, lo, hi in zip(*repeats.Anchors(24).find(b), strict=True) for p in range(lo, hi + 1)}
    whole = spread()
    monkeypatch.setattr(repeats, "_SEGMENT", 50)
    assert spread() == whole and sorted(whole) == list(range(len(b) - 23))


def test_blocks_in_one_process(monkeypatch):
    """Contexts and searches cut into small blocks find what one block finds."""
    import pyarrow as pa

    rnd = random.Random(3)
    shared = "".join(rnd.choice("abcdefgh") for _ in range(90))
    texts = [("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 40))) + shared[rnd.randint(0, 30) :]).encode() for _ in range(30)]
    finder = repeats.Anchors(24)
    kind = pa.list_(pa.struct([("h", pa.int64()), ("a", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())]))
    found = [[dict(zip(("h", "a", "lo", "hi"), map(int, x), strict=True)) for x in zip(*finder.find(t), strict=True)] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary()), pa.array(found, kind)], ["tid", "body", "shared"])

    def hits():
        rows = [r for b in repeats._contexts(24)(iter([batch])) for r in b.to_pylist()]
        n, first = Counter(r["ck"] for r in rows), {r["ck"]: r for r in rows}
        ordered = sorted(first.values(), key=lambda r: r["h"])
        one = pa.RecordBatch.from_arrays([pa.array([r[c] for r in ordered], k) for c, k in (("h", pa.int64()), ("ck", pa.binary()), ("off", pa.int32()), ("ctx", pa.binary()))] + [pa.array([n[r["ck"]] for r in ordered], pa.int64())], ["h", "ck", "off", "ctx", "n"])
        got = {r["ck"]: r["found"] for b in repeats._search(24)(iter([one])) for r in b.to_pylist()}
        return {(r["tid"], r["base"] + s) for r in rows for f in got.get(r["ck"], ()) for s in range(f["s"], f["e"] + 1)}

    whole = hits()
    monkeypatch.setattr(repeats, "BLOCK", 100)
    assert hits() == whole
    seen = Counter(t[i : i + 24] for t in texts for i in range(len(t) - 23))
    assert whole == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 23) if seen[t[i : i + 24]] > 1}


def test_edge_texts(spark):
    compare(spark, EDGE, 400)
    assert repeats.repeats(frame(spark, [])).collect() == []


def test_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    compare(spark, rows, 400)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=10, max_size=60), min_size=1, max_size=5))
def test_anchors_depend_on_windows_alone(texts):
    finder, place = repeats.Anchors(24), {}
    for t in texts:
        b = t.encode()
        covered = []
        for h, a, lo, hi in zip(*finder.find(b), strict=True):
            covered += range(lo, hi + 1)
            for p in range(lo, hi + 1):
                assert place.setdefault(b[p : p + 24], (h, a - p)) == (h, a - p)
        assert covered == list(range(max(0, len(b) - 23)))
