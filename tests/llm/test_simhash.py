import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tarn.llm import simhash
from tarn.llm.components import components
from tests.llm.texts import EDGE, frame


def brute_fp(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return {find(i): min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))}, [find(i) for i in range(len(fps))]


def compare(rows, texts):
    fps = [r["fp"] & (1 << 64) - 1 for r in rows]
    names, at = brute_components([r["doc_id"] for r in rows], fps)
    assert [r["component_id"] for r in rows] == [names[a] for a in at]
    for r, f in zip(rows, fps, strict=True):
        assert f in {brute_fp(t) for t in texts[r["doc_id"]]}, r["doc_id"]


def test_edge_texts(spark):
    texts = {}
    for i, t, _ in EDGE:
        texts.setdefault(i, []).append(t)
    rows = simhash.near_duplicates(frame(spark).withColumn("fp", F.lit("clash"))).collect()
    assert len(rows) == len(EDGE)
    compare(rows, texts)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    compare(simhash.near_duplicates(docs).collect(), {r["doc_id"]: [r["text"]] for r in docs.collect()})


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def test_all_links_within_two_bits(spark):
    import random

    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    fps = base + [b ^ sum(1 << i for i in rnd.sample(range(64), rnd.choice((1, 2, 3)))) for b in base for _ in range(15)]
    fps += [1 << 63, 0, 3 << 62]
    rows = [(f - (f >> 63 << 64),) for f in set(fps)]
    found = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame(rows, "fp long"))).collect()}
    all_fps = sorted(set(fps))
    _, at = brute_components(all_fps, all_fps)
    groups = {}
    for f, a in zip(all_fps, at, strict=True):
        groups.setdefault(a, []).append(f - (f >> 63 << 64))
    for g in groups.values():
        assert {found.get(f, f) for f in g} == {min(g)}


@pytest.mark.parametrize("n", [2, 97])
def test_components_of_a_path_and_a_star(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(n)] + [(5000, 5000), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(n)}


def test_crowded_segments_lose_no_link(spark, monkeypatch):
    """Thousands of fingerprints share a segment; some are linked across it, by either segment."""
    import random

    rnd = random.Random(9)
    fps = [(0xABCD0123 << 32) | rnd.getrandbits(32) for _ in range(1500)] + [rnd.getrandbits(32) << 32 | 0x80000001 for _ in range(300)]
    fps += [f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for f in rnd.sample(fps, 500)] + [0, 3, 1 << 63, (1 << 64) - 1, (1 << 64) - 2]
    fps = sorted(set(fps))
    want = {(min(a, b), max(a, b)) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2}
    df = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    for limit in (simhash.BUCKET, 4, 1 << 20):
        monkeypatch.setattr(simhash, "BUCKET", limit)
        found = {tuple(sorted((r["u"] & (1 << 64) - 1, r["v"] & (1 << 64) - 1))) for r in simhash.links(df).collect()}
        assert found <= want
        root = {r["node"]: r["root"] for r in components(spark.createDataFrame([tuple(x - (x >> 63 << 64) for x in p) for p in found], "u long, v long")).collect()}
        assert all(root[a - (a >> 63 << 64)] == root[b - (b >> 63 << 64)] for a, b in want)
    assert len(want) > 400 and found == want
