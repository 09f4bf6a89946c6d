import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tarn.llm import mixing
from tests.llm.texts import EDGE, frame


@pytest.mark.parametrize("seed", range(12))
def test_period_is_pfair(seed):
    rnd = random.Random(seed)
    weights = {f"s{i}": rnd.choice((1, 2, 5, 40, 300)) * rnd.random() + 0.01 for i in range(rnd.randint(1, 40))}
    parts, period = mixing.quanta(weights)
    assert sum(parts.values()) == period and min(parts.values()) >= 1
    slots = mixing.pfair_period(parts, period)
    assert sorted(t for x in slots.values() for t in x) == list(range(period))
    for s, q in parts.items():
        assert len(slots[s]) == q
        for k, t in enumerate(slots[s]):
            assert k * period // q <= t < -(-(k + 1) * period // q)


def check(rows, block, weights):
    """Against a plain simulation: counts of each source after each slot stay within a block of its share, by phase."""
    blocks = defaultdict(set)
    sizes = Counter()
    for r in rows:
        blocks[r["slot"]].add((r["source"], r["block"], r["phase_start"], r["release"], r["deadline"]))
        sizes[r["source"], r["block"]] += 1
    assert sorted(blocks) == list(range(len(blocks))) and all(len(b) == 1 for b in blocks.values())
    last = {s: max(b for s2, b in sizes if s2 == s) for s, _ in sizes}
    assert all(n == block for (s, b), n in sizes.items() if b < last[s])
    order = [next(iter(blocks[t])) for t in range(len(blocks))]
    seen, taken, start = Counter(), Counter(), 0
    left = Counter(s for s, *_ in order)
    for t, (s, b, phase, release, deadline) in enumerate(order):
        assert b == seen[s] and release <= t < deadline
        if phase != start:
            start, taken = phase, Counter()
        if t == start:
            parts, period = mixing.quanta({x: weights[x] for x in left if left[x]})
        seen[s] += 1
        taken[s] += 1
        left[s] -= 1
        for x, q in parts.items():
            assert abs(taken[x] - (t - start + 1) * q / period) < 1


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs, block=4).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    n = Counter("=" + r["source"] for r in rows)
    check([{**r.asDict(), "source": "=" + r["source"]} for r in rows], 4, {s: k**0.5 for s, k in n.items()})


def test_hot_source_and_given_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    monkeypatch.setattr(mixing, "SUPER", 4)
    rows = [(i, "t", "hot") for i in range(3000)] + [(5000 + i, "t", f"s{i % 3}") for i in range(300)] + [(9000 + i, "t", None) for i in range(50)]
    got = mixing.mix(frame(spark, rows), {"hot": 1, "s0": 2, "s1": 0.5}, block=8).collect()
    assert len(got) == len(rows)
    names = lambda s: "null" if s is None else f"={s}"
    check([{**r.asDict(), "source": names(r["source"])} for r in got], 8, {"=hot": 1, "=s0": 2, "=s1": 0.5, "=s2": 0.5, "null": 0.5})


def test_edge_rows(spark):
    df = frame(spark).withColumn("slot", F.lit("clash")).withColumn("block", F.lit(0))
    got = mixing.in_order(mixing.mix(df, text="text", block=2)).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(i), str(t)) for i, t, _ in EDGE)
    assert [(r["slot"], r["place"]) for r in got] == sorted((r["slot"], r["place"]) for r in got)
    assert mixing.mix(frame(spark, [])).collect() == []


def test_bad_weights(spark):
    with pytest.raises(ValueError):
        mixing.mix(frame(spark), {"a": 0})


def test_long_schedules_follow_the_target_itself():
    rnd = random.Random(5)
    for weights in ({"a": 1.0, "b": 0.0001, "c": 0.3711}, {f"s{i}": rnd.random() ** 4 + 1e-5 for i in range(25)}):
        total, taken, order = sum(weights.values()), Counter(), []
        for s, k, phase, release, deadline, t in mixing.schedule(dict.fromkeys(weights, 10**6), weights):
            assert t == len(order) and k == taken[s] and phase == 0 and release <= t < deadline
            taken[s] += 1
            order.append(s)
            assert abs(taken[s] - (t + 1) * weights[s] / total) < 1 + 1e-6 and abs(taken[s] - 1 - t * weights[s] / total) < 1 + 1e-6
            if t == 100_000:
                break
        assert all(abs(taken[s] - len(order) * w / total) < 1 + 1e-6 for s, w in weights.items())


def test_weight_below_a_thousandth(spark):
    rows = [(i, "t", "hot") for i in range(6000)] + [(9000 + i, "t", "rare") for i in range(20)]
    got = mixing.mix(frame(spark, rows), {"hot": 1, "rare": 0.0001}, block=1).collect()
    assert sum(r["source"] == "rare" and r["slot"] < 5900 for r in got) <= 1


def test_thousands_of_sources(spark):
    rows = [(i, "t", f"s{i % 3000}") for i in range(7000)]
    got = mixing.mix(frame(spark, rows), block=2).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(7000))
    assert sorted({r["slot"] for r in got}) == list(range(len({(r["source"], r["block"]) for r in got})))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)


def test_as_many_phases_as_sources_take_no_longer():
    order = list(mixing.schedule(dict.fromkeys(map(str, range(50_000)), 1), dict.fromkeys(map(str, range(50_000)), 1.0)))
    assert len({s for s, *_ in order}) == 50_000 and [t for *_, t in order] == list(range(50_000))
