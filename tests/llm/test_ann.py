
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, top=20, is_query=lambda i: i % 20 == 0):
    by = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by[i] = min(by.get(i, v), v)
    sizes = [len(v) for v in by.values()]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), d)) if sizes else 0
    by = {i: np.float32(v).astype(float) for i, v in by.items() if len(v) == dim}
    out = []
    for i, v in by.items():
        if is_query(i):
            near = sorted((-float(sum(a * b for a, b in zip(v, w, strict=True))), j) for j, w in by.items() if j != i)[:top]
            out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(near)]
    return sorted(out)


def recall(got, want):
    a, b = {(g[0], g[2]) for g in got}, {(w[0], w[2]) for w in want}
    return len(a & b) / max(1, len(b))


def check_shape(got, want):
    assert [(g[0], g[1]) for g in got] == [(w[0], w[1]) for w in want]


def test_recall_on_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = sorted(map(tuple, ann.nearest(df, lambda i: i % 20 == 0).collect()))
    want = brute([tuple(r) for r in df.select("vec_id", "embedding").collect()])
    check_shape(got, want)
    assert recall(got, want) >= 0.97
    exact = {(w[0], w[2]): w[3] for w in want}
    assert all(exact[g[0], g[2]] == g[3] for g in got if (g[0], g[2]) in exact)


def rows(n, dim, seed=0):
    rnd = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rnd.normal(size=dim) * (1 + i % 3)], 0) for i in range(n)]


@pytest.mark.parametrize("dim", [1, 3, 7, 64])
def test_small_tables_are_exact(spark, dim):
    data = rows(90, dim)
    got = sorted(map(tuple, ann.nearest(spark.createDataFrame(data, SCHEMA), lambda i: i % 20 == 0).collect()))
    assert got == brute(data)


def test_blocks_are_merged(spark, monkeypatch):
    monkeypatch.setattr(ann, "CODE_BLOCK", 9)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    data = rows(1200, 8)
    got = sorted(map(tuple, ann.nearest(spark.createDataFrame(data, SCHEMA), lambda i: i % 20 == 0).collect()))
    want = brute(data)
    check_shape(got, want)
    assert recall(got, want) >= 0.97


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = rows(60, 4) + [(100 + i, [0.5, 1.0, 0.0, -0.0], 0) for i in range(400)] + [(5, [9.0, 9.0, 9.0, 9.0], 0), (5, [9.0, 9.0, 9.0, 9.0], 1)]
    data += [(1000, None, 0), (1020, [], 0), (1040, [0.0] * 4, 0), (1060, [1.0, None, 1.0, 1.0], 0), (1080, [nan, 1.0, 1.0, 1.0], 0), (1100, [inf, 1.0, 1.0, 1.0], 0), (1120, [1.0] * 3, 0), (None, [1.0] * 4, 0), (-40, [1.0] * 4, None)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("rep", F.lit("clash")).withColumn("v", F.lit(1))
    assert sorted(map(tuple, ann.nearest(df, lambda i: i % 20 == 0).collect())) == brute(data)


def test_few_or_no_rows(spark):
    assert ann.nearest(spark.createDataFrame([], SCHEMA), lambda i: i % 20 == 0).collect() == []
    one = spark.createDataFrame([(20, [1.0, 2.0], 0)], SCHEMA)
    assert ann.nearest(one, lambda i: i % 20 == 0).collect() == []
    two = spark.createDataFrame([(20, [1.0, 2.0], 0), (21, [1.0, 2.0], 0)], SCHEMA)
    assert list(map(tuple, ann.nearest(two, lambda i: i % 20 == 0).collect())) == [(20, 1, 21, 5.0)]


def test_score_aware_codes_lose_less_of_large_products():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = ann.Quantiser.fit(x)
    plain = ann.Quantiser(q.books, 64, 1.0)
    back = lambda c: np.stack([q.books[j][c[:, j]] for j in range(c.shape[1])], 1).reshape(len(x), -1)[:, :64]
    along = lambda c: abs(((x - back(c)) * x).sum(1)).mean()
    assert along(q.codes(x)) < along(plain.codes(x))


def test_many_nearly_equal_vectors_keep_all_neighbours(spark):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=16)
    near = base + 1e-4 * rnd.normal(size=(2000, 16))
    data = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(np.concatenate([near, rnd.normal(size=(500, 16))]))]
    query = lambda i: i % 100 == 0
    got = sorted(map(tuple, ann.nearest(spark.createDataFrame(data, SCHEMA), query).collect()))
    assert got == brute(data, is_query=query)
