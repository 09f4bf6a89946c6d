import pytest

from tarn.streaming import broker, folds


def event(seq, kind="progress"):
    return {"seq": seq, "type": kind, "status": "running", "percent": 1, "message": None}


def test_publish():
    assert broker.publish(None, [event(1)]) == (None, [])
    history, out = broker.publish(None, [event(0, "create"), *map(event, range(1, 400))])
    assert len(history) == broker.HISTORY and history[-1]["seq"] == 399
    assert [e["seq"] for e in out] == list(range(1, 65))
    history, out = broker.publish(history, [*map(event, range(400, 500)), event(500, "complete"), event(501)])
    assert history is None and len(out) == broker.BUFFER and out[-1]["type"] == "complete" and out[0]["seq"] == 401


def test_stream(spark, tmp_path):
    schema = "task_id string, seq long, type string, status string, percent int, message string"
    rows = [("a", 0, "create"), ("a", 1, "progress"), ("b", 2, "progress"), ("a", 3, "complete"), ("a", 4, "progress"), ("c", 5, "create"), ("c", 6, "progress")]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame([(*r, "s", 1, None) for r in part], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = broker.deliveries(stream).writeStream.format("memory").queryName("got").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["task_id"], r["seq"]) for r in spark.table("got").collect()}
    assert got == {("a", 1), ("a", 3), ("c", 6)}


def test_retries(spark):
    cases = {"ok": [True], "second": [False, True], "dead": [False, False, False, True], "open": [False], "none": []}
    df = spark.createDataFrame(list(cases.items()), "task_id string, outcomes array<boolean>")
    got = {r["task_id"]: (r["attempts"], r["wait_ms"], r["state"]) for r in folds.retried(df).collect()}
    assert got == {"ok": (1, 0, "done"), "second": (2, 2000, "done"), "dead": (3, 6000, "dead"), "open": (1, 2000, "waiting"), "none": (0, 0, "waiting")}


def test_queue(spark):
    from pyspark.sql import functions as F

    rows = [("a", "q", "waiting", 50, None), ("b", "q", "waiting", 10, None), ("c", "q", "claimed", 1, 0), ("d", "q", "waiting", 10**9, None), ("e", "r", "claimed", 5, 10**7)]
    df = spark.createDataFrame(rows, "task_id string, queue string, state string, available_ms long, claimed_ms long")
    assert {r["queue"]: r["task_id"] for r in folds.next_job(df, F.lit(100), "queue").collect()} == {"q": "b"}
    assert folds.claimable(df, F.lit(folds.LEASE_MS + 1)).count() == 3


@pytest.mark.parametrize(("calls", "want"), [
    ([(i, False) for i in range(5)] + [(10, True), (31_000, True), (31_001, True), (31_002, False)], ["closed"] * 4 + ["open", "open", "half-open", "closed", "closed"]),
    ([(i, False) for i in range(5)] + [(40_000, False), (40_001, True), (80_000, True), (80_001, False)], ["closed"] * 4 + ["open"] * 3 + ["half-open", "open"]),
    ([(0, False), (1, False), (2, True), (3, False), (4, False), (5, False), (6, False), (7, False)], ["closed"] * 7 + ["open"]),
])
def test_breaker(spark, calls, want):
    df = spark.createDataFrame([("s", t, ok) for t, ok in reversed(calls)] + [("t", 0, False)], "service string, t_ms long, ok boolean")
    assert [r["state"] for r in folds.breaker(df).where("service = 's'").orderBy("t_ms").collect()] == want


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "queued", 5), ("a", 2, "completed", 100), ("a", 3, "running", 50), ("b", 1, "failed", 10), ("b", 2, "running", 20)], "task_id string, seq int, status string, percent int")
    assert {r["task_id"]: (r["status"], r["percent"]) for r in folds.latest(df).collect()} == {"a": ("completed", 100), "b": ("running", 20)}
