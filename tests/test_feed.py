import time

import pytest

from tarn.streaming import feed

LIMITS = (1000, 15_000, 600_000)
PLACE = dict.fromkeys(f.split()[0] for f in feed._PLACE.split(", ")) | {"open": False, "reading": False, "told": False}


def reading(**more):
    return feed.Reading([], None, PLACE | more, LIMITS)


def event(seq, kind="progress", status="running", percent=1):
    return (seq, kind, status, percent, None)


def test_history_then_snapshot_then_live():
    r = reading()
    r.event(event(0), 0)
    assert not r.history and not r.out
    r.event(event(1, "create"), 0)
    for i in range(2, 300):
        r.event(event(i), 0)
    assert len(r.history) == feed.HISTORY and not r.out
    r.snapshot = event(300, None, "formatting", 80)
    r.reader("open", 10)
    assert [x[0] for x in r.out] == ["history"] * feed.HISTORY + ["snapshot"]
    r.out = []
    for i in range(301, 400):
        r.event(event(i), 20)
    r.event(event(400, "complete", "completed"), 20)
    assert len(r.out) == feed.BUFFER and r.out[-1][2] == "complete" and r.out[0][1] == 302
    assert not r.place["open"] and not r.place["reading"] and not r.history


def test_polls_keep_alives_and_idle_tasks():
    r = reading()
    r.event(event(1, "create"), 0)
    r.snapshot = event(1, None)
    r.reader("open", 0)
    r.due(999)
    assert [x[0] for x in r.out] == ["snapshot"]
    r.due(1000)
    assert len(r.out) == 1 and r.place["poll_at"] == 2000  # nothing new
    r.snapshot = event(2, None, "running", 50)
    r.due(2000)
    r.due(15_000)
    assert [x[0] for x in r.out] == ["snapshot", "poll", "keep-alive"]
    r.due(700_000)
    assert r.place["open"] and r.place["idle_at"] == 1_300_000  # a reader keeps it
    r.reader("close", 700_001)
    r.due(1_300_001)
    assert not r.place["open"]
    lost = reading()
    lost.reader("open", 0)
    lost.snapshot = event(9, None, "failed", 100)
    lost.due(1000)
    assert [(x[0], x[3]) for x in lost.out] == [("poll", "failed")] and not lost.place["reading"]


def put(spark, folder, rows):
    names = [f.split()[0] for f in feed.INPUT.split(", ")]
    spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], feed.INPUT).coalesce(1).write.mode("append").json(folder)


def run(spark, folder, checkpoint, out, limits, until):
    stream = spark.readStream.schema(feed.INPUT).option("maxFilesPerTrigger", 1).json(folder)
    q = feed.feed(stream, *limits).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="500 milliseconds").start()
    end = time.time() + 120
    try:
        while time.time() < end and q.isActive and not until(q):
            time.sleep(0.5)
        if q.exception():
            raise q.exception()
    finally:
        q.stop()


def got(spark, out):
    return sorted(((r["task_id"], r["via"], r["seq"], r["type"], r["status"]) for r in spark.read.schema(feed.OUTPUT).parquet(out).collect()), key=str)


@pytest.fixture
def rocks(spark):
    feed.enable(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_restart_from_the_checkpoint(rocks, tmp_path):
    folder, checkpoint, out = (str(tmp_path / n) for n in ("in", "cp", "out"))
    say = lambda task, seq, source, kind, status="running": {"task_id": task, "seq": seq, "source": source, "type": kind, "status": status}
    read = lambda n: lambda q: sum(p["numInputRows"] for p in q.recentProgress) >= n
    put(rocks, folder, [say("a", 0, "event", "create"), say("a", 1, "event", "progress"), say("b", 1, "event", "progress"), say("b", 2, "snapshot", None), {"seq": 3, "source": "event", "type": "create"}])
    run(rocks, folder, checkpoint, out, LIMITS, read(5))
    assert got(rocks, out) == []
    put(rocks, folder, [say("a", 2, "reader", "open"), say("b", 3, "reader", "open"), say("a", 3, "event", "progress", "formatting")])
    run(rocks, folder, checkpoint, out, LIMITS, read(3))
    first = [("a", "history", 1, "progress", "running"), ("a", "live", 3, "progress", "formatting"), ("b", "snapshot", 2, None, "running")]
    assert got(rocks, out) == first
    # the events of task b are lost, that of task a arrives; b's end comes by a poll, after a restart
    put(rocks, folder, [say("a", 4, "event", "complete", "completed"), say("a", 5, "event", "progress"), say("b", 6, "snapshot", None, "failed")])
    ended = lambda _: {("a", "live", 4, "complete", "completed"), ("b", "poll", 6, None, "failed")} <= set(got(rocks, out))
    run(rocks, folder, checkpoint, out, LIMITS, ended)
    assert got(rocks, out) == sorted([*first, ("a", "live", 4, "complete", "completed"), ("b", "poll", 6, None, "failed")], key=str)


def test_keep_alive(rocks, tmp_path):
    folder, checkpoint, out = (str(tmp_path / n) for n in ("in", "cp", "out"))
    put(rocks, folder, [{"task_id": "a", "seq": 1, "source": "reader", "type": "open"}])
    run(rocks, folder, checkpoint, out, (1000, 1500, 600_000), lambda _: (tmp_path / "out" / "_spark_metadata").exists() and ("a", "keep-alive", None, None, None) in got(rocks, out))
    assert {r[1] for r in got(rocks, out)} == {"keep-alive"}


def test_sources(spark):
    events = spark.createDataFrame([("a", 1, "create")], "task_id string, seq long, type string")
    snapshots = spark.createDataFrame([("a", 2, "queued", 0, "m", 1)], "task_id string, seq long, status string, percent int, message string, other int")
    readers = spark.createDataFrame([("a", 3, "open")], "task_id string, seq long, type string")
    assert sorted(map(tuple, feed.sources(events, snapshots, readers).collect()), key=str) == [("a", "event", 1, "create", None, None, None), ("a", "reader", 3, "open", None, None, None), ("a", "snapshot", 2, None, "queued", 0, "m")]
