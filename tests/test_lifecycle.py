import pytest

from tarn.streaming import feed, lifecycle

FULL = [s for s in lifecycle.STAGES if s not in lifecycle.OPTIONAL]


@pytest.mark.parametrize(("was", "status", "why"), [
    (None, "queued", None), (None, "unpacking", "not queued"), ("queued", "classifying", None), ("queued", "unpacking", "skips a stage"), ("queued", "queued", "already queued"), ("unpacking", "queued", None),
    ("recovering_wxss", "verifying", None), ("recovering_wxss", "formatting", None), ("fallback_recovering", "recovering_js", "backwards"), ("verifying", "verifying", "repeated"), ("verifying", "completed", "too early"),
    ("packaging", "completed", None), ("packaging", "partial", None), ("decrypting", "failed", None), ("failed", "queued", "already ended"), ("completed", "failed", "already ended"), ("queued", "odd", "unknown status"), ("queued", None, "unknown status"),
])
def test_rules(was, status, why):
    assert lifecycle.refusal(was, status) == why


def test_every_status_has_a_way_on():
    for at, s in enumerate(FULL[:-1]):
        assert lifecycle.refusal(s, FULL[at + 1]) is None and lifecycle.refusal(s, "failed") is None


def test_two_outputs_over_a_restart(spark, tmp_path):
    feed.enable(spark)
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    rows = [("a", i, s) for i, s in enumerate(FULL)] + [("a", 90, "completed"), ("a", 91, "failed"), ("b", 1, "queued"), ("b", 2, "classifying"), ("b", 3, "formatting"), ("b", 4, "queued"), ("b", 5, "classifying"), ("b", 6, "failed"), ("c", 1, "packaging"), (None, 1, "queued")]
    try:
        for part in (rows[:4] + rows[-8:-4], rows[4:-8] + rows[-4:]):
            spark.createDataFrame(part, "task_id string, seq long, status string").coalesce(1).write.mode("append").json(folder)
            stream = spark.readStream.schema("task_id string, seq long, status string").json(folder)
            q = lifecycle.lifecycle(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert not q.exception()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    told = spark.read.schema(lifecycle.OUTPUT).parquet(str(tmp_path / "out"))
    good, bad = lifecycle.accepted(told).collect(), lifecycle.refused(told).collect()
    assert {(r["task_id"], r["seq"], r["refused"]) for r in bad} == {("a", 91, "already ended"), ("b", 3, "skips a stage"), ("c", 1, "not queued")}
    last = {t: max((r["seq"], r["status"], r["percent"], r["attempt"]) for r in good if r["task_id"] == t) for t in "ab"}
    assert last == {"a": (90, "completed", 100, 1), "b": (6, "failed", 5, 2)} and len(good) + len(bad) == len(rows) - 1


def test_a_table(spark):
    feed.enable(spark)
    try:
        df = spark.createDataFrame([("a", 2, "classifying"), ("a", 1, "queued"), ("a", 3, "queued"), ("a", None, "failed")], "task_id string, seq long, status string")
        got = {(r["seq"], r["status"], r["refused"], r["attempt"]) for r in lifecycle.lifecycle(df).collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == {(None, "failed", "not queued", None), (1, "queued", None, 1), (2, "classifying", None, 1), (3, "queued", None, 2)}
