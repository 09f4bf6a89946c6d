import json

import pytest

from tarn.operators import acceptance

GOOD = {"status": "completed", "score": {"verifierPassed": True, "manifest": 100}, "artifacts": {"fileCount": 2, "files": ["a", "b"], "sourceBreakdown": {"native": 1, "fallback": 1}}, "packaging": {"downloadReady": True, "archiveSize": 10}, "verification": {"wxmlPlaceholderCount": 0}}


def rows():
    change = lambda **more: json.dumps(GOOD | more)
    main = acceptance.MAIN
    return [
        (main, json.dumps(GOOD), []), ("other", '{"see": "https://host/home/x and /pages/a"}', []), (main, change(status="odd"), ["status"]), (main, change(score={"verifierPassed": False, "manifest": 99}), ["verifier", "manifest"]),
        (main, change(artifacts={"fileCount": 3, "files": ["a", "b"], "sourceBreakdown": {"native": 3}}), ["files"]), (main, change(artifacts={"fileCount": 2, "files": ["a", "b"]}), ["sources"]), (main, change(packaging={}), ["archive"]),
        (main, change(status="failed", packaging={}), []), (main, change(verification={"wxmlUnresolvedMarkers": 1}), ["unclean"]), (main, change(note="in /home/me/x"), ["host path"]), ("other", '{"p": "C:\\\\x"}', ["host path"]),
        ("other", "[1]", ["object"]), (main, "{", ["object"]), ("other", None, ["object"]), (None, "{}", []), (main, "{}", ["status", "verifier", "manifest", "files", "sources"]),
    ]


def frame(spark, kept):
    return spark.createDataFrame([(i, n, t) for i, (n, t, _) in enumerate(kept)], "task_id int, name string, text string")


def test_each_expectation(spark):
    got = {r["task_id"]: r["broken"] for r in acceptance.broken(frame(spark, rows())).collect()}
    assert got == {i: b for i, (_, _, b) in enumerate(rows())}


def test_the_gate_counts_in_the_pass_that_writes(spark, tmp_path):
    good = [r for r in rows() if not r[2]]
    assert acceptance.judged(frame(spark, good), str(tmp_path / "good")) == {"reports": len(good)}
    assert spark.read.parquet(str(tmp_path / "good")).count() == len(good)
    with pytest.raises(acceptance.Rejected, match="host path: 2") as refused:
        acceptance.judged(frame(spark, rows()), str(tmp_path / "bad"))
    assert refused.value.counts["object"] == 3 and refused.value.counts["archive"] == 1
    assert acceptance.judged(frame(spark, []), str(tmp_path / "none")) == {"reports": 0}
