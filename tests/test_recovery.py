import io
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarn.operators import manifest, recovery, tasks
from tarn.sources import archive


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


@pytest.fixture
def world(spark):
    have = {"full": ["app.js", "app.wxss", "a.js", "a.wxml", "a.wxss"], "runtime": ["app-service.js", "page-frame.html", "app-wxss.js", "k.js"], "bare": ["a.json"]}
    files = table(spark, "pkg_id string, path string", *((p, f) for p, fs in have.items() for f in fs))
    pages = table(spark, "pkg_id string, ord int, route string", *((p, 0, "a") for p in have))
    packs = table(spark, "pkg_id string", *((p,) for p in have))
    assets = manifest.page_assets(pages, files, table(spark, "pkg_id string, page string, chunk string"))
    return packs, files, assets, recovery.hints(packs, files)


def rows(df):
    return {r["pkg_id"]: tuple(r)[1:] for r in df.collect()}


def codes(df):
    return {(r["pkg_id"], r["code"]) for r in df.collect()}


def test_tracks(spark, world):
    packs, files, assets, hinted = world
    summary, told = recovery.script_track(assets, hinted)
    assert rows(summary) == {"full": (2, False, True), "runtime": (3, True, True), "bare": (0, True, False)}
    assert codes(told) == {("runtime", "recover.js.page.missing_runtime"), ("runtime", "recover.js.app.missing"), ("bare", "recover.js.page.missing")}
    components = table(spark, "pkg_id string, path string", ("runtime", "c"), ("bare", "c"))
    summary, told = recovery.markup_track(assets, components, files, hinted)
    assert rows(summary) == {"full": (1, False, True), "runtime": (0, True, False), "bare": (0, True, False)}
    assert codes(told) == {("runtime", "recover.wxml.page.missing_runtime"), ("runtime", "recover.wxml.component.missing_runtime"), ("bare", "recover.wxml.page.missing")}
    summary, told = recovery.style_track(assets, hinted)
    assert rows(summary) == {"full": (2, False, True), "runtime": (0, True, True), "bare": (0, False, True)}
    assert codes(told) == {("runtime", "recover.wxss.app.missing")}


def test_fallback_plan(spark):
    t = table(spark, "pkg_id string, partial boolean, success boolean", ("a", False, True), ("a", True, True), ("b", False, True), ("s", True, True))
    profiles = table(spark, "pkg_id string, is_subpackage boolean", ("a", False), ("b", False), ("s", True))
    assert rows(recovery.fallback_plan(t, profiles)) == {"a": (True, "run", False), "b": (False, "none", False), "s": (True, "guard", True)}
    assert rows(recovery.fallback_plan(t, profiles, enabled=False))["a"] == (True, "off", True)


def test_fallback_status(spark):
    r = table(
        spark, "pkg_id string, state string, text string", ("m", "missing", None), ("u", "unreadable", None), ("i", "read", "{oops"), ("c", "read", '{"status": "completed"}'),
        ("d", "read", '{"status": "completed", "diagnostics": [{"code": "x"}]}'), ("p", "read", '{"status": "partial"}'), ("k", "read", '{"status": "odd"}'),
    )
    assert rows(recovery.fallback_status(r)) == {
        "m": ("completed", "recover.fallback.status_missing"), "u": ("partial", "recover.fallback.status_unreadable"), "i": ("partial", "recover.fallback.status_invalid"), "c": ("completed", None),
        "d": ("partial", None), "p": ("partial", None), "k": ("partial", "recover.fallback.status_unknown"),
    }


def test_fallback_outcome_and_listing(spark):
    runs = table(spark, "pkg_id string, process_ok boolean, has_dir boolean, status string", ("a", True, True, "completed"), ("b", False, True, "completed"), ("c", True, True, "completed"))
    files = table(spark, "pkg_id string, path string, text string", ("a", "x.js", ""), ("c", "app.json", ""), ("a", "status.json", ""), ("a", "i.png", ""), ("a", "page-frame.js", ""), ("a", "app-wxss.js", "x"))
    assert rows(recovery.fallback_outcome(runs, files)) == {"a": (True, False), "b": (False, True), "c": (True, True)}
    assert {r["path"] for r in recovery.listed_files(files, "status.json").where("pkg_id = 'a'").collect()} == {"src/x.js", "src/page-frame.js", "src/app-wxss.js"}
    assert rows(recovery.renderer(files)) == {"a": ("app-wxss.js",)}


def test_deletions_placeholders_configs(spark):
    files = table(spark, "pkg_id string, path string", ("p", "a.js"), ("p", "b.js"), ("p", "x.wxml"))
    w = table(spark, "pkg_id string, path string, weight int", ("p", "a.js", 4), ("p", "a.js", 4), ("p", "b.js", 7))
    assert {r["path"] for r in recovery.after_deletions(files, w).collect()} == {"b.js", "x.wxml"}
    pages = table(spark, "pkg_id string, route string, config string", ("p", "x", "{}"), ("p", "../y", "{}"), ("p", "z", None))
    assert {r["path"] for r in recovery.placeholders(pages.where("route = 'x'"), files).collect()} == {"x.js", "x.json"}
    assert {r["path"] for r in recovery.page_configs(pages, files).collect()} == {"x.json"}


def test_components_and_imports(spark):
    pages = table(spark, "pkg_id string, route string", ("p", "a/x"), ("p", "b"))
    refs = table(spark, "pkg_id string, page string, ref string", ("p", "a/x", "/c/d"), ("p", "b", "c/d"), ("p", "b", "https://x"), ("p", "gone", "c/d"))
    assert [tuple(r) for r in recovery.marked_components(pages, refs).collect()] == [("p", "c/d", 2)]
    edges = table(spark, "pkg_id string, sheet string, imported string", ("p", "a", "s"), ("p", "b", "s"), ("p", "a", "t"), ("p", "a", "t"))
    assert {(r["imported"], r["action"]) for r in recovery.import_counts(edges).collect()} == {("s", "file"), ("t", "inline")}


def test_zip(spark):
    df = table(spark, "pkg_id string, path string, content binary", ("p", "b.js", bytearray(b"1" * 99)), ("p", "a/é.js", bytearray(b"")), ("q", "../x", bytearray(b"")), ("r", "x", bytearray(b"z")))
    packed = {r["pkg_id"]: bytes(r["archive"]) for r in archive.pack(df).collect()}
    assert set(packed) == {"p", "r"}
    z = zipfile.ZipFile(io.BytesIO(packed["p"]))
    assert z.namelist() == ["src/a/é.js", "src/b.js"] and z.read("src/b.js") == b"1" * 99
    got = archive.listing(archive.pack(df))
    assert {(r["pkg_id"], r["path"], r["size"]) for r in got.collect()} == {("p", "src/a/é.js", 0), ("p", "src/b.js", 99), ("r", "src/x", 1)}
    assert archive.directory(packed["p"][:-30])[1] == "no directory" and archive.directory(b"")[1] == "no directory"
    assert archive.directory(packed["r"].replace(b"PK\x01\x02", b"PK\x01\x03"))[1] == "directory cut off"
    errors = {r["pkg_id"]: r["error"] for r in archive.entry_list(table(spark, "pkg_id string, path string", ("a", "src/x"), ("b", "x"), ("c", "src/x"), ("c", "src/x"), ("d", "src/../x"))).collect()}
    assert errors == {"a": None, "b": "outside prefix", "c": "duplicate entry", "d": "unsafe entry"}


def test_requests(spark):
    df = table(spark, "n string, s long, k string", ("a.WXAPKG", 5, None), (None, 5, None), ("a.wxapkg", 60 << 20, ""), ("a.zip", 5, "wx0123456789abcdef"), ("a.wxapkg", 5, "wx1"))
    assert [r[0] for r in df.select(tasks.request_error(F.col("n"), F.col("s"), F.col("k"))).collect()] == [None, "no file", "too large", "wrong suffix", "bad key id"]
    now, good = datetime(2024, 5, 1, 12), "0b8f6f5e-1c3a-4e55-9a77-0123456789ab"
    df = table(spark, "i string, t timestamp", (good, now - timedelta(hours=11)), (good, now - timedelta(hours=13)), (good, now + timedelta(seconds=30)), (good, now + timedelta(minutes=3)), ("x", now), (good, None))
    assert [r[0] for r in df.select(tasks.stored_record_ok(F.col("i"), F.col("t"), F.lit(now))).collect()] == [True, False, True, False, False, False]


def test_projections(spark):
    df = table(spark, "task_id string, status string, percent int, error_code string, error string, message string", ("a", "failed", 5, "x", "e" * 600, "m"), ("b", "completed", 100, "x", "e", "m"), ("c", "running", 9, None, None, "m"))
    by = {r["task_id"]: r for r in tasks.public_tasks(df).collect()}
    assert len(by["a"]["error"]) == 500 and by["b"]["error"] is None and by["c"]["report_url"] is None and by["b"]["report_url"] == "/api/tasks/b/report"
    assert rows_of(tasks.events(df), "task_id", "type") == {"a": "error", "b": "complete", "c": "progress"}
    req = table(spark, "task_id string, name string", ("a", "report"), ("../a", "report"), ("a", "secrets"), ("..", "profile"))
    assert [(r["task_id"], r["file"]) for r in tasks.named_report(req).collect()] == [("a", "recovery-report.json")]
    states = table(spark, "s string, n long", ("running", None), ("failed", 0), ("partial", 9), ("completed", 0)).select(tasks.packaging_state(F.col("s"), F.col("n"))).collect()
    assert [r[0] for r in states] == ["pending", "unavailable", "ready", "pending"]


def rows_of(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_summaries(spark):
    t = table(spark, "task_id string", ("a",), ("b",))
    files = table(spark, "task_id string, path string, source string", ("a", "x", ""), ("a", "y", "odd"), ("a", "z", "fallback"))
    archives = table(spark, "task_id string, archive_size long", ("a", 7), ("b", 0))
    got = {r["task_id"]: (r["file_count"], r["sources"], r["ready"]) for r in tasks.artifact_summary(t, files, archives).collect()}
    assert got == {"a": (3, {"native": 1, "other": 1, "fallback": 1}, True), "b": (0, None, False)}
    entries = table(spark, "task_id string, path string", ("a", "src/x"), ("b", "src/x"), ("b", "report.json"))
    assert rows_of(tasks.repack(table(spark, "task_id string", ("a",), ("b",), ("c",)), entries), "task_id", "action") == {"a": "keep", "b": "repack", "c": "none"}
    facts = table(spark, "gate_ok boolean, manifest int, file_count int, archive_count int, unsafe_entries int, leaks int", (True, 100, 3, 3, 0, 0), (True, 99, 3, 3, 0, 0), (True, 100, 3, 2, 0, 0))
    assert [r["accepted"] for r in tasks.accepted(facts).collect()] == [True, False, False]
    leaks = table(spark, "text string", ("ok",), ("at /root/x",))
    assert tasks.reports_without_host_paths(leaks, "/root/").count() == 1


def test_formatter(spark):
    df = table(spark, "e boolean, s long, h boolean, b boolean, k string", (False, 1, True, False, "js"), (True, 5 << 20, True, False, "js"), (True, 5 << 20, False, False, "css"), (True, 1, True, True, "js"), (True, 1, True, False, "js"))
    why = tasks.format_decision(*(F.col(c) for c in "eshbk"))
    assert [r[0] for r in df.select(why).collect()] == ["formatter disabled", "file exceeds formatter limit", "formatter unavailable", "formatter circuit breaker open", None]
    df = table(spark, "w string, r string, f boolean, a string, b string", ("x", "", False, "1", "2"), (None, "", True, "1", "2"), (None, "skipped", False, "1", "2"), (None, "", False, "1", "1"), (None, "", False, "1", "2"))
    assert [r[0] for r in df.select(tasks.format_status(*(F.col(c) for c in "wrfab"))).collect()] == ["skipped", "failed", "skipped", "unchanged", "formatted"]
    runs = table(spark, "task_id string, stage string, seq int, success boolean, partial boolean", ("t", "js", 1, False, False), ("t", "js", 2, True, False), ("t", "js", 3, True, True))
    assert [(r["attempt"], r["status"]) for r in tasks.stage_attempts(runs).orderBy("seq").collect()] == [(1, "failed"), (2, "success"), (3, "partial")]


def test_clean_up_and_metrics(spark):
    files = table(spark, "task_id string, path string", ("a", "input/x"), ("a", "result/x"), ("b", "raw/x"))
    t = table(spark, "task_id string, status string, pages int, n int", ("a", "failed", 3, None), ("b", "running", 1, 2))
    assert {tuple(r) for r in tasks.without_work_files(files, t).collect()} == {("a", "result/x"), ("b", "raw/x")}
    assert {tuple(r) for r in tasks.stage_metrics(t, "classify", "pages", "n").collect()} == {("a", "classify", "pages", 3), ("b", "classify", "pages", 1), ("b", "classify", "n", 2)}


def test_reports(spark):
    import json

    t = table(spark, "task_id string, status string", ("a", "partial"), ("b", "failed"))
    profiles, scores = table(spark, "task_id string, variant string", ("a", "game")), table(spark, "task_id string, overall int", ("a", 70))
    stages = table(spark, "task_id string, seq int, stage string, success boolean, partial boolean, engine string", ("a", 2, "js", True, False, "native"), ("a", 1, "unpack", True, True, "/opt/x"))
    summaries = tasks.artifact_summary(t, table(spark, "task_id string, path string, source string", ("a", "x", "")), table(spark, "task_id string, archive_size long", ("a", 5)))
    got = {r["task_id"]: json.loads(r["report"]) for r in tasks.recovery_reports(t, profiles, scores, stages, summaries).collect()}
    assert got["a"]["profile"] == {"variant": "game"} and got["a"]["score"] == {"overall": 70} and got["a"]["packaging"] == {"status": "ready", "downloadReady": True, "archiveSize": 5}
    assert [(x["stage"], x["status"], x["engine"]) for x in got["a"]["stageResults"]] == [("unpack", "partial", ""), ("js", "success", "native")]
    assert got["b"]["packaging"]["status"] == "unavailable" and "profile" not in got["b"] and got["b"]["artifacts"]["fileCount"] == 0
    df = table(spark, "s string", ("completed",), ("queued",), ("",), (None,))
    assert [r[0] for r in df.select(tasks.ui_state(F.col("s"))).collect()] == ["completed", "processing", "idle", "idle"]
