import json

import pytest
from pyspark.sql import functions as F

from tarn.operators import diagnostics, integrity, manifest, merge

FILES = "pkg_id string, ord int, path string, text string"


def files(spark, **packages):
    rows = [(p, i, path, text) for p, found in packages.items() for i, (path, text) in enumerate(found.items())]
    return spark.createDataFrame(rows, FILES)


def routes(df):
    out = {}
    for r in df.orderBy("pkg_id", "ord").collect():
        out.setdefault(r["pkg_id"], []).append((r["route"], r["source"], r["confidence"]))
    return out


SCRIPT = """var x; __wxAppCode__['app.json'] = {"pages": ["r/a", 5, "r/b"], "workers": "w"};
__wxAppCode__['r/a.json'] = {"s": "}{", "usingComponents": {}}; __wxAppCode__['bad.json'] = {oops}; __wxAppCode__['r/a.wxml'] = function(){ return {} };
__LAZY_CODE_LOADING_CHUNK_MAP__ = [['__COMMON__',['p/x','p/y']],['pk1',['q/z',]]].forEach(f)"""


def test_manifest_layers(spark):
    df = files(
        spark,
        conf={"app-config.json": json.dumps({"pages": ["a/b.html", "/c"], "global": {"window": {"t": "Demo"}}}), "a/b.js": ""},
        both={"app.json": json.dumps({"pages": ["x"], "debug": True}), "app-config.json": json.dumps({"pages": ["y"], "window": {"k": 1}})},
        empty={"app.json": '{"pages": []}', "p/q.json": "{}", "p/q.wxml": ""},
        runtime={"app-service.js": SCRIPT, "z/z.json": "{}"},
        inferred={"p/b.json": "{}", "p/a.json": "{}", "components/c.json": "{}", "d.json": '{"component": true}', "sitemap.json": "{}"},
        scan={"app-service.js": "", "pages/i.js": "", "pages/i.wxml": "", "common/x.js": "", "components/k.js": "", "app.js": ""},
        bad={"app.json": "{not json", "q/w.wxml": ""},
    )
    got = routes(manifest.pages(df))
    assert got["conf"] == [("a/b", "app-config.json", "authoritative"), ("c", "app-config.json", "authoritative")]
    assert got["both"] == [("x", "app.json", "authoritative")]
    assert "empty" not in got
    assert got["runtime"] == [("r/a", "app-service.js", "runtime"), ("r/b", "app-service.js", "runtime")]
    assert [r[0] for r in got["inferred"]] == ["p/a", "p/b"] and got["inferred"][0][2] == "inferred"
    assert [r[0] for r in got["scan"]] == ["app-service", "pages/i"] and got["scan"][0][1:] == ("directory-scan", "fallback")
    by = {(r["pkg_id"], r["field"]): (r["source"], json.loads(r["value"])) for r in manifest.fields(df).collect()}
    assert by["conf", "window"] == ("app-config.json", {"t": "Demo"}) and by["both", "debug"] == ("app.json", True)
    assert ("both", "window") not in by and by["empty", "pages"] == ("app.json", []) and by["runtime", "workers"] == ("app-service.js", "w")


def test_script_documents_and_chunks(spark):
    df = files(spark, p={"app-service.js": SCRIPT})
    assert [(r["path"], json.loads(r["doc"])) for r in manifest.script_documents(df).collect()][1] == ("r/a.json", {"s": "}{", "usingComponents": {}})
    assert {(r["page"], r["chunk"]) for r in manifest.lazy_chunks(df).collect()} == {("p/x", "common.app.js"), ("p/y", "common.app.js"), ("q/z", "pk1.appservice.js")}
    assert manifest.assignments("__wxAppCode__['a.json'] = {\"x\": \"{\" ") == [] == manifest.assignments("none")


def test_tabbar(spark):
    doc = {"pages": ["pages/index/index"], "tabBar": {"list": [{"pagePath": "pages/index/index.html"}, {"pagePath": "other"}, {"text": "x"}, "odd", {"pagePath": "pages/index/index"}]}}
    df = files(spark, p={"app.json": json.dumps(doc)})
    tabs = manifest.tabbar(df)
    assert [(r["page_path"], r["changed"]) for r in tabs.orderBy("ord").collect()] == [("pages/index/index", True), ("other", False), (None, False), (None, False), ("pages/index/index", False)]
    marked = integrity.tabbar_issues(tabs, manifest.pages(df))
    assert [r["status"] for r in marked.orderBy("ord").collect()] == ["ok", "unregistered", "item", "item", "duplicate"]


def test_page_issues_and_pairs(spark):
    pages = spark.createDataFrame([("p", i, r) for i, r in enumerate(["a", "a", "b.html", "../c", "d", "e"])] + [("q", 0, "a")], "pkg_id string, ord int, route string")
    have = spark.createDataFrame([("p", "a.js"), ("p", "a.wxml"), ("p", "e.json"), ("p", "d.wxss")], "pkg_id string, path string")
    rows = integrity.page_issues(pages, have)
    assert [r["status"] for r in rows.where("pkg_id = 'p'").orderBy("ord").collect()] == ["ok", "duplicate", "invalid", "invalid", "missing", "ok"]
    packs = spark.createDataFrame([("p",), ("q",), ("none",)], "pkg_id string")
    tabs = spark.createDataFrame([], "pkg_id string, ord int, page_path string, status string")
    got = {r["pkg_id"]: tuple(r)[1:] for r in integrity.manifest_summary(packs, rows, tabs).collect()}
    assert got == {"p": (6, 4, 3, 0, False), "q": (1, 1, 1, 0, False), "none": (0, 1, 0, 0, False)}
    assert {r["route"]: r["has_pair"] for r in integrity.page_pairs(pages.where("pkg_id = 'p'"), have).collect()}["a"]


def test_markup_quality(spark):
    markers = "<!-- some-recovery: unresolved text omitted -->" * 2 + "<!-- some-recovery: unresolved attributes omitted -->" * 2
    rows = [
        ("p", "a.wxml", '<button bindtap="Empty">Empty</button><button catchtap=\'Empty\'>x</button><view bindtap="card active"/>'), ("p", "b.wxml", markers), ("p", "c.wxml", '<view bindtap="{{h}}" bind:tap="{{g}}"/>'),
        ("p", "d.wxml", '<a bindtap="onTap" bind:change="x.y" binding="card active"/><b>Empty</b><!-- Empty -->'),
    ]
    counted = integrity.markup_quality(spark.createDataFrame(rows, "pkg_id string, path string, text string"))
    by = {r["path"]: (r["placeholders"], r["text_markers"], r["attribute_markers"], r["suspicious"], r["dynamic"], r["has_issue"]) for r in counted.collect()}
    assert by == {"a.wxml": (3, 0, 0, 3, 0, True), "b.wxml": (0, 2, 2, 0, 0, True), "c.wxml": (0, 0, 0, 0, 2, False), "d.wxml": (0, 0, 0, 0, 0, False)}
    missing = spark.createDataFrame([("p", "c.wxml"), ("p", "a.wxml")], "pkg_id string, path string")
    total = integrity.quality_summary(counted, missing).first()
    assert total["issue_files"] == 3 and total["dynamic_files"] == 1 and total["placeholders_files"] == 1


def test_missing_references(spark):
    refs = spark.createDataFrame([("p", "a/x.wxml", "import", s) for s in ("y.wxml", "../b", "/c.wxml?q", "{{d}}", "//cdn/x", "gone", "../../up")] + [("p", "a/x.wxml", "wxs", "m")], "pkg_id string, path string, tag string, src string")
    have = spark.createDataFrame([("p", f) for f in ("a/y.wxml", "b.wxml", "c.wxml", "a/m.wxs")], "pkg_id string, path string")
    assert {r["src"] for r in integrity.missing_references(refs, have).collect()} == {"gone", "../../up"}


FACTS = "page_count int, manifest_issues int, missing_pages int, invalid_tabs int, manifest_ok boolean, total_pages int, js_files int, js_ok int, wxml_files int, wxml_ok int, wxss_files int, wxss_ok int, issue_files int, missing_pairs int, gate_ok boolean, fallback_used boolean"


@pytest.mark.parametrize(("facts", "want"), [
    ((10, 0, 0, 0, True, 10, 10, 8, 10, 5, 7, 4, 0, 4, False, True), {"overall": 47, "penalty": 10, "wxss": 57}),
    ((19, 2, 0, 0, False, 19, 19, 19, 34, 34, 0, 0, 31, 0, False, False), {"manifest": 89, "wxml": 8, "wxss": 100, "overall": 68}),
    ((0, 1, 0, 0, False, 0, 0, 0, 0, 0, 0, 0, 0, 0, False, False), {"manifest": 0, "js": 0, "wxss": 0, "overall": 0}),
    ((1, 0, 0, 0, True, 1, 1, 1, 1, 1, 1, 1, 0, 0, True, False), {"overall": 100}),
    ((1, 0, 0, 0, False, 1, 1, 1, 1, 1, 0, 0, 1, 0, False, False), {"manifest": 80, "wxml": 0}),
])
def test_score(spark, facts, want):
    row = integrity.score(spark.createDataFrame([facts], FACTS)).first()
    assert {k: row[k] for k in want} == want and 0 <= row["overall"] <= 100


def test_status(spark):
    df = spark.createDataFrame([(0, False, True, False, 0, True), (3, True, True, False, 0, True), (3, False, False, False, 0, True), (3, False, True, False, 0, True), (3, False, True, True, 0, True), (3, False, True, False, 1, True), (3, False, True, False, 0, None)], "n int, c boolean, m boolean, p boolean, i int, a boolean")
    got = [r[0] for r in df.select(integrity.final_status(*(F.col(x) for x in "ncmpia"))).collect()]
    assert got == ["failed", "failed", "partial", "completed", "partial", "partial", "partial"]


def test_merge(spark):
    native = spark.createDataFrame([("p", 0, "a", "1"), ("p", 1, "b", "2")], "pkg_id string, ord int, path string, text string")
    fallback = spark.createDataFrame([("p", 0, "a", "1"), ("p", 1, "b", "9"), ("p", 2, "c", "3")], "pkg_id string, ord int, path string, text string")
    assert {r["path"]: r["outcome"] for r in merge.merge_outcome(native, fallback, ["pkg_id", "path"], "text").collect()} == {"a": "identical", "b": "preserved", "c": "added"}
    merged = merge.insert_only(native, fallback, ["pkg_id", "path"])
    assert {r["path"]: r["text"] for r in merged.collect()} == {"a": "1", "b": "2", "c": "3"}
    assert merge.insert_only(merged, fallback, ["pkg_id", "path"]).count() == 3
    known = spark.createDataFrame([("p", "a", "fallback"), ("p", "zz", "native")], "pkg_id string, path string, source string")
    assert {r["path"]: r["source"] for r in merge.with_provenance(native, known).collect()} == {"a": "fallback", "b": "native"}


def test_best_source_and_breakdown(spark):
    df = spark.createDataFrame([("p", 0, "a", "fallback"), ("p", 1, "b", "x"), ("p", 2, "a", "native"), ("p", 3, "a", "manifest"), ("p", 4, "c", "")], "pkg_id string, ord int, path string, source string")
    assert [(r["ord"], r["path"], r["source"]) for r in merge.best_source(df).orderBy("ord").collect()] == [(0, "a", "native"), (1, "b", "x"), (4, "c", "")]
    assert {r["source"]: r["n"] for r in merge.source_breakdown(df, "pkg_id").collect()} == {"fallback": 1, "x": 1, "native": 2, "manifest": 1}


def test_sequences(spark):
    df = spark.createDataFrame([("t", i, s, p) for i, (s, p) in enumerate([("q", 1), ("q", 1), ("r", 1), ("q", 1), ("q", None), ("q", None)])], "k string, i int, s string, p int")
    assert [r["i"] for r in merge.changed(df, ["k"], ["i"], ["s", "p"]).orderBy("i").collect()] == [0, 2, 3, 4]
    assert [r["i"] for r in merge.tail(df, ["k"], ["i"], 2).orderBy("i").collect()] == [4, 5]
    ends = spark.createDataFrame([("p", 0, 10), ("p", 1, 5), ("p", 2, 20)], "p string, o int, e int")
    assert [r["seen_end"] for r in merge.running_end(ends, ["p"], ["o"], "e").orderBy("o").collect()] == [None, 10, 10]
    runs = spark.createDataFrame([("t", "js", 1), ("t", "js", 4), ("t", "css", 2)], "task_id string, stage string, seq int")
    assert [(r["seq"], r["attempt"]) for r in merge.attempts(runs).orderBy("seq").collect()] == [(1, 1), (2, 1), (4, 2)]


def test_common_folder(spark):
    df = spark.createDataFrame([("p", x) for x in ("a/b/c.js", "a/b/d/e.js", "a/b/c/x.js")] + [("q", "m.js"), ("q", "n/o.js"), ("r", "k/l.js"), ("s", "ab/x"), ("s", "abc/x")], "p string, f string")
    assert {r["p"]: r["folder"] for r in merge.common_folder(df, "p", "f").collect()} == {"p": "a/b", "q": "", "r": "k", "s": ""}


def test_diagnostics(spark):
    rows = [(0, "verify.js.unparsable", "warn"), (1, "recover.js.page.missing", "warn"), (2, "recover.js.page.x", "error"), (3, "odd", "error"), (4, "odd", "info"), (5, "verify.js.unparsable", "warn"), (6, "verify.wxss.unparsable", "warn"), (7, "odd2", "warn"), (5, "verify.js.unparsable", "warn")]
    df = spark.createDataFrame([(*r, "s", "f", "m" * 200) for r in rows], "seq int, code string, severity string, stage string, file string, message string")
    assert diagnostics.dedupe(df).count() == 7
    got = [(r["class"], r["n"], r["tone"]) for r in diagnostics.in_order(diagnostics.grouped(df)).collect()]
    assert got == [("page-logic", 2, "danger"), ("other-error", 1, "danger"), ("source-parse", 4, "warning"), ("other-warn", 1, "warning")]
    assert [len(r["message"]) for r in diagnostics.short_list(df, 2).collect()] == [120, 120]


def test_app_json_and_subpackages(spark):
    own = {"pages": ["/a.html", 3], "odd": {"k": 1}, "subpackages": [{"root": "s", "pages": ["p", 1], "x": 2}, "no", {"pages": "none"}], "usingComponents": {"a": "b", "c": 1}, "tabBar": {"list": [{"pagePath": "/a.html"}, 5]}}
    df = files(spark, p={"app.json": json.dumps(own)}, q={"app-config.json": json.dumps({"pages": ["z"], "subPackages": [{"root": "r"}], "window": {"t": 1}})}, r={"x.js": ""}, bad={"app.json": "{", "y.wxml": ""})
    got = {r["pkg_id"]: json.loads(r["text"]) for r in manifest.app_json(df).collect()}
    assert got["p"] == {**own, "pages": ["a"], "usingComponents": {"a": "b"}, "tabBar": {"list": [{"pagePath": "a"}, 5]}}
    assert got["q"] == {"pages": ["z"], "subPackages": [{"root": "r"}], "window": {"t": 1}}
    assert got["r"] == {"pages": ["x"]} and set(got) == {"p", "q", "r"}  # a malformed app.json ends its package
    assert [(r["pkg_id"], r["root"], r["pages"]) for r in manifest.subpackages(df).orderBy("pkg_id", "ord").collect()] == [("p", "s", ["p"]), ("p", "", []), ("q", "r", [])]
