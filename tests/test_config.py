import json

from pyspark.sql import functions as F

from tarn.functions import labels, scalars
from tarn.operators import config, integrity, manifest, merge, tasks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pages_by_package(spark):
    text = json.dumps({
        "entryPagePath": "pages/home.html", "pages": ["/pages/a.html", "pages/home", "pages/a", "../x", 7, "sub/b", ""],
        "subPackages": [{"root": "/sub/", "pages": ["b", "sub/c.html", "c", "../../out", None, "../pages/z"]}, {"pages": ["x"]}, 3, {"root": "t", "pages": "none"}],
    })
    df = spark.createDataFrame([("p", text), ("q", "[]"), ("r", None), ("s", "{")], "pkg_id string, text string")
    got = rows(config.package_pages(df))
    assert got == sorted([("p", None, 0, "pages/home"), ("p", None, 1, "pages/a"), ("p", "sub/", 0, "b"), ("p", "sub/", 1, "c")], key=str)


def test_page_configurations(spark):
    page = lambda **uses: {"window": {"title": 'a "b"', "usingComponents": uses}}
    text = json.dumps({"page": {
        "/pages/a.html": page(x="../c/x", y="/c/y.wxml", z="../../out", n=5, u="..\\\\c\\\\w"), "c/x.html": {"window": {"component": False, "usingComponents": {"y": "y", "self": "x"}, "k": [1, {"b": 2, "a": 1}]}}, "../no.html": {},
        "pages/b.html": 7, "d.html": {"window": [1]}, "pages/a2.html": {"other": 1}, "/pages/a2.html": {"window": {"last": True}},
    }})
    df = spark.createDataFrame([("p", text), ("q", "[]"), ("r", None), ("s", '{"page": [1]}'), ("t", "{")], "pkg_id string, text string").withColumn("page", F.lit("clash"))
    own, uses, told = config.page_configurations(df)
    got = {r["page"]: (json.loads(r["window"]), r["component"]) for r in own.collect()}
    assert set(got) == {"pages/a.html", "c/x.html", "c/y.html", "c/w.html", "pages/b.html", "d.html", "pages/a2.html"}
    assert got["c/x.html"] == ({"component": True, "usingComponents": {"y": "y", "self": "x"}, "k": [1, {"b": 2, "a": 1}]}, True) and list(got["c/x.html"][0]) == ["component", "usingComponents", "k"]
    assert got["c/y.html"] == ({"component": True}, True) and got["pages/b.html"] == ({}, False) and got["d.html"] == ({}, False) and got["pages/a2.html"] == ({"last": True}, False)
    assert rows(uses) == [("p", "c/x.html", "c/x.html"), ("p", "c/x.html", "c/y.html"), ("p", "pages/a.html", "c/w.html"), ("p", "pages/a.html", "c/x.html"), ("p", "pages/a.html", "c/y.html")]
    assert rows(told) == [("p", "component_path_unsafe", "pages/a.html", "../../out"), ("p", "page_config_unsafe", None, "../no.html")]
    pages = spark.createDataFrame([("p", "pages/a.html"), ("p", "pages/gone.html"), ("o", "pages/a.html")], "pkg_id string, page string")
    assert rows(config.component_closure(pages, uses)) == [("o", "pages/a.html", 0), ("p", "c/w.html", 1), ("p", "c/x.html", 1), ("p", "c/y.html", 1), ("p", "pages/a.html", 0), ("p", "pages/gone.html", 0)]


def test_closure_ends_on_cycles(spark):
    uses = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("p", "c", "d"), ("p", "x", "y")], "pkg_id string, page string, component string")
    pages = spark.createDataFrame([("p", "a")], "pkg_id string, page string")
    assert rows(config.component_closure(pages, uses)) == [("p", "a", 0), ("p", "b", 1), ("p", "c", 2), ("p", "d", 3)]
    assert config.component_closure(pages.limit(0), uses).collect() == []


def test_games(spark):
    files = [("g", "game.js", "x"), ("g", "app-config.json", '{"b": 1, "subContext": 2, "a": [1, "2"]}'), ("a", "app-service.js", "x"), ("a", "game.js", "x"), ("a", "app-config.json", "{}"), ("s", "x/game.js", "x"), ("h", "game.js", ""), ("h", "app-config.json", "[")]
    df = spark.createDataFrame(files, "pkg_id string, path string, text string")
    assert rows(config.package_route(df)) == [("a", "app"), ("g", "game"), ("h", "game"), ("s", "subpackage")]
    got = {(r["pkg_id"], r["path"]): r["text"] for r in config.game_files(df).collect()}
    assert json.loads(got.pop(("g", "game.json"))) == {"b": 1, "a": [1, "2"]}
    assert got == {(p, n): t for p, n, t in files if (p, n) != ("g", "app-config.json")}


def test_icons(spark):
    icons = spark.createDataFrame([("p", 1, "data:image/png;base64,YWI="), ("p", 2, "YWI="), ("p", 3, "??"), ("p", 4, None), ("q", 5, "YWI=")], "pkg_id string, item int, icon string")
    files = spark.createDataFrame([("p", "z", b"ab"), ("p", "b", b"ab"), ("p", "a", b"x")], "pkg_id string, path string, content binary")
    assert rows(config.icon_matches(icons, files).select("item", "icon_path")) == [(1, "b"), (2, "b"), (3, None), (4, None), (5, None)]


def test_modules(spark):
    refs = spark.createDataFrame([("p", "a/b", "m", "p:x"), ("p", "a/b", "n<", "w"), ("p", "a/b", "o", "./c.wxs"), ("p", "a/b", "u", "../../c")], "pkg_id string, page string, module string, ref string")
    inline = spark.createDataFrame([("p", "p:x", "code"), ("p", "w", "unused without a colon")], "pkg_id string, ref string, source string")
    outputs = spark.createDataFrame([("p", "w", "u/w.wxs")], "pkg_id string, ref string, path string")
    assert rows(config.module_tags(refs, inline, outputs)) == [("p", "a/b", "m", "inline", "code"), ("p", "a/b", "n&lt;", "written", "../u/w.wxs"), ("p", "a/b", "o", "named", "c.wxs")]


def test_sets_and_counts(spark):
    ab = lambda s: spark.createDataFrame([(c,) for c in s], "k string")
    assert rows(merge.set_differences(ab("abc"), ab("bcdd"), ["k"])) == [(1, 1, 1)] and rows(merge.set_differences(ab("a"), ab("a"), ["k"])) == [(0, 0, 0)]
    assert rows(merge.set_differences(ab(""), ab(""), ["k"])) == [(0, 0, 0)]
    files = spark.createDataFrame([("p", "formatted"), ("p", "odd"), ("p", None), ("q", "skipped")], "pkg_id string, status string")
    assert rows(tasks.status_counts(files, "pkg_id")) == [("p", 1, 0, 0, 2, True), ("q", 0, 0, 1, 0, False)]


def test_durations(spark):
    schema = "task_id string, stage string, at_ms long"
    starts, ends = spark.createDataFrame([("t", "s", 5), ("t", "s", 9), ("t", "s", 50)], schema), spark.createDataFrame([("t", "s", 7), ("t", "s", 9), ("t", "r", 4)], schema)
    assert rows(tasks.stage_durations(starts, ends)) == [("t", "r", 4, 0), ("t", "s", 7, 2), ("t", "s", 9, 0)]


def test_labels_and_metrics(spark):
    df = spark.createDataFrame([("formatting", "native", '{"n": 2.9, "m": -2.9, "s": "x", "b": true}', b"abcdef"), ("?", "other", "{}", b""), (None, None, None, None)], "stage string, engine string, m string, out binary")
    v = F.try_parse_json("m")
    got = df.select(labels.stage_label(F.col("stage")), labels.engine_label(F.col("engine")), scalars.metric_number(v, "n"), scalars.metric_number(v, "m"), scalars.metric_number(v, "b"), scalars.metric_text(v, "s"), scalars.metric_text(v, "n"), scalars.last_bytes(F.col("out"), 2)).collect()
    assert list(map(tuple, got)) == [("整理代码格式", "内置反编译", 2, -2, None, "x", "", b"ef"), ("处理当前步骤", "other", None, None, None, "", "", b""), ("处理当前步骤", "", None, None, None, "", "", None)]
    states = [("partial", False, True), ("success", False, False), ("queued", None, None), ("x", True, True), ("x", None, True), (None, None, None)]
    tones = spark.createDataFrame(states, "status string, partial boolean, success boolean").select(labels.stage_tone(F.col("status"), F.col("partial"), F.col("success")))
    assert [r[0] for r in tones.collect()] == ["warning", "success", "neutral", "warning", "success", "danger"]


def test_malformed_and_layers(spark):
    files = spark.createDataFrame([("a", "app.json", "{"), ("b", "app.json", "[]"), ("c", "app.json", "{}"), ("d", "x.json", "{"), ("c", "p.json", '{"component": true}'), ("c", "app-service.js", "__wxAppCode__['p.json'] = {\"component\": false}; __wxAppCode__['q.json'] = {}"), ("d", "app-service.js", "__wxAppCode__['p.json'] = {\"component\": true}; __wxAppCode__['p.json'] = {}")], "pkg_id string, path string, text string")
    assert rows(manifest.malformed(files).select("pkg_id")) == [("a",), ("b",)]
    assert not {r["pkg_id"] for r in manifest.pages(files.unionByName(files.where("pkg_id = 'a'").selectExpr("pkg_id", "'x.js' as path", "text"))).collect()} & {"a", "b"}
    assert manifest.fields(files.unionByName(files.where("pkg_id = 'a'").selectExpr("pkg_id", "'app-config.json' as path", "'{\"pages\": [\"p\"]}' as text"))).count() == 0
    got = {(r["pkg_id"], r["route"]) for r in manifest.pages(files).where("source = 'page-json-inferred'").collect()}
    assert got == {("c", "q"), ("d", "p")}


def test_marker_is_a_parameter(spark):
    df = spark.createDataFrame([("<!-- own: text gone --><!-- x-recovery: unresolved text omitted -->",)], "text string")
    count = lambda *marker: df.select(integrity.markup_counters(F.col("text"), *marker)["text_markers"]).first()[0]
    assert count() == 1 and count("<!-- own: {} gone -->") == 1 and count("<!-- other: {} -->") == 0


def test_checked_files(spark):
    files = spark.createDataFrame([("p", "a.js", 1, ""), ("p", "b.wxs", 1, ""), ("p", "c.css", 1, ""), ("p", "d.wxml", 1, "<a>"), ("p", "e.wxml", 3 << 20, "<a>"), ("p", "f.wxml", 1, None), ("p", "g.json", 1, "{")], "pkg_id string, path string, size int, text string")
    said = spark.createDataFrame([("p", "a.js", None), ("p", "c.css", "odd")], "pkg_id string, path string, error string")
    got = integrity.checked_files(files, said)
    assert rows(got.select("path", "class", "skipped", "error")) == [("a.js", "js", False, None), ("b.wxs", "js", False, "not parsed"), ("c.css", "wxss", False, "odd"), ("d.wxml", "wxml", False, "unclosed tag <a>"), ("e.wxml", "wxml", True, None), ("f.wxml", "wxml", False, None)]
    assert rows(integrity.parse_counts(got)) == [("p", 2, 1, 3, 2, 1, 0, 1)]
