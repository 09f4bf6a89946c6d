import posixpath

import pytest
from pyspark.sql import functions as F

from tarn.functions import paths, scalars

PATHS = ["a/b", "/a/../b", "a/./b//c", "../x", "a/../../x", "", ".", "..", "/", "//a", "a/..", "a\\b", "c:/x", "pages/index", "a/b/", "...", "a/...", "/.."]


def values(spark, column, data):
    return [r["v"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x string").select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_clean(spark):
    want = [posixpath.normpath(p).replace("//", "/") if p else "." for p in PATHS]
    assert values(spark, paths.clean, PATHS) == want


def test_safe_paths(spark):
    got = dict(zip(PATHS, values(spark, paths.output_path, PATHS), strict=True))
    assert got["/a/../b"] == "b" and got["../x"] is None and got["//a"] == "a" and got["a\\b"] is None and got["c:/x"] is None and got["..."] == "..." and got["/"] is None
    got = dict(zip(PATHS, values(spark, paths.zip_entry_ok, PATHS), strict=True))
    assert [p for p, ok in got.items() if ok] == ["a/b", "pages/index", "...", "a/..."]
    got = dict(zip(PATHS, values(spark, paths.fallback_path, PATHS), strict=True))
    assert got["a\\b"] == "a/b" and got["a/../../x"] is None and got["/a/../b"] is None
    got = dict(zip(PATHS, values(spark, paths.page_base, PATHS), strict=True))
    assert got["/a/../b"] is None and got["a/.."] == "." and got["a/../../x"] is None


@pytest.mark.parametrize(("page", "ref", "want"), [("pages/a/b", "../c/d", "pages/c/d"), ("pages/a", "/x/y", "x/y"), ("", "./k", "k"), ("p/a", "../../x", None), ("p/a", "https://x", None), ("p/a", "", None), ("a", "b", "b")])
def test_resolve(spark, page, ref, want):
    assert spark.range(1).select(paths.resolve(F.lit(page), F.lit(ref)).alias("v")).first()["v"] == want


def test_relative(spark):
    cases = [("a/b/c.js", "a/d.js"), ("x.js", "a/b.js"), ("a/b/c", "a/b/d"), ("a/b", "c/d/e")]
    for s, t in cases:
        assert spark.range(1).select(paths.relative(F.lit(s), F.lit(t)).alias("v")).first()["v"] == posixpath.relpath(t, posixpath.dirname(s) or ".")


def test_walk_order(spark):
    df = spark.createDataFrame([("a.js",), ("a/x",), ("a-b/x",)], "p string")
    assert [r["p"] for r in df.orderBy(paths.walk_order(F.col("p"))).collect()] == ["a/x", "a-b/x", "a.js"]


def test_ratio_cuts(spark):
    df = spark.createDataFrame([(29, 100), (57, 100), (1, 3), (5, 0), (50, 100)], "a int, b int")
    assert [r["v"] for r in df.select(scalars.ratio(F.col("a"), F.col("b")).alias("v")).collect()] == [28, 56, 33, 0, 50]


def test_sizes_and_durations(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (1048576,), (-1,), (None,), (999,), (9_940,), (59_400,), (61_000,), (120_000,)], "n long")
    rows = df.select(scalars.bytes_text(F.col("n")).alias("b"), scalars.duration_text(F.col("n")).alias("d")).collect()
    assert [r["b"] for r in rows[:7]] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "", ""]
    assert [r["d"] for r in rows[6:]] == ["", "999 ms", "9.9 s", "59 s", "1 min 1 s", "2 min"]


ROUTES = {"pages/home/index": True, "pages/a.html": False, "/pages/a": False, "a/": False, " a": False, "a?b": False, "../a": False, "a/../b": False, ".": False, "": False, "a\\b": False, "a//b": False, "a.b": True, "a/..b": True}


def test_routes(spark):
    assert dict(zip(ROUTES, values(spark, scalars.valid_route, list(ROUTES)), strict=True)) == ROUTES
    assert values(spark, scalars.normal_route, ["/pages/index/index.html", "pages/user/profile.wxml", " a\\b.JS ", "x.js.html"]) == ["pages/index/index", "pages/user/profile", "a/b", "x.js"]


def test_kinds(spark):
    files = ["app.js", "workers.js", "a/b.wxs", "p/i.wxml", "x.HTML", "s.wxss", "app.json", "page-frame.js", "noext"]
    assert values(spark, scalars.file_kind, files) == ["script", "script", "script", "template", "template", "style", "asset", "script", "asset"]
    assert values(spark, scalars.script_kind, files)[:3] == ["app", "worker", "wxs"]
    assert values(spark, scalars.source_tag, files)[-2:] == ["runtime", "native"]


def test_events(spark):
    names = ["bindtap", "bind:change", "binding", "catchtouchmove", "capture-bind:x", "bind:", "BINDTAP", "data-bind"]
    assert values(spark, scalars.event_attribute, names) == [True, True, False, True, True, False, True, False]
    handlers = ["onTap", "card active", "", "Empty", "{{h}}", "a.b", "a.b.c", " x "]
    assert values(spark, scalars.suspicious_handler, handlers) == [False, True, True, True, False, False, True, False]


def test_text_predicates(spark):
    texts = ["plain\ttext\r\n", "a\0b", "x" * 600 + "\0", "a\x01b"]
    assert values(spark, scalars.likely_text, texts) == [True, False, True, True]
    assert values(spark, scalars.no_control_in_head, texts) == [True, False, True, False]
    assert values(spark, scalars.no_control_anywhere, texts) == [True, False, False, False]


def test_axis(spark):
    df = spark.createDataFrame([(0,), (5,), (13,), (100,), (999,), (31,)], "t long")
    assert [r["v"] for r in df.select(scalars.nice_step(F.col("t")).alias("v")).collect()] == [1, 1, 5, 20, 200, 10]


def test_escape(spark):
    assert values(spark, scalars.xml_escape, ["<a href=\"x\">'&'"]) == ["&lt;a href=&quot;x&quot;&gt;&apos;&amp;&apos;"]
    assert values(spark, lambda c: scalars.occurrences(c, "ab"), ["ababab", "a", ""]) == [3, 0, 0]
