import json

from pyspark.sql import functions as F

from tarn.functions import references, scrub
from tarn.operators import trees

TEXTS = [
    "", "plain words", "/srv/tasks/1/result/src/a.js", "at /srv/tasks/1/result/src/a.js, and C:\\work\\y.js; \\\\host\\share\\z", "see https://host/home/x and file:///root/x.txt or FILE://C:/d/e", "a://", "b://x/y/", "/", "/..", "../a/b", "a/../../b", "./a//b/.",
    "/x/fallback/input/q.js", "/x/fallback/q.js", "/reports/", "/a/reports/b/reports/c.json", "C:foo", "x /tmp/a b", "http://", "wss://host/p?q=/etc/x", "/opt/https://x.y/z", "mixed é /home/é/x.js.", "x:/a\\b", "s3://b/result/x y", "(/var/log/x)", "/app", "in /app now",
]
DOCS = [
    {"a": {"b": [{"files": ["home/a.js", "/home/b/c.js", "../x", "a:b", 5, ["/tmp/q"]], "metrics": {"pageCount": 3, "zipPath": "/tmp/x", "mode": "plain", "variant": "odd", "used": True, "failed": -1, "native": 2.0, "pages": 1.5, "scripts": "4", "styles": [1]}, "path": "/opt/x/y"}]}},
    {"metrics": {"x": 1}, "deep": [[[{"k": ["/etc/passwd", None, True, 1, -2]}]]], "z": {}, "y": []}, [], {}, "in /home/x/y.js", 5, None, True, ["/tmp/a"], {"metrics": [{"p": "/srv/x"}], "files": "/srv/result/f", "m": {"metrics": "at /srv/q"}}, {"b": 1, "a": {"metrics": {"metrics": {"pageCount": 1}}}, "é\"": "x\ny"},
]


def test_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", references.text(F.col("t")).alias("text"), references.path(F.col("t")).alias("path"), references.relative_file(F.col("t")).alias("file"))
    got = {r["i"]: (r["text"], r["path"], r["file"]) for r in df.collect()}
    want = {i: (scrub.text(t), scrub.path(t), scrub.relative_file(t)) for i, t in enumerate(TEXTS)}
    assert {TEXTS[i]: (v, want[i]) for i, v in got.items() if v != want[i]} == {}


def test_documents_as_without_rows(spark):
    texts = [json.dumps(d, ensure_ascii=False) for d in DOCS] + [None, "{", "1 2", '{"a": 1, "a": "/srv/b"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").withColumn("node", F.lit(1)).withColumn("kids", F.lit(2))
    got = {r["doc_id"]: r["text"] for r in trees.published(df).collect()}
    want = {i: scrub.json_text(t) if t is not None else None for i, t in enumerate(texts)} | {len(texts) - 1: None}
    plain = lambda t: t and t.replace('"native":2.0', '"native":2')
    want = {i: plain(t) for i, t in want.items()}
    assert {texts[i]: (v, want[i]) for i, v in got.items() if v != want[i]} == {} and len(got) == len(want)


def test_empty(spark):
    assert trees.published(spark.createDataFrame([], "doc_id int, text string")).collect() == []
