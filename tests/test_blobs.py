import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tarn.sources import blobs, container

FILES = {"app.json": b"{}", "pages/a.js": b"x" * 5000, "pages/b.js": b"y" * 70_000, "z": b""}


class Counting(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        got = super().read(n)
        self.read_bytes += len(got)
        return got


def reader(kind, wanted=lambda _: True, **options):
    made = kind({"path": "x"} | options)
    return lambda data: list(made.rows(data, len(data.getvalue()), wanted))


def test_only_the_bytes_asked_for():
    data = container.encode(FILES)
    index = container.read_index(data)[0]
    overhead = len(data) - sum(map(len, FILES.values()))
    f = Counting(data)
    assert [r[1:4] for r in reader(blobs.PackageReader, content="false")(f)] == index and f.read_bytes == overhead
    f = Counting(data)
    got = reader(blobs.PackageReader, lambda n: n == "pages/a.js")(f)
    assert [(r[1], r[4]) for r in got] == [("pages/a.js", b"x" * 5000)] and f.read_bytes == overhead + 5000
    f = Counting(data)
    assert {r[1]: r[4] for r in reader(blobs.PackageReader)(f)} == FILES


@pytest.mark.parametrize("data", [b"", b"short", container.MARKER + b"x" * 50, b"\x00" * 20, b"\xbe" + b"\x00" * 20, container.encode(FILES)[:100], b"\xbe" + b"\x00" * 8 + b"\xff\xff\xff\xff\xed"])
def test_bad_packages_are_rows_with_the_same_reason(spark, data):
    want = container.scan(spark.createDataFrame([("p", bytearray(data))], "pkg_id string, content binary")).first()["error"]
    (row,) = reader(blobs.PackageReader)(Counting(data))
    assert row[5] == want and row[:5] == (None,) * 5


def test_strictness():
    data = container.encode(FILES) + b"more"
    assert reader(blobs.PackageReader, strict="true")(Counting(data))[0][5] == "declared size differs" and len(reader(blobs.PackageReader)(Counting(data))) == 4


def zipped(entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_archives_by_their_directories():
    data = zipped([("a", b"1" * 100_000), ("b/c", os.urandom(100_000)), ("d", b"")])
    f = Counting(data)
    assert [(r[1], r[2], r[4], r[5]) for r in reader(blobs.ArchiveReader, content="false")(f)] == [("a", 100_000, None, None), ("b/c", 100_000, None, None), ("d", 0, None, None)]
    assert f.read_bytes <= blobs.TAIL + 300
    got = reader(blobs.ArchiveReader, lambda n: n == "a")(Counting(data))
    assert [(r[1], r[4]) for r in got] == [("a", b"1" * 100_000)]
    assert reader(blobs.ArchiveReader)(Counting(zipped([("s", b"stored")], zipfile.ZIP_STORED)))[0][4] == b"stored"
    broken = bytearray(zipped([("s", b"stored")], zipfile.ZIP_STORED))
    broken[broken.index(b"stored")] ^= 1
    assert reader(blobs.ArchiveReader)(Counting(bytes(broken)))[0][4:] == (None, "content differs")
    with pytest.warns(UserWarning, match="Duplicate"):
        twice = zipped([("a", b""), ("a", b"")])
    for bad, why in ((b"", "no directory"), (data[:-30], "no directory"), (twice, "duplicate entry"), (b"xx" + data, "directory misplaced")):
        assert reader(blobs.ArchiveReader)(Counting(bad))[0][5] == why


def test_packages_through_spark(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    rows = [(f"p{i}", bytearray(container.encode(FILES | {"own": str(i).encode()}))) for i in range(20)] + [("bad/..", bytearray(b"no")), ("none", None)]
    blobs.write_packages(spark.createDataFrame(rows, "pkg_id string, content binary").repartition(4), path)
    (tmp_path / "p" / "left-behind.pkg").write_bytes(b"an attempt that was lost")
    got = blobs.read_packages(spark, path)
    assert got.count() == 20 * 5 + 2 and {r["pkg_id"]: r["error"] for r in got.where("error is not null").collect()} == {"bad/..": "file too small", "none": "file too small"}
    own = got.where("path = 'own'")
    assert {(r["pkg_id"], bytes(r["content"])) for r in own.collect()} == {(f"p{i}", str(i).encode()) for i in range(20)}
    assert got.where("pkg_id in ('p1', 'p2') and path like 'pages/%' and size > 5000").select("pkg_id", "path").distinct().count() == 2
    assert blobs.read_packages(spark, path, content=False).where("content is not null").count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        assert blobs.read_packages(spark, path, prefix="pages/").where("path <> 'pages/b.js'").count() == 20 and blobs.read_packages(spark, path).count() == 102
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    os.remove(tmp_path / "p" / blobs.LIST)
    assert blobs.read_packages(spark, path).where("error is not null").count() == 3


def test_archives_through_spark(spark, tmp_path):
    path = f"file://{tmp_path}/z"
    rows = [(f"p{i}", f"d/{j}.js", bytearray(f"{i} {j} ".encode() * 50)) for i in range(7) for j in range(9)] + [("unsafe", "../x", bytearray(b"")), ("empty", "a", None)]
    blobs.write_archives(spark.createDataFrame(rows, "pkg_id string, path string, content binary").repartition(5), path)
    got = {(r["pkg_id"], r["path"]): bytes(r["content"]) for r in blobs.read_archives(spark, path).collect()}
    assert got == {(p, f"src/{n}"): bytes(c or b"") for p, n, c in rows if p != "unsafe"}
    listed = json.loads((tmp_path / "z" / blobs.LIST).read_text())
    assert {x["pkg_id"]: x["entries"] for x in listed} == {f"p{i}": 9 for i in range(7)} | {"empty": 1}
    with zipfile.ZipFile(tmp_path / "z" / listed[-1]["file"]) as z:
        assert z.testzip() is None


def test_a_failed_task_leaves_no_archive(spark, tmp_path):
    path = tmp_path / "z"
    broken = spark.range(40).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("pkg_id"), F.lit("a").alias("path"), F.expr("if(id = 33, raise_error('lost'), cast('x' as binary))").alias("content"))
    with pytest.raises(Exception, match="lost"):
        blobs.write_archives(broken, f"file://{path}")
    assert not list(path.glob("*")) if path.exists() else True
