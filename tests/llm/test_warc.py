import base64
import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tarn.llm import plans, warc

ROWS = [
    (5, "http://a", "same"), (3, "http://b", "same"), (9, None, "same"), (1, "http://c\r\nX: y", None), (2, "u", ""), (4, "u", "é \r\n\r\n \U0001f600"), (6, "u", "x" * 300_000),
    (7, "u", "y"), (7, "u", "y"), (None, "u", "nobody"), (None, "u", "nobody"), (8, "u", "z"), (None, "u", "z"),
]
SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = sum((x or "") == (h or "") for *_, x in rows) > 1 and len(data) >= least and (h or "") in first and first[h or ""] != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


def result(spark, tmp_path, df, split=warc.SPLIT, least=0):
    path = f"file://{tmp_path}/w{random.random()}"
    warc.write(warc.plan_records(df, least=least), path)
    return warc.read(spark, path, split)


def digest_rows(records):
    return sorted([tuple(r) for r in records.select(warc.page_number("record_id"), "payload_bytes", "payload_digest", "warc_type", warc.page_number("refers_to")).collect()], key=str)


@pytest.mark.parametrize("split", [7, 100, 4096, 1 << 25])
@pytest.mark.parametrize("least", [0, 3])
def test_edge_rows(spark, tmp_path, split, least):
    df = spark.createDataFrame(ROWS if split > 50 else ROWS[:5], SCHEMA).withColumn("payload", F.lit("clash"))
    records = result(spark, tmp_path, df.coalesce(2), split, least)
    assert digest_rows(records) == brute(ROWS if split > 50 else ROWS[:5], least)
    for r in records.where("warc_type = 'response'").collect():
        assert bytes(r["payload"]) in {(h or "").encode() for *_, h in ROWS}


def test_empty(spark, tmp_path):
    assert result(spark, tmp_path, spark.createDataFrame([], SCHEMA)).collect() == []


def test_pages(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, plans.op9_warc(spark, sf).collect()), key=str) == brute(rows)


def test_every_cut_gives_each_record_once():
    rnd = random.Random(3)
    bodies = [rnd.randbytes(rnd.choice((0, 5, 300))) + (warc.MAGIC * 3 if i % 2 else b"") for i in range(12)]
    data = b"".join(warc.member(warc.record(f"urn:page:{i}", "u", b, len(b), warc.digest(b), None, "2024-01-01T00:00:00Z")) for i, b in enumerate(bodies))
    whole = list(warc.members(io.BytesIO(data), 0, len(data)))
    assert [warc.parse(d)["payload"] for _, d in whole] == bodies
    for cut in range(0, len(data) + 1, 3):
        assert list(warc.members(io.BytesIO(data), 0, cut)) + list(warc.members(io.BytesIO(data), cut, len(data))) == whole


def test_damage_is_reported():
    m = warc.member(warc.record("urn:page:1", "u", b"abc", 3, warc.digest(b"abd"), None, "2024-01-01T00:00:00Z"))
    with pytest.raises(ValueError, match="digest"):
        warc.parse(next(warc.members(io.BytesIO(m), 0, len(m)))[1])
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(m[:-9]), 0, len(m)))


def test_leftovers_of_lost_attempts_are_not_read(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(warc.plan_records(spark.createDataFrame(ROWS, SCHEMA)), path)
    n = warc.read(spark, path).count()
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(warc.member(warc.record("urn:page:1", "u", b"", 0, warc.digest(b""), None, "d")))
    assert warc.read(spark, path).count() == n == len(ROWS)
    assert all(x["size"] for x in json.loads((tmp_path / "w" / warc.LIST).read_bytes()))
