"""WARC archives as a Spark data source: one gzip member a record, a splittable reader, a committing writer.

Reader: an archive is cut into byte ranges. A task scans its range for the gzip magic, takes a candidate as a
member only if it inflates to a WARC version line, and owns the records whose members start inside its range;
it reads past the range's end to finish the last one. After a member the next is expected where it ended.

Writer: a task writes one archive under a name of its own, streaming, and reports name and size. The commit
writes the list of reported archives, and the reader reads that list: what a lost or repeated attempt left
behind isn't in it.

Paths: file: URIs and plain paths are opened directly, others through pyarrow's file systems; on a cluster
that is a folder that driver and executors share. A record's payload digest is verified when it is read.
"""

import base64
import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tarn.session import ship

MAGIC = b"\x1f\x8b\x08"
SPLIT = 32 << 20
_STEP = 1 << 18
_BATCH = 8 << 20
LIST = "_archives.json"
FIELDS = "record_id string, warc_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, archive string, position long"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str, mode: str):
    if "://" not in path or path.startswith("file:"):
        local = re.sub("^file:(//)?", "", path)
        if "w" in mode:
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner) if "w" in mode else system.open_input_file(inner)


def _remove(path: str) -> None:
    if "://" not in path or path.startswith("file:"):
        local = re.sub("^file:(//)?", "", path)
        if os.path.exists(local):
            os.remove(local)
    else:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        system.delete_file(inner)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value: control characters and spaces at the ends would break the record."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(record_id: str, uri: str | None, payload: bytes | None, size: int, sha1: str, refers_to: str | None, date: str) -> bytes:
    """A response, or a revisit if refers_to is given; a revisit has the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_clean(uri)}"] if uri is not None else []
    head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT}"] if refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Archive(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    archive: str | None
    size: int


class _Window:
    """Reads at any position of a file through one buffer."""

    def __init__(self, file):
        self.file, self.at, self.data = file, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.at <= at or at + n > self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(n, 2 * _STEP))
        return self.data[at - self.at : at - self.at + n]


def _is_record(window: _Window, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(window.read(at, 1024), 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, inflated member) of the records that start in [start, end)."""
    window, at = _Window(file), start
    while at < end:
        if not (window.read(at, 3) == MAGIC and _is_record(window, at)):
            at += 1
            while at < end:  # to the next magic; it may lie across two steps
                chunk = window.read(at, min(_STEP, end - at + 2))
                found = chunk.find(MAGIC)
                if found >= 0:
                    at += found
                    break
                at += max(1, len(chunk) - 2)
            continue
        inflate, out, here = zlib.decompressobj(31), [], at
        while not inflate.eof:
            chunk = window.read(here, _STEP)
            if not chunk:
                raise EOFError(f"a member at {at} is cut off")
            out.append(inflate.decompress(chunk))
            here += len(chunk) - len(inflate.unused_data)
        yield at, b"".join(out)
        at = here


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    sha1 = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    full = fields["warc-type"] == "response"
    if full and sha1 and digest(payload) != sha1:
        raise ValueError(f"{fields.get('warc-record-id')}: payload digest differs")
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    return {"record_id": bare("warc-record-id"), "warc_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"), "refers_to": bare("warc-refers-to"), "payload_digest": sha1, "payload_bytes": int(length[1]) if length else len(payload), "payload": payload if full else None}


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.split = options["path"].rstrip("/"), int(options.get("splitBytes", SPLIT))
        self.names = [f.name for f in schema.fields]
        self.payload = options.get("payload", "true") == "true"

    def partitions(self):
        with _open(f"{self.path}/{LIST}", "rb") as f:
            found = json.loads(f.read())
        return [Archive(f"{self.path}/{x['archive']}", at, min(at + self.split, x["size"])) for x in found for at in range(0, x["size"], self.split)] or [Archive("", 0, 0)]

    def read(self, partition):

        schema = _arrow_schema()
        if not partition.path:
            return
        with _open(partition.path, "rb") as f:
            rows, size = [], 0
            for at, data in members(f, partition.start, partition.end):
                row = parse(data) | {"archive": partition.path.rpartition("/")[2], "position": at}
                if not self.payload:
                    row["payload"] = None
                rows.append(row)
                size += len(data)
                if size >= _BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in FIELDS.split(", "))])


class WarcWriter(DataSourceArrowWriter):
    """Rows (record_id, target_uri, payload, payload_bytes, sha1_hex, refers_to) to archives."""

    def __init__(self, options):
        self.path, self.date = options["path"].rstrip("/"), options.get("date", "2024-01-01T00:00:00Z")

    def write(self, iterator):
        name, size, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    out = out or _open(f"{self.path}/{name}", "wb")
                    sha1 = base64.b32encode(bytes.fromhex(r["sha1_hex"])).decode()
                    data = member(record(r["record_id"], r["target_uri"], r["payload"], r["payload_bytes"], sha1, r["refers_to"], self.date))
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return Written(name if out else None, size)

    def commit(self, messages):
        done = sorted((m.archive, m.size) for m in messages if m and m.archive)
        with _open(f"{self.path}/{LIST}", "wb") as f:
            f.write(json.dumps([{"archive": a, "size": n} for a, n in done]).encode())

    def abort(self, messages):
        for m in messages:
            if m and m.archive:
                _remove(f"{self.path}/{m.archive}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return FIELDS

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def plan_records(pages: DataFrame, key: str = "page_id", uri: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Rows for the writer: of equal payloads of at least `least` bytes, the smallest key's is whole, others refer to it.

    Digests and their smallest keys are aggregated with a partial step before the shuffle, and only digests that
    occur twice or more are joined back; adaptive execution splits the partition of a payload with many copies.
    Defined results: a null html is an empty payload; rows that repeat the smallest key are all whole; in a group
    without any key all are whole; a null key's record id has no number.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(uri).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("sha1_hex", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    known = rows.select("page", "sha1_hex", "payload_bytes").groupBy("sha1_hex", "payload_bytes").agg(F.min("page").alias("first"), F.count("*").alias("n"))
    known = known.where((F.col("n") > 1) & (F.col("payload_bytes") >= least) & F.col("first").isNotNull()).select("sha1_hex", "payload_bytes", "first")
    joined = rows.join(known, ["sha1_hex", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return joined.select(name(F.col("page")).alias("record_id"), "target_uri", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "sha1_hex", F.when(again, name(F.col("first"))).alias("refers_to"))


def write(records: DataFrame, path: str) -> None:
    ship(records.sparkSession)
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").option("path", path).save()


def read(spark: SparkSession, path: str, split: int = SPLIT, payload: bool = True) -> DataFrame:
    ship(spark)
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("splitBytes", split).option("payload", str(payload).lower()).load()


def page_number(record: str) -> Column:
    return F.expr(f"try_cast(nullif(replace({record}, 'urn:page:', ''), '') as bigint)")
