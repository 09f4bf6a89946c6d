"""ZIP archives of packages: a sink with checked entries and a reader with structural checks.

An archive's central directory comes last and needs all its entries, so a package is one unit of work: entries are
dealt by package and sorted, and an archive is written as its rows stream by; only its directory is held.
"""

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import paths
from tarn.session import ship

FIXED_TIME = (1980, 1, 1, 0, 0, 0)  # the same files give the same bytes


def entry_list(entries: DataFrame, prefix: str = "src") -> DataFrame:
    """(pkg_id, files, error): sorted entries; an unsafe, foreign or repeated one refuses the list."""
    p = F.col("path")
    seen = entries.groupBy("pkg_id", "path").agg(F.count("*").alias("n"))
    error = F.when(~paths.zip_entry_ok(p), "unsafe entry").when(~p.startswith(f"{prefix}/"), "outside prefix").when(F.col("n") > 1, "duplicate entry")
    return seen.withColumn("e", error).groupBy("pkg_id").agg(F.sort_array(F.collect_list("path")).alias("files"), F.max("e").alias("error"))


def entries(files: DataFrame, prefix: str = "src") -> DataFrame:
    """(pkg_id, path below the prefix, content) of packages whose entries are all fit for an archive."""
    good = entry_list(files.withColumn("path", F.concat(F.lit(f"{prefix}/"), "path")), prefix).where("error is null").select("pkg_id")
    return files.join(good, "pkg_id", "left_semi").select("pkg_id", F.concat(F.lit(f"{prefix}/"), "path").alias("path"), "content")


def pack(files: DataFrame, prefix: str = "src") -> DataFrame:
    """files(pkg_id, path, content) to (pkg_id, archive, entries). Refused packages and empty ones give no row."""
    ship(files.sparkSession)
    rows = entries(files, prefix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out, archive, n = None, None, None, 0

        def done() -> pa.RecordBatch:
            archive.close()
            return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([out.getvalue()], pa.binary()), pa.array([n], pa.int64())], ["pkg_id", "archive", "entries"])

        for batch in batches:
            for pkg, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pkg != current or archive is None:
                    if archive is not None:
                        yield done()
                    current, out, n = pkg, io.BytesIO(), 0
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(zipfile.ZipInfo(path, FIXED_TIME), content or b"", zipfile.ZIP_DEFLATED)
                n += 1
        if archive is not None:
            yield done()

    return rows.repartition("pkg_id").sortWithinPartitions("pkg_id", "path").mapInArrow(run, "pkg_id string, archive binary, entries long")


def directory(data: bytes) -> tuple[list[tuple[str, int]], str | None]:
    """Entries of an archive's central directory, or why it is refused: ZIP64, encryption, repeated or cut-off entries."""
    end = data.rfind(b"PK\x05\x06")
    if end < 0 or end + 22 > len(data):
        return [], "no directory"
    count, size, at = struct.unpack_from("<HII", data, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (size, at):
        return [], "ZIP64"
    if at + size != end:
        return [], "directory misplaced"
    out, names = [], set()
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02" or at + 46 > end:
            return [], "directory cut off"
        flags, length, name, extra, note = (struct.unpack_from(f, data, at + k)[0] for f, k in (("<H", 8), ("<I", 24), ("<H", 28), ("<H", 30), ("<H", 32)))
        text = data[at + 46 : at + 46 + name].decode("utf-8", "replace")
        if flags & 1 or text in names:
            return [], "encrypted" if flags & 1 else "duplicate entry"
        names.add(text)
        out.append((text, length))
        at += 46 + name + extra + note
    return (out, None) if at == end else ([], "directory cut off")


def listing(archives: DataFrame) -> DataFrame:
    """archives(pkg_id, archive) to (pkg_id, path, size, error)."""
    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pkg, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, why = directory(data or b"")
                rows += [(pkg, p, n, None) for p, n in found] if not why else [(pkg, None, None, why)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["pkg_id", "path", "size", "error"])

    return archives.select("pkg_id", "archive").mapInArrow(run, "pkg_id string, path string, size long, error string")
