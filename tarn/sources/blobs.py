"""Packages and archives as files, written and read as Spark data sources that touch only the bytes asked for.

    package_files     rows (pkg_id, content): a file each; read back as entries, from header, index and the ranges of their contents
    archive_files     rows (pkg_id, path, content), sorted: a ZIP each, streamed; read back from central directories and ranges

Writing: a task writes files under names of their own and reports them, the commit writes their list, and a reader of the folder
reads what the list names. A task that is lost or repeated leaves files that no list names; one that fails removes its own. A folder
without a list is somebody else's: all of its files are read.

Reading: a task gets some files. Of a package it reads 14 bytes, then the index; of an archive its end, then the directory. Filters on the entry's
path (equal, in, starts with) and on pkg_id are pushed down where spark.sql.python.filterPushdown.enabled is set, and the option prefix says the same
in any session, so contents of other entries aren't read; with content off none is. What is wrong with a file is a row with an error.

Paths: plain ones and file: URIs are opened directly, others through pyarrow's file systems.
"""

import json
import os
import re
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from tarn.session import ship
from tarn.sources import archive, container

LIST = "_files.json"
#: A reading task takes files of so many bytes together; what is read at an archive's end to find its directory; rows of contents go out in batches of so many bytes.
SPLIT, TAIL, BATCH = 64 << 20, 22 + 0xFFFF, 8 << 20
PACKAGE_FIELDS = "pkg_id string, file string, ord int, path string, offset long, size long, content binary, error string"
ARCHIVE_FIELDS = "pkg_id string, file string, ord int, path string, size long, crc32 long, content binary, error string"
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _local(path: str) -> str | None:
    return re.sub("^file:(//)?", "", path) if "://" not in path or path.startswith("file:") else None


def _system(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def open_path(path: str, mode: str) -> BinaryIO:
    if (local := _local(path)) is not None:
        if "w" in mode:
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    system, inner = _system(path)
    return system.open_output_stream(inner) if "w" in mode else system.open_input_file(inner)


def remove(path: str) -> None:
    if (local := _local(path)) is not None:
        if os.path.exists(local):
            os.remove(local)
        return
    system, inner = _system(path)
    system.delete_file(inner)


def files_below(path: str) -> list[tuple[str, str, int]]:
    """(pkg_id, path, size) of a folder's files: those of its list, else all that it holds."""
    from pyarrow import fs

    local = _local(path)
    system, inner = (fs.LocalFileSystem(), local) if local is not None else _system(path)
    found = [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file]
    if any(f.path == f"{inner.rstrip('/')}/{LIST}" for f in found):
        with open_path(f"{path}/{LIST}", "rb") as f:
            return [(x["pkg_id"], f"{path}/{x['file']}", x["size"]) for x in json.loads(f.read())]
    return sorted((os.path.basename(f.path), f"{path}{f.path[len(inner.rstrip('/')) :]}", f.size) for f in found if not os.path.basename(f.path).startswith(("_", ".")))


@dataclass
class Files(InputPartition):
    files: list[tuple[str, str, int]]


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class _Writer(DataSourceArrowWriter):
    """Files under unique names; a list of them at the commit."""

    extension = ""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")

    def name(self, pkg: str) -> str:
        return f"{urllib.parse.quote(pkg, safe='')[:120]}-{uuid.uuid4().hex}{self.extension}"

    def packages(self, iterator: Iterator[pa.RecordBatch], opened: list[str]) -> Iterator[dict]:
        """Writes each package, and says what it wrote; opened: gets each name before it is opened."""
        raise NotImplementedError

    def write(self, iterator):
        opened: list[str] = []
        try:
            return Written(list(self.packages(iterator, opened)))
        except BaseException:
            for name in opened:
                remove(f"{self.path}/{name}")
            raise

    def commit(self, messages):
        listed = sorted((x for m in messages if m for x in m.files), key=lambda x: (x["pkg_id"], x["file"]))
        with open_path(f"{self.path}/{LIST}", "wb") as f:
            f.write(json.dumps(listed).encode())

    def abort(self, messages):
        for m in messages:
            for x in m.files if m else ():
                remove(f"{self.path}/{x['file']}")


class PackageWriter(_Writer):
    extension = ".pkg"

    def packages(self, iterator, opened):
        for batch in iterator:
            for pkg, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                opened.append(self.name(pkg))
                data = content.as_buffer() if content.is_valid else b""
                with open_path(f"{self.path}/{opened[-1]}", "wb") as f:
                    f.write(data)
                yield {"pkg_id": pkg, "file": opened[-1], "size": len(data)}


class ArchiveWriter(_Writer):
    """A package's rows must be neighbours; an entry goes out as it comes, and only the directory is held."""

    extension = ".zip"

    def packages(self, iterator, opened):
        current, out, zipped, n = None, None, None, 0

        def done() -> dict:
            zipped.close()
            size = out.tell()
            out.close()
            return {"pkg_id": current, "file": opened[-1], "size": size, "entries": n}

        try:
            for batch in iterator:
                for pkg, path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if zipped is None or pkg != current:
                        if zipped is not None:
                            yield done()
                        current, n = pkg, 0
                        opened.append(self.name(pkg))
                        out = open_path(f"{self.path}/{opened[-1]}", "wb")
                        zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    zipped.writestr(zipfile.ZipInfo(path, archive.FIXED_TIME), content.as_buffer() if content.is_valid else b"", zipfile.ZIP_DEFLATED)
                    n += 1
            if zipped is not None:
                yield done()
        finally:
            if out is not None and not out.closed:
                out.close()


def _wanted(filters: list[Filter]) -> tuple[Callable[[str], bool], Callable[[str], bool], list[Filter]]:
    """(test of a pkg_id, test of a path, filters that aren't covered)."""
    tests: dict[str, list[Callable[[str], bool]]] = {"pkg_id": [], "path": []}
    rest = []
    for f in filters:
        own = tests.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
        if own is None or not isinstance(f, EqualTo | In | StringStartsWith):
            rest.append(f)
        elif isinstance(f, In):
            own.append(lambda x, v=frozenset(f.value): x in v)
        elif isinstance(f, EqualTo):
            own.append(lambda x, v=f.value: x == v)
        else:
            own.append(lambda x, v=f.value: x.startswith(v))
    return (lambda x: all(t(x) for t in tests["pkg_id"])), (lambda x: all(t(x) for t in tests["path"])), rest


class _Reader(DataSourceReader):
    fields = ""

    def __init__(self, options):
        self.path, self.content = options["path"].rstrip("/"), options.get("content", "true") == "true"
        self.strict, self.split = options.get("strict", "false") == "true", int(options.get("splitBytes", SPLIT))
        self.pushed: list[Filter] = [StringStartsWith(("path",), options["prefix"])] if options.get("prefix") else []

    def partitions(self):
        wanted, parts, size = _wanted(self.pushed)[0], [], self.split
        for f in files_below(self.path):
            if wanted(f[0]):
                if size >= self.split:
                    parts.append([])
                    size = 0
                parts[-1].append(f)
                size += f[2]
        return [Files(p) for p in parts] or [Files([])]

    def rows(self, file: BinaryIO, size: int, wanted: Callable[[str], bool]) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition):
        wanted, names, kinds = _wanted(self.pushed)[1], *zip(*(f.split() for f in self.fields.split(", ")), strict=True)
        # a pushed filter on the path leaves rows of errors out, which have none
        held, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
        only = any(f.attribute == ("path",) for f in self.pushed if hasattr(f, "attribute"))
        for pkg, path, length in partition.files:
            with open_path(path, "rb") as f:
                for row in self.rows(f, length, wanted):
                    if row[1] is None and only:
                        continue
                    held.append((pkg, path.rpartition("/")[2], *row))
                    size += len(row[-2] or b"") + 100
                    if size >= BATCH:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()


class _Pushing:
    """For sessions that push filters down; Spark refuses such a reader in others."""

    def pushFilters(self, filters):
        self.pushed = [*self.pushed, *filters]
        yield from _wanted(filters)[2]


def _at(file: BinaryIO, at: int, n: int) -> bytes:
    file.seek(at)
    return file.read(n)


class PackageReader(_Reader):
    fields = PACKAGE_FIELDS

    def rows(self, file, size, wanted):
        bad = lambda why: (None, None, None, None, None, why)
        head = _at(file, 0, container.HEADER)
        why = "file too small" if size < container.HEADER else "encrypted" if head.startswith(container.MARKER) else "bad first marker" if head[0] != container.FIRST else "bad last marker" if head[13] != container.LAST else None
        if why:
            yield bad(why)
            return
        index_length, body_length = struct.unpack_from(">II", head, 5)
        if index_length < 4 or container.HEADER + index_length + body_length > size:
            yield bad("bad index length" if index_length < 4 else "sections out of bounds")
            return
        entries, why = container.parse_index(_at(file, container.HEADER, index_length), body_length, size, self.strict)
        if why:
            yield bad(why)
            return
        for i, (name, offset, n) in enumerate(entries):
            if wanted(name):
                yield i, name, offset, n, _at(file, offset, n) if self.content else None, None


class ArchiveReader(_Reader):
    fields = ARCHIVE_FIELDS

    def rows(self, file, size, wanted):
        bad = lambda why: (None, None, None, None, None, why)
        tail = _at(file, max(0, size - TAIL), min(size, TAIL))
        end = tail.rfind(b"PK\x05\x06")
        if end < 0 or end + 22 > len(tail):
            yield bad("no directory")
            return
        count, length, at = struct.unpack_from("<HII", tail, end + 10)
        if count == 0xFFFF or 0xFFFFFFFF in (length, at):
            yield bad("ZIP64")
            return
        if at + length != size - len(tail) + end:
            yield bad("directory misplaced")
            return
        data, here, names, found = _at(file, at, length), 0, set(), []
        for _ in range(count):
            if data[here : here + 4] != b"PK\x01\x02" or here + 46 > length:
                yield bad("directory cut off")
                return
            flags, method = struct.unpack_from("<HH", data, here + 8)
            crc, packed, n, name, extra, note = struct.unpack_from("<IIIHHH", data, here + 16)
            text = data[here + 46 : here + 46 + name].decode("utf-8", "replace")
            if flags & 1 or text in names or method not in (0, 8):
                yield bad("encrypted" if flags & 1 else "duplicate entry" if text in names else "unknown method")
                return
            names.add(text)
            found.append((text, n, crc, method, packed, struct.unpack_from("<I", data, here + 42)[0]))
            here += 46 + name + extra + note
        if here != length:
            yield bad("directory cut off")
            return
        for i, (text, n, crc, method, packed, local) in enumerate(found):
            if not wanted(text):
                continue
            content = why = None
            if self.content:
                name, extra = struct.unpack_from("<HH", _at(file, local, 30), 26)
                content = _at(file, local + 30 + name + extra, packed)
                try:
                    content = zlib.decompress(content, -15) if method else content
                    why = None if len(content) == n and zlib.crc32(content) == crc else "content differs"
                except zlib.error:
                    why = "content differs"
                content = None if why else content
            yield i, text, n, crc, content, why


class PushingPackageReader(_Pushing, PackageReader):
    pass


class PushingArchiveReader(_Pushing, ArchiveReader):
    pass


def _source(short: str, fields: str, plain: type, pushing: type, writer: type) -> type:
    class Source(DataSource):
        @classmethod
        def name(cls):
            return short

        def schema(self):
            return fields

        def reader(self, schema):
            return (pushing if self.options.get("pushdown") == "true" else plain)(self.options)

        def writer(self, schema, overwrite):
            return writer(self.options)

    return Source


PackageSource = _source("package_files", PACKAGE_FIELDS, PackageReader, PushingPackageReader, PackageWriter)
ArchiveSource = _source("archive_files", ARCHIVE_FIELDS, ArchiveReader, PushingArchiveReader, ArchiveWriter)


def _registered(spark: SparkSession) -> None:
    ship(spark)
    for source in (PackageSource, ArchiveSource):
        spark.dataSource.register(source)


def write_packages(packages: DataFrame, path: str) -> None:
    """packages(pkg_id, content) to a file each below path, which must be new."""
    _registered(packages.sparkSession)
    packages.select("pkg_id", "content").write.format("package_files").mode("append").option("path", path).save()


def _read(spark: SparkSession, source: str, path: str, **options: str | bool) -> DataFrame:
    _registered(spark)
    text = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}
    return spark.read.format(source).options(path=path, pushdown=spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"), **text).load()


def read_packages(spark: SparkSession, path: str, content: bool = True, strict: bool = False, prefix: str = "") -> DataFrame:
    """Entries of the packages below path, as container.scan() has them, with their contents; with a prefix only those whose paths begin so."""
    return _read(spark, "package_files", path, content=content, strict=strict, prefix=prefix)


def write_archives(files: DataFrame, path: str, prefix: str = "src") -> None:
    """files(pkg_id, path, content) to an archive for each package below path, which must be new. Refused and empty packages give none."""
    _registered(files.sparkSession)
    rows = archive.entries(files, prefix).repartition("pkg_id").sortWithinPartitions("pkg_id", "path")
    rows.write.format("archive_files").mode("append").option("path", path).save()


def read_archives(spark: SparkSession, path: str, content: bool = True, prefix: str = "") -> DataFrame:
    """Entries of the archives below path, with a prefix only those whose paths begin so; without contents only directories are read."""
    return _read(spark, "archive_files", path, content=content, prefix=prefix)
