"""Package containers as tables: header checks, index scan, extraction, profile, encoder.

Layout, all integers big-endian: 0xBE, u32, u32 index length, u32 body length, 0xED, index, body. The index is a
u32 count and for each file u32 name length, name, u32 offset in the package, u32 size.

Header fields are cut out with column expressions. The index, a chain of records of varying length, is walked
in Python over Arrow batches, one output row for each entry; contents are then cut out with substring, so the
package's bytes don't pass through Python again. A bad package gives an error row and never fails the job.
"""

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import paths, scalars
from tarn.session import ship

# Markers and limits.
MARKER = b"V1MMWX"
FIRST, LAST = 0xBE, 0xED
HEADER = 14
MAX_FILES = 100_000
MAX_NAME = 4096
ALIASES = ("app-service.js", "appservice.js")


def packages(spark: SparkSession, path: str) -> DataFrame:
    """(pkg_id, path, length, content) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("pkg_id"), "path", "length", "content")


def _byte(content: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, 1)), 16, 10).cast("int")


def _u32(content: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, 4)), 16, 10).cast("long")


def is_encrypted(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 6) == F.lit(MARKER), F.lit(False))


def is_plain(content: Column) -> Column:
    return F.coalesce((F.octet_length(content) >= HEADER) & (_byte(content, 0) == FIRST) & (_byte(content, 13) == LAST), F.lit(False))


def encryption_mode(content: Column) -> Column:
    return F.when(is_encrypted(content), "encrypted").when(is_plain(content), "plain").otherwise("unknown")


def valid_key_id(key_id: Column) -> Column:
    return key_id.rlike("^wx[a-f0-9]{16}$")


def index_count(content: Column) -> Column:
    """The count at byte 14 if the first marker holds; the last marker isn't looked at."""
    return F.when((F.octet_length(content) >= 18) & (_byte(content, 0) == FIRST), _u32(content, 14)).otherwise(0).cast("long")


def header(df: DataFrame) -> DataFrame:
    """Adds index_length, body_length and header_error (null for a good header)."""
    c, n = F.col("content"), F.octet_length("content").cast("long")
    error = (
        F.when(n < HEADER, "file too small").when(is_encrypted(c), "encrypted").when(_byte(c, 0) != FIRST, "bad first marker").when(_byte(c, 13) != LAST, "bad last marker")
        .when(_u32(c, 5) < 4, "bad index length").when(HEADER + _u32(c, 5) + _u32(c, 9) > n, "sections out of bounds")
    )
    return df.withColumns({"index_length": F.when(n >= HEADER, _u32(c, 5)), "body_length": F.when(n >= HEADER, _u32(c, 9)), "header_error": error})


def read_index(data: bytes, strict: bool = False) -> tuple[list[tuple[str, int, int]], str | None]:
    """Entries of a package with a good header, or the reason why its index is refused.

    strict: the declared end is the file's end, offsets lie in the body, names are UTF-8 without NUL and
    differ, and the index ends where its records end.
    """
    index_length, body_length = struct.unpack_from(">II", data, 5)
    return parse_index(memoryview(data)[HEADER : HEADER + index_length], body_length, len(data), strict)


def parse_index(index: memoryview | bytes, body_length: int, total: int, strict: bool = False) -> tuple[list[tuple[str, int, int]], str | None]:
    """read_index() from the index section alone, the declared length of the body and the length of the whole file."""
    body = HEADER + len(index)
    (count,) = struct.unpack_from(">I", index)
    if count > MAX_FILES:
        return [], "too many files"
    if count * 12 > len(index) - 4:
        return [], "bad file count"
    if strict and body + body_length != total:
        return [], "declared size differs"
    out, at, names = [], 4, set()
    for _ in range(count):
        if at + 4 > len(index):
            return [], "index cut off"
        (size,) = struct.unpack_from(">I", index, at)
        if not 0 < size <= MAX_NAME:
            return [], "bad name length"
        if at + 12 + size > len(index):
            return [], "entry exceeds index"
        raw = bytes(index[at + 4 : at + 4 + size])
        offset, length = struct.unpack_from(">II", index, at + 4 + size)
        at += 12 + size
        if offset + length > total:
            return [], "file out of bounds"
        if strict:
            try:
                name = raw.decode()
            except UnicodeDecodeError:
                return [], "name is not UTF-8"
            if "\0" in name or name in names or offset < body:
                return [], "NUL in name" if "\0" in name else "duplicate name" if name in names else "offset outside body"
            names.add(name)
        out.append((raw.decode("utf-8", "replace"), offset, length))
    if strict and at != len(index):
        return [], "trailing index bytes"
    return out, None


def scan(df: DataFrame, strict: bool = False) -> DataFrame:
    """(pkg_id, ord, name, offset, size, error): a row for each entry, or one with the error."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pkg, data, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entries, why = ([], error) if error else read_index(data, strict)
                rows += [(pkg, i, *e, None) for i, e in enumerate(entries)] or ([(pkg, None, None, None, None, why)] if why else [])
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["pkg_id", "ord", "name", "offset", "size", "error"])

    return header(df).select("pkg_id", "content", "header_error").mapInArrow(run, "pkg_id string, ord int, name string, offset long, size long, error string")


def extract(df: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries with content, checked as a whole package: (pkg_id, ord, path, name, offset, size, content, action, error).

    Paths must be safe. A later entry of a path is skipped if its bytes equal the first one's, and refuses the
    package otherwise. One entry of a runtime name that lies within what earlier entries referenced is an alias;
    all other sizes count, and may not exceed the package.
    """
    c = df.select("pkg_id", F.col("content").alias("__data"), F.octet_length("content").cast("long").alias("__length"), (HEADER + _u32(F.col("content"), 5)).alias("__body"))
    cut = F.when(F.col("size") > 0, F.expr("substring(__data, cast(offset as int) + 1, cast(size as int))")).otherwise(F.lit(b""))
    rows = entries.where("error is null").join(c, "pkg_id").withColumn("path", paths.output_path(F.col("name"))).withColumn("content", cut)
    by_pkg = Window.partitionBy("pkg_id").orderBy("ord")
    first = Window.partitionBy("pkg_id", "path").orderBy("ord")
    rows = rows.withColumn("__first", F.first("content").over(first)).withColumn("__nth", F.row_number().over(first)).drop("__data")
    again = F.col("__nth") > 1
    rows = rows.withColumn("__end", F.when(again, F.lit(0)).otherwise(F.col("offset") + F.col("size")))
    seen = F.greatest(F.coalesce(F.max("__end").over(by_pkg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.col("__body"))
    named = F.lower(F.regexp_extract("name", r"([^/]*)$", 1)).isin(*ALIASES)
    inside = (F.col("offset") < seen) & (F.col("offset") + F.col("size") <= seen) & (F.col("offset") >= F.col("__body"))
    rows = rows.withColumn("__could", ~again & named & inside)
    nth = F.sum(F.col("__could").cast("int")).over(by_pkg.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("action", F.when(again, "skip").when(F.col("__could") & (nth == 1), "alias").otherwise("write"))
    total = F.sum(F.when(F.col("action") == "write", F.col("size")).otherwise(0)).over(Window.partitionBy("pkg_id"))
    error = (
        F.when(F.col("path").isNull(), "unsafe path").when(again & (F.col("content") != F.col("__first")), "divergent duplicate").when(total > F.col("__length"), "extracted size exceeds package")
    )
    return rows.withColumn("error", error).select("pkg_id", "ord", "path", "name", "offset", "size", "content", "action", "error")


def files(extracted: DataFrame) -> DataFrame:
    """(pkg_id, ord, path, ext, kind, source, size, sha256, text) of packages without an error."""
    bad = extracted.where("error is not null").select("pkg_id").distinct()
    good = extracted.where("action <> 'skip'").join(bad, "pkg_id", "left_anti")
    p = F.col("path")
    text = F.when(scalars.is_text_artifact(p), F.col("content").cast("string"))
    return good.select("pkg_id", "ord", "path", scalars.extension(p).alias("ext"), scalars.file_kind(p).alias("kind"), scalars.source_tag(p).alias("source"), "size", F.sha2("content", 256).alias("sha256"), text.alias("text"))


def flags_to_variant(**flag: Column) -> Column:
    """Variant by precedence: game, subpackage, 4.x, standard, encrypted, unknown."""
    return (
        F.when(flag["game"], "game").when(flag["subpackage"], "subpackage").when(flag["like_4x"], "wechat4x").when(flag["standard"], "standard").when(flag["encrypted"], "encrypted").otherwise("unknown")
    )


def profile(df: DataFrame, found: DataFrame) -> DataFrame:
    """One row a package, from its bytes and the names of its files (conditional aggregates)."""
    p = F.col("path")
    has = lambda *names: F.coalesce(F.bool_or(p.isin(*names)), F.lit(False))
    named = found.groupBy("pkg_id").agg(
        has("app-config.json").alias("has_app_config"), has("app-service.js").alias("has_app_service"), has("workers.js").alias("has_workers"), has("page-frame.html").alias("has_page_frame_html"),
        has("page-frame.js").alias("has_page_frame_js"), has("app-wxss.js").alias("has_app_wxss"), has("game.json", "game.js").alias("is_game"),
        F.coalesce(F.bool_or(p.contains("/__APP__") | p.startswith("__APP__/")), F.lit(False)).alias("is_subpackage"),
    )
    flags = [c for c in named.columns if c != "pkg_id"]
    c = F.col("content")
    base = df.select("pkg_id", is_encrypted(c).alias("is_encrypted"), is_plain(c).alias("is_standard"), index_count(c).alias("index_file_count"))
    out = base.join(named, "pkg_id", "left").fillna(False, flags)
    like = F.col("has_app_config") | F.col("has_page_frame_html") | F.col("has_page_frame_js") | F.col("has_app_wxss")
    out = out.withColumn("is_4x_like", like)
    variant = flags_to_variant(game=F.col("is_game"), subpackage=F.col("is_subpackage"), like_4x=F.col("is_4x_like"), standard=F.col("is_standard"), encrypted=F.col("is_encrypted"))
    needs = {"needs_key_id": F.col("is_encrypted"), "supports_native": F.col("is_standard") | F.col("is_4x_like") | F.col("is_subpackage") | F.col("is_game") | F.col("has_app_service")}
    return out.withColumns({"variant": variant} | needs)


def encode(files_by_name: dict[str, bytes]) -> bytes:
    """A package: names sorted, offsets absolute, bodies in the order of names."""
    names = sorted(files_by_name)
    raw = [n.encode() for n in names]
    index_length = 4 + sum(12 + len(n) for n in raw)
    at, index = HEADER + index_length, [struct.pack(">I", len(names))]
    for name, key in zip(raw, names, strict=True):
        index.append(struct.pack(">I", len(name)) + name + struct.pack(">II", at, len(files_by_name[key])))
        at += len(files_by_name[key])
    body = b"".join(files_by_name[n] for n in names)
    return struct.pack(">BIIIB", FIRST, 0, index_length, len(body), LAST) + b"".join(index) + body


def encode_table(found: DataFrame) -> DataFrame:
    """(pkg_id, path, content) to (pkg_id, content): each package's files gathered, which bounds a task by one package."""
    ship(found.sparkSession)

    def pack(table: pa.Table) -> pa.Table:
        rows = dict(zip(table["path"].to_pylist(), table["content"].to_pylist(), strict=True))
        return pa.table({"pkg_id": [table["pkg_id"][0].as_py()], "content": pa.array([encode(rows)], pa.binary())})

    return found.select("pkg_id", "path", "content").groupBy("pkg_id").applyInArrow(pack, "pkg_id string, content binary")
