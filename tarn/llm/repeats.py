"""Removal of repeated strings: every byte covered by a SPAN-byte string that also starts anywhere else goes.

1. Anchors. Each SPAN-byte window selects the k-gram of least hash in it (leftmost, if tied), which depends on
   nothing but the window's content: equal windows select the same k-gram at the same place. Windows that share
   an anchor are consecutive, so a text has about one anchor in SPAN / 2 bytes. Anchors whose hash occurs once
   are dropped, and with them all windows that can't repeat. Copies of a whole text count as one text here.
2. Contexts. An anchor's windows together are its context. Equal contexts collapse to one with a count.
3. Suffix arrays. Contexts of one anchor hash are cut into eight-byte words aligned to the anchor, so equal windows
   are cut alike, and a block of such groups gets one suffix array over its words (suffix.py). Suffixes
   next to each other that share SPAN / 8 - 1 words form classes; within a class windows at each of the eight byte
   shifts are equal if the bytes left and right of the shared words are. All comparisons are of bytes, not hashes.
4. Windows found go back to the texts that hold the context; their union is what is removed.

No step gathers more than one text, one block of BLOCK bytes or one anchor's contexts in a task. An anchor with
more than HOT distinct contexts is settled by counting its windows' digests in a distributed aggregate instead.

Defined results: a null text is empty. Matches don't cross texts; the same text may match itself, overlaps
included. Repeated rows are copies, so all their bytes go if there are SPAN or more. Texts below SPAN stay whole. Bytes
are judged on the input. Extra columns are ignored; ids may be null or repeat. An empty table gives an empty table.
"""

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.suffix import suffix_array
from tarn.llm.work import discard, written
from tarn.session import ship

SPAN = 400
HOT = 8192
BLOCK = 2 << 20
_SEGMENT = 1 << 19
_ANCHORS = "array<struct<h:long,a:int,lo:int,hi:int>>"


class Anchors:
    """Finds the anchors of a text: (hash, position, first and last window start) for each run of windows."""

    def __init__(self, span: int):
        if span % 8 or span < 24:
            raise ValueError("span must be a multiple of 8, 24 at least")
        self.span, self.k = span, 32 if span >= 64 else 8
        n, base = _SEGMENT + span, 0x9E3779B97F4A7C15
        step = lambda x: np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(x)))), dtype=np.uint64)
        self.up, self.down = step(base), step(pow(base, -1, 1 << 64))
        self.value = np.random.default_rng(400).integers(0, 1 << 64, 256, dtype=np.uint64)

    def find(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = [self._segment(np.frombuffer(text[i : i + _SEGMENT + self.span - 1], np.uint8), i) for i in range(0, len(text) - self.span + 1, _SEGMENT)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4

    def _segment(self, x: np.ndarray, at: int):
        n, k, w = len(x), self.k, self.span - self.k + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[x] * self.up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        tagged = h & ~np.uint64(0xFFFFF) | np.arange(len(h), dtype=np.uint64)
        rows = np.concatenate((tagged, np.full(-len(h) % w, ~np.uint64(0)))).reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(h) - w + 1
        chosen = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        last = np.concatenate((first[1:], [m])) - 1
        return h[chosen[first]].view(np.int64), chosen[first] + at, first + at, last + at


def _text(batch: pa.RecordBatch, i: int) -> Iterator[bytes]:
    for t in batch.column(i).cast(pa.binary()):
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def scan(docs: DataFrame, key: str, text: str, span: int) -> DataFrame:
    """(doc_id, text_id binary: SHA-256, n_bytes, anchors) for each row."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(span)
        inner = pa.struct([("h", pa.int64()), ("a", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])
        for batch in batches:
            ids, n, at, parts = [], [], [0], [(np.zeros(0, np.int64),) * 4]
            for t in _text(batch, 1):
                ids.append(sha256(t).digest())
                n.append(len(t))
                parts.append(finder.find(t))
                at.append(at[-1] + len(parts[-1][0]))
            columns = [pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*parts, strict=True), inner, strict=True)]
            anchors = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(inner)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), anchors], ["doc_id", "text_id", "n_bytes", "anchors"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, text_id binary, n_bytes long, anchors {_ANCHORS}")


def _contexts(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tid", "base", "ck", "h", "off", "ctx"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
        rows: list[list] = [[] for _ in names]
        size = 0
        for batch in batches:
            for tid, t, anchors in zip(batch.column(0).to_pylist(), _text(batch, 1), batch.column(2).to_pylist(), strict=True):
                for x in anchors:
                    ctx, off = t[x["lo"] : x["hi"] + span], x["a"] - x["lo"]
                    ck = blake2b(x["h"].to_bytes(8, "big", signed=True) + off.to_bytes(4, "big") + ctx, digest_size=16).digest()
                    for column, value in zip(rows, (tid, x["lo"], ck, x["h"], off, ctx), strict=True):
                        column.append(value)
                    size += len(ctx)
                    if size > BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)
                        rows, size = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

    return run


def repeated_windows(contexts: list[tuple[bytes, int]], counts: list[int], span: int) -> list[np.ndarray]:
    """For each (context, place of the anchor in it), by count of its occurrences: which window starts repeat."""
    core = span // 8 - 1
    pads = [-off % 8 for _, off in contexts]
    data = [b"\0" * p + c + b"\0" * (-(p + len(c)) % 8) for (c, _), p in zip(contexts, pads, strict=True)]
    words_in = np.array([len(d) // 8 for d in data])
    n = len(contexts)
    heads = np.concatenate(([0], np.cumsum(words_in + 1)[:-1]))
    words = np.frombuffer(b"".join(d + b"\0" * 8 for d in data), ">u8").astype(np.uint64)
    ends = heads + words_in
    symbols = np.unique(words, return_inverse=True)[1].astype(np.int64) + n
    symbols[ends] = np.arange(n - 1, -1, -1)  # a symbol of its own ends each context; the last is the least
    owner = np.repeat(np.arange(n), words_in + 1)
    sa = np.array(suffix_array(symbols), np.int64)
    sa = sa[sa + core <= ends[owner[sa]]]
    alike = np.arange(1, len(sa))
    for j in range(core):
        alike = alike[symbols[sa[alike] + j] == symbols[sa[alike - 1] + j]]
    starts = np.ones(len(sa), bool)
    starts[alike] = False
    klass = np.cumsum(starts)
    weight = np.minimum(np.array(counts), 2)[owner[sa]]
    some = np.bincount(klass, weight)[klass] >= 2 if len(sa) else np.zeros(0, bool)
    sa, klass, weight = sa[some], klass[some], weight[some]
    ctx = owner[sa]
    lengths = np.array([len(c) for c, _ in contexts])
    windows = np.maximum(lengths - span + 1, 0)
    flags, offset = np.zeros(windows.sum(), bool), np.concatenate(([0], np.cumsum(windows)[:-1]))
    place = 8 * (sa - heads[ctx]) - np.array(pads)[ctx]
    for r in range(8):
        at = place - r
        ok = np.flatnonzero((at >= 0) & (at < windows[ctx]))
        mask = np.uint64((1 << 8 * r) - 1)
        around = words[sa[ok] - 1] & mask | words[np.minimum(sa[ok] + core, len(words) - 1)] & ~mask
        order = np.lexsort((around, klass[ok]))
        a, k, w = around[order], klass[ok][order], weight[ok][order]
        same = (a[1:] == a[:-1]) & (k[1:] == k[:-1])
        hit = w >= 2
        hit[1:] |= same
        hit[:-1] |= same
        hit_rows = ok[order[hit]]
        flags[offset[ctx[hit_rows]] + at[hit_rows]] = True
    return np.split(flags, offset[1:])


def runs(flags: np.ndarray) -> list[dict]:
    """First and last index of each run of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return [{"s": int(a), "e": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_RUNS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _search(span: int):
    """Rows (h, ck, off, ctx, n), each h together and in order, to (ck, found) for contexts with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: list[tuple]) -> pa.RecordBatch:
            flags = repeated_windows([(c, o) for _, o, c, _ in rows], [n for *_, n in rows], span)
            found = [(ck, runs(f)) for (ck, *_), f in zip(rows, flags, strict=True) if f.any()]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.binary()), pa.array([f for _, f in found], _RUNS)], ["ck", "found"])

        rows, group, size, last = [], [], 0, None
        for batch in batches:
            for h, ck, off, ctx, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != last:
                    if len(group) > 1 or any(x[3] > 1 for x in group):
                        rows += group
                    if size > BLOCK and rows:
                        yield settle(rows)
                        rows = []
                    size = 0 if not rows else size
                    group, last = [], h
                group.append((ck, off, ctx, n))
                size += len(ctx)
        rows += group if len(group) > 1 or any(x[3] > 1 for x in group) else []
        if rows:
            yield settle(rows)

    return run


def _window_digests(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, ck, off, ctx, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = len(ctx) - span + 1
                digests = [blake2b(ctx[i : i + span], digest_size=16).digest() for i in range(m)]
                yield pa.RecordBatch.from_arrays([pa.array([ck] * m, pa.binary()), pa.array(range(m), pa.int32()), pa.array(digests, pa.binary()), pa.array([n] * m, pa.int64())], ["ck", "s", "w", "n"])

    return run


def _cut(span: int):
    """Rows (tid, text, hits) to the removed spans and digests of what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for tid, t, hits in zip(batch.column(0).to_pylist(), _text(batch, 1), batch.column(2).to_pylist(), strict=True):
                edges = np.zeros(len(t) + 1, np.int32)
                for x in hits:
                    for f in x["found"]:
                        edges[x["base"] + f["s"]] += 1
                        edges[x["base"] + f["e"] + span] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                spans = runs(gone)
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                for column, value in zip(out, (tid, int(gone.sum()), len(spans), sha256(kept).hexdigest(), spans), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), _RUNS]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["tid", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, text_id, n_bytes, n_removed, n_spans, kept_sha256, spans: first and last byte of each removed run)."""
    rows = written(scan(docs, key, text, span), "anchors")
    texts = rows.groupBy("text_id").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("anchors").alias("anchors"))
    texts = written(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")

    each = texts.select("tid", F.explode("anchors").alias("x")).select("tid", "x.*")
    # as a table with an exchange of its own, so that adaptive execution can split the partition of a hot anchor
    often = written(each.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"), "often")
    shared = each.join(often.hint("merge"), "h").groupBy("tid").agg(F.collect_list(F.struct("h", "a", "lo", "hi")).alias("shared"))
    shared = shared.join(texts.select("tid", "text_id"), "tid")

    bodies = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("body"))
    bodies = bodies.where(F.octet_length("body") >= span).withColumn("text_id", F.unhex(F.sha2("body", 256)))
    one = bodies.withColumn("k", F.row_number().over(Window.partitionBy("text_id").orderBy("text_id"))).where("k = 1").drop("k")
    bodies = written(one.join(shared, "text_id").select("tid", "body", "shared"), "bodies")

    discard(often)

    found_in = written(bodies.mapInArrow(_contexts(span), "tid long, base int, ck binary, h long, off int, ctx binary"), "contexts")
    distinct = found_in.groupBy("ck").agg(F.count("*").alias("n"), F.first("h").alias("h"), F.first("off").alias("off"), F.first("ctx").alias("ctx"))
    distinct = written(distinct.select("h", "ck", "off", "ctx", "n"), "distinct")
    hot = distinct.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > HOT).select("h")
    usual = distinct.join(hot, "h", "left_anti").repartition("h").sortWithinPartitions("h").mapInArrow(_search(span), "ck binary, found array<struct<s:int,e:int>>")
    windows = distinct.join(hot, "h", "left_semi").mapInArrow(_window_digests(span), "ck binary, s int, w binary, n long")
    again = windows.groupBy("w").agg(F.sum("n").alias("m")).where("m > 1").select("w")
    counted = windows.join(again, "w").groupBy("ck").agg(F.collect_list(F.struct("s", F.col("s").alias("e"))).alias("found"))
    found = written(usual.unionByName(counted), "found")
    discard(distinct)

    hits = found_in.select("ck", "tid", "base").join(found, "ck").groupBy("tid").agg(F.collect_list(F.struct("base", "found")).alias("hits"))
    cut = bodies.select("tid", "body").join(hits, "tid").mapInArrow(_cut(span), "tid long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:int,e:int>>")

    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= span)
    pick = lambda every, some, none: F.when(whole, every).otherwise(F.coalesce(some, none))
    all_of_it = F.array(F.struct(F.lit(0).alias("s"), (F.col("n_bytes") - 1).cast("int").alias("e")))
    result = texts.select("tid", "text_id", "copies", "n_bytes").join(cut, "tid", "left").select(
        "text_id",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.sha2(F.lit(b""), 256), F.col("kept_sha256"), F.lower(F.hex("text_id"))).alias("kept_sha256"),
        pick(all_of_it, F.col("spans"), F.array().cast("array<struct<s:int,e:int>>")).alias("spans"),
    )
    result = written(result, "result")
    discard(texts, bodies, found_in, found)
    return rows.select("doc_id", "text_id", "n_bytes").join(result, "text_id")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """docs with kept (binary): the text's bytes less those removed."""
    spans = repeats(docs, key, text, span).select("text_id", "spans").dropDuplicates(["text_id"])
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    keyed = docs.drop("kept").withColumn("__t", F.unhex(F.sha2(body, 256)))
    joined = keyed.join(spans.withColumnsRenamed({"text_id": "__t", "spans": "__s"}), "__t")
    at = F.concat(F.array(F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"))), F.col("__s"))
    piece = lambda x, i: F.substring(body, x["e"] + 2, F.coalesce(F.get(F.col("__s"), i)["s"], F.octet_length(body)) - x["e"] - 1)
    kept = F.aggregate(F.transform(at, piece), F.lit(b""), lambda a, b: F.concat(a, b))
    return joined.withColumn("kept", kept).drop("__t", "__s")
