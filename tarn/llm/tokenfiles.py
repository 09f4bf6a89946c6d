"""Token ids of documents in compressed binary files, written and read as a Spark data source.

encode: texts to ids with a tokenizers file of the byte-level kind, in Arrow batches. Between two
characters of different classes (ASCII and Latin letters: blank after a non-blank, letter beside digit or mark, but
for a letter after an apostrophe) the
tokenizer's own pattern always splits, whatever stands left and right. So a block of texts is cut there with NumPy,
its distinct pieces are found (bytescan) and only those go through the library, unless a worker has met them; ids are
then laid out by index. A piece that the pattern leaves whole goes to the library's merges directly, others through
all its steps. in_order deals documents by ranges of their key and sorts them.

Files: one a task, in the order of the tasks. A file is a row of shards of about SHARD ids, each with a Re-Pair
grammar of its own (repair), and a footer that lists them; the commit writes one line for each file, with the
number of ids before it. What a lost or repeated attempt left behind isn't in that list. A shard holds keys,
numbers of ids, ends of documents in the sequence, terminals, rules with the lengths of their expansions, and
the sequence, in the narrowest of two widths. find() gets any ids of one document without decoding others.

Defined results: a null text is empty (its end id alone). Null keys come first. Rows that repeat a key are all
written, in the order of their texts' hashes, equal ones in the order of the input, so a hot key is spread over
several tasks. Bytes that aren't UTF-8 become U+FFFD. The tokenizer's special strings in a text are ordinary
text. An empty table gives no files and no rows. Only the named columns are read. A long document makes its
shard longer.
"""

import json
import os
import re
import uuid
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tarn.llm import repair
from tarn.llm.bytescan import Texts, cut, distinct, hashes, spread
from tarn.llm.warc import _open, _remove
from tarn.session import ship

SHARD = 1 << 20
#: Pieces that a worker remembers, at some 200 bytes each (160 MB), and bytes of texts encoded at a time.
CACHE, BLOCK = 800_000, 4 << 20
LIST = "_files.json"
MAGIC = b"TARNTOK1"
FIELDS = "doc_id long, start long, n_tokens long, ids binary"
_BATCH = 4 << 20

_SPACE, _LETTER, _DIGIT, _MARK, _QUOTE, _OTHER = range(6)


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[0x21:0x7F] = _MARK
    out[list(b" \t\n\v\f\r")] = _SPACE
    out[ord("0") : ord("9") + 1] = _DIGIT
    for first, last in ("AZ", "az"):
        out[ord(first) : ord(last) + 1] = _LETTER
    out[ord("'")] = _QUOTE
    return out


_CLASS = _classes()
_SPLITS = np.zeros((6, 6), bool)
for _before, _after in (
    (_LETTER, (_SPACE, _DIGIT, _MARK, _QUOTE)), (_DIGIT, (_SPACE, _LETTER, _MARK, _QUOTE)), (_MARK, (_SPACE, _LETTER, _DIGIT)), (_QUOTE, (_SPACE, _DIGIT)),
):
    _SPLITS[_before, list(_after)] = True
_SPLITS = _SPLITS.reshape(-1)


def pieces(block: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the pieces of a block's texts, which together are its bytes."""
    kind = _CLASS[block.data[:-8]]
    lead = np.flatnonzero((block.data[:-8] >= 0xC3) & (block.data[:-8] <= 0xC9))  # two bytes of U+00C0 to U+024F, all letters but two
    point = (block.data[lead].astype(np.int32) & 31) << 6 | (block.data[lead + 1] & 63)
    lead = lead[(block.data[lead + 1] >> 6 == 2) & (point != 0xD7) & (point != 0xF7)]
    kind[lead] = kind[lead + 1] = _LETTER
    begins = np.zeros(len(kind), bool)
    begins[1:] = _SPLITS[kind[:-1] * 6 + kind[1:]]
    begins[block.at[:-1][block.at[:-1] < len(kind)]] = True
    start = np.flatnonzero(begins)
    return start, np.diff(np.append(start, len(kind)))


#: Pieces that the pattern leaves whole: Latin letters, digits or marks, after a blank or none. Letters beyond ASCII are two bytes, C3 80 to C9 8F, but for C3 97 and C3 B7.
_WHOLE = re.compile(rb" ?(?:(?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])++|[0-9]++|[!-&(-/:-@\[-`{-~]++)").fullmatch


def _letters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return "".join(chr(b if b in prints else 256 + others.index(b)) for b in range(256))


class Pieces:
    """Ids of pieces, each encoded when first met. Two generations of them are kept: what the newer one lacks is looked up in the older."""

    def __init__(self, spec: str, size: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.half, self.letters = Tokenizer.from_str(spec), size // 2, _letters()
        self.tokenizer.encode_special_tokens = True
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        kind = json.loads(spec)
        before = kind["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before["add_prefix_space"] or kind["normalizer"] or any(not t["special"] for t in kind["added_tokens"]):
            raise ValueError("not a byte-level tokenizer with the usual pattern")

    def find(self, found: list[bytes]) -> list[bytes]:
        """The ids of each piece as unsigned 32-bit numbers."""
        if len(self.new) > self.half:
            self.old, self.new = self.new, {}
        new, old, mixed, tokenize, letters = self.new, self.old, [], self.tokenizer.model.tokenize, self.letters
        for p in found:
            if p in new:
                continue
            if ids := old.get(p):
                new[p] = ids
            elif _WHOLE(p):
                new[p] = array("I", [t.id for t in tokenize(charmap_decode(p, "strict", letters)[0])]).tobytes()
            else:
                mixed.append(p)
        for p, e in zip(mixed, self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in mixed], add_special_tokens=False), strict=True):
            new[p] = array("I", e.ids).tobytes()
        return list(map(new.__getitem__, found))

    def encode(self, block: Texts, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; where each text's ids end)."""
        start, length = pieces(block)
        none = np.zeros(len(start), np.int64)
        number, members = distinct(block.data, start, length, none, hashes(block.data, start, length))
        data = block.data.tobytes()
        known = self.find([data[i:j] for i, j in zip(start[members].tolist(), (start + length)[members].tolist(), strict=True)])
        ids, lengths = np.frombuffer(b"".join(known), np.uint32), np.fromiter(map(len, known), np.int64, len(known)) // 4
        n = lengths[number]
        sums = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=sums[1:])
        ends = sums[np.searchsorted(start, block.at[1:])] + np.arange(1, block.size + 1)
        out = np.full(int(ends[-1]), end, np.uint32)
        text = np.ones(len(out), bool)
        text[ends - 1] = False
        out[text] = ids[spread((np.cumsum(lengths) - lengths)[number], n)]
        return out, ends


_WORKER: dict[str, Pieces] = {}


def remembered(name: str, spec: str) -> Pieces:
    """The pieces that this worker has met, in whichever task."""
    if name not in _WORKER:
        _WORKER[name] = Pieces(spec)
    return _WORKER[name]


def encode(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit numbers, the end id last. Keeps the rows' order; no shuffle."""
    ship(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(tokenizer, spec.value)
        for batch in batches:
            for block in cut(batch.column(1), BLOCK):
                ids, ends = known.encode(block, end)
                at = np.concatenate(([0], 4 * ends)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.size), pa.BinaryArray.from_buffers(pa.binary(), block.size, [None, pa.py_buffer(at), pa.py_buffer(ids)])], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """(key, text) dealt by ranges of the key and sorted; spark.sql.shuffle.partitions ranges unless a number is given."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), F.asc("tie"), F.asc("row")]
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).select("doc_id", "text")


def shard_bytes(keys: list[int | None], tokens: np.ndarray, ids: np.ndarray) -> bytes:
    grammar, seq, ends = repair.compress(ids, np.cumsum(tokens))
    wide = len(grammar.lengths) > 1 << 16
    head = np.array([len(keys), len(grammar.terminals), len(grammar.rules), len(seq), wide], "<i8")
    arrays = [head, np.array([k or 0 for k in keys], "<i8"), np.array([k is not None for k in keys], "u1"), tokens.astype("<i8"), ends.astype("<i8")]
    arrays += [grammar.terminals.astype("<u4"), grammar.rules.astype("<u4"), grammar.lengths[len(grammar.terminals) :].astype("<u4"), seq.astype("<u4" if wide else "<u2")]
    return b"".join(a.tobytes() for a in arrays)


class Shard:
    """A shard's arrays; ids are expanded when asked for."""

    def __init__(self, data: bytes):
        docs, terminals, rules, seq, wide = np.frombuffer(data, "<i8", 5).tolist()
        at = 40

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        keys, there = take("<i8", docs), take("u1", docs)
        self.keys = pa.array(keys, mask=there == 0)
        self.tokens, self.ends = take("<i8", docs), take("<i8", docs)
        t = take("<u4", terminals)
        r, lengths = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64), take("<u4", rules).astype(np.int64)
        self.grammar = repair.Grammar(t, r, np.concatenate((np.ones(terminals, np.int64), lengths)))
        self.seq = take("<u4" if wide else "<u2", seq)

    def document(self, i: int) -> np.ndarray:
        """The part of the sequence that is document i."""
        return self.seq[self.ends[i - 1] if i else 0 : self.ends[i]]

    def batches(self, start: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
        before = start + np.cumsum(self.tokens) - self.tokens
        flat = self.grammar.flat() if with_ids else None
        i = 0
        while i < len(self.keys):
            j = max(i + 1, int(np.searchsorted(before, before[i] + _BATCH // 4)))
            ids = pa.nulls(j - i, pa.binary())
            if with_ids:
                found = repair.expand(self.grammar, self.seq[self.ends[i - 1] if i else 0 : self.ends[j - 1]], flat).astype("<u4")
                at = np.concatenate(([0], 4 * np.cumsum(self.tokens[i:j]))).astype(np.int32)
                ids = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at), pa.py_buffer(found)])
            yield pa.RecordBatch.from_arrays([self.keys.slice(i, j - i), pa.array(before[i:j]), pa.array(self.tokens[i:j]), ids], ["doc_id", "start", "n_tokens", "ids"])
            i = j


@dataclass
class File(InputPartition):
    path: str
    size: int
    start: int


@dataclass
class Written(WriterCommitMessage):
    task: int
    file: str | None
    size: int
    docs: int
    ids: int


class TokenWriter(DataSourceArrowWriter):
    """Rows (doc_id, ids), or (doc_id, text) with a tokenizer, in order within a task and from task to task."""

    def __init__(self, options):
        self.path, self.shard = options["path"].rstrip("/"), int(options.get("shardIds", SHARD))
        self.tokenizer, self.end, self.spec = options.get("tokenizer"), int(options.get("end", "0")), None
        if self.tokenizer:
            with open(self.tokenizer, encoding="utf-8") as f:
                self.spec = f.read()

    def documents(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        for batch in iterator:
            keys, column = batch.column(0).to_pylist(), batch.column(1)
            if self.spec is None:
                for key, value in zip(keys, column, strict=True):
                    yield key, np.frombuffer(value.as_buffer(), "<u4") if value.is_valid else np.zeros(0, "<u4")
                continue
            known = remembered(self.tokenizer, self.spec)
            for block in cut(column, BLOCK):
                ids, ends = known.encode(block, self.end)
                for i, (begin, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                    yield keys[block.first + i], ids[begin:end]

    def write(self, iterator):
        name, out, size, docs, ids, footer = f"part-{uuid.uuid4().hex}.tok", None, 0, 0, 0, []
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        tokens: list[int] = []

        def flush() -> None:
            nonlocal size, docs, ids
            data = shard_bytes(keys, np.array(tokens, np.int64), np.concatenate(held))
            out.write(data)
            n = sum(tokens)
            footer.append([size, len(data), len(keys), n, keys[0], keys[-1]])
            size, docs, ids = size + len(data), docs + len(keys), ids + n
            for x in (keys, held, tokens):
                x.clear()

        try:
            have = 0
            for key, found in self.documents(iterator):
                out = out or _open(f"{self.path}/{name}", "wb")
                keys.append(key)
                tokens.append(len(found))
                held.append(found)
                have += len(found)
                if have >= self.shard:
                    flush()
                    have = 0
            if keys:
                flush()
            if out:
                tail = json.dumps(footer).encode()
                out.write(tail + len(tail).to_bytes(8, "little") + MAGIC)
                size += len(tail) + 16
        finally:
            if out:
                out.close()
        return Written(TaskContext.get().partitionId(), name if out else None, size, docs, ids)

    def commit(self, messages):
        listed, start = [], 0
        for m in sorted((m for m in messages if m and m.file), key=lambda m: m.task):
            listed.append({"file": m.file, "size": m.size, "start": start, "docs": m.docs, "ids": m.ids})
            start += m.ids
        with _open(f"{self.path}/{LIST}", "wb") as f:
            f.write(json.dumps(listed).encode())

    def abort(self, messages):
        for m in messages:
            if m and m.file:
                _remove(f"{self.path}/{m.file}")


def _footer(f, size: int) -> list[list]:
    f.seek(size - 16)
    tail = f.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a file of token ids")
    n = int.from_bytes(tail[:8], "little")
    f.seek(size - 16 - n)
    return json.loads(f.read(n))


class TokenReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.ids = options["path"].rstrip("/"), options.get("ids", "true") == "true"

    def partitions(self):
        return [File(f"{self.path}/{x['file']}", x["size"], x["start"]) for x in listing(self.path)] or [File("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        start = partition.start
        with _open(partition.path, "rb") as f:
            for at, size, _, ids, _, _ in _footer(f, partition.size):
                f.seek(at)
                yield from Shard(f.read(size)).batches(start, self.ids)
                start += ids


class TokenSource(DataSource):
    @classmethod
    def name(cls):
        return "token_ids"

    def schema(self):
        return FIELDS

    def reader(self, schema):
        return TokenReader(self.options)

    def writer(self, schema, overwrite):
        return TokenWriter(self.options)


def listing(path: str) -> list[dict]:
    with _open(f"{path}/{LIST}", "rb") as f:
        return json.loads(f.read())


def write(rows: DataFrame, path: str, shard_ids: int = SHARD, tokenizer: str | None = None, end: int = 0) -> None:
    """Rows (doc_id, ids) of encode(), or with a tokenizer rows (doc_id, text), to files below path, which must be new.

    A reader sees them in the order of partitions and rows. Texts are encoded in the writer's task, so ids don't go through Spark.
    """
    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(TokenSource)
    out = rows.write.format("token_ids").mode("append").option("path", path).option("shardIds", shard_ids).option("end", end)
    (out.option("tokenizer", tokenizer) if tokenizer else out).save()


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids): a task for each file. Without ids nothing is expanded."""
    ship(spark)
    spark.dataSource.register(TokenSource)
    return spark.read.format("token_ids").option("path", path).option("ids", str(ids).lower()).load()


def find(path: str, key: int, start: int = 0, stop: int | None = None) -> list[np.ndarray]:
    """Ids start .. stop - 1 of each document of that key. Reads footers and the shards whose keys may hold it."""
    out = []
    for x in listing(path):
        with _open(f"{path}/{x['file']}", "rb") as f:
            for at, size, _, _, first, last in _footer(f, x["size"]):
                if last is None or not (first is None or first <= key) or last < key:
                    continue
                f.seek(at)
                shard = Shard(f.read(size))
                for i in np.flatnonzero(np.array(shard.keys.fill_null(key - 1)) == key).tolist():
                    out.append(repair.window(shard.grammar, shard.document(i), start, int(shard.tokens[i]) if stop is None else stop))
    return out
