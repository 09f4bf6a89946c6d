"""Byte-level BPE: ranked merges over the bytes of distinct words, and decoding by concatenation.

Two styles give the same ids.

* ``encode_columns``: Spark higher-order functions only. Each distinct word of a text becomes an array of
  one-byte binaries, over which ``aggregate`` folds merges, the lowest rank first; ranks come from a
  literal map, held as an array of small maps by hash since a lookup in one Spark map walks all its keys.
  ``decode_column`` concatenates the ids' binary pieces out of a literal array.
* ``encode``: the same fold over distinct words in Arrow batches, each word merged once for a task's cache.
  The higher-order functions are interpreted and give each text its own distinct words; README.md has the
  figures for which the queries use this one.

Defined results: a null text counts as empty and has no ids. Bytes that aren't UTF-8 become U+FFFD. Long
pieces are merged with a heap, in n log n. Rows are independent: ties, repeated rows, empty tables and
extra columns need nothing. A column of the input with the name of a result is replaced.
"""

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tarn.llm.work import let
from tarn.session import ship

#: Pieces cached by a task; at a few hundred bytes each, under 100 MB.
CACHE = 250_000
_HEAP_FROM = 64
_BUCKETS = 1 << 15


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The word's ids: the pair of lowest rank, leftmost first, is joined until none has a rank."""
    if word in ranks:
        return (ranks[word],)
    if len(word) > _HEAP_FROM:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    order = [get(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while order and (least := min(order)) != _NONE:
        i = order.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del order[i]
        if i < len(order):
            order[i] = get(parts[i] + parts[i + 1], _NONE)
        if i:
            order[i - 1] = get(parts[i - 1] + parts[i], _NONE)
    return tuple(ranks[p] for p in parts)


_NONE = 1 << 62


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part starts at i and ends at end[i]; end[i] = 0 once joined
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # a part of the pair was joined meanwhile
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (b := before[i]) >= 0 and (r := ranks.get(word[b:stop])) is not None:
            heapq.heappush(heap, (r, b, stop))
    return tuple(ranks[word[i : end[i]]] for i in range(n) if end[i])


class Words(dict):
    """Ids by piece, each merged when first met; emptied when full."""

    def __init__(self, ranks: dict[bytes, int], size: int = CACHE):
        self.ranks, self.size = ranks, size

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.size:
            self.clear()
        self[piece] = ids = merge(piece.encode(), self.ranks)
        return ids


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with ids array<int>, and if named so a column with the SHA-256 of the ids decoded again. Needs no shuffle."""
    ship(docs.sparkSession)
    out = docs.drop(ids, *([decoded] if decoded else []))
    pieces = {i: p for p, i in ranks.items()}
    schema = StructType([*out.schema.fields, StructField(ids, ArrayType(IntegerType())), *([StructField(decoded, StringType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        import regex

        find, words = regex.compile(pattern).findall, Words(ranks)
        for batch in batches:
            at, column, shas = [0], [], []
            for t in batch.column(text).cast(pa.binary()):
                got = list(chain.from_iterable(map(words.__getitem__, find(t.as_buffer().to_pybytes().decode("utf-8", "replace"))))) if t.is_valid else []
                column.append(pa.array(got, pa.int32()))
                at.append(at[-1] + len(got))
                if decoded:
                    shas.append(sha256(b"".join(map(pieces.__getitem__, got))).hexdigest())
            flat = pa.concat_arrays(column) if column else pa.array([], pa.int32())
            new = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat), *([pa.array(shas, pa.string())] if decoded else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [f.name for f in schema.fields])

    return out.mapInArrow(run, schema)


def literal_ranks(ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal: piece -> bucket pmod(xxhash64(hex), _BUCKETS) -> map from hex to rank."""
    import xxhash

    buckets: list[list[str]] = [[] for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        h = xxhash.xxh64_intdigest(key.encode(), seed=42)
        buckets[(h - (h >> 63 << 64)) % _BUCKETS].append(f'"{key}":{rank}')
    return F.from_json(F.lit("[" + ",".join("{" + ",".join(b) + "}" for b in buckets) + "]"), "array<map<string,int>>")


def encode_columns(text: Column, ranks: dict[bytes, int], pattern: str) -> Column:
    """The text's ids as array<int>, by Spark's higher-order functions."""
    table = literal_ranks(ranks)
    rank = lambda piece: let(F.hex(piece), lambda k: F.try_element_at(F.get(table, F.pmod(F.xxhash64(k), F.lit(_BUCKETS)).cast("int")), k))

    def step(parts: Column, _) -> Column:
        order = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p, i: rank(F.concat(p, F.get(parts, i + 1))))
        join = lambda i: F.concat(F.slice(parts, 1, i - 1), F.array(F.concat(F.get(parts, i - 1), F.get(parts, i))), F.slice(parts, i + 2, F.size(parts)))
        return let(order, lambda o: F.when(F.array_min(o).isNull(), parts).otherwise(let(F.array_position(o, F.array_min(o)).cast("int"), join)))

    def ids(word: Column) -> Column:
        data = word.cast("binary")
        single = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.substring(data, i, 1))
        steps = F.sequence(F.lit(1), F.octet_length(data))
        fold = F.aggregate(steps, single, step, lambda parts: F.transform(parts, rank))
        return F.when(rank(data).isNotNull(), F.array(rank(data))).otherwise(fold)

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))
    known = lambda w: F.map_from_entries(F.transform(F.array_distinct(w), lambda x: F.struct(x.alias("k"), ids(x).alias("v"))))
    return let(words, lambda w: let(known(w), lambda m: F.flatten(F.transform(w, lambda x: F.element_at(m, x)))))


def decode_column(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The binary pieces of the ids, concatenated. An id without a piece gives null."""
    hexes = {i: p.hex() for p, i in ranks.items()}
    pieces = F.from_json(F.lit("[" + ",".join(f'"{hexes[i]}"' if i in hexes else "null" for i in range(max(hexes, default=-1) + 1)) + "]"), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): ids encoded and decoded again, without shipping them back to the JVM."""
    ship(docs.sparkSession)
    pieces = {i: p for p, i in ranks.items()}
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        import regex

        find, words, names = regex.compile(pattern).findall, Words(ranks), {i: str(i) for i in pieces}
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1).cast(pa.binary()):
                whole = t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else ""
                ids = list(chain.from_iterable(map(words.__getitem__, find(whole))))
                n.append(len(ids))
                a.append(sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                b.append(sha256(b"".join(map(pieces.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


