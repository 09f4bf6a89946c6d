"""What each of five filters removes, in every order of applying them, by part of the corpus.

1. scan: one pass over the bytes of Arrow text columns. Byte classes and their prefix sums count capitals,
   symbols and code points; words are found and their verified hashes sorted (bytescan) for distinct words.
   A text becomes four failure bits and its SHA-256.
2. Equal texts: the smallest key of a digest that occurs twice or more is joined back. The aggregate combines
   before its shuffle, the join is a sort-merge join between exchanges, so a hot text is split.
3. Masks: everything asked for depends on a text's part, its five bits and its labels only, so rows shrink to
   at most 32 counts a part, and the counts of all orders and steps are their product with a fixed matrix.

Defined results: a null text is empty, a null part the part "". A row without key is in no order: it never
counts as a copy, nothing is a copy of it, and it has no label. Rows that repeat a key are counted one by
one and aren't copies of each other. A key is good or toxic if any of its labels says so. Each row fails or
passes by its own text: ties need nothing. An empty table gives no parts. Only the named columns are read,
so other columns may have any name. A long text is a block of its own.
"""

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.bytescan import SPACE, byte_class, cut, distinct, hashes, words
from tarn.llm.work import discard, written
from tarn.session import ship

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
SYMBOLS = byte_class(b"#$%&*|")
CAPITALS = byte_class(bytes(range(ord("A"), ord("Z") + 1)))
#: Bytes that begin a code point.
LEADS = ~byte_class(bytes(range(0x80, 0xC0)))
_PARTS = 256
_COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def masks(column: pa.Array, min_words: int = MIN_WORDS, min_distinct: int = MIN_DISTINCT, max_capitals: int = MAX_CAPITALS) -> np.ndarray:
    """Bits A to D of each text: few words, few distinct words, many capitals, any symbol. The last two arguments are percentages."""
    out = []
    for block in cut(column):
        text, found = block.data[:-8], words(block, SPACE)
        n = np.bincount(found.text, minlength=block.size)
        _, members = distinct(block.data, found.start, found.length, found.text, hashes(block.data, found.start, found.length))
        different = np.bincount(found.text[members], minlength=block.size)
        capitals, points = block.per_text(CAPITALS[text]), block.per_text(LEADS[text])
        fails = (n < min_words, 100 * different < min_distinct * n, 100 * capitals > max_capitals * points, block.per_text(SYMBOLS[text]) > 0)
        out.append(sum(f.astype(np.int32) << i for i, f in enumerate(fails)))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", **limits: int) -> DataFrame:
    """(key, part, mask, digest) of each row, without a shuffle. limits: those of masks()."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2).cast(pa.binary())
            digests = [hashlib.sha256(t.as_buffer() if t.is_valid else b"").digest() for t in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks(column, **limits), pa.int32()), pa.array(digests, pa.binary())], ["key", "part", "mask", "digest"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, part string, mask int, digest binary")


def with_copies(scanned: DataFrame) -> DataFrame:
    """The rows with bit E set where a smaller key has the same digest."""
    firsts = scanned.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    joined = scanned.join(firsts, "digest", "left")
    return joined.select("key", "part", (F.col("mask") + F.when(F.col("key") > F.col("first"), 16).otherwise(0)).alias("mask"))


def counts(flagged: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 rows a part."""
    said = labels.groupBy(F.col(key).cast("long").alias("key")).agg(F.max(F.expr(f"cast(`{quality}` = 1 as int)")).alias("good"), F.max(F.expr(f"cast(`{toxic}` = 1 as int)")).alias("toxic"))
    joined = flagged.join(said.where("good = 1 or toxic = 1"), "key", "left")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c)
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def steps() -> tuple[list[str], np.ndarray, dict[str, np.ndarray]]:
    """The 120 orders; the filter of each of the 600 (order, step) pairs; for each count a 0/1 matrix from those pairs to masks."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    index = np.array([[FILTERS.index(f) for f in o] for o in orders])
    own = (1 << index).reshape(-1, 1)
    earlier = (np.cumsum(1 << index, axis=1) - (1 << index)).reshape(-1, 1)
    mask = np.arange(32).reshape(1, -1)
    fails, before = (mask & own) > 0, (mask & earlier) > 0
    tables = {"kept": ~fails & ~before, "removed": fails & ~before, "redundant": fails & before, "unique_fails": mask == own}
    return orders, index.reshape(-1), {k: v.astype(np.int64) for k, v in tables.items()}


def interactions(counted: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part."""
    ship(counted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, own, tables = steps()
        pairs = len(own)
        for whole in batches:
            for at in range(0, len(whole), _PARTS):
                batch = whole.slice(at, _PARTS)
                m = len(batch)
                n, good, toxic = (np.zeros((m, 32), np.int64) for _ in range(3))
                for i, cells in enumerate(batch.column(1).to_pylist()):
                    for c in cells:
                        n[i, c["mask"]], good[i, c["mask"]], toxic[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                out = {k: n @ t.T for k, t in tables.items()}
                out |= {"good_lost": good @ tables["removed"].T, "toxic_lost": toxic @ tables["removed"].T}
                by_filter = np.stack([out["removed"][:, own == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
                out["shapley"] = by_filter[:, own]
                columns = [batch.column(0).take(pa.array(np.repeat(np.arange(m), pairs))), pa.array(orders * m).take(pa.array(np.repeat(np.arange(m * len(orders)), len(FILTERS)))), pa.array(np.tile(np.arange(1, 6, dtype=np.int32), m * len(orders)))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(out[c].reshape(-1)) for c in _COLUMNS], ["part", "filter_order", "step", *_COLUMNS])

    cells = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COLUMNS))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", **limits: int) -> DataFrame:
    """interactions() of the five filters over docs."""
    scanned = written(scan(docs, key, text, part, **limits), "scanned")
    counted = written(counts(with_copies(scanned), labels, key), "masks")  # at most 32 rows a part
    discard(scanned)
    return interactions(counted)
