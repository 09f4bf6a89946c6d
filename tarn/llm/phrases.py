"""Phrases that occur more often than their parts suggest, mined level by level (Apriori).

A text is lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words. Level k counts
k-word phrases within pieces, by language, in one pass over the texts:

1. A task numbers the words of a block of bytes exactly (bytescan), counts phrases as tuples of such numbers and
   hands on one row for each phrase of the block; Spark deals these by phrase and sums them. Few phrases recur from block to block, so
   combining them once more before the shuffle would cost a table of nearly all of a task's phrases.
2. Phrases of `least` occurrences or more are the level's table. Their hashes are marked in a bitmap, which is
   broadcast: 16 bits a phrase, and never over MAX_BITS (32 MB), whatever the size of the table. A task of the
   next level hands on a phrase only if both its overlapping parts, all but its last and all but its first word,
   are marked. Phrases that share a mark with a frequent one pass as well, which costs rows and no exactness:
   counts are of all occurrences and decide alone.
3. Each phrase is cut after each word, the parts' counts are joined from the level tables, and the lowest score
   counts. A part of a phrase is at least as frequent, so the tables hold it.

Defined results: a null text is empty; a null language is UND. Keys aren't read, so null and repeated ones need
nothing; equal texts count each time. Ties: smallest cut of equal score, then by score, occurrences and bytes.
An empty table gives none. Only the two named columns are read. A long text is a block of its own. Scores are
exact while occurrences stay under 10^16.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.bytescan import LOWER, SPACE, Texts, byte_class, cut, distinct, hashes, mixed, spread, words
from tarn.llm.work import discard, written
from tarn.session import ship

LEAST, LONGEST, OVERLAP, TOP = 10, 3, 50, 2000
UND = "und"
SCALE = 1_000_000
BREAKS = byte_class(b".,;:!?\x0a\x0b\x0c\x0d")
_OUTSIDE = BREAKS | SPACE
MIN_BITS, MAX_BITS = 16, 28
BLOCK = 2 << 20
_ROWS = 1 << 17
_SALT = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROW = "lang string, gram string, n long"


def _classes(keys: np.ndarray, inverse: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(a member of each class of equal keys, its size, the class of each key if asked for)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    first = np.flatnonzero(new)
    ids = None
    if inverse:
        ids = np.empty(len(keys), np.int64)
        ids[order] = np.cumsum(new) - 1
    return order[first], np.diff(np.append(first, len(keys))), ids


def marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the first bits of each hash are set in the bitmap (2^n bits in 64-bit numbers)."""
    at = h >> np.uint64(64 - (len(bitmap) * 64).bit_length() + 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _rows(data: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray, k: int, lang: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each phrase of k words that begins with word at[i]: its words joined by one space."""
    data = np.append(data, np.uint8(32))
    for i in range(0, len(at), _ROWS):
        some = at[i : i + _ROWS]
        s, m = np.full((len(some), 2 * k - 1), len(data) - 1), np.ones((len(some), 2 * k - 1), np.int64)
        for j in range(k):
            s[:, 2 * j], m[:, 2 * j] = start[some + j], length[some + j]
        ends = np.zeros(len(some) + 1, np.int32)
        np.cumsum(m.sum(axis=1), out=ends[1:])
        gram = pa.StringArray.from_buffers(len(some), pa.py_buffer(ends), pa.py_buffer(data[spread(s.reshape(-1), m.reshape(-1))]))
        yield pa.RecordBatch.from_arrays([lang.slice(i, _ROWS), gram, pa.array(n[i : i + _ROWS])], ["lang", "gram", "n"])


def _count(langs: pa.Array, texts: pa.Array, k: int, known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Phrases of k words in each block of the texts, with both parts marked in `known`; for k = 1 also the empty phrase, once for each word."""
    names, codes, salt = _languages(langs)
    for block in cut(texts, BLOCK):
        block = Texts(block.first, block.size, LOWER[block.data], block.at)
        found = words(block, _OUTSIDE)
        if not len(found.start):
            continue
        code = codes[block.first + found.text]
        h = mixed(hashes(block.data, found.start, found.length) ^ salt[code])
        ids, members = distinct(block.data, found.start, found.length, code, h)
        take = lambda at: names.dictionary.take(pa.array(code[at]))  # noqa: E731, B023
        if k == 1:
            yield from _rows(block.data, found.start, found.length, members, 1, take(members), np.bincount(ids))
            total = np.bincount(code, minlength=len(salt))
            yield pa.RecordBatch.from_arrays([names.dictionary, pa.array([""] * len(salt), pa.string()), pa.array(total)], ["lang", "gram", "n"])
            continue
        piece = np.cumsum(BREAKS[block.data], dtype=np.int32)[found.start]
        follows = (found.text[1:] == found.text[:-1]) & (piece[1:] == piece[:-1])
        valid, gram = np.ones(len(ids), bool), h
        for j in range(2, k):
            valid = valid[:-1] & follows[: len(valid) - 1] & valid[1:]
            gram = _longer(gram, h, j)
        fit = valid & marked(known, gram)
        at = np.flatnonzero(fit[:-1] & follows[: len(fit) - 1] & fit[1:])
        if not len(at):
            continue
        number = ids[at]
        for j in range(1, k):
            first, n, number = _classes((number << 32) | ids[at + j], j < k - 1)
        yield from _rows(block.data, found.start, found.length, at[first], k, take(at[first]), n)


def _languages(langs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(names, code of each row, hash of each name)."""
    names = langs.dictionary_encode()
    return names, names.indices.to_numpy(zero_copy_only=False), np.array([xxhash.xxh3_64_intdigest(x) for x in names.dictionary.to_pylist()], np.uint64)


def with_hashes(table: DataFrame, k: int) -> DataFrame:
    """(lang, gram, n) of phrases of k words with h, their hash in texts; that of the empty phrase is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, codes, salt = _languages(batch.column(0).cast(pa.string()))
            out = np.zeros(len(batch), np.uint64)
            for block in cut(batch.column(1), BLOCK):
                found = words(block, SPACE)
                h = mixed(hashes(block.data, found.start, found.length) ^ salt[codes[block.first + found.text]]).reshape(-1, k)
                gram = h[:, 0]
                for j in range(1, k):
                    gram = mixed(gram * _MIX + h[:, j])
                out[block.first + found.text[::k]] = gram
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], ["lang", "gram", "n", "h"])

    return table.select("lang", "gram", "n").mapInArrow(run, _ROW + ", h long")


def _longer(gram: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of phrases of k words from those of k - 1 words and of words."""
    n = len(h) - k + 1
    return mixed(gram[:n] * _MIX + h[k - 1 : k - 1 + n])


def bitmap(table: DataFrame, h: str = "h") -> np.ndarray:
    """Marks of a table's hashes. Rows are combined to 64-bit numbers by Spark; at most 2^MAX_BITS bits reach the driver."""
    bits = min(max((16 * table.count()).bit_length(), MIN_BITS), MAX_BITS)
    at = F.shiftrightunsigned(F.col(h), 64 - bits)
    found = table.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{h}`, {64 - bits}) & 63 as int))")).alias("marks")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["at"].to_numpy()] = found["marks"].to_numpy().view(np.uint64)
    return out


def levels(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """Tables (lang, gram, n, h) of frequent phrases of 1 .. longest words. The first also has each language's words, as the empty phrase."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UND)).alias("lang"), F.col(text).cast("string").alias("text"))
    tables: list[DataFrame] = []
    for k in range(1, longest + 1):
        known = spark.sparkContext.broadcast(bitmap(tables[-1].where("gram <> ''"))) if tables else None

        def run(batches: Iterator[pa.RecordBatch], k=k, known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _count(batch.column(0).cast(pa.string()), batch.column(1), k, known.value if known else None)

        dealt = rows.mapInArrow(run, _ROW).repartition("lang", "gram")  # combined already, by blocks: a phrase has a row for each
        counted = dealt.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        tables.append(written(with_hashes(counted.where((F.col("n") >= least) | (F.col("gram") == "")), k), f"grams{k}"))
        if known:
            known.destroy()
    return tables


def score(a: str, left: str, right: str, scale: int = SCALE) -> Column:
    """floor(scale * a * a / (left * right)) by exact decimals."""
    d = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"cast({scale} as decimal(7, 0)) * {d(a)} * {d(a)} div ({d(left)} * {d(right)})")


def _parts(k: int) -> Column:
    """The contiguous phrases of two words or more inside a phrase of k words, without itself."""
    w = F.split("gram", " ")
    return F.array_distinct(F.array(*(F.array_join(F.slice(w, i + 1, m), " ") for m in range(2, k) for i in range(k - m + 1))))


def collocations(tables: list[DataFrame], overlap: int = OVERLAP) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases that aren't mostly part of a longer one, from level tables."""
    count = lambda name, c: grams.select("lang", F.col("gram").alias(name), F.col("n").alias(c))
    grams = tables[0].where("gram <> ''").select("lang", "gram", "n")
    cuts, inside = [], []
    for k, t in enumerate(tables[1:], 2):
        grams = grams.unionByName(t.select("lang", "gram", "n"))
        cuts.append(t.select("lang", "gram", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("k")))
        if k > 2:
            inside.append(t.select("lang", F.explode(_parts(k)).alias("gram"), F.col("n").alias("longer")))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    cut_rows = union(cuts).withColumn("first", F.expr("substring_index(gram, ' ', k)")).withColumn("rest", F.expr("substring(gram, length(first) + 2)"))
    scored = cut_rows.join(count("first", "l"), ["lang", "first"]).join(count("rest", "r"), ["lang", "rest"]).withColumn("score", score("a", "l", "r"))
    best = scored.groupBy("lang", F.col("gram").alias("phrase")).agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    if inside:
        longer = union(inside).groupBy("lang", F.col("gram").alias("phrase")).agg(F.max("longer").alias("longer"))
        best = best.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {overlap} * a"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first rows of each language. Parts of a language are cut to as many rows first, so no task sorts all of them."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("part", F.pmod(F.hash("phrase"), F.lit(_SALT)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "part")
    out = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "score")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, overlap: int = OVERLAP, top: int = TOP) -> DataFrame:
    """ranked() collocations of the texts, with n, the words of their language; the level tables are removed once they are scored."""
    tables = levels(docs, text, lang, least, longest)
    all_words = tables[0].where("gram = ''").select("lang", "n")
    out = written(ranked(collocations(tables, overlap), top).join(all_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    discard(*tables)
    return out
