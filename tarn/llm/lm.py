"""Language-model scoring by context-tree weighting over bytes, beside an add-half unigram base.

Each byte is eight binary decisions. A decision is coded in the contexts of the last 0 to DEPTH bytes; every
context node keeps how often the decision was 0 and 1 in training (the Krichevsky-Trofimov estimate), and
weighting mixes a node's own estimate with its children's, in proportion to the probability each gave to the
training data. With training counts frozen a byte's probability depends on the byte and its DEPTH
predecessors alone, so a text's code length is a sum over its (DEPTH + 1)-grams.

1. Grams and words of all texts are counted, combined before the shuffle. The tables grow with the corpus.
2. Grams are dealt by their last two context bytes, so that a part holds whole subtrees from depth 2 down. It
   weights them bottom-up. Depths 0 and 1 have at most 65,792 nodes; the driver finishes these from sums.
3. Each gram gets the log probability of its byte. Texts are scored in tasks against the FREQUENT most common
   grams and words (two maps of bounded size, broadcast); all others of a text are joined with the tables.

Defined results: a null text is empty: no words, one end token, score 0. A null id is treated as the empty
string (its remainder is 0, so it trains). Bytes before a text's start count as zero. Rows are scored one by
one, so repeated ids and ties need nothing. Without training rows N and V are 0. Extra columns are ignored.
"""

from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.work import written
from tarn.session import ship

DEPTH = 5
#: Words and grams scored in the task: at most so many of each, words of so many bytes at most; about 15 MB each.
FREQUENT, FREQUENT_GRAMS, FREQUENT_BYTES = 1 << 18, 1 << 20, 32
FOLDS, HELD_OUT = 5, 1
#: A task hands on partial counts when it has so many words or grams; texts are worked off in pieces of so many bytes.
LIMITS = (300_000, 1_500_000, 1 << 20)


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def _bytes(batch: pa.RecordBatch, i: int) -> Iterator[bytes]:
    for t in batch.column(i).cast(pa.binary()):
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def _pieces(texts: list[bytes], depth: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, place of each piece's first gram, text of each piece), about `piece` bytes of texts at a time.

    A gram has the byte lowest and the byte before it highest, then the ones before that.
    """
    parts, owner, starts, size = [], [], [], 0
    for k, t in enumerate(texts):
        for i in range(0, len(t), piece):
            before = bytes(max(0, depth - i)) + t[max(0, i - depth) : i]
            parts.append(before + t[i : i + piece])
            owner.append(k)
            starts.append(size)
            size += len(parts[-1])
            if size >= piece:
                yield _grams(parts, starts, owner, depth)
                parts, owner, starts, size = [], [], [], 0
    if parts:
        yield _grams(parts, starts, owner, depth)


def _grams(parts: list[bytes], starts: list[int], owner: list[int], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    n = len(a)
    out = a[depth:].copy()
    for d in range(1, depth + 1):
        out |= a[depth - d : n - d] << 8 * (depth + 1 - d)
    lengths = np.array([len(p) - depth for p in parts])
    keep = np.repeat(np.array(starts), lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return out[keep], np.cumsum(lengths) - lengths, np.array(owner)


def corpus_counts(docs: DataFrame, text: str = "text", depth: int = DEPTH, limits: tuple[int, int, int] = LIMITS) -> DataFrame:
    """docs(text, held_out) to (word binary, gram long, n long, m long): counts in training (n) and in all texts (m).

    Words are counted in training only; the empty one is the end token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(words, grams, n, m):
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(grams, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["word", "gram", "n", "m"])

        words, ends, held = Counter(), 0, (np.zeros(0, np.int64),) * 3
        for batch in batches:
            texts, out = list(_bytes(batch, 0)), batch.column(1).to_pylist()
            for part, trains in (([t for t, h in zip(texts, out, strict=True) if not h], True), ([t for t, h in zip(texts, out, strict=True) if h], False)):
                for grams, _, _ in _pieces(part, depth, limits[2]):
                    g, m = np.unique(grams, return_counts=True)
                    held = _added(held, (g, m if trains else np.zeros_like(m), m))
                    if len(held[0]) > limits[1]:
                        yield rows([None] * len(held[0]), *held)
                        held = (np.zeros(0, np.int64),) * 3
                for t in part if trains else ():
                    words.update(t.lower().split())
                    ends += 1
                    if len(words) > limits[0]:
                        yield rows(list(words), [None] * len(words), list(words.values()), list(words.values()))
                        words.clear()
        n = [*words.values(), ends]
        yield rows([*words, b""], [None] * len(n), n, n)
        yield rows([None] * len(held[0]), *held)

    parts = docs.select(F.col(text).cast("string").alias("text"), "held_out").mapInArrow(run, "word binary, gram long, n long, m long")
    return parts.groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("m > 0")


def _added(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Two tables of keys and counts as one."""
    if not len(a[0]):
        return b
    keys = np.concatenate((a[0], b[0]))
    order = np.argsort(keys, kind="stable")  # two sorted runs: timsort merges them
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], *(np.add.reduceat(np.concatenate(x)[order], first) for x in zip(a[1:], b[1:], strict=True))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5, by Stirling's series after moving up to 8 or more."""
    shift = np.ones_like(x)
    for _ in range(8):
        small = x < 8
        if not small.any():
            break
        shift[small] *= x[small]
        x = np.where(small, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - np.log(shift)


_SMALL = np.arange(4096, dtype=np.float64)
_HALVES, _WHOLES = _lgamma(_SMALL + 0.5), _lgamma(_SMALL + 1)


def _log_gamma(n: np.ndarray, table: np.ndarray, add: float) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    big = n >= len(table)
    if big.any():
        out[big] = _lgamma(n[big] + add)
    return out


def _block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the KT estimator gave to a node's decisions."""
    return _log_gamma(zeros, _HALVES, 0.5) + _log_gamma(ones, _HALVES, 0.5) - np.log(np.pi) - _log_gamma(zeros + ones, _WHOLES, 1.0)


_HALF = np.log(0.5)


class Subtrees:
    """Weighting over grams (sorted, distinct) with training counts n, from `depth` up to depth `top`.

    bits[k]: probability of the gram's k-th bit, mixed over depths from `top` down. nodes[k]: for the nodes of
    depth `top` at bit k a gram of each, and the log of the node's weighted probability.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, top: int, depth: int):
        x, n = grams & 255, n.astype(np.float64)
        self.bits, self.nodes = [None] * 8, [None] * 8
        for d in range(depth, top - 1, -1):
            context = grams >> 8 * (depth + 1 - d)
            for k in range(8):
                node, one = context << k | x >> (8 - k), (x >> (7 - k) & 1).astype(bool)
                if d == depth:
                    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
                    at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(node))))
                else:
                    _, first, at = np.unique(node, return_index=True, return_inverse=True)
                zeros, ones = np.bincount(at, n * ~one, len(first)), np.bincount(at, n * one, len(first))
                own = _block(zeros, ones)
                mine = ((np.where(one, ones[at], zeros[at])) + 0.5) / (zeros + ones + 1)[at]
                if self.nodes[k] is None:
                    self.bits[k], self.nodes[k] = mine, (first, own)
                    continue
                child, below = self.nodes[k]
                both = np.logaddexp(_HALF + own, _HALF + np.bincount(at[child], below, len(first)))
                stay = np.exp(_HALF + own - both)[at]
                self.bits[k], self.nodes[k] = stay * mine + (1 - stay) * self.bits[k], (first, both)


_TOP = 2  # depth from which subtrees are whole in a part


def subtrees(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """counts(gram, n, m) to (gram, m, bits binary) for each gram, and (a, node, s): sums over depth-2 nodes.

    s of node < 256 is the sum of log probabilities of the depth-2 nodes below context byte a; s of node 256 + x
    is the training count of byte x after a.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (("gram", pa.int64()), ("m", pa.int64()), ("bits", pa.binary()), ("a", pa.int32()), ("node", pa.int32()), ("s", pa.float64()))

        def rows(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

        sums = np.zeros((256, 512))

        def done(grams, n, m):
            tree = Subtrees(grams, n, _TOP, depth)
            for k, (first, logs) in enumerate(tree.nodes):
                g = grams[first]
                np.add.at(sums, (g >> 8 * depth, 1 << k | (g & 255) >> (8 - k)), logs)
            np.add.at(sums, (grams >> 8 * depth, 256 + (grams & 255)), n)
            bits = np.stack(tree.bits, axis=1)
            bits = np.where(bits > 0.5, bits - 1, bits).astype(np.float32)  # near 1 the distance to 1 is kept, as a negative number
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(grams), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())
            none = [None] * len(grams)
            return rows(grams, m, data, none, none, none)

        held, size = [], 0
        for batch in batches:
            g, n, m = (c.to_numpy() for c in batch.columns)
            held.append((g, n, m))
            size += len(g)
            if size > 300_000:
                g, n, m = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = np.searchsorted(g, g[-1] >> 8 * (depth - 1) << 8 * (depth - 1))  # the last pair may go on
                if cut:
                    yield done(g[:cut], n[:cut], m[:cut])
                held, size = [(g[cut:], n[cut:], m[cut:])], len(g) - cut
        if size:
            yield done(*(np.concatenate(x) for x in zip(*held, strict=True)))
        a, node = np.nonzero(sums)
        none = [None] * len(a)
        yield rows(none, none, none, a, node, sums[a, node])

    pair = F.shiftright("gram", 8 * (depth - 1))
    dealt = counts.select("gram", "n", "m").repartition(pair).sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "gram long, m long, bits binary, a int, node int, s double")


def gram_scores(tree: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, m, f): log10 probability of each gram's byte, with depths 0 and 1 mixed in."""
    sums = tree.where("gram is null").groupBy("a", "node").agg(F.sum("s").alias("s")).toArrow()  # at most 2^17 rows
    table = np.zeros((256, 512))
    table[sums.column("a").to_numpy(), sums.column("node").to_numpy()] = sums.column("s").to_numpy()
    counts, below = table[:, 256:], table[:, :256]

    def nodes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heap = np.concatenate((np.zeros_like(rows), rows), axis=1)
        for q in (128, 64, 32, 16, 8, 4, 2, 1):
            heap[:, q : 2 * q] = heap[:, 2 * q : 4 * q : 2] + heap[:, 2 * q + 1 : 4 * q : 2]
        return heap[:, 0::2] * (np.arange(256) > 0), heap[:, 1::2] * (np.arange(256) > 0)

    z1, o1 = nodes(counts)
    own1 = _HALF + _block(z1, o1)
    both1 = np.logaddexp(own1, _HALF + below)
    z0, o0 = nodes(counts.sum(axis=0, keepdims=True))
    own0 = _HALF + _block(z0, o0)
    stay1, stay0 = np.exp(own1 - both1), np.exp(own0 - np.logaddexp(own0, _HALF + both1.sum(axis=0, keepdims=True)))[0]
    p1 = np.stack([(z1 + 0.5) / (z1 + o1 + 1), (o1 + 0.5) / (z1 + o1 + 1)], axis=2)
    p0 = np.stack([(z0 + 0.5) / (z0 + o0 + 1), (o0 + 0.5) / (z0 + o0 + 1)], axis=2)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(0).to_numpy()
            bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, 8).astype(np.float64)
            bits = np.where(bits < 0, 1 + bits, bits)
            a, x, f = g >> 8 * depth, g & 255, np.zeros(len(g))
            for k in range(8):
                q, one = 1 << k | x >> (8 - k), x >> (7 - k) & 1
                f += np.log10(stay0[q] * p0[q, one] + (1 - stay0[q]) * (stay1[a, q] * p1[a, q, one] + (1 - stay1[a, q]) * bits[:, k]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f)], ["gram", "m", "f"])

    return tree.where("gram is not null").select("gram", "m", "bits").mapInArrow(run, "gram long, m long, f double")


def _most_common(rows: DataFrame, n: str, most: int) -> DataFrame:
    """All rows above a count that at most `most` rows pass."""
    step = F.floor(F.log2(n) * 16).cast("int")
    steps = rows.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()  # a few hundred rows at most
    total, least = 0, 1 << 30
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["rows"]
        if total > most:
            break
        least = r["step"]
    return rows.where(step >= least)


class Slots:
    """Values by integer key: hash tables in which each slot has one key; what finds its slot taken goes to the next table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables = []
        left = np.arange(len(keys))
        for turn in range(64):
            if not len(left):
                break
            shift = 64 - max(4, int(2 * len(left)).bit_length())
            factor = np.uint64(0x9E3779B97F4A7C15 + 2 * turn * 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1)
            at = self._at(keys[left], factor, shift)
            slot = np.full(1 << (64 - shift), -1, np.int64)
            slot[at] = left
            held = slot >= 0
            self.tables.append((factor, shift, np.where(held, keys[slot], -1), np.where(held, values[slot], 0.0)))
            left = left[slot[at] != left]

    @staticmethod
    def _at(keys: np.ndarray, factor: np.uint64, shift: int) -> np.ndarray:
        return (keys.view(np.uint64) * factor >> np.uint64(shift)).view(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 where there is none; places of keys that aren't there)."""
        out, left, asked = np.zeros(len(keys)), None, keys
        for factor, shift, known, values in self.tables:
            at = self._at(asked, factor, shift)
            hit = known[at] == asked
            if left is None:
                out = np.where(hit, values[at], 0.0)
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = values[at[hit]]
                left = left[~hit]
            asked = keys[left]
        return out, np.arange(len(keys)) if left is None else left


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, limits: tuple[int, int, int] = LIMITS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), learned from rows that aren't held out."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    counts = written(corpus_counts(docs, depth=depth, limits=limits), "counts")
    words = counts.where("word is not null").select("word", "n")
    grams = written(gram_scores(written(subtrees(counts.where("gram is not null"), depth), "tree"), depth), "grams")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("n"))), F.lit(0)).alias("ends")).first()
    norm, end = log10(total["n"] + 0.5 * (total["v"] + 1)), log10(total["ends"] + 0.5)
    known_end = int(total["ends"] > 0)
    often = _most_common(words.where(F.length("word").between(1, FREQUENT_BYTES)), "n", FREQUENT).toArrow()
    common_words = {w: log10(n + 0.5) for w, n in zip(often.column("word").to_pylist(), often.column("n").to_pylist(), strict=True)}
    often = _most_common(grams, "m", FREQUENT_GRAMS).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((common_words, often.column("gram").to_numpy(), often.column("f").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, slots = shared.value[0].get, Slots(*shared.value[1:])
        row = TaskContext.get().partitionId() << 33

        def lists(owner: np.ndarray, n: int, fields: list[tuple[str, pa.Array]]) -> pa.ListArray:
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([a for _, a in fields], [f for f, _ in fields]))

        for batch in batches:
            texts = list(_bytes(batch, 2))
            k = len(texts)
            n_tokens, n_known, base, words, times, whose = [], [], [], [], [], []
            for i, t in enumerate(texts):
                tokens = t.lower().split()
                part, known = end, known_end
                for w, n in Counter(tokens).items():
                    p = common(w)
                    if p is None:
                        words.append(w)
                        times.append(n)
                        whose.append(i)
                    else:
                        part += n * p
                        known += n
                n_tokens.append(len(tokens) + 1)
                n_known.append(known)
                base.append(part)
            score, rare = np.zeros(k), []
            for g, first, owner in _pieces(texts, depth, limits[2]):
                f, left = slots.get(g)
                np.add.at(score, owner, np.add.reduceat(f, first))
                rare.append((owner[np.searchsorted(first, left, "right") - 1], g[left]))
            who, what = (np.concatenate(x) for x in zip(*rare, strict=True)) if rare else (np.zeros(0, np.int64),) * 2
            order = np.lexsort((what, who))
            who, what = who[order], what[order]
            new = np.flatnonzero(np.concatenate(([True], (what[1:] != what[:-1]) | (who[1:] != who[:-1])))) if len(who) else np.zeros(0, np.int64)
            n = np.diff(np.append(new, len(who)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + k), pa.int64()), batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score),
                    lists(np.array(whose, np.int64), k, [("word", pa.array(words, pa.binary())), ("n", pa.array(times, pa.int64()))]),
                    lists(who[new].astype(np.int64), k, [("gram", pa.array(what[new], pa.int64())), ("n", pa.array(n, pa.int64()))]),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "grams"],
            )
            row += k

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, words array<struct<word:binary,n:long>>, grams array<struct<gram:long,n:long>>"
    scored = written(docs.mapInArrow(run, schema), "scored")
    logs = words.withColumn("c", F.log10(F.col("n") + 0.5)).drop("n")
    each = lambda c: scored.select("row", F.explode(c).alias("r")).select("row", "r.*").withColumnRenamed("n", "times")
    none = F.lit(0.0)
    of_words = each("words").join(logs, "word", "left").select(
        "row", (F.col("times") * F.coalesce("c", F.lit(log10(0.5)))).alias("base"), F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0).alias("known"), none.alias("score")
    )
    of_grams = each("grams").join(grams.select("gram", "f"), "gram").select("row", none.alias("base"), F.lit(0).cast("long").alias("known"), (F.col("times") * F.col("f")).alias("score"))
    sums = of_words.groupBy("row").agg(*(F.sum(c).alias(f"w_{c}") for c in ("base", "known"))).join(of_grams.groupBy("row").agg(F.sum("score").alias("g_score")), "row", "full")
    out = scored.drop("words", "grams").join(sums, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "w_known").alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        (plus("base", "w_base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), plus("score", "g_score").alias("score"),
    )
