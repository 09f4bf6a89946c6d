"""Near copies by the similarity of word shingles: fingerprints and MinHash bands propose pairs, exact set similarity decides.

A text's set holds the 64-bit hashes of its shingles. Equal sets are one entry. Two generators propose pairs of entries:

* SimHash: the entry's fingerprint is looked up in the multi-index tables of simhash.links.
* Bands: 64 bits can't tell a similarity of 0.8 from less (10 of them differ, give or take 3), so links at two bits find
  few of those pairs. ROWS minima make a band, BANDS of them a sketch; a pair at Jaccard similarity 0.8 shares no
  band with probability (1 - 0.8 ** 4) ** 20 = 3e-5, so that much recall is lost at the limit and less above it.

Each entry is compared with one pivot of each band value it has: the entry whose band values are the most common ones, which in
a group of edited copies is the text they were made of. A cluster of near copies therefore costs one comparison for each member and
pivot. Band values that still mix components name the entries that are left, and these are joined by prefixes: of two sets at the
similarity each holds one of the other's rarest shingles, as many as it may lack and one more. Shingles that one entry alone has fill most
prefixes and join nothing, so a passage that many texts share doesn't bring them all together, and no pair is lost. Shingles that more than a few
entries share are no reason to pair them all: a pivot is taken from these, and they are joined by the rarest of their differences from it (_differences). Proposals are first judged by their sketches: a pair at the limit agrees in 64 of the 80 minima, give or take
4, and goes if it agrees in less than LEAST of them (probability 3e-7); sets are made and joined for the rest alone. Joins on
band values are sort-merge joins, whose hot partitions adaptive execution splits. No candidate is cut by number.

Defined results: words are those of simhash. A text of fewer words than a shingle has one shingle, a null or blank text
none; texts without shingles are copies of each other. Null ids take part but are never names. Extra columns are ignored.
"""

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.components import components
from tarn.llm.simhash import SEED, links as fingerprint_links, majority
from tarn.llm.work import discard, written
from tarn.session import ship

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Equal minima below which a pair isn't at SIMILARITY. Other similarities keep the same distance in standard deviations.
LEAST = 44
#: Entries with one shingle in their prefixes, up to which they are paired; times at most that more of them get a pivot, and pairs
#: that crowds would be compared in, for each row of a prefix, up to which a pivot once is enough.
CROWD, ROUNDS, LOAD = 16, 3, 128
_PART = 1 << 12  # shingles hashed again at once


def shingle_set(text: bytes | None, shingle: int = SHINGLE):
    """Sorted distinct hashes of the text's shingles."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    found = {xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))} if words else set()
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def minima(hashes):
    """The least of BANDS * ROWS orders of the hashes, uint64; none for an empty set."""
    import numpy as np

    if not len(hashes):
        return np.zeros(0, np.uint64)
    rnd = np.random.default_rng(SEED)
    times, plus = (rnd.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
    times |= np.uint64(1)
    least = np.full(BANDS * ROWS, np.uint64((1 << 64) - 1))
    for i in range(0, len(hashes), _PART):
        least = np.minimum(least, (hashes[i : i + _PART] * times + plus).min(1))
    return least


def band_values(least) -> list[int]:
    """BANDS signed numbers; none for an empty set."""
    from xxhash import xxh64_intdigest

    return [_signed(xxh64_intdigest(row.tobytes(), k)) for k, row in enumerate(least.reshape(-1, ROWS))]


def _signed(h: int) -> int:
    return h - (h >> 63 << 64)


def sketches(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, text_hash, entry, fp, size, bands, sketch): entry is a digest of the shingles, sketch the minima's last 32 bits."""
    ship(docs.sparkSession)
    schema = "doc_id long, text_hash long, entry long, fp long, size int, bands array<long>, sketch array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for t in batch.column(2):
                found = shingle_set(t.as_buffer().to_pybytes() if t.is_valid else None, shingle)
                least = minima(found)
                values = (_signed(xxh64_intdigest(found.tobytes(), SEED)), _signed(majority(found.astype(">u8").view("uint8").reshape(-1, 8))), len(found), band_values(least), least.astype("uint32").view("int32"))
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], ["doc_id", "text_hash", "entry", "fp", "size", "bands", "sketch"])

    return _keyed(docs, doc_id, text).mapInArrow(run, schema)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("text"))


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """docs(doc_id, text_hash, text) and wanted(entry, doc_id, text_hash) to (entry, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else None, shingle).view("int64") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["entry", "shingles"])

    w = wanted.select("entry", F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    one = docs.join(w, docs["doc_id"].eqNullSafe(w["__id"]) & (docs["text_hash"] == w["__hash"]))
    return one.select("entry", "text").mapInArrow(run, "entry long, shingles array<long>")


class _Judge:
    """Decides which pairs of entries are similar enough: by sizes and sketches, then by whole sets."""

    def __init__(self, docs: DataFrame, entries: DataFrame, shingle: int, similarity: float):
        self.docs, self.entries, self.shingle, self.similarity = docs, entries, shingle, similarity
        least = BANDS * ROWS * similarity
        spread = (BANDS * ROWS * SIMILARITY * (1 - SIMILARITY)) ** 0.5
        self.least = int(least - (BANDS * ROWS * SIMILARITY - LEAST) * (BANDS * ROWS * similarity * (1 - similarity)) ** 0.5 / spread)

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Of pairs(u, v, ...) those that sizes and sketches don't rule out."""
        known = lambda side: self.entries.select(F.col("entry").alias(side), F.col("size").alias(f"__n{side}"), F.col("sketch").alias(f"__s{side}"))
        both = pairs.join(known("u"), "u").join(known("v"), "v")
        near = F.least("__nu", "__nv") >= self.similarity * F.greatest("__nu", "__nv")
        equal = F.aggregate(F.zip_with("__su", "__sv", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
        return both.where(near).where(equal >= self.least).select(*pairs.columns)

    def similar(self, pairs: DataFrame, *names: str) -> DataFrame:
        """Of pairs(u, v, ...) those at the similarity or above: their named columns, as a written table."""
        likely = written(self.likely(pairs), "likely")
        wanted = self.entries.join(likely.select(F.col("u").alias("entry")).union(likely.select("v")).distinct(), "entry", "left_semi")
        sets = written(_sets(self.docs, wanted, self.shingle), "sets")
        side = lambda name: sets.select(F.col("entry").alias(name), F.col("shingles").alias(f"__{name}"))
        both = likely.join(side("u"), "u").join(side("v"), "v")
        shared = F.size(F.array_intersect("__u", "__v"))
        alike = both.where(shared >= self.similarity * (F.size("__u") + F.size("__v") - shared)).select(*names)
        links = written(alike.distinct(), "links")
        discard(likely, sets)
        return links


def _by_fingerprint(entries: DataFrame) -> DataFrame:
    """(u, v): each entry with the smallest of its fingerprint, and that of the smallest fingerprint linked to its own."""
    firsts = written(entries.groupBy("fp").agg(F.min("entry").alias("first")), "firsts")
    linked = fingerprint_links(firsts.select("fp"))
    near = linked.groupBy("u").agg(F.min("v").alias("v"))
    near = near.join(firsts.selectExpr("fp as u", "first as a"), "u").join(firsts.selectExpr("fp as v", "first as b"), "v").select("a", "b")
    pairs = written(entries.select("entry", "fp").join(firsts, "fp").where("entry <> first").select("entry", "first").union(near).toDF("u", "v"), "near")
    discard(firsts, linked)
    return pairs


def _by_band(entries: DataFrame) -> DataFrame:
    """(band, entry, pivot) for band values that entries share: the pivot has the most common values, the smallest of equals."""
    keyed = entries.select("entry", F.explode("bands").alias("band"))
    shared = written(keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    often = written(keyed.join(shared.hint("merge"), "band"), "often")
    score = written(often.groupBy("entry").agg(F.sum("n").alias("score")), "score")
    scored = written(often.join(score.hint("merge"), "entry").select("band", "entry", "score"), "scored")
    pivots = written(scored.groupBy("band").agg(F.min(F.struct((-F.col("score")).alias("s"), "entry"))["entry"].alias("pivot")), "pivots")
    met = written(scored.select("band", "entry").join(pivots.hint("merge"), "band"), "met")
    discard(shared, often, score, scored, pivots)
    return met


def _differences(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """members(entry, root, pivot) to (pivot, token, entry, root, size, d, w, at, index, probe), a written table: the shingles by which an
    entry may meet another of its pivot. pivot 0 is the empty set.

    An entry is its pivot without R and with A: d is |R| + |A|. With t = similarity / (1 + similarity) two entries are at the similarity exactly if
    their differences share w + w' shingles, w = (t - 1/2) |pivot| + (1 - t) |R| + t |A|. Of an entry that isn't like its pivot, w is over
    h = (1/2 - t) |pivot|. Entries that are like their pivot have a link to it, so of a pair one isn't and looks for the others (probe) whose w isn't larger
    (index). What they share at least gives the length of each prefix: w + max(w, h) and, since w' can't be less than similarity * (w - h) - h, (1 + similarity) * (w - h).
    """
    t = similarity / (1 + similarity)
    own = sets.select("entry", F.size("shingles").alias("size"), "shingles")
    far = sets.select(F.col("entry").alias("pivot"), F.col("shingles").alias("other")).union(sets.sparkSession.range(1).select("id", F.array().cast("array<long>")))
    both = members.select("entry", "root", "pivot").join(own, "entry").join(far.hint("merge"), "pivot")
    both = both.withColumns({"gone": F.array_except("other", "shingles"), "come": F.array_except("shingles", "other")})
    sized = both.withColumns({"h": (0.5 - t) * F.size("other"), "d": F.size("gone") + F.size("come"), "w": (1 - t) * F.size("gone") + t * F.size("come")}).withColumn("w", F.col("w") - F.col("h"))
    tokens = sized.select("pivot", "entry", "root", "size", "d", "w", "h", F.explode(F.concat("gone", "come")).alias("token"))
    tokens = written(tokens, "tokens")
    times = written(tokens.groupBy("pivot", "token").agg(F.count("*").alias("times")).where("times > 1"), "times")
    group = Window.partitionBy("pivot", "entry")
    shared = tokens.join(times.hint("merge"), ["pivot", "token"]).withColumns({"rank": F.row_number().over(group.orderBy("times", "token")), "known": F.count("*").over(group)})
    # the d - known shingles that no other entry of the pivot has come first in the prefix
    placed = shared.withColumn("at", F.col("d") - F.col("known") + F.col("rank"))
    within = lambda least: F.col("at") <= F.col("d") - F.ceil(least - 1e-6) + 1
    roles = {"index": within(F.col("w") + F.greatest("w", "h")), "probe": (F.col("w") > F.col("h") + 1e-6) & within((1 + similarity) * (F.col("w") - F.col("h")))}
    found = written(placed.withColumns(roles).where("index or probe").select("pivot", "token", "entry", "root", "size", "d", "w", "at", "index", "probe"), "prefix")
    discard(tokens, times)
    return found


def _meetings(left: DataFrame, similarity: float) -> DataFrame:
    """(u, v, a, b): pairs of different roots in rows of _differences, at the first shingle their differences share or at one whose place allows it."""
    side = lambda role, u, a: left.where(role).select("pivot", "token", F.col("entry").alias(u), F.col("root").alias(a), *(F.col(c).alias(f"__{c}{u}") for c in ("size", "d", "w", "at")))
    both = side("index", "u", "a").hint("merge").join(side("probe", "v", "b"), ["pivot", "token"])
    sizes = F.least("__sizeu", "__sizev") >= similarity * F.greatest("__sizeu", "__sizev")
    rest = F.least(F.col("__du") - F.col("__atu"), F.col("__dv") - F.col("__atv")) + 1 >= F.col("__wu") + F.col("__wv") - 1e-6
    return both.where("u <> v and a <> b and __wu <= __wv").where(sizes & rest).select("u", "v", "a", "b")


def _by_prefix(judge: _Judge, members: DataFrame) -> DataFrame:
    """members(entry, root) to (u, v, a, b), a written table: pairs of entries, of different roots a and b, among them all at the similarity that no
    path of such pairs joins.

    Entries that share a shingle of their prefixes are paired where they are CROWD or fewer. Where they are more, a pivot is taken from them, the one
    most often met in crowds, and paired with all; they go on with their differences from it, of which most are rarer. When ROUNDS of that are over, or
    crowds have become so small that pairs are LOAD times the rows at most, all are paired.
    """
    sets = written(_sets(judge.docs, judge.entries.join(members, "entry", "left_semi"), judge.shingle), "sets")
    now, found = written(members.withColumn("pivot", F.lit(0).cast("long")), "members"), []
    for k in range(ROUNDS + 1):
        prefix = _differences(now, sets, judge.similarity)
        discard(now)
        mixed = prefix.groupBy("pivot", "token").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b"), F.count_if("index").alias("i"), F.count_if("probe").alias("p"))
        mixed = written(mixed.where("a < b and i > 0 and p > 0").select("pivot", "token", "n", (F.col("i").cast("double") * F.col("p")).alias("load")), "mixed")
        left = written(prefix.join(mixed.hint("merge"), ["pivot", "token"]), "left")
        load, rows = mixed.agg(F.sum(F.when(F.col("n") > CROWD, F.col("load"))), F.sum("n")).first()
        last = not load or k == ROUNDS or k > 0 and load <= LOAD * rows
        found.append(written(_meetings(left if last else left.where(F.col("n") <= CROWD), judge.similarity).distinct(), "pairs"))
        discard(prefix, mixed)
        if last:
            discard(left)
            break
        crowd = left.where(F.col("n") > CROWD)
        score = written(crowd.groupBy("entry").agg(F.sum("n").alias("score")), "score")
        scored = crowd.select("pivot", "token", "entry", "root").join(score.hint("merge"), "entry")
        pivots = written(scored.groupBy("pivot", "token").agg(F.min(F.struct((-F.col("score")).alias("s"), "entry", "root")).alias("one")).selectExpr("pivot", "token", "one.entry as next", "one.root as b"), "pivots")
        now = written(crowd.join(pivots.hint("merge"), ["pivot", "token"]).where("entry <> next").select("entry", "root", F.col("next").alias("pivot"), "b").distinct(), "members")
        discard(left, score, pivots)
        found.append(written(now.where("root <> b").selectExpr("entry as u", "pivot as v", "root as a", "b"), "pairs"))
    pairs = written(reduce(DataFrame.union, found).distinct(), "pairs")
    discard(sets, *found)
    return pairs


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, root, component_id) for every row of docs: root numbers the row's component, component_id is its smallest id."""
    rows = written(sketches(docs, doc_id, text, shingle), "sketches")
    whole = rows.groupBy("entry").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("one"), *(F.first(c).alias(c) for c in ("fp", "size", "bands", "sketch")))
    entries = written(whole.select("entry", "least", F.col("one.doc_id").alias("doc_id"), F.col("one.text_hash").alias("text_hash"), "fp", "size", "bands", "sketch"), "entries")
    judge = _Judge(_keyed(docs, doc_id, text), entries, shingle, similarity)
    met, near = _by_band(entries), _by_fingerprint(entries)
    links = judge.similar(met.where("entry <> pivot").select(F.col("entry").alias("u"), F.col("pivot").alias("v")).union(near).distinct(), "u", "v")
    roots = components(links)
    discard(near, links)
    placed = written(met.join(roots.withColumnRenamed("node", "entry"), "entry", "left").select("band", "entry", F.coalesce("root", "entry").alias("root")), "placed")
    mixed = placed.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("band")
    left = written(placed.join(mixed.hint("merge"), "band"), "mixed")
    discard(met, placed)
    more = _by_prefix(judge, left.select("entry", "root").distinct())
    # components of components: the links left join roots, of which few are in any
    links = judge.similar(more, "a", "b")
    discard(more)
    again = components(links.toDF("u", "v"))
    named = entries.select("entry", "least").join(roots.withColumnRenamed("node", "entry"), "entry", "left").withColumn("node", F.coalesce("root", "entry")).drop("root")
    named = named.join(again, "node", "left").select("entry", "least", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(named.join(names, "root").select("entry", "root", "component_id"), "classes")
    found = written(rows.select("doc_id", "text_hash", "entry").join(classes, "entry").select("doc_id", "text_hash", "root", "component_id"), "copies")
    discard(rows, entries, left, links, roots, again, classes)
    return found
