"""SimHash near-duplicates: fingerprints of word shingles, linked at a small Hamming distance.

Fingerprints are counted bit by bit with numpy over Arrow batches. Linking works on distinct fingerprints,
so copies cost one entry. Multi-index hashing: a fingerprint has two segments of 32 bits, each with a table from the
segment's value to the fingerprints that hold it. Of two bits or three, one segment has one at most, so a fingerprint
looks up the Hamming ball of radius 1 around each of its segments, and every match is verified by the complete distance.
Of a pair that differs in a bit of the segment one side has that bit set, so only set bits are flipped.

A value that more than BUCKET fingerprints hold isn't matched pair by pair: whoever looks it up is keyed by whole
fingerprints instead, its own and those one bit away. Two fingerprints share one of these keys exactly if they
differ in two bits at most, a key holds 65 at most, and each member is linked to the smallest of its key. No pair is missed.

For a similarity of shingle sets instead of a distance, near_duplicates() hands over to copies.py.

Defined results: a null or blank text has fingerprint zero, which links like any other. A null doc_id takes
part in links but is never a component's name; a component with no other id has component_id null. Repeated
rows get the same component. Extra columns are ignored. An empty table gives an empty table.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.components import components
from tarn.llm.work import discard, written
from tarn.session import ship

SEED = 42
SHINGLE = 3
#: Bits in which linked fingerprints may differ. The index is built for this radius.
RADIUS = 2
BITS, SEGMENT = 64, 32
#: Fingerprints that hold one segment value, up to which they are compared pair by pair.
BUCKET = 64
_ROWS = 1 << 15  # shingles unpacked at once, 2 MB of bits


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The text's 64-bit fingerprint, unsigned."""
    import numpy as np
    from xxhash import xxh64_digest

    words = (text or b"").lower().split()  # bytes: only A-Z are lowered, only the six ASCII spaces split
    if not words:
        return 0
    if len(words) <= shingle:
        digests = [xxh64_digest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digests = [xxh64_digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)]
    return majority(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, BITS // 8))


def majority(digests) -> int:
    """The bits set in over half of the digests: rows of eight bytes, the highest first."""
    import numpy as np

    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(digests), _ROWS):
        counts += np.unpackbits(digests[i : i + _ROWS], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long): fp holds the 64 bits, as a signed number."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f - (f >> 63 << 64) for f in fps], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bit(i: int) -> int:
    return (1 << i) - (1 << 64 if i == 63 else 0)


def _segments(fp: str = "fp") -> list[Column]:
    """Each segment's value, tagged with the segment's number."""
    parts = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << SEGMENT) - 1)) for at in range(0, BITS, SEGMENT)]
    return [part.bitwiseOR(F.lit(k << SEGMENT)) for k, part in enumerate(parts)]


def _ball(key: Column) -> Column:
    """A key and those with one set bit of the segment cleared."""
    bits = F.filter(F.array(*(F.lit(1 << i) for i in range(SEGMENT))), lambda b: key.bitwiseAND(b) != 0)
    return F.concat(F.array(key), F.transform(bits, lambda b: key.bitwiseXOR(b)))


def _near(u: str, v: str) -> Column:
    return F.bit_count(F.col(u).bitwiseXOR(F.col(v))) <= RADIUS


def links(distinct: DataFrame) -> DataFrame:
    """distinct(fp) -> (u, v), a written table: links that connect all fingerprints within RADIUS of each other."""
    table = distinct.select("fp", F.explode(F.array(*_segments())).alias("key"))
    crowded = written(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key"), "crowded")
    index = table.join(crowded, "key", "left_anti").select("key", F.col("fp").alias("v")).union(crowded.select("key", F.lit(None).cast("long")))
    asked = distinct.select(F.col("fp").alias("u"), F.explode(F.flatten(F.array(*map(_ball, _segments())))).alias("key"))
    met = written(asked.join(index.hint("merge"), "key").where(F.col("v").isNull() | (F.col("u") != F.col("v")) & _near("u", "v")).select("u", "v"), "met")
    found = written(met.where("v is not null").union(_by_whole(met.where("v is null").select(F.col("u").alias("fp")).distinct())), "links")
    discard(crowded, met)
    return found


def _by_whole(distinct: DataFrame) -> DataFrame:
    """Links to the smallest fingerprint of each key, keys being whole fingerprints at distance 1 or less."""
    keyed = distinct.select("fp", F.explode(F.transform(F.array(*(F.lit(m).cast("long") for m in (0, *map(_bit, range(BITS))))), lambda m: m.bitwiseXOR(F.col("fp")))).alias("key"))
    least = keyed.withColumn("v", F.min("fp").over(Window.partitionBy("key"))).where("fp <> v")
    return least.where(_near("fp", "v")).selectExpr("fp as u", "v")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; with a similarity what copies.near_copies returns."""
    if similarity is not None:
        from tarn.llm.copies import near_copies

        return near_copies(docs, doc_id, text, shingle, similarity)
    fps = written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = links(distinct.select("fp"))
    roots = components(linked)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(named.join(names, "root").select("fp", "component_id"), "classes")
    discard(distinct, linked, roots)
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")
