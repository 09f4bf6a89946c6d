"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only on the rows' path.

Each source's rows, in an order fixed by a hash, form blocks of BLOCK rows. Time is counted in slots of one
block. With weight w, block k of a source is released at floor(k / w) and due at ceil((k + 1) / w);
earliest-deadline-first over released blocks then keeps every source within one block of weight times time.
Weights are taken as exact fractions and never rounded to a period. When a
source runs out, a new phase starts with the weights of the others scaled up; the guarantee holds within each
phase. Every row is placed exactly once: nothing is dropped or repeated.

Sources may be any number. A block has BLOCK rows, or more where these would be over SCHEDULE blocks, so that the driver,
which holds one count and one weight for each source and lays the blocks out one after the other, has the same bounded
work at any size: B log S for B blocks of S sources, B at most SCHEDULE + S, written to a table in parts of PART. Rows meet it,
and the counts, in joins: Spark broadcasts a table below its own threshold and shuffles beyond. A hot source is cut into buckets
of about BUCKET rows by hash; row numbers are bucket offsets, themselves summed in two levels, plus the rank within the bucket.

Defined results: a null source is a source of its own. Sources without a given weight share the least weight
given. Rows are ordered within a source by hash, then id, then text hash; equal rows are interchangeable.
Rows without an id are dealt by the hash of all their columns. An empty table gives an empty table. Columns of the input stay; one with the name of a result is replaced.
"""

import heapq
from collections.abc import Iterator, Mapping
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.work import new_dir, written

BLOCK = 32
PERIOD = 1024
SCHEDULE = 1 << 20
PART = 1 << 17
BUCKET, SUPER = 128, 1024
#: Default target weights: rows to this power, between natural shares (1) and equal ones (0).
TEMPERATURE = 0.5


def quanta(weights: Mapping[str, float], period: int = PERIOD) -> tuple[dict[str, int], int]:
    """Weights as whole parts of a period: largest remainders, one part at least. The schedule itself doesn't round."""
    period = max(period, 4 * len(weights))
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s)):
        if sum(parts.values()) >= period:
            break
        parts[s] += 1
    while sum(parts.values()) > period:
        parts[max(parts, key=lambda s: (parts[s], s))] -= 1
    return parts, period


def pfair_period(parts: Mapping[str, int], period: int) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period of whole parts."""
    slots: dict[str, list[int]] = {s: [] for s in parts}
    for s, *_, t in islice(schedule({s: q + 1 for s, q in parts.items()}, parts), period):
        slots[s].append(t)
    return slots


def exact(weights: Mapping[str, float]) -> dict[str, int]:
    """Weights as whole numbers in exactly the same proportions."""
    ratios = {s: float(w).as_integer_ratio() for s, w in weights.items()}
    whole = max((d for _, d in ratios.values()), default=1)  # denominators are powers of two
    return {s: n * (whole // d) for s, (n, d) in ratios.items()}


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(source, block, phase_start, release, deadline, slot) in the order of slots: earliest deadline among released blocks.

    A source enters a phase's heaps with its first block in it. Until then it stands among the fresh ones, whose first
    deadlines have the order of their weights, so a new phase moves only sources that the last one served.
    """
    part = exact({s: weights[s] for s, n in blocks.items() if n})
    total, first, at, t = sum(part.values()), dict.fromkeys(part, 0), 0, 0
    fresh = [(-w, s) for s, w in part.items()]
    heapq.heapify(fresh)
    waiting: list[tuple[int, int, str, int]] = []
    ready: list[tuple[int, int, str, int]] = []
    while part:
        while waiting and waiting[0][0] <= t:
            _, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, -part[s], s, k))
        new = fresh and (at - (total // fresh[0][0]), *fresh[0], 0)  # the weight is negative, so this rounds up
        if new and (not ready or new < ready[0]):
            heapq.heappop(fresh)
            due, _, s, k = new
        else:
            due, _, s, k = heapq.heappop(ready)
        yield s, first[s] + k, at, at + k * total // part[s], due, t
        t += 1
        if first[s] + k + 1 < blocks[s]:
            heapq.heappush(waiting, (at + (k + 1) * total // part[s], at - (-(k + 2) * total // part[s]), s, k + 1))
            continue
        total -= part.pop(s)
        at = t
        for *_, x, k in waiting + ready:  # the next block of each source that this phase served
            first[x] += k
            heapq.heappush(fresh, (-part[x], x))
        waiting, ready = [], []


def _laid_out(spark: SparkSession, blocks: Mapping[str, int], weights: Mapping[str, float]) -> DataFrame:
    """schedule() as a table, written in parts."""
    path, slots = new_dir(spark, "schedule"), schedule(blocks, weights)
    schema = "__key string, block long, phase_start long, release long, deadline long, slot long"
    part, done = list(islice(slots, PART)), False
    while part or not done:
        spark.createDataFrame(part, schema).write.mode("append").parquet(path)
        part, done = list(islice(slots, PART)), True
    return spark.read.schema(schema).parquet(path)


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", key: str = "doc_id", text: str | None = None, block: int | None = None) -> DataFrame:
    """docs with block, phase_start, release, deadline and slot (long), and place, the row's rank within its block."""
    new = ["block", "phase_start", "release", "deadline", "slot", "place"]
    docs = docs.drop(*new)
    keyed = docs.withColumn("__key", _key(source))
    counted = written(keyed.groupBy("__key").agg(F.count("*").alias("n")), "sources")
    counts = {r["__key"]: r["n"] for r in counted.collect()}
    if weights is None:
        target = {s: n**TEMPERATURE for s, n in counts.items()}
    else:
        given = {"null" if s is None else f"={s}": w for s, w in weights.items()}
        if not given or min(given.values()) <= 0:
            raise ValueError("weights must be positive")
        target = {s: given.get(s, min(given.values())) for s in counts}
    block = block or max(BLOCK, -(-sum(counts.values()) // SCHEDULE))
    plan = _laid_out(docs.sparkSession, {s: -(-n // block) for s, n in counts.items()}, target)

    order = [F.col(key), F.xxhash64(text)] if text else [F.col(key)]
    dealt = keyed.join(counted.select("__key", F.ceil(F.col("n") / BUCKET).alias("__buckets")), "__key").withColumn("__h", F.when(F.col(key).isNull(), F.xxhash64(*docs.columns)).otherwise(F.xxhash64(F.col(key)))).withColumn("__bucket", F.pmod(F.xxhash64("__h"), F.col("__buckets")))
    sizes = dealt.groupBy("__key", "__bucket").agg(F.count("*").alias("n")).withColumn("__super", F.floor(F.col("__bucket") / SUPER))
    supers = sizes.groupBy("__key", "__super").agg(F.sum("n").alias("m"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.withColumn("m", F.coalesce(F.sum("m").over(before("__key", "__super")), F.lit(0)))
    offsets = sizes.withColumn("n", F.coalesce(F.sum("n").over(before("__key", "__super", "__bucket")), F.lit(0))).join(supers, ["__key", "__super"])
    offsets = offsets.select("__key", "__bucket", (F.col("n") + F.col("m")).alias("__offset"))

    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("__key", "__bucket").orderBy("__h", *order)) - 1)
    placed = ranked.join(offsets, ["__key", "__bucket"])
    number = (F.col("__offset") + F.col("__rank")).cast("long")
    placed = placed.withColumn("block", F.floor(number / block)).withColumn("place", F.pmod(number, F.lit(block)).cast("int"))
    return placed.join(plan, ["__key", "block"]).select(*docs.columns, *new)


def in_order(mixed: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of mix() in schedule order: range-partitioned, into parts if given, and sorted by slot and place."""
    by = ("slot", "place")
    return (mixed.repartitionByRange(max(1, parts), *by) if parts is not None else mixed.repartitionByRange(*by)).sortWithinPartitions(*by)
