"""Merging of recovery tracks, provenance, and first-wins deduplication. Order is data: every input carries ord."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Events kept of a key, and ranks of sources; a higher rank replaces a lower one.
TAIL = 256
SOURCE_RANKS = {"manifest": 3, "native": 3, "runtime": 3, "generated": 2, "inferred": 2, "fallback": 1}


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the first by order stays."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def source_rank(source: Column) -> Column:
    rank = F.lit(0)
    for value in sorted(set(SOURCE_RANKS.values())):
        rank = F.when(source.isin(*[s for s, r in SOURCE_RANKS.items() if r == value]), value).otherwise(rank)
    return rank


def best_source(files: DataFrame) -> DataFrame:
    """files(pkg_id, ord, path, source): of a path the best source, the earliest of equals; ord becomes the path's first."""
    w = Window.partitionBy("pkg_id", "path")
    marked = files.withColumn("__nth", F.row_number().over(w.orderBy(source_rank(F.col("source")).desc(), "ord"))).withColumn("__first", F.min("ord").over(w))
    return marked.where("__nth = 1").withColumn("ord", F.col("__first")).drop("__nth", "__first")


def merge_outcome(native: DataFrame, fallback: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """fallback with outcome: added (native lacks it), identical, or preserved (native differs and wins)."""
    mine = native.select(*keys, F.col(content).alias("__native"), F.lit(True).alias("__there"))
    joined = fallback.join(mine, list(keys), "left")
    outcome = F.when(F.col("__there").isNull(), "added").when(F.col("__native").eqNullSafe(F.col(content)), "identical").otherwise("preserved")
    return joined.withColumn("outcome", outcome).drop("__native", "__there")


def insert_only(native: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All native rows, and fallback rows whose key native lacks. Merging again changes nothing."""
    return native.unionByName(fallback.join(native.select(*keys), list(keys), "left_anti"))


def with_provenance(scanned: DataFrame, known: DataFrame, default: str = "native") -> DataFrame:
    """Scanned files with the source of what is known about them; what is known but wasn't scanned is dropped."""
    return scanned.join(known.select("pkg_id", "path", F.col("source").alias("__source")), ["pkg_id", "path"], "left").withColumn("source", F.coalesce("__source", F.lit(default))).drop("__source")


def source_breakdown(files: DataFrame, *keys: str) -> DataFrame:
    """Counts by source; an empty or missing one counts as native."""
    return files.groupBy(*keys, F.coalesce(F.nullif("source", F.lit("")), F.lit("native")).alias("source")).agg(F.count("*").alias("n"))


def without(pages: DataFrame, claimed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pages.join(claimed, list(keys), "left_anti")


def set_differences(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row (only_first, only_second, repeated): keys that one side alone holds, and keys that a side holds twice or more.

    Two equal sets without duplicates give zeros. Both sides meet in one aggregate by key, which combines before its shuffle.
    """
    sides = first.select(*keys, F.lit(1).alias("__a"), F.lit(0).alias("__b")).union(second.select(*keys, F.lit(0), F.lit(1)))
    counts = sides.groupBy(*keys).agg(F.sum("__a").alias("a"), F.sum("__b").alias("b"))
    return counts.agg(F.count_if((F.col("b") == 0)).alias("only_first"), F.count_if((F.col("a") == 0)).alias("only_second"), F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("repeated"))


def running_end(entries: DataFrame, keys: Sequence[str], order: Sequence[str], end: str) -> DataFrame:
    """Adds seen_end: the largest end of strictly earlier rows (null for the first). The order must be total."""
    return entries.withColumn("seen_end", F.max(end).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))


def changed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows whose values differ from the row before, by key; each key's first row stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    now = F.struct(*values)
    return rows.withColumn("__now", now).withColumn("__was", F.lag("__now").over(w)).withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | ~F.col("__now").eqNullSafe(F.col("__was"))).drop("__now", "__was", "__n")


def tail(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = TAIL) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order))
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def attempts(stages: DataFrame) -> DataFrame:
    """stages(task_id, stage, seq) with attempt: 1 for a stage's first run."""
    return stages.withColumn("attempt", F.row_number().over(Window.partitionBy("task_id", "stage").orderBy("seq")))


def expired(rows: DataFrame, at: str, cutoff: Column, protected: DataFrame, key: str) -> DataFrame:
    """Rows not after the cutoff whose key isn't protected."""
    return rows.where(F.col(at) <= cutoff).join(protected.select(key), key, "left_anti")


def common_folder(files: DataFrame, key: str, path: str) -> DataFrame:
    """The longest common folder of each key's paths. Only the least and the greatest path matter, so this
    is a min and a max, combined before the shuffle."""
    ends = files.groupBy(key).agg(F.min(path).alias("__a"), F.max(path).alias("__b"))
    a, b = F.split("__a", "/"), F.split("__b", "/")
    n = F.least(F.size(a), F.size(b)) - 1
    differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i >= n) | (F.get(a, i) != F.get(b, i)))
    return ends.select(key, F.array_join(F.slice(a, 1, F.element_at(differ, 1)), "/").alias("folder"))


def distinct_list(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """(keys, values): a key's values, each once, in order of first appearance; only first appearances are gathered."""
    firsts = rows.groupBy(*keys, value).agg(F.min(order).alias("__first"))
    return firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__first", value))), lambda x: x[value]).alias("values"))
