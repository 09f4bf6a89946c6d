"""JSON documents as rows, a row for each value: cut level by level, changed by rules on columns, put together bottom-up.

levels() explodes the values of a level into those below it, without a shuffle. published() rewrites them and folds back: the rows of a level are
grouped by their parent and joined to it. Numbers have the form that Spark gives them: 2.0 is 2.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import references
from tarn.operators.expressions import typed
from tarn.session import settled


def members(raw: Column) -> Column:
    """Members of a JSON object in the order of its text: (key, value) with value as typed() has it."""
    texts, values = F.from_json(raw, "map<string,string>"), F.from_json(raw, "map<string,variant>")
    return F.transform(F.arrays_zip(F.map_keys(texts).alias("k"), F.map_values(texts).alias("t"), F.map_values(values).alias("v")), lambda x: F.struct(x["k"].alias("key"), typed(x["t"], x["v"]).alias("value")))


def items(raw: Column) -> Column:
    """Items of a JSON array, with keys that are null."""
    texts, values = F.from_json(raw, "array<string>"), F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")
    return F.transform(F.arrays_zip(texts.alias("t"), values.alias("v")), lambda x: F.struct(F.lit(None).cast("string").alias("key"), typed(x["t"], x["v"]).alias("value")))


def levels(docs: DataFrame, key: str = "doc_id", text: str = "text") -> list[DataFrame]:
    """The values of each level: (key, parent, node, pos, name, above, inside, raw, kind). The document itself is the node "0".

    name is a value's key in its object, above that of what holds it, inside the kind of what holds it: o an object, a a list. A text that isn't
    one JSON document has no rows. Keys must be unique.
    """
    wrapped = F.concat(F.lit("["), F.col(text), F.lit("]"))
    root = F.try_element_at(items(wrapped), F.lit(1))["value"]
    rows = docs.where(F.try_parse_json(text).isNotNull()).select(key, F.lit("").alias("parent"), F.lit("0").alias("node"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("above"), F.lit(None).cast("string").alias("inside"), root["raw"].alias("raw"), root["kind"].alias("kind"))
    out = []
    while True:
        level = settled(rows)
        if level.isEmpty():
            return out
        out.append(level)
        below = F.when(F.col("kind") == "o", members(F.col("raw"))).when(F.col("kind") == "a", items(F.col("raw")))
        found = level.select(key, F.col("node").alias("parent"), F.col("name").alias("above"), F.col("kind").alias("inside"), F.posexplode(below).alias("pos", "m"))
        rows = found.select(key, "parent", F.concat_ws(".", "parent", F.col("pos").cast("string")).alias("node"), "pos", F.col("m.key").alias("name"), "above", "inside", F.col("m.value.raw").alias("raw"), F.col("m.value.kind").alias("kind"))


def json_string(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def published(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): documents as they may be published; null for a text that isn't one document, or has an object that repeats a key.

    Texts lose host paths. In an object named metrics only what is allowed stays, and an empty one goes. Items of a list named files that are names of files
    inside a tree stay as they are, others are taken as paths. Keys are sorted.
    """
    result = None
    for level in reversed(levels(docs, key, text)):
        metric = (F.col("inside") == "o") & F.coalesce(F.col("above") == "metrics", F.lit(False))
        listed = (F.col("inside") == "a") & F.coalesce(F.col("above") == "files", F.lit(False))
        shown = F.when(metric, F.col("raw")).when(listed, F.when(references.relative_file(F.col("raw")), F.col("raw")).otherwise(references.path(F.col("raw")))).otherwise(references.text(F.col("raw")))
        leaf = F.when(F.col("kind") == "s", json_string(shown)).when(F.col("kind") == "n", F.col("raw"))
        if result is None:
            met = level.withColumn("kids", F.array().cast("array<struct<name:string,pos:int,out:string>>"))
        else:
            kids = result.groupBy(key, F.col("parent").alias("node")).agg(F.sort_array(F.collect_list(F.struct("name", "pos", "out"))).alias("kids"))
            met = level.join(kids, [key, "node"], "left")
        fields = F.array_join(F.transform("kids", lambda k: F.concat(json_string(k["name"]), F.lit(":"), k["out"])), ",")
        whole = F.when(F.col("kind") == "o", F.concat(F.lit("{"), F.coalesce(fields, F.lit("")), F.lit("}"))).when(F.col("kind") == "a", F.concat(F.lit("["), F.coalesce(F.array_join("kids.out", ","), F.lit("")), F.lit("]"))).otherwise(leaf)
        done = met.withColumn("out", whole)
        dropped = (metric & ~references.metric_allowed(F.col("name"), F.col("raw"), F.col("kind"))) | (F.coalesce(F.col("name") == "metrics", F.lit(False)) & (F.col("kind") == "o") & (F.col("out") == "{}"))
        result = done.where(~F.coalesce(dropped, F.lit(False))).select(key, "parent", "node", F.coalesce("name", F.lit("")).alias("name"), "pos", "out")
    found = result.select(key, F.col("out").alias("text")) if result is not None else docs.select(key, F.lit(None).cast("string").alias("text")).limit(0)
    return docs.select(key).join(found, key, "left")
