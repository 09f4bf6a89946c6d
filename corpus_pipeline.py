"""From documents to token ids: quality rules, near-duplicates, personal data, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and gives the documents that the next one works on; run() writes each
result as Parquet in the shared folder and reads it again. All stages but the last return the columns of docs; columns that
a stage doesn't use pass it under other names, so that none of its results can take their place.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, mixing, pii, quality, simhash
from tarn.llm.plans import _tokenizer
from tarn.llm.work import written
from tarn.session import table


SHINGLE, SIMILARITY = 5, 0.8


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the columns that aren't used under names no operator has, and what gives docs' columns back."""
    names = {c: c if c in used else f"__column_{k}" for k, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), lambda df: df.select([df[new].alias(old) for old, new in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose host isn't rejected. Rejected ones go.

    Hosts are judged in a pass of their own that keeps only sums; the second pass counts again, which costs
    less than moving texts through a shuffle or a table.
    """
    plain, back = apart(docs, "source", "text")
    hosts = quality.host_verdicts(quality.document_counts(docs.select("source", "text")))
    return back(quality.judge(quality.document_counts(plain), hosts).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8 or more): the one with
    the smallest id, then of the smallest text hash; a document without an id only where no other has one. Of rows with the
    same id and text one stays; rows with the same id and other texts are other documents."""
    found = simhash.near_duplicates(docs, shingle=SHINGLE, similarity=SIMILARITY)
    row = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = row.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")).alias("w"))
    first = written(first.select(F.col("w.doc_id").alias("__id"), F.col("w.text_hash").alias("__hash"), F.col("w.n").alias("__n")), "firsts")
    plain, back = apart(docs, "doc_id", "text")
    kept = plain.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash")))
    if first.where("__n > 1").isEmpty():
        return back(kept)
    whole = F.struct(*plain.columns)
    again = kept.where("__n > 1").groupBy("__id", "__hash").agg(F.min_by(whole, F.xxhash64(whole)).alias("w")).select("w.*")
    return back(kept.where("__n = 1").select(plain.columns).union(again))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by [kind]; n_chars follows the text."""
    plain, back = apart(docs, "text", "n_chars")
    redacted = pii.annotate(plain, redacted=True)
    return back(redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else redacted)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule: files and rows follow its slots. Readers of several
    files needn't keep their order, so byte_bpe restores it from the same rows."""
    plain, back = apart(docs, "doc_id", "source", "text")
    return back(mixing.in_order(mixing.mix(plain, text="text")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and the digest of the ids decoded again, with its slot of the Pfair
    schedule and its place therein, in that order. They depend on the rows alone, so that they are those of mixing_sources."""
    columns = [c for c in ("doc_id", "lang", "source", "text") if c in docs.columns]
    mixed = mixing.in_order(mixing.mix(docs.select(columns), text="text"))
    encoded = bpe.encode(mixed.select(*columns, "slot", "place"), *_tokenizer(), ids="ids", decoded="decoded_sha256")
    return encoded.select(*columns[:-1], F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256", "slot", "place")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing_sources", mixing_sources),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express fingerprints, trees, the schedule or merges; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
