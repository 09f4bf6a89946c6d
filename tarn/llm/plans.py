"""Thin queries opN_<name>: each applies its operator to its whole table and derives the digest columns."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import ann, attribution, audit, bpe, lm, mixing, oracles, phrases, pii, quality, repeats, simhash, tokenfiles, warc
from tarn.llm.work import new_dir, written
from tarn.session import table


def _tokenizer(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *_tokenizer())


def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(spark, sf_dir, "documents"), *_tokenizer())


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixing.in_order(mixed).select("slot", "place", "doc_id", "source", "block", "phase_start", "release", "deadline")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = written(quality.document_counts(docs.select("doc_id", "source", "text")).drop("text"), "counts")
    judged = quality.judge(counted, quality.host_verdicts(counted))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_spans = F.size(F.filter(F.split("spans", ","), lambda s: s != "")).cast("long")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", n_spans.alias("n_spans"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "warc")
    warc.write(warc.plan_records(table(spark, sf_dir, "pages")), path)
    records = warc.read(spark, path, payload=False)
    return records.select(warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), warc.page_number("refers_to").alias("refers_to"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_dir(spark, "tokens")
    tokenfiles.write(tokenfiles.in_order(table(spark, sf_dir, "documents")), path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return tokenfiles.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


PLANS = {f.__name__: f for f in (op1_byte_bpe, op2_repeated_strings, op3_token_counts, op4_lm_scoring, op5_mixing, op6_quality_rules, op7_simhash_near_dedup, op8_pii, op9_warc, op10_nearest, op11_filter_audit, op12_token_files, op13_phrases)}
#: SQL can't tokenise, fingerprint, weight, schedule, score spans or search approximately; those queries have brute-force tests.
ORACLES = {"op2_repeated_strings": oracles.REPEATED_STRINGS, "op6_quality_rules": oracles.QUALITY_RULES, "op9_warc": oracles.WARC, "op11_filter_audit": oracles.FILTER_AUDIT, "op13_phrases": oracles.PHRASES}
