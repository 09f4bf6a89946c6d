from hashlib import sha256

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import bpe
from tests.llm.texts import EDGE, frame

RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [(50, "a\x1c\x1d\x85b  c᠎​ d", "x"), (51, "aaaaaaaaaa" * 300, "x"), (52, "日本語のテキスト  \n\n  x'll 12345٣ é́", "x"), (53, "<|endoftext|> ok", "x")]


def expect(text):
    ids = TIK.encode_ordinary(text or "")
    return len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((text or "").encode()).hexdigest()


def check(rows, texts):
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted((str(i), *expect(t)) for i, t in texts)


def test_edge_texts(spark):
    rows = EDGE + ODD
    df = frame(spark, rows).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    check(bpe.digests(df, RANKS, P.PATTERN).collect(), [(r[0], r[1]) for r in rows])
    got = bpe.encode(df, RANKS, P.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(r[0]), TIK.encode_ordinary(r[1] or "")) for r in rows)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(bpe.digests(docs, RANKS, P.PATTERN).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty(spark):
    assert bpe.digests(frame(spark, []), RANKS, P.PATTERN).collect() == []
    assert bpe.encode(frame(spark, []), RANKS, P.PATTERN).collect() == []


def test_higher_order_functions_agree(spark):
    rows = [r for r in EDGE + ODD if r[0] not in (11, 51)] + [(60, "thndndsh lyed'll the  cat\n", "x")]
    df = frame(spark, rows).withColumn("ids", bpe.encode_columns(F.col("text"), RANKS, P.PATTERN)).withColumn("back", bpe.decode_column(F.col("ids"), RANKS))
    for r in df.collect():
        assert r["ids"] == TIK.encode_ordinary(r["text"] or ""), r["text"]
        assert bytes(r["back"]) == (r["text"] or "").encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_merges_as_the_library_does(text):
    import regex

    words = bpe.Words(RANKS, 3)
    assert [i for p in regex.findall(P.PATTERN, text) for i in words[p]] == TIK.encode_ordinary(text)


@pytest.mark.parametrize("word", [b"ab" * 40, b"thndndshing" * 30, b"\xff" * 70, bytes(range(256))])
def test_heap_merges_alike(word):
    short = bpe._HEAP_FROM
    try:
        bpe._HEAP_FROM = 1 << 30
        plain = bpe.merge(word, RANKS)
    finally:
        bpe._HEAP_FROM = short
    assert bpe.merge(word, RANKS) == plain
