import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import attribution, bpe
from tests.llm.texts import EDGE, frame

RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def brute(text, split=attribution.paragraphs):
    """Byte by byte: each token goes to the section with most of its bytes, the earlier one of equals."""
    text = text or ""
    parts = attribution.partition(split(text), len(text))
    section = [k for k, (_, a, b) in enumerate(parts) for _ in text[a:b].encode()]
    counts, at = [0] * len(parts), 0
    for i in TIK.encode_ordinary(text):
        n = len(TIK.decode_single_token_bytes(i))
        mine = section[at : at + n]
        counts[max(sorted(set(mine)), key=mine.count)] += 1
        at += n
    return [(k, *p, n) for k, (p, n) in enumerate(zip(parts, counts, strict=True))]


def thirds(text):
    n = len(text) // 3
    return [("a", 1, 1 + n), ("b", 1 + n, 1 + 2 * n)] if n else []


@pytest.mark.parametrize("split", [attribution.paragraphs, thirds])
def test_edge_texts(spark, split):
    rows = [*EDGE, (70, "word \n\n\n  word\n\n\U0001f600é\U0001f600\r\nx\n", "x"), (71, "\n\n", "x")]
    df = frame(spark, rows).withColumn("section", F.lit("clash"))
    got = attribution.section_tokens(df, RANKS, P.PATTERN, split=split).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(i), *x) for i, t, _ in rows for x in brute(t, split))
    totals = attribution.section_totals(attribution.section_tokens(df, RANKS, P.PATTERN), df.where("doc_id is not null and doc_id <> 8")).collect()
    texts = {i: t for i, t, _ in rows}
    assert all(r["n_tokens"] == len(TIK.encode_ordinary(texts[r["doc_id"]] or "")) == r["n_heading"] + r["n_body"] + r["n_outside"] for r in totals)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = attribution.section_tokens(docs, RANKS, P.PATTERN).collect()
    assert sorted(map(tuple, got)) == sorted((r["doc_id"], *x) for r in docs.collect() for x in brute(r["text"]))


def test_empty(spark):
    assert attribution.section_tokens(frame(spark, []), RANKS, P.PATTERN).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=20), st.lists(st.integers(1, 9), min_size=1, max_size=8))
def test_shares(tokens, sections):
    sections = [*sections, max(1, sum(tokens) - sum(sections))]
    tokens = [*tokens, sum(sections) - sum(tokens)] if sum(sections) > sum(tokens) else tokens
    got = attribution.attribute(np.cumsum(tokens), np.concatenate(([0], np.cumsum(sections))))
    owner, at, want = [k for k, n in enumerate(sections) for _ in range(n)], 0, [0] * len(sections)
    for n in tokens:
        mine = owner[at : at + n]
        want[max(sorted(set(mine)), key=mine.count)] += 1
        at += n
    assert got.tolist() == want


def test_overlapping_sections_are_refused():
    with pytest.raises(ValueError):
        attribution.partition([("a", 0, 5), ("b", 3, 6)], 9)
