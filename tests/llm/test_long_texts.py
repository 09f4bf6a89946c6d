"""Texts far longer than any ordinary document: each operator gives its defined result, in about linear time."""

import time
from hashlib import sha256

import public_tokenizers as P
import pytest
import tiktoken

from tarn.llm import attribution, bpe, lm, pii, quality, repeats, simhash
from tests.llm.test_pii import brute as brute_pii
from tests.llm.texts import frame

RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
N = 500_000
LONG = {"blanks": " " * N + "x", "lines": "\n" * N, "digits": "1" * N, "letters": "a" * N, "zeros": "0" * 5000 + ".1.1.1", "dots": "1." * (N // 2)}
ROWS = [(i, t, "a") for i, t in enumerate(LONG.values())]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


def test_base_spans_of_long_runs():
    start = time.perf_counter()
    for name, text in LONG.items():
        assert name != "zeros" or pii.base_spans(text) == [("ip", 0, len(text))]
        pii.spans(text, *pii.model())
    assert time.perf_counter() - start < 60
    small = "12.0003.0000000255.7 1.2.3.256 00.1.2.3.4.5.6.7 9" + "1" * 3000 + ".1.2.3"
    assert pii.base_spans(small) == brute_pii(small)


def test_encoding(docs):
    got = {r["doc_id"]: r for r in bpe.digests(docs, RANKS, P.PATTERN).collect()}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    for i, t, _ in ROWS:
        assert got[i]["decoded_sha256"] == sha256(t.encode()).hexdigest()
        if not t[:2].isspace():  # the library itself can't take so many blanks
            assert got[i]["n_tokens"] == len(tik.encode_ordinary(t))


def test_attribution(docs):
    counted = {}
    for r in attribution.section_tokens(docs, RANKS, P.PATTERN).collect():
        counted[r["doc_id"]] = counted.get(r["doc_id"], 0) + r["n_tokens"]
    assert counted == {r["doc_id"]: r["n_tokens"] for r in bpe.digests(docs, RANKS, P.PATTERN).collect()}


def test_others(docs):
    assert {r["doc_id"]: r["n_words"] for r in quality.document_counts(docs).collect()} == {i: len(t.split()) for i, t, _ in ROWS}
    assert {r["doc_id"] for r in simhash.near_duplicates(docs).collect()} == set(range(len(ROWS)))
    assert {r["doc_id"]: r["n_tokens"] for r in lm.scores(docs).collect()} == {i: len(t.split()) + 1 for i, t, _ in ROWS}
    short = [(i, t[:50_000], s) for i, t, s in ROWS]  # a text of one period has an anchor for each byte
    assert {r["doc_id"]: r["n_removed"] for r in repeats.repeats(frame(docs.sparkSession, short)).collect()} == {i: 5000 if t[:2] == "00" else len(t) for i, t, _ in short}
