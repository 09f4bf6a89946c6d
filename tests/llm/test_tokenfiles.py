import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarn.llm import plans, repair, tokenfiles
from tarn.llm.bytescan import cut, distinct
from tests.llm.texts import EDGE, frame

PATH = P.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True
ODD = [(50, "a\x1c\x1d\x85b  c᠎​ d", "x"), (51, "a   b   c,'s don't 'tis ''s x'5 '", "x"), (52, "日本語のテキスト  \n\n  x'll 12345٣ é́", "x"), (53, "<|endoftext|> ok", "x"), (54, "ab" * 50_000, "x"), (55, " \n" * 50_000 + "x", "x")]


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def expected(rows):
    """Counts and checksums of rows in the order of their keys; rows of one key in any order."""
    return sorted((i is not None, i, len(ids_of(t)), zlib.crc32(np.array(ids_of(t), "<u4").tobytes())) for i, t in rows if i is not None) + [(False, None, len(ids_of(t)), zlib.crc32(np.array(ids_of(t), "<u4").tobytes())) for i, t in rows if i is None]


def check(rows, texts):
    rows = sorted(rows, key=lambda r: r["start"])
    start, last = 0, None
    for r in rows:
        assert r["start"] == start
        assert last is None or r["doc_id"] >= last
        start, last = start + r["n_tokens"], r["doc_id"]
    got = [(r["doc_id"] is not None, r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows]
    key = lambda x: (x[0], x[1] or 0, *x[2:])
    assert sorted(got, key=key) == sorted(expected(texts), key=key)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(plans.op12_token_files(spark, sf).collect(), [(r["doc_id"], r["text"]) for r in docs])


@pytest.mark.parametrize("shard", [1, 500, 1 << 20])
def test_edge_texts_and_random_access(spark, tmp_path, shard):
    rows = [*EDGE, *ODD, (None, None, "a"), (7, "other text of the same id", "b"), *[(3, "copy", "a")] * 300]
    docs = frame(spark, rows).withColumn("ids", F.lit("clash")).withColumn("tie", F.lit(1)).withColumn("row", F.lit(1)).repartition(5)
    path = f"file://{tmp_path}/t"
    tokenfiles.write(tokenfiles.encode(tokenfiles.in_order(docs, partitions=6), PATH, 2), path, shard)
    back = tokenfiles.read(spark, path)
    check(back.withColumn("ids_crc32", F.crc32("ids")).collect(), [(r[0], r[1]) for r in rows])
    assert sum(r["n_tokens"] for r in tokenfiles.read(spark, path, ids=False).collect()) == sum(len(ids_of(r[1])) for r in rows)
    whole = ids_of(ODD[4][1])
    assert [x.tolist() for x in tokenfiles.find(path, 54)] == [whole]
    assert [x.tolist() for x in tokenfiles.find(path, 54, 777, 801)] == [whole[777:801]]
    assert sorted(x.tolist() for x in tokenfiles.find(path, 7)) == sorted(ids_of(r[1]) for r in rows if r[0] == 7)
    assert tokenfiles.find(path, 999) == []
    hot = [r["doc_id"] for r in tokenfiles.in_order(docs, partitions=6).withColumn("p", F.spark_partition_id()).where("doc_id = 3").select("p").distinct().withColumnRenamed("p", "doc_id").collect()]
    assert len(hot) > 1


def test_texts_are_encoded_by_the_writer(spark, tmp_path):
    rows = [*EDGE, *ODD]
    path = f"file://{tmp_path}/t"
    tokenfiles.write(tokenfiles.in_order(frame(spark, rows), partitions=3), path, 700, tokenizer=PATH, end=2)
    check(tokenfiles.read(spark, path).withColumn("ids_crc32", F.crc32("ids")).collect(), [(r[0], r[1]) for r in rows])


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tokenfiles.write(tokenfiles.encode(tokenfiles.in_order(frame(spark, [])), PATH, 2), path)
    assert tokenfiles.read(spark, path).collect() == []


def test_only_committed_files_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tokenfiles.write(tokenfiles.encode(tokenfiles.in_order(frame(spark, EDGE)), PATH, 2), path)
    Path(tmp_path, "t", "part-lost.tok").write_bytes(b"half a file of a lost attempt")
    assert tokenfiles.read(spark, path).count() == len(EDGE)
    assert len(json.loads(Path(tmp_path, "t", tokenfiles.LIST).read_text())) + 1 == len(list(Path(tmp_path, "t").glob("*.tok")))


KNOWN = tokenfiles.Pieces(Path(PATH).read_text(encoding="utf-8"), 200)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(list(" \t\n'abZs019.,-<|\x1c\x85  é")), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_pieces_encode_as_whole_texts(texts):
    for block in cut(pa.array([t.encode() for t in texts], pa.binary())):
        ids, ends = KNOWN.encode(block, 2)
        assert [p.tolist() for p in np.split(ids, ends[:-1])] == [ids_of(t) for t in texts]


def lists():
    return st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=8)


@settings(max_examples=300, deadline=None)
@given(lists(), st.integers(2, 5), st.sampled_from([2, 4]))
def test_round_trip(docs, least, fall):
    ids, ends = np.array([x * 7919 for d in docs for x in d], np.uint32), np.cumsum([len(d) for d in docs])
    grammar, seq, at = repair.compress(ids, ends.astype(np.int64), least, fall, 10**9)
    assert repair.expand(grammar, seq).tolist() == ids.tolist()
    assert (grammar.rules < np.arange(len(grammar.rules))[:, None] + len(grammar.terminals)).all()
    begin = 0
    for d, end in zip(docs, at.tolist(), strict=True):
        part = seq[begin:end]
        assert repair.expand(grammar, part).tolist() == [x * 7919 for x in d]
        assert [repair.token(grammar, part, i) for i in range(len(d))] == [x * 7919 for x in d]
        assert repair.window(grammar, part, 1, len(d) - 1).tolist() == [x * 7919 for x in d][1 : max(1, len(d) - 1)]
        begin = end


def test_repeats_shrink():
    ids = np.tile(np.random.default_rng(3).integers(0, 40_000, 300), 2000).astype(np.uint32)
    grammar, seq, _ = repair.compress(ids, np.array([len(ids)]))
    assert len(seq) + 2 * len(grammar.rules) < len(ids) / 100
    one = np.zeros(1 << 18, np.uint32)
    grammar, seq, _ = repair.compress(one, np.array([len(one)]))
    assert len(seq) + len(grammar.rules) < 100 and repair.expand(grammar, seq).tolist() == one.tolist()


@pytest.mark.parametrize("low", [0, 1, 255])
def test_words_of_nearly_equal_hashes_stay_apart(low):
    """Hashes that differ in their low bits only, where distinct() keeps places, are collisions, and bytes decide."""
    words = [b"a", b"b", b"longer word", b"longer ward", b"a", b"longer word", b"b"]
    start = np.cumsum([0, *map(len, words[:-1])])
    length = np.array([len(w) for w in words])
    data = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
    h = np.array([(7 << 60) | (hash(w) & low) for w in words], np.uint64)
    number, members = distinct(data, start, length, np.zeros(len(words), np.int64), h)
    assert [words[members[n]] for n in number] == words and len(members) == 4
