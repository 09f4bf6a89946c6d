import re

import pytest

from tarn.llm import quality
from tests.llm.texts import EDGE, frame


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows, hit = {}, set()
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            hit.update(j for i in at for j in range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def check(rows):
    for r in rows:
        n = brute(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n, r["doc_id"]
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])


def test_edge_texts(spark):
    rows = quality.document_counts(frame(spark)).collect()
    assert len(rows) == len(EDGE)
    check(rows)


def test_documents(spark, sf):
    check(quality.document_counts(spark.read.parquet(f"{sf}/documents.parquet")).collect())


def test_clashing_columns_and_empty(spark):
    from pyspark.sql import functions as F

    df = frame(spark).withColumn("n_words", F.lit("old")).withColumn("kept", F.lit(5)).withColumn("__c", F.lit(1))
    counted = quality.document_counts(df)
    judged = quality.judge(counted, quality.host_verdicts(counted))
    assert judged.count() == len(EDGE) and dict(judged.dtypes)["kept"] == "boolean" and dict(judged.dtypes)["n_words"] == "bigint"
    none = quality.document_counts(frame(spark, []))
    assert quality.judge(none, quality.host_verdicts(none)).collect() == []


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "# " * 50 + good, "junk") for i in range(40)] + [(100 + i, good + str(i), f"h{i % 5}") for i in range(200)] + [(999, good, "junk"), (1000, good, None)]
    counted = quality.document_counts(frame(spark, rows))
    hosts = quality.host_verdicts(counted)
    assert {r["host"]: r["host_ok"] for r in hosts.collect()} == {"junk": False} | {f"h{i}": True for i in range(5)}
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(counted, hosts).collect()}
    assert not kept[999] and kept[1000] and all(kept[100 + i] for i in range(200))


def test_shuffled_verdicts_equal_broadcast_ones(spark, monkeypatch):
    counted = quality.document_counts(frame(spark))
    hosts = quality.host_verdicts(counted)
    a = sorted(map(str, quality.judge(counted, hosts).collect()))
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", -1)
    assert sorted(map(str, quality.judge(counted, hosts).collect())) == a


def test_prior_shrinks_small_hosts():
    a, b = quality.beta_prior(2, 1000, 500_000.0, 500.0, 500 * 0.81 + 500 * 0.01)
    assert a == pytest.approx(b) and 0 < a + b < 10
    a, b = quality.beta_prior(1, 10, 100.0, 5.0, 2.5)
    assert a + b == 10
