from collections import Counter
from hashlib import sha256

import corpus_pipeline
from tarn.llm import pii, quality
from tests.llm import test_copies, test_pii, test_quality
from tests.llm.test_bpe import TIK
from tests.llm.texts import EDGE, frame


def brute(rows):
    """rows: dicts of documents; the rows of each stage by plain loops."""
    stages = []
    counted = []
    for r in rows:
        n, chars, symbols, dups, rep = test_quality.brute(r["text"])
        lines = sum(any(c not in " \t\n\x0b\x0c\r" for c in x) for x in (r["text"] or "").split("\n"))
        base = n < 10 or 100 * rep > 20 * n
        counted.append({"base": base, "symbols": symbols > n, "duplicate_lines": dups > 0 and 2 * dups > lines, "word_length": n > 0 and (chars < 2 * n or chars > 15 * n)})
    bad = set()
    size = Counter(r["source"] for r in rows if r["source"] is not None)
    for rule, (_, limit) in quality.HOST_RULES.items():
        fails = Counter(r["source"] for r, c in zip(rows, counted, strict=True) if c[rule] and r["source"] is not None)
        a, b = quality.beta_prior(len(size), sum(size.values()), float(sum(n * n for n in size.values())), float(sum(fails.values())), sum(fails[s] ** 2 / n for s, n in size.items()))
        bad |= {s for s, n in size.items() if (fails[s] + a) / (n + a + b) > limit}
    rows = [r for r, c in zip(rows, counted, strict=True) if not c["base"] and r["source"] not in bad]
    stages.append(rows)
    groups = {}
    for r, root in zip(rows, test_copies.roots([(r["doc_id"], r["text"]) for r in rows]), strict=True):
        groups.setdefault(root, []).append(r)
    kept = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"])) for g in groups.values()]
    stages.append(kept)
    rows = []
    for r in kept:
        t = r["text"]
        every = pii.spans(t, *pii.model())[1]
        assert set(test_pii.brute(t)) <= set(every)
        out, done = "", 0
        cover = [any(a <= i < b for _, a, b in every) for i in range(len(t))] if every else []
        for i, c in enumerate(cover):
            if c and (not i or not cover[i - 1] or (i in {a for _, a, _ in every} and not any(a < i < b for _, a, b in every))):
                out += t[done:i] + f"[{next(k for k, a, _ in every if a == i)}]"
            if c:
                done = i + 1
            else:
                out += t[i]
                done = i + 1
        rows.append({**r, "text": out if every else t, "n_chars": len(out if every else t)})
    stages += [rows, rows]
    stages.append([{"doc_id": r["doc_id"], "lang": r["lang"], "source": r["source"], "n_tokens": len(ids), "ids": ids, "decoded_sha256": sha256(r["text"].encode()).hexdigest()} for r in rows for ids in [TIK.encode_ordinary(r["text"])]])
    return stages


def walk(spark, docs, sf):
    want = brute([r.asDict() for r in docs.collect()])
    for (name, stage), rows in zip(corpus_pipeline.STAGES, want, strict=True):
        columns = docs.columns
        docs = stage(spark, docs, sf)
        got = docs.drop("slot", "place").collect() if name == "byte_bpe" else docs.collect()
        assert sorted(map(str, (r.asDict() for r in got))) == sorted(map(str, rows)), name
        if name != "byte_bpe":
            assert docs.columns == columns
    return want


def test_documents(spark, sf):
    want = walk(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert sorted(map(str, (r.asDict() for r in corpus_pipeline.run(spark, sf).drop("slot", "place").collect()))) == sorted(map(str, want[-1]))
    assert len(want[0]) < 200 and len(want[1]) < len(want[0])


def test_edge_rows(spark, sf):
    rows = [(*r, "en", 1) for r in EDGE]
    walk(spark, frame(spark, rows, "doc_id long, text string, source string, lang string, n_chars long"), sf)


def test_empty(spark, sf):
    docs = frame(spark, [], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.collect() == []


def test_mixing_is_in_order(spark, sf):
    from tarn.llm import mixing

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = [r["doc_id"] for r in mixing.mix(docs, text="text").orderBy("slot", "place").collect()]
    assert [r["doc_id"] for r in corpus_pipeline.mixing_sources(spark, docs, sf).collect()] == want
