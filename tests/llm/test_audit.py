import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import regex

from tarn.llm import audit, bytescan
from tests.llm.texts import EDGE, frame

SHOUT = "AB cd " * 120
ROWS = [*EDGE, (20, SHOUT, "a"), (21, SHOUT, None), (3, SHOUT, ""), (None, SHOUT, "b"), (None, None, None), (22, None, "b"), (23, "w%d " * 3, "c"), (24, " ".join(f"w{i}" for i in range(300)), "c"), (20, SHOUT, "a")]
LABELS = [(20, 1, 0), (20, 0, 1), (21, 1, 1), (24, 1, 0), (None, 1, 1), (2, None, 1), (999, 1, 1)]


def brute(rows, labels):
    docs = [(i, t or "", p or "") for i, t, p in rows]
    masks = []
    for i, t, _ in docs:
        w = regex.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(regex.findall("[A-Z]", t)) > 2 * len(t), bool(regex.search("[#$%&*|]", t)), i is not None and any(j is not None and j < i and t == u for j, u, _ in docs))
        masks.append({f for f, bad in zip("ABCDE", fails, strict=True) if bad})
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {p for _, _, p in docs}:
        own = [(i, m) for (i, _, p), m in zip(docs, masks, strict=True) if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                redundant = sum(f in m for _, m in own) - len(gone)
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(m == {f} for _, m in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_all_orders(spark):
    docs = frame(spark, ROWS).selectExpr("*", "1 as mask", "2 as digest", "'x' as part")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in audit._COLUMNS] for r in audit.audit(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect()}
    assert got == brute(ROWS, LABELS)


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(frame(spark, []), labels).collect() == []
    assert audit.audit(frame(spark, [(1, None, None)]), labels).count() == 600


def plain(text):
    w = regex.findall(rb"[^\x20\x09-\x0D]+", text)
    return (len(w) < 200) + 2 * (100 * len(set(w)) < 50 * len(w)) + 4 * (100 * len(regex.findall(b"[A-Z]", text)) > 2 * len(text.decode())) + 8 * bool(regex.search(b"[#$%&*|]", text))


def test_masks_of_long_and_short_texts():
    rng = np.random.default_rng(5)
    letters = np.array(list("abAB \n\x00é$"), dtype=object)
    texts = ["".join(rng.choice(letters, int(n))).encode() for n in rng.integers(0, 3000, 400)]
    texts += [b"x" * 300_000 + b" " + b"x" * 300_000, b" " * 200_000, b"", ("y" * 99 + " ").encode() * 5000, b"a" * 64 + b" " + b"a" * 65 + b" " + b"a" * 63 + b"b"]
    want = [plain(t) for t in texts]
    assert audit.masks(pa.array(texts)).tolist() == want
    whole = pa.array([b"junk", *texts, None])
    assert audit.masks(whole.slice(1)).tolist() == [*want, 1]


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bytescan, "hashes", lambda data, start, length: np.zeros(len(start), np.uint64))
    block = next(bytescan.cut(pa.array([b"a b a c", b"b b", b"\x00 \x00\x00 \x00"])))
    found = bytescan.words(block, bytescan.SPACE)
    ids, members = bytescan.distinct(block.data, found.start, found.length, found.text, bytescan.hashes(block.data, found.start, found.length))
    assert ids.tolist() == [0, 1, 0, 2, 3, 3, 4, 5, 4]
    assert bytescan.strings(block.data, found.start[members], found.length[members]).to_pylist() == [b"a", b"b", b"c", b"b", b"\x00", b"\x00\x00"]


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_blocks_hold_every_text(limit):
    texts = [b"", b"ab c", None, b"d" * 30, b" e", b""]
    got = []
    for b in bytescan.cut(pa.array(texts), limit):
        found = bytescan.words(b, bytescan.SPACE)
        got += [(b.first + int(t), b.data[s : s + n].tobytes()) for s, n, t in zip(found.start, found.length, found.text, strict=True)]
    assert got == [(1, b"ab"), (1, b"c"), (3, b"d" * 30), (4, b"e")]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
