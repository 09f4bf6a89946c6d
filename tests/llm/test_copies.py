import random

import corpus_pipeline
from tarn.llm import copies
from tests.llm.texts import EDGE, frame

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def roots(rows):
    """rows: (id, text). The number of each row's component, by all pairs."""
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def brute(rows):
    root = roots(rows)
    return sorted((str(i), str(min((x for (x, _), r in zip(rows, root, strict=True) if r == at and x is not None), default=None))) for (i, _), at in zip(rows, root, strict=True))


def test_edited_copies_go_and_clean_documents_stay(spark, sf):
    rnd = random.Random(3)
    rows, kept = [], []
    for i in range(0, 400, 4):
        words = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        rows.append((i, " ".join(words)))
        kept.append(i)
        for k in range(1, 4):  # one to three words replaced: similarity 0.95 to 0.86
            other = list(words)
            for at in rnd.sample(range(0, 200, 10), k):
                other[at] = "edited"
            rows.append((i + k, " ".join(other)))
    half = rows[0][1].split()[:100] + [f"v{k}" for k in range(100)]
    rows.append((1000, " ".join(half)))
    docs = frame(spark, [(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == [*kept, 1000]


def test_chain_is_found_beyond_the_smallest(spark):
    """A chain in which most pairs aren't similar: every link must be found, not only those to one entry."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 200])) for i in range(20)]
    assert {r["component_id"] for r in copies.near_copies(frame(spark, [(*r, "s") for r in rows])).collect()} == {0}


def test_against_all_pairs(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for some in (rows, [(i, t) for i, t, _ in EDGE]):
        got = copies.near_copies(frame(spark, [(*r, "s") for r in some])).collect()
        assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == brute(some)
    assert copies.near_copies(frame(spark, [])).collect() == []


def test_stage_with_repeated_ids_and_clashing_columns(spark, sf):
    """One id with other texts is another document, rows without an id go last, and no column is lost to an operator's."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(8, text, "a"), (8, text, "a"), (8, text + " 13 14 15 16 17 18", "b"), (None, text, "c"), (None, "words of a document without any id that no other row has", "d"), (9, text, "e"), (3, "x", "f"), (3, "x", "g")]
    clash = ("n_words", "kept", "spans", "n_email", "slot", "block", "place", "fp", "root", "text_hash", "component_id", "base_failed", "entry")
    docs = frame(spark, rows, "doc_id long, text string, source string")
    docs = docs.selectExpr("*", "'en' as lang", "length(text) as n_chars", *(f"concat('{c}', source) as `{c}`" for c in clash))
    got = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns
    kept = [(r["doc_id"], r["text"], r["source"]) for r in got.collect()]
    assert sorted(map(str, kept)) in [sorted(map(str, [rows[0], rows[2], rows[4], x])) for x in rows[6:]]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert all(r[c] == f"{c}{r['source']}" for r in out.collect() for c in clash)
    assert {r["doc_id"] for r in corpus_pipeline.byte_bpe(spark, docs, sf).collect()} == {None, 3, 8, 9}


def edited(rnd, base, edits, tag):
    words = list(base)
    for at in rnd.sample(range(0, len(words), 5), edits):
        words[at] = tag if tag else f"e{rnd.randrange(4)}"
    return " ".join(words)


def bands_that_mix(spark, rows):
    """The judge of the rows, and all entries, each its own root."""
    docs = frame(spark, [(*r, "s") for r in rows])
    found = copies.written(copies.sketches(docs, "doc_id", "text", copies.SHINGLE), "sketches")
    return copies._Judge(copies._keyed(docs, "doc_id", "text"), found, copies.SHINGLE, copies.SIMILARITY), found.selectExpr("entry", "entry as root")


def test_pairs_of_a_crowd_do_not_grow_with_its_square(spark):
    """Copies of one text that differ too much from each other: there is nothing to find, and few pairs are made for that."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    made = []
    for n in (150, 300):
        judge, members = bands_that_mix(spark, [(i, edited(rnd, base, 5, f"t{i}")) for i in range(n)])
        made.append(copies._by_prefix(judge, members).count())
        assert made[-1] <= 10 * n
    assert made[1] <= 3 * made[0]


def test_crowds_lose_no_link(spark, monkeypatch):
    rnd = random.Random(6)
    texts = {}
    for n in (40, 100, 200):
        base = [f"{n}w{i}" for i in range(n)]
        texts |= dict.fromkeys(edited(rnd, base, rnd.randrange(1, n // 20 + 1), "") for _ in range(90))
    rows = list(enumerate(texts))
    want = brute(rows)
    assert 30 < len({c for _, c in want}) < len(rows) - 20
    judge, members = bands_that_mix(spark, rows)
    ids = {r["entry"]: r["doc_id"] for r in judge.entries.collect()}
    for crowd, rounds, load in ((2, 2, 0), (16, 3, 128)):
        for name, value in (("CROWD", crowd), ("ROUNDS", rounds), ("LOAD", load)):
            monkeypatch.setattr(copies, name, value)
        links = judge.similar(copies._by_prefix(judge, members), "u", "v")
        root = {r["node"]: r["root"] for r in copies.components(links).collect()}
        least = {}
        for e, i in ids.items():
            least[root.get(e, e)] = min(i, least.get(root.get(e, e), i))
        assert sorted((str(i), str(least[root.get(e, e)])) for e, i in ids.items()) == want
