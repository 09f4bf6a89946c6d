import json

from pyspark.sql import functions as F

from tarn.operators import expressions

N = lambda s: [[7], [3, s]]

def op(sign, *args):
    return [[2, sign], *args]


def cases():
    """(tree, text) by the rules of the notation."""
    a, b, c = N("a"), N("b"), N("c")
    out = [
        (None, ""), ([3, "plain"], "plain"), ([3, 7], "7"), ([1, 5], "{{5}}"), ([1, True], "{{true}}"), ([1, None], "{{null}}"), ([1, "it's \"x\"\n\x1f\\"], "{{'it\\'s \"x\"\\n\\u001f\\\\'}}"),
        ([1, [1, "x", [2]]], "{{[ 1,'x',[2] ]}}"), ([1, {"b": 1, "a": "q"}], "{{b:1,a:'q'}}"), ([1, {}], "{{}}"), (a, "{{a}}"),
        ([11, [3, "x-"], a, [3, "-y"], [1, 2]], "x-{{a}}-y{{2}}"),
        (op("+", a, op("*", b, c)), "{{a+b*c}}"), (op("*", op("+", a, b), c), "{{(a+b)*c}}"), (op("-", op("+", a, b), c), "{{a+b-c}}"), (op("-", op("+", a, b)), "{{-(a+b)}}"), (op("!", op("&&", a, b)), "{{!(a&&b)}}"),
        (op("?:", op("==", a, [1, 1]), b, op("||", b, c)), "{{a==1?b:b||c}}"), (op("&&", op("?:", a, b, c), a), "{{(a?b:c)&&a}}"), (op("!", a), "{{!a}}"),
        ([[6], a, [3, "name"]], "{{a.name}}"), ([[6], a, b], "{{a[b]}}"), ([[6], a, [3, "0x"]], "{{a[0x]}}"), ([[6], a, [1, 0]], "{{a[0]}}"), ([[6], [[6], a, [3, "x"]], [[6], b, [3, "y"]]], "{{a.x[b.y]}}"),
        ([[5]], "{{[]}}"), ([[5], a], "{{[a]}}"), ([[5], [[5], a], b], "{{[a,b]}}"), ([[5], [[5]], b], "{{[b]}}"), ([[5], a, b], "{{[...a,b]}}"), ([[5], [[5], [[5], a]], b], "{{[ [a],b ]}}"),
        ([[8], "k", a], "{{k:a}}"), ([[9], [[8], "k", a], [[8], "m", b]], "{{k:a,m:b}}"), ([[9], [[10], a], [[8], "m", b]], "{{...a,m:b}}"), ([[9], a, b], "{{ __unkownMerge:[a,b] }}"),
        ([[8], "k", [[8], "m", a]], "{{ k:{m:a} }}"), ([[12], a, [[5], [[5], b], c]], "{{a(b,c)}}"), ([[12], a, b], "{{a.apply(null,b)}}"), ([[4], a], "{{a}}"),
        ([[99, "q"], 1], "{{ __unkownSpecific:[ [99,'q'],1 ] }}"), ([[7], [11, "x"]], "{{ __unTestedGetValue:[ [ [7],[11,'x'] ] ] }}"),
        ({"unresolved": True}, None), (op("+", a, {"unresolved": True}), None), ([11, [3, "x"], [[5], [1, [{"unresolved": True}]]]], None), ([77, 1], None), ("text", None), ([[7], [5, 1]], None), ([1, {"unresolved": True, "b": 1}], "{{unresolved:true,b:1}}"),
    ]
    return [(json.dumps(t), text) for t, text in out[1:]] + [(None, ""), ("{", None), ("[3, \"<\"", None), ("", None)]


def test_forms(spark):
    rows = [(i, t, "x", 1) for i, (t, _) in enumerate(cases())]
    df = spark.createDataFrame(rows, "tree_id int, ops string, text string, pos int").withColumn("kids", F.lit(1))
    got = {r["tree_id"]: (r["text"], r["unresolved"]) for r in expressions.restored(df).collect()}
    want = {i: (text, text is None) for i, (_, text) in enumerate(cases())}
    assert {cases()[i]: v for i, v in got.items() if v != want[i]} == {} and len(got) == len(want)


def test_deep_and_empty(spark):
    tree, text = N("x"), "x"
    for i in range(6):
        tree, text = ([[6], tree, [3, f"m{i}"]], f"{text}.m{i}") if i % 2 else (op("!", tree), f"!{text}")
    got = expressions.restored(spark.createDataFrame([(1, json.dumps(tree))], "tree_id int, ops string")).first()
    assert got["text"] == "{{" + text + "}}"
    assert expressions.restored(spark.createDataFrame([], "tree_id int, ops string")).collect() == []
