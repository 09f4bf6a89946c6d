"""Expression text from trees of operation codes: a tree's nodes are rows, folded bottom-up, level by level.

A tree is JSON. [3, text] is text, [1, value] a value, [11, tree ...] one text after another; [[code, sign], tree ...] is an operation:

    2 operators    4 its operand    5 array    6 member    7 name    8 field    9 merge    10 spread    12 call

{"unresolved": true}, at any depth, marks what couldn't be recovered; a tree with such a mark, or of any other shape, is unresolved.

nodes() cuts trees into rows, a level of all trees at a time: each row explodes into its operands, without a shuffle. restored() goes
back up: the rows of a level are grouped by their parent and joined to it, and column expressions put the parent's text together from
its operands' texts, their precedence and their marks. A level's rows are those of all trees, and no function of a tree recurses.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.session import settled

# The precedence of each operator (a minus sign with one operand binds as tightly as a negation), and the names under
# which forms that nobody can write are kept.
PRECEDENCE = {
    "?:": 4, "||": 5, "&&": 6, "|": 7, "^": 8, "&": 9, "===": 10, "==": 10, "!=": 10, "!==": 10, ">=": 11, "<=": 11, ">": 11, "<": 11, "<<": 12, ">>": 12,
    "+": 13, "*": 14, "/": 14, "%": 14, "!": 16, "~": 16,
}
UNKNOWN, UNKNOWN_MERGE, UNKNOWN_NAME = "__unkownSpecific:", "__unkownMerge:", "__unTestedGetValue:"

_ELEMENT = "array<struct<raw:string,kind:string>>"
_CONTROLS = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"} | {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in "\b\t\n\f\r"}


def typed(raw: Column, value: Column) -> Column:
    """(raw, kind) of a JSON value: s a string, a an array, o an object, n anything else; raw is the string itself or the JSON text."""
    t = F.schema_of_variant(value)
    kind = F.when(t.startswith("ARRAY"), "a").when(t.startswith("OBJECT"), "o").when(t == "STRING", "s").otherwise("n")
    return F.struct(F.when(kind == "n", F.coalesce(F.to_json(value), F.lit("null"))).otherwise(raw).alias("raw"), kind.alias("kind"))


def _elements(raw: Column) -> Column:
    texts, values = F.from_json(raw, "array<string>"), F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")
    return F.transform(F.arrays_zip(texts.alias("t"), values.alias("v")), lambda x: typed(x["t"], x["v"]))


def _fields(raw: Column) -> tuple[Column, Column]:
    """An object's values and their names, in the order of the text."""
    texts, values = F.from_json(raw, "map<string,string>"), F.from_json(raw, "map<string,variant>")
    return F.transform(F.arrays_zip(F.map_values(texts).alias("t"), F.map_values(values).alias("v")), lambda x: typed(x["t"], x["v"])), F.map_keys(texts)


def _children(mode: str, scoped: Column, elements: Column, first: int) -> Column:
    """Elements from place `first` on as child rows."""
    return F.transform(F.slice(elements, first + 1, F.greatest(F.size(elements) - first, F.lit(0))), lambda x, i: F.struct((i + first).cast("int").alias("pos"), x["raw"].alias("raw"), x["kind"].alias("kind"), F.lit(mode).alias("mode"), scoped.alias("scoped")))


def _described(rows: DataFrame) -> DataFrame:
    """Adds what a node is (form), its sign, number of elements, names of fields, own text, and its children."""
    fields, names = _fields(F.col("raw"))
    rows = rows.withColumn("e", F.when(F.col("kind") == "a", _elements(F.col("raw"))).when(F.col("kind") == "o", fields).otherwise(F.array().cast(_ELEMENT)))
    rows = rows.withColumn("names", F.when(F.col("kind") == "o", names))
    head = F.get("e", F.lit(0))
    rows = rows.withColumn("h", F.when(head["kind"] == "a", _elements(head["raw"]))).withColumn("n", F.size("e"))
    plain, code = F.when(head["kind"] == "n", head["raw"]), F.get("h", F.lit(0))["raw"]
    inner = F.when((code == "7") & (F.get("e", F.lit(1))["kind"] == "a"), _elements(F.get("e", F.lit(1))["raw"]))
    rows = rows.withColumn("inner", inner)
    mark = (F.col("kind") == "o") & F.coalesce(F.try_variant_get(F.try_parse_json("raw"), "$.unresolved", "boolean"), F.lit(False)) & (F.col("n") == 1)
    named = F.get("inner", F.lit(0))["raw"]
    form = (
        F.when(F.col("kind").isNull(), "nothing").when(mark, "unresolved").when(F.col("mode") == "value", F.concat(F.lit("value-"), F.col("kind"))).when(F.col("kind") != "a", "unresolved")
        .when(plain == "3", "text").when(plain == "1", "direct").when(plain == "11", "list").when(plain.isNotNull() | F.col("h").isNull(), "unresolved")
        .when(code.isin("2", "4", "5", "6", "8", "9", "10", "12"), code).when((code == "7") & (named == "3"), "name").when((code == "7") & (named == "11"), "unknown-name").when(code == "7", "unresolved").otherwise("unknown")
    )
    rows = rows.withColumn("form", form).withColumn("sign", F.get("h", F.lit(1))["raw"])
    own = F.when(F.col("form") == "text", F.get("e", F.lit(1))["raw"]).when(F.col("form") == "name", F.get("inner", F.lit(1))["raw"]).when(F.col("form") == "8", F.get("e", F.lit(1))["raw"]).when(F.col("form").isin("value-s", "value-n"), F.col("raw"))
    yes, whole = F.lit(True), F.array(F.struct("raw", "kind"))
    children = (
        F.when(F.col("form") == "direct", _children("value", yes, F.slice("e", 1, 2), 1)).when(F.col("form") == "list", _children("code", F.col("scoped"), F.col("e"), 1))
        .when(F.col("form").isin("value-a", "value-o"), _children("value", yes, F.col("e"), 0)).when(F.col("form").isin("unknown", "unknown-name"), _children("value", yes, whole, 0))
        .when(F.col("form") == "2", _children("code", yes, F.col("e"), 1)).when(F.col("form").isin("4", "10"), _children("code", yes, F.slice("e", 1, 2), 1))
        .when(F.col("form").isin("5", "6", "9", "12"), _children("code", yes, F.slice("e", 1, 3), 1)).when(F.col("form") == "8", _children("code", yes, F.slice("e", 1, 3), 2))
    )
    return rows.withColumn("own", own).withColumn("children", children)


def nodes(trees: DataFrame, key: str = "tree_id", ops: str = "ops") -> list[DataFrame]:
    """The rows of each level: (key, parent, node, pos, scoped, form, sign, n, names, own, children). The root is the node "0"."""
    root = F.try_element_at(_elements(F.concat(F.lit("["), F.col(ops), F.lit("]"))), F.lit(1))
    rows = trees.select(key, F.lit("").alias("parent"), F.lit("0").alias("node"), F.lit(0).alias("pos"), root["raw"].alias("raw"), F.when(F.col(ops).isNull(), None).otherwise(F.coalesce(root["kind"], F.lit("n"))).alias("kind"), F.lit("code").alias("mode"), F.lit(False).alias("scoped"))
    levels = []
    while True:
        level = settled(_described(rows).select(key, "parent", "node", "pos", "scoped", "form", "sign", "n", "names", "own", "children"))
        if level.isEmpty():
            return levels
        levels.append(level)
        below = level.select(key, F.col("node").alias("parent"), F.explode("children").alias("c"))
        rows = below.select(key, "parent", F.concat_ws(".", "parent", F.col("c.pos").cast("string")).alias("node"), "c.pos", "c.raw", "c.kind", "c.mode", "c.scoped")


def braced(value: Column, pair: str) -> Column:
    """value between the brackets of pair, with spaces where it begins or ends with a bracket itself."""
    tight = value.rlike(r"(?s)^[{\[(]") | value.rlike(r"(?s)[}\])]\z")
    return F.concat(F.lit(pair[0]), F.when(tight, F.concat(F.lit(" "), value, F.lit(" "))).otherwise(value), F.lit(pair[1]))


def quoted(value: Column) -> Column:
    """A string between single quotes; double quotes stay as they are."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    whole = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), _CONTROLS.items(), escaped)
    return F.concat(F.lit("'"), F.when(value.rlike(r"[\x00-\x1f]"), whole).otherwise(escaped), F.lit("'"))


def _binding(sign: Column, n: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in PRECEDENCE.items() for x in pair))
    return F.when(sign == "-", F.when(n == 3, 13).otherwise(16)).otherwise(F.coalesce(F.try_element_at(known, sign), F.lit(0)))


def _inside(value: Column) -> Column:
    """Without its brackets and the blanks beside them."""
    return F.regexp_replace(F.substring(value, F.lit(2), F.length(value) - 2), r"^\s+|\s+\z", "")


def _text(kid, form: Column, sign: Column, n: Column, own: Column, kids: Column) -> Column:
    """A node's text before its scope, from its operands' texts."""
    k1, k2 = kid(1), kid(2)
    bind = _binding(sign, n)

    def operand(i: int) -> Column:
        found = F.try_element_at(F.filter(kids, lambda k: k["pos"] == i), F.lit(1))
        loose = found["operator"] & (bind > found["bind"])
        return F.when(F.coalesce(loose, F.lit(False)), braced(kid(i), "()")).otherwise(kid(i))

    is_list = lambda c: c.startswith("[") & c.endswith("]")
    array = F.when(n == 1, "[]").when(n == 2, braced(k1, "[]")).when(~is_list(k1), braced(F.concat(F.lit("..."), k1, F.lit(","), k2), "[]")).when(k1 == "[]", braced(k2, "[]")).otherwise(braced(F.concat(_inside(k1), F.lit(","), k2), "[]"))
    is_name = F.coalesce(F.try_element_at(F.filter(kids, lambda k: k["pos"] == 2), F.lit(1))["name"], F.lit(False))
    member = F.when(~is_name & k2.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z"), F.concat(k1, F.lit("."), k2)).otherwise(F.concat(k1, braced(k2, "[]")))
    part = lambda c: F.when(c.startswith("..."), c).when(c.startswith("{") & c.endswith("}"), _inside(c))
    merged = F.when(part(k1).isNull() | part(k2).isNull(), braced(F.concat(F.lit(UNKNOWN_MERGE), braced(F.concat(k1, F.lit(","), k2), "[]")), "{}")).otherwise(braced(F.concat(part(k1), F.lit(","), part(k2)), "{}"))
    call = F.when(is_list(k2), F.concat(k1, braced(_inside(k2), "()"))).otherwise(F.concat(k1, F.lit(".apply"), braced(F.concat(F.lit("null,"), k2), "()")))
    operated = F.when(sign == "?:", F.concat(operand(1), F.lit("?"), operand(2), F.lit(":"), operand(3))).when(sign.isin("!", "~") | ((sign == "-") & (n != 3)), F.concat(sign, operand(1))).otherwise(F.concat(operand(1), sign, operand(2)))
    texts = F.transform(kids, lambda k: k["text"])
    pairs = F.transform(F.arrays_zip(F.col("names").alias("a"), texts.alias("b")), lambda x: F.concat(x["a"], F.lit(":"), x["b"]))
    return (
        F.when(form.isin("text", "name"), own).when(form == "direct", k1).when(form == "list", F.array_join(texts, "")).when(form == "2", operated).when(form == "4", k1).when(form == "5", array).when(form == "6", member)
        .when(form == "8", braced(F.concat(own, F.lit(":"), k2), "{}")).when(form == "9", merged).when(form == "10", F.concat(F.lit("..."), k1)).when(form == "12", call)
        .when(form == "unknown", braced(F.concat(F.lit(UNKNOWN), kid(0)), "{}")).when(form == "unknown-name", braced(F.concat(F.lit(UNKNOWN_NAME), braced(kid(0), "[]")), "{}"))
        .when(form == "value-a", braced(F.array_join(texts, ","), "[]")).when(form == "value-o", braced(F.array_join(pairs, ","), "{}")).when(form == "value-s", quoted(own)).when(form == "value-n", own).otherwise("")
    )


_KID = "array<struct<pos:int,text:string,operator:boolean,bind:int,name:boolean,unresolved:boolean>>"


def restored(trees: DataFrame, key: str = "tree_id", ops: str = "ops") -> DataFrame:
    """(key, text, unresolved): an expression in double braces, or plain text, for each tree; text is null where it is unresolved.

    A null tree is empty text. Keys must be unique; other columns are ignored.
    """
    result = None
    for level in reversed(nodes(trees, key, ops)):
        if result is None:
            met = level.withColumn("kids", F.array().cast(_KID))
        else:
            kids = result.groupBy(key, F.col("parent").alias("node")).agg(F.sort_array(F.collect_list(F.struct("pos", "text", "operator", "bind", "name", "unresolved"))).alias("kids"))
            met = level.join(kids, [key, "node"], "left").withColumn("kids", F.coalesce("kids", F.array().cast(_KID)))
        kid = lambda i: F.coalesce(F.try_element_at(F.filter(F.col("kids"), lambda k: k["pos"] == i), F.lit(1))["text"], F.lit(""))
        form = F.col("form")
        text = _text(kid, form, F.coalesce("sign", F.lit("")), F.col("n"), F.coalesce("own", F.lit("")), F.col("kids"))
        told = met.withColumn("raw", text).withColumn("unresolved", (form == "unresolved") | F.exists("kids", lambda k: k["unresolved"]))
        bare = F.col("scoped") | form.isin("text", "list", "nothing") | form.startswith("value-")
        wrapped = F.when(bare, F.col("raw")).when(F.col("raw").startswith("{") & F.col("raw").endswith("}"), F.concat(F.lit("{"), "raw", F.lit("}"))).otherwise(F.concat(F.lit("{{"), "raw", F.lit("}}")))
        result = told.select(key, "parent", "pos", wrapped.alias("text"), (form == "2").alias("operator"), F.when(form == "2", _binding(F.coalesce("sign", F.lit("")), F.col("n"))).alias("bind"), (form == "name").alias("name"), "unresolved")
    if result is None:
        return trees.select(key, F.lit("").alias("text"), F.lit(False).alias("unresolved"))
    return result.select(key, F.when(~F.col("unresolved"), F.col("text")).alias("text"), "unresolved")
