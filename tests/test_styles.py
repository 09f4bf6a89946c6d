import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from tarn import session
from tarn.functions import paths
from tarn.operators import styles

OWN = "pkg_id string, file string, file_ord int, call int, ord int, kind string, value string"
SHARED = "pkg_id string, sheet string, ord int, kind string, value string"


def tables(spark, packages):
    """packages: {name: (files, sheets)}; a file is (name, calls), a call or sheet a list of pieces, a piece a text or (kind, value)."""
    own, shared = [], []
    whole = lambda x: ("text", x) if isinstance(x, str) else x
    for pkg, (files, sheets) in packages.items():
        for f, (file, calls) in enumerate(files):
            for c, call in enumerate(calls):
                own += [(pkg, file, f, c, i, *whole(x)) for i, x in enumerate(call)] or [(pkg, file, f, c, 0, None, None)]
        for sheet, content in sheets.items():
            shared += [(pkg, sheet, i, *whole(x)) for i, x in enumerate(content)] or [(pkg, sheet, 0, None, None)]
    return spark.createDataFrame(own, OWN), spark.createDataFrame(shared, SHARED)


def by_hand(files, sheets, ext=".wxss"):
    """The same by depth-first recursion over one package."""
    count, pure, told, out = {}, {}, set(), {}

    def visit(content, above, file):
        for x in content:
            if isinstance(x, tuple) and x[0] == "import":
                if x[1] not in sheets:
                    continue
                if x[1] in above:
                    continue
                count[x[1]] = count.get(x[1], 0) + 1
                if count[x[1]] == 1:
                    visit(sheets[x[1]], {*above, x[1]}, file)

    for file, calls in files:
        for call in calls:
            visit(call, set(), file)
            if len(call) == 1 and call[0][0] == "import" and call[0][1] in sheets:
                pure.setdefault(call[0][1], file)
    homes = dict(pure)
    for s in sheets:
        if s not in pure and count.get(s, 0) > 1:
            import hashlib

            homes[s] = "__shared__/" + (s if s.isdigit() else "shared-" + hashlib.sha256(s.encode()).hexdigest()[:16]) + ext

    def write(content, above, file):
        text = ""
        for x in content:
            if isinstance(x, str):
                text += x
            elif x[0] == "rpx":
                text += x[1] + "rpx"
            elif x[0] == "import":
                s = x[1]
                if s not in sheets:
                    told.add(("unresolved_import", file, s))
                    text += styles.MISSING
                elif s in above:
                    told.add(("import_cycle", file, s))
                    text += styles.CYCLE
                elif s in homes and homes[s] != file:
                    up = file.count("/") if not (file.split("/")[0] == homes[s].split("/")[0] and "/" in homes[s]) else 0
                    text += '@import "' + "../" * up + (homes[s] if up or "/" not in file else homes[s].split("/", 1)[1]).rsplit(".", 1)[0] + ext + '";\n'
                elif s in homes:
                    text += write(sheets[s], above | {s}, file)
                else:
                    text += f"/*! sheet {s} */" + write(sheets[s], above | {s}, file) + styles.CLOSES
        return text

    for file, calls in files:
        out[file] = out.get(file, "") + "".join(write(c, set(), file) for c in calls)
    for s, home in homes.items():
        if s not in pure:
            out[home] = out.get(home, "") + write(sheets[s], {s}, home)
    return count, homes, out, told


I = lambda s: ("import", s)  # noqa: E731, E741
PACKAGES = {
    "plain": ([("app.wxss", [["a{", ("rpx", "12"), ("suffix", "x"), "}", I("1")]]), ("p/q.wxss", [[I("1"), I("2")], ["z"]])], {"1": ["one"], "2": ["two", I("3")], "3": ["three"], "4": ["never"]}),
    "own": ([("app.wxss", [[I("1")]]), ("b/c.wxss", [[I("1"), "x"]]), ("d.wxss", [[I("1")]])], {"1": ["one", I("2")], "2": [], "3": [I("1")]}),
    "cycle": ([("app.wxss", [["s", I("a")]])], {"a": ["A", I("b")], "b": ["B", I("c"), I("b")], "c": ["C", I("a")]}),
    "shared-cycle": ([("app.wxss", [[I("a"), "-", I("b")]]), ("e.wxss", [[]])], {"a": ["A", I("b")], "b": ["B", I("a")]}),
    "gone": ([("app.wxss", [[I("zz"), I("k")]]), ("f.wxss", [[I("zz")]])], {"k": [I("yy"), I("yy"), "k"]}),
    "none": ([("app.wxss", [[]])], {"k": []}),
}


def check(spark, packages):
    own, shared = (df.withColumn("home", F.lit(1)).withColumn("above", F.lit(1)).withColumn("action", F.lit(1)) for df in tables(spark, packages))
    sheets = styles.sheet_files(own, shared)
    files, told = styles.rebuilt(own, shared, sheets)
    sheets, files, told = sheets.collect(), files.collect(), told.collect()
    for pkg, (own_files, own_sheets) in packages.items():
        count, homes, out, notes = by_hand(own_files, own_sheets)
        assert {r["sheet"]: r["imports"] for r in sheets if r["pkg_id"] == pkg} == {s: count.get(s, 0) for s in own_sheets}, pkg
        assert {r["sheet"]: r["file"] for r in sheets if r["pkg_id"] == pkg and r["file"]} == homes, pkg
        assert {r["file"]: r["text"] for r in files if r["pkg_id"] == pkg} == out, pkg
        assert {(r["code"], r["file"], r["sheet"]) for r in told if r["pkg_id"] == pkg} == notes, pkg


def test_packages(spark):
    check(spark, PACKAGES)
    own, shared = tables(spark, PACKAGES)
    got = {(r["pkg_id"], r["sheet"]): r["action"] for r in styles.sheet_files(own, shared).collect()}
    assert got["plain", "1"] == "file" and got["plain", "2"] == got["plain", "3"] == "inline" and got["plain", "4"] == "unused" and got["own", "1"] == "own"
    assert got["cycle", "a"] == got["cycle", "b"] == "inline" and got["shared-cycle", "b"] == "file" and got["shared-cycle", "a"] == "inline"


def test_deep_and_wide(spark):
    rng = random.Random(3)
    packages = {"chain": ([("app.wxss", [[I("0")]]), ("g.wxss", [["x", I("7")]])], {str(i): [f"<{i}>", *([I(str(i + 1))] if i < 9 else [])] for i in range(10)})}
    for n in range(8):
        names = [f"s{i}" for i in range(7)]
        sheets = {s: [rng.choice("abc"), *(I(rng.choice(names[i + 1 :])) for _ in range(rng.randrange(3)) if names[i + 1 :])] for i, s in enumerate(names)}
        packages[f"dag{n}"] = ([(f"x{k}.wxss", [[I(rng.choice(names)), "y", I(rng.choice([*names, "unknown"]))]]) for k in range(3)], sheets)
    check(spark, packages)


def test_blocked_and_empty(spark):
    own, shared = tables(spark, {"own": PACKAGES["own"]})
    blocked = spark.createDataFrame([("own", "app.wxss")], "pkg_id string, file string")
    got = {r["sheet"]: r["file"] for r in styles.sheet_files(own, shared, blocked).collect()}
    assert got["1"] == "d.wxss"
    empty = spark.createDataFrame([], OWN), spark.createDataFrame([], SHARED)
    sheets = styles.sheet_files(*empty)
    assert sheets.collect() == [] and [x.collect() for x in styles.rebuilt(*empty, sheets)] == [[], []]


def test_links_equal_relative_paths(spark):
    folders = ["", "a/", "a/b/", "a//b/", "/a/", "//", "b/a/", "a/b/c/", "./a/", "../", "ab/"]
    names = [f"{x}{y}" for x in folders for y in ("a", "x.wxss", "b.c.d")]
    df = spark.createDataFrame([(x, y) for x in names for y in names], "file string, home string")
    said = styles._import(F.col("file"), F.col("home"), ".wxss")
    plain = F.concat(F.lit('@import "'), paths.change_extension(paths.relative(F.col("file"), F.col("home")), ".wxss"), F.lit('";\n'))
    assert df.select("*", *styles._views(F.col("file"))).where(said != plain).collect() == []


def test_files_need_no_pieces_any_more(spark):
    """What the pieces were made from, and the tables between, can go before the files are read."""
    own, shared = map(session.settled, tables(spark, PACKAGES))
    folder = Path(re.sub("^file:/+", "/", session.shared_dir(spark)))
    there = lambda: {p.name for p in folder.glob("settled-*")}
    before = there()
    sheets = styles.sheet_files(own, shared)
    assert len(there() - before) == 1
    expected = [sorted(df.collect()) for df in styles.rebuilt(own, shared, sheets)]
    before = there()
    found = styles.rebuilt(own, shared, sheets)
    made = there() - before
    session.discard(own, shared, sheets)
    assert [sorted(df.collect()) for df in found] == expected
    assert {f.split("/")[-2] for f in found[0].inputFiles()} == made


def test_own_file_with_a_shared_name(spark):
    check(spark, {"p": ([("__shared__/1.wxss", [["own", "own too"]]), ("b.wxss", [[I("1"), I("1")]])], {"1": ["one", I("2"), "more"], "2": ["two"]})})


def test_no_shuffle_files_stay(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    stay = lambda: {x.toString() for x in (found.apply(i) for found in [manager.getAllFiles()] for i in range(found.size())) if "shuffle_" in x.toString()}
    before = stay()
    table = session.settled(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert stay() <= before
    assert len(table.collect()) == 7
