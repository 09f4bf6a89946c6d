"""Style sheets put together from pieces that share imports: a graph over edge rows, worked off by iterated joins.

A package has files and shared sheets. Both are rows of pieces, in order:

    own(pkg_id, file, file_ord, call, ord, kind, value)    a file's own pieces; each call adds to the file
    shared(pkg_id, sheet, ord, kind, value)                a shared sheet's pieces

kind is text, rpx (a number, written with that unit), suffix (dropped) or import, whose value names a shared sheet. A row of
null kind says that a file or a sheet is there and has no pieces.

Levels of imports are worked off by joins keyed by package and sheet, once for each level. What a level gives is settled, so that plans
stay short and lost tasks are recomputed from the last level, and what nothing reads any more is discarded. Texts don't go along with
the levels: a sheet's pieces are one row, met once for each place that the sheet is copied to.
"""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import paths
from tarn.session import discard, settled

FOLDER, EXTENSION = "__shared__", ".wxss"
#: Comments in place of what is left out or has no name of its own; {} is the sheet.
CYCLE, MISSING = "/*! import cycle left out */", "/*! import of an unknown sheet left out */"
OPENS, CLOSES = "/*! sheet {} */", "/*! end of sheet */"
_FIRST, _LAST = -1, (1 << 31) - 1
_KEY = ["pkg_id", "sheet"]
#: Fates of imports whose sheets are put in their place.
_PUT = ("self", "copy")


def _layers(own: DataFrame, there: DataFrame, links: DataFrame) -> list[DataFrame]:
    """(pkg_id, sheet, v) by level: visits of sheets, v a struct of place and above; a sheet's smallest v counts.

    place is the list of positions that leads to a sheet: file, call, piece, then a piece of each sheet above; the first in order counts,
    as in a walk that follows imports as it meets them. An import of a sheet that stands above closes a cycle and isn't followed.
    """
    roots = own.where("kind = 'import'").select("pkg_id", F.col("value").alias("sheet"), F.array("file_ord", "call", "ord").cast("array<int>").alias("place")).join(there, _KEY)
    visit = F.struct("place", "above")
    layers = [settled(roots.withColumn("above", F.array().cast("array<string>")).groupBy(*_KEY).agg(F.min(visit).alias("v")))]
    while not layers[-1].isEmpty():
        onward = layers[-1].join(links, _KEY).select("pkg_id", "target", F.concat("v.place", F.array(F.col("ord").cast("int"))).alias("place"), F.concat("v.above", F.array("sheet")).alias("above"))
        found = onward.where("not array_contains(above, target)").groupBy("pkg_id", F.col("target").alias("sheet")).agg(F.min(visit).alias("new"))
        met = found.join(_all(layers), _KEY, "left").groupBy(*_KEY).agg(F.min("new").alias("new"), F.min("v").alias("v"))
        layers.append(settled(met.where("v is null or new < v").select(*_KEY, F.col("new").alias("v"))))
    return layers


def _all(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def sheet_files(own: DataFrame, shared: DataFrame, blocked: DataFrame | None = None, folder: str = FOLDER, extension: str = EXTENSION) -> DataFrame:
    """(pkg_id, sheet, imports, action, file), a settled table: what becomes of each shared sheet.

    own: a call of some file is nothing but its import, so the sheet is that file; the first such file in order, if it isn't among
    blocked(pkg_id, file). file: two imports or more, written below folder. inline: one import, copied to where it stands. unused: none.
    Imports count where they are met: in files, and once in each sheet that files reach; those that close a cycle don't count.
    """
    there = settled(shared.select(*_KEY).distinct())
    targets = there.withColumnRenamed("sheet", "target")
    links = settled(shared.where("kind = 'import'").select(*_KEY, "ord", F.col("value").alias("target")).join(targets, ["pkg_id", "target"]))
    layers = _layers(own, there, links)
    visits = _all(layers).groupBy(*_KEY).agg(F.min("v").alias("v")).select(*_KEY, "v.above")
    in_files = own.where("kind = 'import'").select("pkg_id", F.col("value").alias("sheet"))
    inner = visits.join(links, _KEY).where("target <> sheet and not array_contains(above, target)").select("pkg_id", F.col("target").alias("sheet"))
    counted = in_files.unionAll(inner).groupBy(*_KEY).agg(F.count("*").alias("imports"))
    calls = own.groupBy("pkg_id", "file", "file_ord", "call").agg(F.count("*").alias("n"), F.max(F.when(F.col("kind") == "import", F.col("value"))).alias("sheet")).where("n = 1 and sheet is not null")
    if blocked is not None:
        calls = calls.join(blocked.select("pkg_id", "file"), ["pkg_id", "file"], "left_anti")
    pure = calls.groupBy(*_KEY).agg(F.min_by("file", F.struct("file_ord", "call")).alias("pure"))
    name = F.when(F.col("sheet").rlike("^(0|[1-9][0-9]*)$"), F.col("sheet")).otherwise(F.concat(F.lit("shared-"), F.substring(F.sha2("sheet", 256), 1, 16)))
    known = there.join(counted, _KEY, "left").join(pure, _KEY, "left").withColumn("imports", F.coalesce("imports", F.lit(0)))
    action = F.when(F.col("pure").isNotNull(), "own").when(F.col("imports") > 1, "file").when(F.col("imports") == 1, "inline").otherwise("unused")
    file = F.when(F.col("action") == "own", F.col("pure")).when(F.col("action") == "file", F.concat(F.lit(f"{folder}/"), name, F.lit(extension)))
    sheets = settled(known.withColumn("action", action).select(*_KEY, "imports", "action", file.alias("file")))
    discard(there, links, *layers)
    return sheets


def _views(file: Column) -> list[Column]:
    """What _import() takes of a file, once for each row: its folder, the folder's first segment and the way up from it."""
    folder = paths.parent(file)
    segments = F.filter(F.split(folder, "/"), lambda x: x != "")
    return [F.when(folder == F.array_join(segments, "/"), folder).alias("folder"), F.get(segments, 0).alias("top"), F.repeat(F.lit("../"), F.size(segments)).alias("ups")]


def _import(file: Column, home: Column, extension: str) -> Column:
    """An @import of home seen from file, as by paths.relative; folder, top and ups are columns of _views(file)."""
    name = F.substring_index(home, "/", -1)
    apart = F.col("top").isNull() | ~F.startswith(home, F.concat("top", F.lit("/")))
    seen = F.when(apart, F.concat("ups", home)).when(home == F.concat("folder", F.lit("/"), name), name).otherwise(paths.relative(file, home))
    return F.concat(F.lit('@import "'), paths.change_extension(seen, extension), F.lit('";\n'))


def _fate(target: Column, known: Column, home: Column, file: Column, above: Column) -> Column:
    """What becomes of an import of target, whose file is home, where it stands in file below the sheets above."""
    return F.when(~known, "missing").when(F.array_contains(above, target), "cycle").when(home.isNotNull() & (home != file), "link").when(home.isNotNull(), "self").otherwise("copy")


def _said(fate: Column, home: Column, file: Column, extension: str) -> Column:
    """What stands in place of an import whose sheet isn't put there."""
    return F.when(fate == "link", _import(file, home, extension)).when(fate == "missing", MISSING).when(fate == "cycle", CYCLE)


def _contents(shared: DataFrame, sheets: DataFrame) -> DataFrame:
    """(pkg_id, sheet, items): a sheet's pieces in order, structs of at, text, target, known and home. target is an import's sheet, home its file."""
    pieces = shared.where("kind is not null").select(*_KEY, F.col("ord").cast("int").alias("at"), "kind", "value")
    imports = pieces.where("kind = 'import'").select("pkg_id", F.col("sheet").alias("of"), "at", F.col("value").alias("sheet")).join(sheets, _KEY, "left")
    imports = imports.select("pkg_id", F.col("of").alias("sheet"), F.struct("at", F.lit(None).cast("string").alias("text"), F.col("sheet").alias("target"), F.col("action").isNotNull().alias("known"), "home").alias("item"))
    texts = pieces.where("kind <> 'import'").withColumn("text", _text()).where("text <> ''")
    none = F.lit(None).cast("string")
    texts = texts.select(*_KEY, F.struct("at", "text", none.alias("target"), F.lit(None).cast("boolean").alias("known"), none.alias("home")).alias("item"))
    return texts.unionByName(imports).groupBy(*_KEY).agg(F.sort_array(F.collect_list("item")).alias("items"))


def _text() -> Column:
    return F.when(F.col("kind") == "text", F.col("value")).when(F.col("kind") == "rpx", F.concat("value", F.lit("rpx"))).when(F.col("kind") != "import", "")


def _written(copies: DataFrame, contents: DataFrame, extension: str) -> DataFrame:
    """copies(pkg_id, file, place, above, sheet, copied) with their sheets' pieces as parts, structs of at, text, sheet and fate.

    text is null where a sheet is put. sheet and above are null where nothing asks for them.
    """
    file = F.col("file")

    def fated(x: Column) -> Column:
        fate = F.when(x["known"].isNotNull(), _fate(x["target"], x["known"], x["home"], file, F.col("above")))
        return F.struct(x["at"].alias("at"), x["text"].alias("text"), x["target"].alias("target"), x["home"].alias("home"), fate.alias("fate"))

    def part(x: Column) -> Column:
        text = F.when(x["fate"].isNull(), x["text"]).otherwise(_said(x["fate"], x["home"], file, extension))
        return F.struct(x["at"].alias("at"), text.alias("text"), F.when(x["fate"] != "link", x["target"]).alias("sheet"), x["fate"].alias("fate"))

    items = F.coalesce("items", F.array().cast(contents.schema["items"].dataType))
    met = copies.join(contents, _KEY, "left").select("pkg_id", "file", "place", "above", "sheet", "copied", F.transform(items, fated).alias("items"), *_views(file))
    above, sheet = F.when(F.exists("items", lambda x: x["fate"].isin(*_PUT)), F.col("above")), F.when(F.col("copied"), F.col("sheet"))
    return met.select("pkg_id", "file", "place", above.alias("above"), sheet.alias("sheet"), "copied", F.transform("items", part).alias("parts"))


def _chunks() -> Column:
    """Texts of a row of _written() with their places; as one if no sheet is put between them."""
    parts, place = F.filter("parts", lambda x: x["text"].isNotNull()), F.col("place")
    before, after = OPENS.split("{}")
    opens, closes = F.concat(F.lit(before), F.col("sheet"), F.lit(after)), F.lit(CLOSES)
    at = lambda n, text: F.struct(F.concat(place, F.array(n)).alias("place"), text.alias("text"))
    ends = F.when(F.col("copied"), F.array(at(F.lit(_FIRST), opens), at(F.lit(_LAST), closes))).otherwise(F.array().cast("array<struct<place:array<int>,text:string>>"))
    joined = F.array_join(F.transform(parts, lambda x: x["text"]), "")
    whole = F.struct("place", F.when(F.col("copied"), F.concat(opens, joined, closes)).otherwise(joined).alias("text"))
    return F.when(F.exists("parts", lambda x: x["fate"].isin(*_PUT)), F.concat(F.transform(parts, lambda x: at(x["at"], x["text"])), ends)).otherwise(F.array(whole))


def rebuilt(own: DataFrame, shared: DataFrame, sheets: DataFrame, extension: str = EXTENSION) -> tuple[DataFrame, DataFrame]:
    """(files(pkg_id, file, text), diagnostics(pkg_id, code, file, sheet)) from the pieces and sheet_files(). They read settled tables
    alone, no longer what they are made from.

    An import becomes, in this order: a comment and a diagnostic if its sheet is unknown or stands above it; an @import if the sheet is
    another file; else the sheet's own pieces, between comments unless the file is that sheet. As sheets are copied at most once
    but for cycles, there are no more copies than sheets; each iteration goes one level deeper.
    """
    sheets = sheets.select(*_KEY, "action", F.col("file").alias("home"))
    contents = settled(_contents(shared, sheets))
    pieces = own.select("pkg_id", "file", F.array("call", "ord").cast("array<int>").alias("place"), "kind", "value")
    met = pieces.where("kind = 'import'").withColumn("sheet", F.col("value")).join(sheets, _KEY, "left")
    nothing = F.array().cast("array<string>")
    fate = _fate(F.col("sheet"), F.col("action").isNotNull(), F.col("home"), F.col("file"), nothing)
    met = met.select("*", fate.alias("fate"), *_views(F.col("file"))).select("pkg_id", "file", "place", _said(F.col("fate"), F.col("home"), F.col("file"), extension).alias("text"), "sheet", "fate")
    plain = pieces.where("kind is null or kind <> 'import'").select("pkg_id", "file", "place", _text().alias("text"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("fate"))
    first = settled(plain.unionByName(met))
    files = sheets.where("action = 'file'").select("pkg_id", F.col("home").alias("file"), F.array(F.lit(_LAST)).alias("place"), F.array("sheet").alias("above"), "sheet", F.lit(False).alias("copied"))
    put = F.col("fate").isin(*_PUT)
    copies = files.unionByName(first.where(put).select("pkg_id", "file", "place", F.array("sheet").alias("above"), "sheet", (F.col("fate") == "copy").alias("copied")))
    levels = []
    while True:
        levels.append(settled(_written(copies, contents, extension)))
        inner = levels[-1].select("pkg_id", "file", "place", "above", F.explode(F.filter("parts", lambda x: x["fate"].isin(*_PUT))).alias("x"))
        if inner.isEmpty():
            break
        copies = inner.select("pkg_id", "file", F.concat("place", F.array("x.at")).alias("place"), F.concat("above", F.array("x.sheet")).alias("above"), "x.sheet", (F.col("x.fate") == "copy").alias("copied"))
    discard(contents)
    written = _all(levels)
    chunks = first.select("pkg_id", "file", F.array(F.struct("place", "text")).alias("chunks")).unionByName(written.select("pkg_id", "file", _chunks().alias("chunks")))
    text = F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list("chunks"))), lambda x: x["text"]), "")
    out = chunks.groupBy("pkg_id", "file").agg(text.alias("text"))
    out = out.withColumn("text", F.when(F.col("pkg_id").isNull() | F.col("file").isNull(), "").otherwise(F.col("text")))
    lost = written.select("pkg_id", "file", F.explode("parts").alias("x")).select("pkg_id", "file", "x.sheet", "x.fate").unionByName(first.select("pkg_id", "file", "sheet", "fate"))
    code = F.when(F.col("fate") == "cycle", "import_cycle").otherwise("unresolved_import")
    return out, lost.where("fate in ('missing', 'cycle')").select("pkg_id", code.alias("code"), "file", "sheet").distinct()
