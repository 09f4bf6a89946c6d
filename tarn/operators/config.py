"""Package configurations as rows: pages of the main package and its subpackages, games, icons, script modules."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import paths, scalars
from tarn.operators.expressions import typed
from tarn.operators.merge import first_wins
from tarn.session import settled

#: A package is what the first of these names in its root says; one with none is a subpackage.
ROUTES = (("app-service.js", "app"), ("game.js", "game"))


def package_route(files: DataFrame) -> DataFrame:
    """(pkg_id, route): app, game or subpackage, by the presence of files in the package's root."""
    route = F.lit("subpackage")
    for name, kind in reversed(ROUTES):
        route = F.when(F.bool_or(F.col("path") == name), kind).otherwise(route)
    return files.groupBy("pkg_id").agg(route.alias("route"))


def _items(value: Column) -> Column:
    """Elements of a JSON array; none for anything else."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def _text(value: Column, field: str = "$") -> Column:
    """A JSON string; null for any other value."""
    found = F.try_variant_get(value, field, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def _bare(path: Column) -> Column:
    return paths.change_extension(path, "")


def package_pages(configs: DataFrame) -> DataFrame:
    """configs(pkg_id, text JSON) to (pkg_id, root, ord, page): pages by package and order, the entry page first.

    root is null for the main package, else a subpackage's root, with a slash at its end. Unsafe paths are left out, extensions
    cut, and of equal pages the first stays. Pages of a subpackage lie below its root, which they may leave out, and are no
    pages of the main package; an entry page is one even where the list lacks it. A configuration that isn't an object has no pages.
    """
    v = configs.select("pkg_id", F.try_parse_json("text").alias("v"))
    field = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    entry = v.select("pkg_id", F.lit(-1).alias("ord"), _bare(paths.fallback_path(_text(F.col("v"), "$.entryPagePath"))).alias("page"))
    listed = v.select("pkg_id", F.posexplode(_items(field("pages"))).alias("ord", "x")).select("pkg_id", "ord", _bare(paths.fallback_path(_text(F.col("x")))).alias("page"))
    main = first_wins(entry.union(listed).where("page <> ''"), ["pkg_id", "page"], ["ord"])

    subs = v.select("pkg_id", F.posexplode(_items(field("subPackages"))).alias("sub", "x"))
    subs = subs.select("pkg_id", "sub", paths.fallback_path(_text(F.col("x"), "$.root")).alias("root"), F.posexplode(_items(F.try_variant_get("x", "$.pages", "variant"))).alias("ord", "p")).where("root is not null")
    prefix = F.concat(F.col("root"), F.lit("/"))
    raw = F.regexp_replace(F.replace(_text(F.col("p")), F.lit("\\"), F.lit("/")), "^/+", "")
    whole = paths.fallback_path(F.when((raw == F.col("root")) | raw.startswith(prefix), raw).otherwise(F.concat(prefix, raw)))
    below = subs.select("pkg_id", "sub", prefix.alias("root"), "ord", whole.alias("whole")).where("whole is not null and startswith(whole, root)")
    below = below.select("pkg_id", "sub", "root", "ord", _bare(F.col("whole")).alias("whole")).where("length(whole) > length(root)")
    kept = main.join(below.select("pkg_id", F.col("whole").alias("page")), ["pkg_id", "page"], "left_anti")
    own = first_wins(below, ["pkg_id", "sub", "whole"], ["ord"]).withColumn("page", F.expr("substring(whole, length(root) + 1)"))
    place = lambda df, *by: df.withColumn("ord", F.row_number().over(Window.partitionBy("pkg_id", *by).orderBy("ord")) - 1)
    columns = ["pkg_id", "root", "ord", "page"]
    return place(kept).withColumn("root", F.lit(None).cast("string")).select(columns).union(place(own, "sub").select(columns))


def game_files(files: DataFrame) -> DataFrame:
    """files(pkg_id, path, text): app-config.json of a game becomes game.json, without subContext; other files stay.

    A configuration that isn't an object stays as it is.
    """
    routes = package_route(files).where("route = 'game'").select("pkg_id", F.lit(True).alias("__game"))
    fields = F.from_json(F.when(F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT"), F.col("text")), "map<string,variant>")
    rewritten = F.to_json(F.map_filter(fields, lambda k, _: k != "subContext"))
    ours = F.coalesce("__game", F.lit(False)) & (F.col("path") == "app-config.json") & rewritten.isNotNull()
    marked = files.join(routes, "pkg_id", "left")
    return marked.withColumn("__text", F.when(ours, rewritten)).select("pkg_id", F.when(F.col("__text").isNotNull(), "game.json").otherwise(F.col("path")).alias("path"), F.coalesce("__text", "text").alias("text"))


def icon_matches(icons: DataFrame, files: DataFrame) -> DataFrame:
    """icons(pkg_id, item, icon) with icon_path: the first file by path whose bytes are the icon's, written inline in base64.

    Contents meet by MD5, which is computed on both sides before the join. An icon that isn't base64, or that no file equals, has
    a null path. files are (pkg_id, path, content).
    """
    digest = F.md5(F.try_to_binary(F.regexp_replace("icon", "^data:[^,]*,", ""), F.lit("base64")))
    known = files.groupBy("pkg_id", F.md5("content").alias("__md5")).agg(F.min("path").alias("icon_path"))
    return icons.withColumn("__md5", digest).join(known, ["pkg_id", "__md5"], "left").drop("__md5")


def module_tags(refs: DataFrame, inline: DataFrame, outputs: DataFrame) -> DataFrame:
    """refs(pkg_id, page, module, ref) with how the page includes each module: (pkg_id, page, module, kind, target).

    In this order: inline, where ref has a colon and its source is among inline(pkg_id, ref, source); a link to where the module was
    written, outputs(pkg_id, ref, path); a link to the path that ref names, seen from the page. Paths that escape the package are
    left out. target is the source, or the path relative to the page; module names are escaped for an attribute.
    """
    known = refs.join(inline.select("pkg_id", "ref", "source"), ["pkg_id", "ref"], "left").join(outputs.select("pkg_id", "ref", F.col("path").alias("written")), ["pkg_id", "ref"], "left")
    named = paths.resolve(F.col("page"), F.regexp_replace("ref", r"^\./", ""))
    inside = F.col("ref").contains(":") & F.col("source").isNotNull()
    kind = F.when(inside, "inline").when(F.col("written").isNotNull(), "written").when(named.isNotNull(), "named")
    link = F.when(F.col("kind") == "written", F.col("written")).otherwise(named)
    target = F.when(F.col("kind") == "inline", F.col("source")).otherwise(paths.relative(F.col("page"), link))
    told = known.withColumn("kind", kind).where("kind is not null")
    return told.select("pkg_id", "page", scalars.attribute_escape(F.col("module")).alias("module"), "kind", target.alias("target"))


def _members(raw: Column) -> Column:
    """Members of a JSON object in the order of its text: (key, raw, kind) as typed() has them; null for any other value."""
    texts, values = F.from_json(raw, "map<string,string>"), F.from_json(raw, "map<string,variant>")
    found = F.transform(F.arrays_zip(F.map_keys(texts).alias("k"), F.map_values(texts).alias("t"), F.map_values(values).alias("v")), lambda x: F.struct(x["k"].alias("key"), typed(x["t"], x["v"]).alias("value")))
    return F.when(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), found)


def _member(raw: Column, key: str, kind: str) -> Column:
    """A member of a JSON object that has the given kind."""
    return F.try_element_at(F.filter(_members(raw), lambda m: (m["key"] == key) & (m["value"]["kind"] == kind)), F.lit(-1))["value"]["raw"]


def _json(text: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def _as_component(window: Column) -> Column:
    """A window with component set to true, at its place if it has one, else at the end."""
    members = F.transform(_members(window), lambda m: F.concat(_json(m["key"]), F.lit(":"), F.when(m["key"] == "component", "true").when(m["value"]["kind"] == "s", _json(m["value"]["raw"])).otherwise(m["value"]["raw"])))
    own = F.exists(_members(window), lambda m: m["key"] == "component")
    return F.concat(F.lit("{"), F.array_join(F.when(own, members).otherwise(F.concat(members, F.array(F.lit('"component":true')))), ","), F.lit("}"))


def page_configurations(configs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """configs(pkg_id, text JSON) to page configurations, what they use, and what was left out.

    1. (pkg_id, page, window, component): a row for each safe path under the field page and for each component that a window names
       under usingComponents; window is its JSON ({} where there is none), with component set to true if any page uses it.
    2. (pkg_id, page, component): uses, a component's path seen from its page, its extension .html.
    3. (pkg_id, code, page, value): page_config_unsafe, component_path_unsafe.

    Of equal paths the last counts. A configuration or a member that isn't an object is empty; components that aren't strings are ignored.
    """
    raw = configs.select("pkg_id", F.posexplode(_members(_member(F.col("text"), "page", "o"))).alias("ord", "m")).select("pkg_id", "ord", F.col("m.key").alias("name"), F.when(F.col("m.value.kind") == "o", F.col("m.value.raw")).otherwise("{}").alias("config"))
    named = raw.withColumn("page", paths.fallback_path(F.col("name")))
    last = named.where("page is not null").groupBy("pkg_id", "page").agg(F.max_by("config", "ord").alias("config"))
    own = settled(last.select("pkg_id", "page", F.coalesce(_member(F.col("config"), "window", "o"), F.lit("{}")).alias("window")))
    used = own.select("pkg_id", "page", F.explode(_members(_member(F.col("window"), "usingComponents", "o"))).alias("m")).where("m.value.kind = 's'")
    target = paths.change_extension(F.replace(F.col("m.value.raw"), F.lit("\\"), F.lit("/")), ".html")
    joined = F.when(target.startswith("/"), F.regexp_replace(target, "^/+", "")).otherwise(paths.clean(F.concat_ws("/", F.when(paths.parent(F.col("page")) != "", paths.parent(F.col("page"))), target)))
    met = settled(used.select("pkg_id", "page", F.col("m.value.raw").alias("value"), paths.fallback_path(joined).alias("component")))
    uses = met.where("component is not null").select("pkg_id", "page", "component").distinct()
    components = uses.select("pkg_id", F.col("component").alias("page"), F.lit(True).alias("component")).distinct()
    rows = own.join(components, ["pkg_id", "page"], "full").withColumn("window", F.coalesce("window", F.lit("{}"))).withColumn("component", F.coalesce("component", F.lit(False)))
    rows = rows.select("pkg_id", "page", F.when(F.col("component"), _as_component(F.col("window"))).otherwise(F.col("window")).alias("window"), "component")
    told = named.where("page is null").selectExpr("pkg_id", "'page_config_unsafe' as code", "cast(null as string) as page", "name as value")
    return rows, uses, told.unionByName(met.where("component is null").selectExpr("pkg_id", "'component_path_unsafe' as code", "page", "value")).distinct()


def component_closure(pages: DataFrame, uses: DataFrame) -> DataFrame:
    """(pkg_id, path, depth): what the pages(pkg_id, page) need, themselves at depth 0, then components of components to a fixed point.

    Breadth first: each round joins the paths found last with uses(pkg_id, page, component) and keeps those that are new, so components that
    use each other end the walk. Rows are one for each path that is needed.
    """
    uses = settled(uses.select("pkg_id", "page", "component").distinct())
    last = settled(pages.select("pkg_id", F.col("page").alias("path"), F.lit(0).alias("depth")).distinct())
    known, depth = last, 0
    while not last.isEmpty():
        depth += 1
        found = last.join(uses, (last["pkg_id"] == uses["pkg_id"]) & (last["path"] == uses["page"])).select(last["pkg_id"], F.col("component").alias("path")).distinct()
        last = settled(found.join(known.select("pkg_id", "path"), ["pkg_id", "path"], "left_anti").withColumn("depth", F.lit(depth)))
        known = known.unionByName(last)
    return known
