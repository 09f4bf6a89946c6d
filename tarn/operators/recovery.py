"""Bookkeeping of recovery: what each track has, what is missing and why, when the fallback runs, what it counts for.

Inputs are tables keyed by pkg_id: pages with asset paths (manifest.page_assets), files, profiles. Nothing is generated.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import paths, scalars

# Weight from which a split file is deleted, how sources of a renderer are tried, source extensions.
DELETE_FROM = 8
RENDERERS = ("page-frame.html", "page-frame.js", "app-wxss.js")
FALLBACK_KINDS = ("js", "json", "wxml", "wxss", "wxs")
LISTED_EXTENSIONS = ("js", "json", "wxml", "wxss", "wxs")
PLACEHOLDER_EXTENSIONS = ("js", "wxml", "json")

_DIAGNOSTIC = "struct<code:string,severity:string,stage:string,file:string>"


def _warn(code: str, stage: str, file: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit("warn").alias("severity"), F.lit(stage).alias("stage"), file.alias("file"))


def hints(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Per package: is there a runtime script, a template source, a runtime style, an app script and an app style."""
    p = F.col("path")
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    found = files.groupBy("pkg_id").agg(
        any_of(p.isin("app-service.js", "workers.js")).alias("runtime_script"), any_of((scalars.extension(p) == "wxml") | p.isin("page-frame.html", "page-frame.js")).alias("template_source"),
        any_of(p.isin("app.wxss", "app-wxss.js")).alias("runtime_style"), any_of(p == "app.js").alias("app_script"), any_of(p == "app.wxss").alias("app_style"),
        F.count_if(scalars.extension(p) == "js").alias("scripts"),
    )
    flags = ["runtime_script", "template_source", "runtime_style", "app_script", "app_style"]
    return packages.select("pkg_id").join(found, "pkg_id", "left").fillna(False, flags).fillna(0, ["scripts"])


def script_track(pages: DataFrame, hinted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, diagnostics) of scripts: existing ones pass; a page without one is partial, and without runtime evidence failed."""
    missing = pages.where("js_path is null").join(hinted.select("pkg_id", "runtime_script"), "pkg_id")
    route = F.col("route")
    own = missing.select("pkg_id", F.when(F.col("runtime_script"), _warn("recover.js.page.missing_runtime", "recovering_js", F.concat(route, F.lit(".js")))).otherwise(_warn("recover.js.page.missing", "recovering_js", route)).alias("d"))
    app = hinted.where("runtime_script and not app_script").select("pkg_id", _warn("recover.js.app.missing", "recovering_js", F.lit("app.js")).alias("d"))
    lacking = missing.groupBy("pkg_id").agg(F.count("*").alias("n"))
    s = hinted.join(lacking, "pkg_id", "left").fillna(0, ["n"])
    summary = s.select(
        "pkg_id", F.col("scripts").alias("recovered"), ((F.col("n") > 0) | (F.col("runtime_script") & ~F.col("app_script"))).alias("partial"),
        ((F.col("scripts") > 0) & ((F.col("n") == 0) | F.col("runtime_script"))).alias("success"),
    )
    return summary, own.unionByName(app).select("pkg_id", "d.*")


def markup_track(pages: DataFrame, components: DataFrame, files: DataFrame, hinted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, diagnostics) of markup: pages and components that have theirs, and those that lack it."""
    have = files.where(scalars.extension(F.col("path")) == "wxml").select("pkg_id", F.regexp_replace("path", r"\.[^./]*$", "").alias("route"), F.lit(True).alias("there")).distinct()
    want = pages.select("pkg_id", "route", F.lit("page").alias("kind")).unionByName(components.select("pkg_id", F.col("path").alias("route"), F.lit("component").alias("kind")))
    rows = want.join(have, ["pkg_id", "route"], "left").fillna(False, ["there"]).join(hinted.select("pkg_id", "template_source"), "pkg_id")
    lacking, file = rows.where(~F.col("there")), F.concat(F.col("route"), F.lit(".wxml"))
    stage = "recovering_wxml"
    told = (
        F.when((F.col("kind") == "page") & ~F.col("template_source"), _warn("recover.wxml.page.missing", stage, file)).when(F.col("kind") == "page", _warn("recover.wxml.page.missing_runtime", stage, file))
        .when(F.col("template_source"), _warn("recover.wxml.component.missing_runtime", stage, file))
    )
    diagnostics = lacking.select("pkg_id", told.alias("d")).where("d is not null").select("pkg_id", "d.*")
    page, none = F.col("kind") == "page", ~F.col("there")
    sums = rows.groupBy("pkg_id").agg(F.count_if("there").alias("recovered"), F.count_if(none & (page | F.col("template_source"))).alias("gaps"), F.count_if(none & page & ~F.col("template_source")).alias("hopeless"))
    s = hinted.select("pkg_id").join(sums, "pkg_id", "left").fillna(0, ["recovered", "gaps", "hopeless"])
    return s.select("pkg_id", "recovered", (F.col("gaps") > 0).alias("partial"), ((F.col("recovered") > 0) & (F.col("hopeless") == 0)).alias("success")), diagnostics


def style_track(pages: DataFrame, hinted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, diagnostics) of styles: page styles are optional; only a lost app style is a gap."""
    own = pages.where("wxss_path is not null").groupBy("pkg_id").agg(F.count("*").alias("n"))
    lost = F.col("runtime_style") & ~F.col("app_style")
    s = hinted.join(own, "pkg_id", "left").fillna(0, ["n"])
    summary = s.select("pkg_id", (F.col("n") + F.col("app_style").cast("long")).alias("recovered"), lost.alias("partial"), F.lit(True).alias("success"))
    return summary, hinted.where(lost).select("pkg_id", _warn("recover.wxss.app.missing", "recovering_wxss", F.lit("app.wxss")).alias("d")).select("pkg_id", "d.*")


def fallback_plan(tracks: DataFrame, profiles: DataFrame, enabled: bool = True) -> DataFrame:
    """tracks(pkg_id, partial, success), a row for each language, to (pkg_id, needed, action, partial).

    The fallback is needed if any language is partial or failed. A subpackage can't be recovered without its main
    package, so it is left alone and partial; where the fallback is off the package is partial, too.
    """
    any_gap = tracks.groupBy("pkg_id").agg(F.bool_or(F.col("partial") | ~F.col("success")).alias("needed"))
    joined = any_gap.join(profiles.select("pkg_id", "is_subpackage"), "pkg_id")
    action = F.when(~F.col("needed"), "none").when(F.col("is_subpackage"), "guard").when(F.lit(enabled), "run").otherwise("off")
    return joined.withColumn("action", action).select("pkg_id", "needed", "action", F.col("action").isin("guard", "off").alias("partial"))


def fallback_status(reports: DataFrame) -> DataFrame:
    """reports(pkg_id, state: missing, unreadable or read, text) with status and code of the first diagnostic.

    Missing counts as completed with a warning; unreadable, invalid or unknown ones are partial; completed only without diagnostics.
    """
    v = F.try_parse_json("text")
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    said, n = F.try_variant_get(v, "$.status", "string"), F.coalesce(F.size(F.try_variant_get(v, "$.diagnostics", "array<variant>")), F.lit(0))
    n = F.greatest(n, F.lit(0))
    read = F.col("state") == "read"
    status = F.when(F.col("state") == "missing", "completed").when(read & ok & (said == "completed") & (n == 0), "completed").otherwise("partial")
    code = (
        F.when(F.col("state") == "missing", "recover.fallback.status_missing").when(F.col("state") == "unreadable", "recover.fallback.status_unreadable").when(~ok, "recover.fallback.status_invalid")
        .when(~F.coalesce(said, F.lit("")).isin("partial", "completed"), "recover.fallback.status_unknown")
    )
    return reports.select("pkg_id", status.alias("status"), code.alias("code"))


def fallback_outcome(runs: DataFrame, files: DataFrame) -> DataFrame:
    """runs(pkg_id, process_ok, has_dir, status): used, partial. A failed process keeps native results; no source file is partial."""
    source = files.where(F.col("path") != "app.json").groupBy("pkg_id").agg(F.bool_or(scalars.extension(F.col("path")).isin(*FALLBACK_KINDS)).alias("has_source"))
    r = runs.join(source, "pkg_id", "left").fillna(False, ["has_source"])
    used = F.col("process_ok") & F.col("has_dir")
    return r.select("pkg_id", used.alias("used"), (~used | ~F.col("has_source") | (F.col("status") != "completed")).alias("partial"))


def listed_files(files: DataFrame, status_file: str) -> DataFrame:
    """Recovered source files as artifacts below src/, without the status file."""
    ext = scalars.extension(F.col("path"))
    kept = files.where(ext.isin(*LISTED_EXTENSIONS) & (F.col("path") != status_file))
    return kept.select("pkg_id", F.concat(F.lit("src/"), F.col("path")).alias("path"), ext.alias("kind"), F.lit("fallback").alias("source"))


def renderer(files: DataFrame) -> DataFrame:
    """(pkg_id, path): the first renderer source a package has; an empty page-frame.js gives way to the style script."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(RENDERERS):
        rank = F.when(F.col("path") == name, i).otherwise(rank)
    usable = files.withColumn("rank", rank).where("rank is not null and not (path = 'page-frame.js' and coalesce(text, '') = '')")
    return usable.groupBy("pkg_id").agg(F.min_by("path", "rank").alias("path"))


def after_deletions(files: DataFrame, weights: DataFrame) -> DataFrame:
    """Files whose weights, summed over the splits that used them up, stay below DELETE_FROM."""
    gone = weights.groupBy("pkg_id", "path").agg(F.sum("weight").alias("w")).where(F.col("w") >= DELETE_FROM)
    return files.join(gone, ["pkg_id", "path"], "left_anti")


def placeholders(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(pkg_id, path, source): files that a subpackage's pages would need and lack, tagged as generated."""
    wanted = pages.select("pkg_id", F.explode(F.array(*(F.concat("route", F.lit(f".{e}")) for e in PLACEHOLDER_EXTENSIONS))).alias("path"))
    return wanted.join(files.select("pkg_id", "path"), ["pkg_id", "path"], "left_anti").withColumn("source", F.lit("generated"))


def page_configs(pages: DataFrame, files: DataFrame) -> DataFrame:
    """pages(pkg_id, route, config JSON) whose derived configuration is written: none exists, and the path is safe."""
    target = paths.output_path(F.concat("route", F.lit(".json")))
    new = pages.where("config is not null").select("pkg_id", target.alias("path"), F.col("config").alias("text")).where("path is not null")
    return new.join(files.select("pkg_id", "path"), ["pkg_id", "path"], "left_anti")


def marked_components(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """Component files that any page refers to, with how many do: (pkg_id, path, declared_by)."""
    resolved = refs.select("pkg_id", "page", paths.resolve(F.col("page"), F.col("ref")).alias("path")).where("path is not null").distinct()
    return resolved.join(pages.select("pkg_id", F.col("route").alias("page")), ["pkg_id", "page"], "left_semi").groupBy("pkg_id", "path").agg(F.count("*").alias("declared_by"))


def import_counts(edges: DataFrame) -> DataFrame:
    """edges(pkg_id, sheet, imported): how many sheets import each; one imported once is inlined, more often it stays a file."""
    n = edges.distinct().groupBy("pkg_id", "imported").agg(F.count("*").alias("n"))
    return n.withColumn("action", F.when(F.col("n") > 1, "file").otherwise("inline"))
