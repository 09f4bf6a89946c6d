"""Verification of recovered packages: manifest, page files, markup quality, gate, score, status.

All are joins, windows and aggregates keyed by pkg_id. Whether a script, style or markup file parses is an input
fact; markup can be checked here (functions/markup.py), scripts and styles need a parser of their own.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarn.functions import markup, paths, scalars

# Patterns of what recovery leaves behind. Markers are comments that name what was left out.
MARKER = r"<!-- [a-z]+-recovery: unresolved {} omitted -->"
COMMENT = r"(?s)<!--.*?-->"
EMPTY_TEXT = r">\s*Empty\s*<"
EMPTY_DOUBLE = r'(?i)\b[a-z][a-z0-9:_-]*\s*=\s*"Empty"'
EMPTY_SINGLE = r"(?i)\b[a-z][a-z0-9:_-]*\s*=\s*'Empty'"
ATTRIBUTE_DOUBLE = r'(?i)\b([a-z][a-z0-9:_-]*)\s*=\s*"([^"]*)"'
ATTRIBUTE_SINGLE = r"(?i)\b([a-z][a-z0-9:_-]*)\s*=\s*'([^']*)'"
PLACEHOLDERS = 3  # fewer of them in a file are taken for real content


def page_issues(pages: DataFrame, files: DataFrame) -> DataFrame:
    """pages(pkg_id, ord, route) with status: duplicate, invalid, unsafe, missing or ok, the first that applies.

    files(pkg_id, path). A page exists if any of its .js, .wxml and .json does: one semi-join-like flag join.
    """
    have = files.where(scalars.extension(F.col("path")).isin("js", "wxml", "json")).select("pkg_id", F.regexp_replace("path", r"\.[^./]*$", "").alias("__base")).distinct().withColumn("__there", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("pkg_id", "route").orderBy("ord"))
    based = pages.withColumn("__nth", nth).withColumn("__base", paths.page_base(F.col("route"))).join(have, ["pkg_id", "__base"], "left")
    status = (
        F.when(F.col("__nth") > 1, "duplicate").when(~scalars.valid_route(F.col("route")), "invalid").when(F.col("__base").isNull(), "unsafe").when(F.col("__there").isNull(), "missing").otherwise("ok")
    )
    return based.withColumn("status", status).drop("__nth", "__base", "__there")


def tabbar_issues(items: DataFrame, pages: DataFrame) -> DataFrame:
    """items(pkg_id, ord, page_path; null for an item that has none) with status: item, path, duplicate, unregistered or ok."""
    known = pages.select("pkg_id", F.col("route").alias("page_path")).distinct().withColumn("__known", F.lit(True))
    valid = F.coalesce(scalars.valid_route(F.col("page_path")), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("pkg_id", "page_path").orderBy("ord"))
    marked = items.withColumn("__nth", nth).join(known, ["pkg_id", "page_path"], "left")
    status = F.when(F.col("page_path").isNull(), "item").when(~valid, "path").when(F.col("__nth") > 1, "duplicate").when(F.col("__known").isNull(), "unregistered").otherwise("ok")
    return marked.withColumn("status", status).drop("__nth", "__known")


def manifest_summary(packages: DataFrame, page_rows: DataFrame, tab_rows: DataFrame) -> DataFrame:
    """(pkg_id, page_count, issues, missing, invalid_tabs, manifest_ok). A package without pages has one issue."""
    bad = lambda *s: F.count_if(F.col("status").isin(*s))
    per_page = page_rows.groupBy("pkg_id").agg(F.count("*").alias("page_count"), bad("duplicate", "invalid", "unsafe", "missing").alias("page_issues"), bad("invalid", "unsafe", "missing").alias("missing"))
    per_tab = tab_rows.groupBy("pkg_id").agg(bad("item", "path", "duplicate", "unregistered").alias("invalid_tabs"))
    out = packages.select("pkg_id").join(per_page, "pkg_id", "left").join(per_tab, "pkg_id", "left").fillna(0, ["page_count", "page_issues", "missing", "invalid_tabs"])
    none = F.col("page_count") == 0
    issues = F.when(none, 1).otherwise(F.col("page_issues") + F.col("invalid_tabs"))
    return out.select("pkg_id", "page_count", issues.cast("long").alias("issues"), "missing", F.when(none, 0).otherwise(F.col("invalid_tabs")).cast("long").alias("invalid_tabs"), (issues == 0).alias("manifest_ok"))


def page_pairs(pages: DataFrame, files: DataFrame) -> DataFrame:
    """pages with has_pair: both .js and .wxml exist (styles and .json aren't needed)."""
    exts = files.select("pkg_id", F.regexp_replace("path", r"\.[^./]*$", "").alias("route"), scalars.extension(F.col("path")).alias("e")).where(F.col("e").isin("js", "wxml"))
    both = exts.groupBy("pkg_id", "route").agg(F.count_distinct("e").alias("n")).where("n = 2").select("pkg_id", "route", F.lit(True).alias("has_pair"))
    return pages.join(both, ["pkg_id", "route"], "left").fillna(False, ["has_pair"])


def attributes(text: Column) -> Column:
    """Name and value of each quoted attribute: double-quoted ones first."""
    both = lambda p: F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("value"))
    return F.concat(both(ATTRIBUTE_DOUBLE), both(ATTRIBUTE_SINGLE))


def markup_counters(text: Column, marker: str = MARKER) -> dict[str, Column]:
    """Counters of a markup file. marker is the pattern of a comment that names what was left out, {} standing for its kind."""
    bare = F.regexp_replace(text, COMMENT, "")
    found = sum((F.regexp_count(bare, F.lit(p)) for p in (EMPTY_TEXT, EMPTY_DOUBLE, EMPTY_SINGLE)), F.lit(0))
    events = F.filter(attributes(text), lambda a: scalars.event_attribute(a["name"]))
    return {
        "placeholders": F.when(found >= PLACEHOLDERS, found).otherwise(0),
        "text_markers": F.regexp_count(text, F.lit(marker.format("text"))),
        "attribute_markers": F.regexp_count(text, F.lit(marker.format("attributes"))),
        "suspicious": F.size(F.filter(events, lambda a: scalars.suspicious_handler(a["value"]))),
        "dynamic": F.size(F.filter(events, lambda a: scalars.dynamic_handler(a["value"]))),
    }


def markup_quality(files: DataFrame, marker: str = MARKER) -> DataFrame:
    """files(pkg_id, path, text) of markup, with counters and has_issue; dynamic bindings are no issue."""
    counted = files.withColumns(markup_counters(F.col("text"), marker))
    return counted.withColumn("has_issue", F.expr("placeholders + text_markers + attribute_markers + suspicious > 0"))


def checked_files(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """files(pkg_id, path, size, text) that a parser is for, with class (js, wxml, wxss), skipped, parses and error.

    Markup is checked here. What a parser says of scripts and styles is given: parsed(pkg_id, path, error), error null for a file
    that parses; a file it says nothing of doesn't. Files above SKIP_BYTES count as parseable without being parsed.
    """
    ext = scalars.extension(F.col("path"))
    kind = F.when(ext.isin("js", "wxs"), "js").when(ext == "wxml", "wxml").when(ext.isin("wxss", "css"), "wxss")
    marked = files.withColumn("class", kind).where("class is not null").withColumn("skipped", F.col("size") > markup.SKIP_BYTES)
    marked = marked.withColumn("__text", F.when((F.col("class") == "wxml") & ~F.col("skipped"), F.col("text")))
    told = markup.with_text_function(marked, "__text", "__error", StringType(), pa.string(), markup.nesting_error)
    said = parsed.select("pkg_id", "path", F.struct("error").alias("__said"))
    joined = told.join(said, ["pkg_id", "path"], "left")
    error = F.when(F.col("skipped"), None).when(F.col("class") == "wxml", F.col("__error")).when(F.col("__said").isNull(), "not parsed").otherwise(F.col("__said.error"))
    return joined.select("pkg_id", "path", "class", "skipped", error.isNull().alias("parses"), error.alias("error"))


def parse_counts(checked: DataFrame) -> DataFrame:
    """Files and those that parse, of each class, by package: the facts that score() takes; skipped is how many weren't parsed."""
    n = [(F.count_if((F.col("class") == c) & ok)).alias(f"{c}_{name}") for c in ("js", "wxml", "wxss") for name, ok in (("files", F.lit(True)), ("ok", F.col("parses")))]
    return checked.groupBy("pkg_id").agg(*n, F.count_if("skipped").alias("skipped"))


def quality_summary(counted: DataFrame, missing_refs: DataFrame) -> DataFrame:
    """Sums by package; files with an issue are counted once, those with missing references included."""
    files = counted.where("has_issue").select("pkg_id", "path").union(missing_refs.select("pkg_id", "path")).groupBy("pkg_id").agg(F.count_distinct("path").alias("issue_files"))
    names = ("placeholders", "text_markers", "attribute_markers", "suspicious", "dynamic")
    sums = counted.groupBy("pkg_id").agg(*(F.sum(n).alias(n) for n in names), *(F.count_if(F.col(n) > 0).alias(f"{n}_files") for n in names))
    return sums.join(files, "pkg_id", "left").fillna(0, ["issue_files"])


def missing_references(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs(pkg_id, path, tag, src) that name no file; dynamic ones and URLs are skipped, ones outside the root are missing."""
    src = F.regexp_extract("src", "^([^?#]*)", 1)
    static = refs.where(~F.col("src").contains("{{") & ~F.col("src").rlike("(?i)^([a-z]+:)?//"))
    full = F.when(src.startswith("/"), F.concat(F.lit("."), src)).otherwise(F.concat_ws("/", F.when(paths.parent(F.col("path")) != "", paths.parent(F.col("path"))), src))
    target = paths.clean(full)
    inferred = F.when(scalars.extension(target) == "", F.concat(target, F.when(F.col("tag") == "wxs", ".wxs").otherwise(".wxml")))
    wanted = static.withColumn("__want", F.array_compact(F.array(target, inferred)))
    names = ("pkg_id", "path", "tag", "src")
    asked = wanted.select(*names, F.explode("__want").alias("__p")).distinct()
    there = asked.join(files.select("pkg_id", F.col("path").alias("__p")), ["pkg_id", "__p"], "left_semi").select(*names).distinct()
    return wanted.join(there, list(names), "left_anti").select(*names)


def gate(total_pages: Column, missing_pairs: Column, parser_ok: Column, issue_files: Column) -> Column:
    return (total_pages > 0) & (missing_pairs == 0) & parser_ok & (issue_files == 0)


def critical(total_pages: Column, *classes: tuple[Column, Column]) -> Column:
    """A file class exists but none of its files parses; only with pages."""
    hit = F.lit(False)
    for n, ok in classes:
        hit = hit | ((n > 0) & (ok == 0))
    return (total_pages > 0) & hit


def score(df: DataFrame) -> DataFrame:
    """Adds manifest, js, wxml, wxss, generated_ratio, penalty and overall to rows of facts.

    Facts: page_count, manifest_issues, missing_pages, invalid_tabs, manifest_ok, total_pages, js_files, js_ok,
    wxml_files, wxml_ok, wxss_files, wxss_ok, issue_files, missing_pairs, gate_ok, fallback_used.
    """
    c, zero = F.col, F.lit(0)
    issues = F.least(F.greatest(c("manifest_issues"), c("missing_pages") + c("invalid_tabs")), c("page_count"))
    manifest = scalars.ratio(c("page_count") - issues, c("page_count"))
    manifest = F.when(~c("manifest_ok") & (issues == 0), F.least(manifest, F.lit(80))).otherwise(manifest)
    pages = c("total_pages") > 0
    wxml_total = F.greatest(c("total_pages"), c("wxml_files"))
    wxml = scalars.ratio(c("wxml_ok"), wxml_total)
    clean = scalars.ratio(F.greatest(c("wxml_files") - c("issue_files"), zero), wxml_total)
    wxml = F.when(c("issue_files") > 0, F.least(wxml, clean)).otherwise(wxml)
    wxss = F.when(c("wxss_files") == 0, 100).otherwise(scalars.ratio(c("wxss_ok"), c("wxss_files")))
    out = df.withColumns({
        "manifest": F.when(c("page_count") == 0, 0).otherwise(manifest),
        "js": F.when(pages, scalars.ratio(c("js_ok"), F.greatest(c("total_pages"), c("js_files")))).otherwise(0),
        "wxml": F.when(pages, wxml).otherwise(0),
        "wxss": F.when(pages, wxss).otherwise(0),
        "generated_ratio": F.when(pages, scalars.ratio(c("missing_pairs"), c("total_pages"))).otherwise(0),
        "penalty": F.when(c("fallback_used"), 10).otherwise(0),
    })
    whole = F.floor(c("manifest") * F.lit(0.3) + c("js") * F.lit(0.2) + c("wxml") * F.lit(0.2) + c("wxss") * F.lit(0.2) + F.when(c("gate_ok"), F.lit(100.0)).otherwise(F.lit(0.0)) * F.lit(0.1)).cast("int")
    overall = F.greatest(whole - c("penalty") - F.floor(c("generated_ratio") / 4).cast("int"), zero)
    return out.withColumn("overall", F.when(c("gate_ok"), overall).otherwise(F.least(overall, F.lit(79))))


def final_status(page_count: Column, is_critical: Column, manifest_ok: Column, partial: Column, issue_files: Column, artifacts_ok: Column) -> Column:
    """failed without pages or with a critical failure; partial if any check failed; else completed."""
    return (
        F.when(F.coalesce(page_count, F.lit(0)) == 0, "failed").when(is_critical, "failed")
        .when(~manifest_ok | partial | (issue_files > 0) | ~F.coalesce(artifacts_ok, F.lit(False)), "partial").otherwise("completed")
    )


def error_code(page_count: Column, is_critical: Column) -> Column:
    return F.when(F.coalesce(page_count, F.lit(0)) == 0, "manifest_incomplete").when(is_critical, "artifact_critical").otherwise("")
