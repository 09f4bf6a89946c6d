"""Packages made of the driver's tables, taken through verification, and operators that SQL can't express.

A package holds the documents of one source among PACKAGE ids in a row, so that no package grows with the table; a document is
one of its files. Pages are markup.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tarn.functions import markup, scrub
from tarn.operators import acceptance, integrity, manifest, merge, trees
from tarn.plans.catalog import query
from tarn.session import shared_dir, table
from tarn.sources import blobs, container, crypt

PACKAGE = 999  # a multiple of three: documents that share a base name stay in one package
PKG = f"source || '-' || (doc_id // {PACKAGE})"
NAME = "'d' || (doc_id // 3) || case when doc_id % 3 = 0 then '.js' when doc_id % 3 = 1 then '.wxml' else '.json' end"


def _pkg() -> Column:
    return F.concat(F.col("source"), F.lit("-"), F.floor(F.col("doc_id") / PACKAGE).cast("string"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pkg_id, ord, path, text): three documents share a base name, if their source is the same."""
    end = F.when(F.col("doc_id") % 3 == 0, ".js").when(F.col("doc_id") % 3 == 1, ".wxml").otherwise(".json")
    path = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 3).cast("string"), end)
    return table(spark, sf_dir, "documents").select(_pkg().alias("pkg_id"), F.col("doc_id").alias("ord"), path.alias("path"), "text")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pkg_id, ord, route): every document declares a page; every fifth one names no file, every eleventh is invalid."""
    route = F.concat(F.when(F.col("doc_id") % 5 == 4, "x").otherwise("d"), F.floor(F.col("doc_id") / 3).cast("string"), F.when(F.col("doc_id") % 11 == 0, ".html").otherwise(""))
    return table(spark, sf_dir, "documents").select(_pkg().alias("pkg_id"), F.col("doc_id").alias("ord"), route.alias("route"))


FILES = f"f as (select {PKG} as pkg_id, {NAME} as path from documents)"
PAGES = f"p as (select {PKG} as pkg_id, doc_id as ord, case when doc_id % 5 = 4 then 'x' else 'd' end || (doc_id // 3) || case when doc_id % 11 = 0 then '.html' else '' end as route from documents)"
STATUS = """s as (select p.*, case when row_number() over (partition by pkg_id, route order by ord) > 1 then 'duplicate' when ends_with(route, '.html') then 'invalid'
       when not exists (select 1 from f where f.pkg_id = p.pkg_id and f.path in (p.route || '.js', p.route || '.wxml', p.route || '.json')) then 'missing' else 'ok' end as status from p)"""


@query("v1_manifest", f"with {FILES}, {PAGES}, {STATUS} select pkg_id, ord, route, status from s")
def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.page_issues(_pages(spark, sf_dir), _files(spark, sf_dir)).select("pkg_id", "ord", "route", "status")


SUMMARY = """m as (select k.pkg_id, count(s.route) as page_count, case when count(s.route) = 0 then 1 else count(*) filter (s.status <> 'ok') end as issues, count(*) filter (s.status in ('invalid', 'missing')) as missing
       from (select distinct pkg_id from f) k left join s on s.pkg_id = k.pkg_id group by k.pkg_id)"""


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, pages = _files(spark, sf_dir), _pages(spark, sf_dir)
    tabs = spark.createDataFrame([], "pkg_id string, ord int, page_path string, status string")
    return integrity.manifest_summary(files.select("pkg_id").distinct(), integrity.page_issues(pages, files), tabs)


@query("v1_summary", f"with {FILES}, {PAGES}, {STATUS}, {SUMMARY} select pkg_id, page_count, cast(issues as bigint) as issues, missing, issues = 0 as manifest_ok from m")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).select("pkg_id", "page_count", "issues", "missing", "manifest_ok")


@query("jn5_page_pairs", f"""with {FILES}, {PAGES} select pkg_id, ord, route, exists (select 1 from f where f.pkg_id = p.pkg_id and f.path = p.route || '.js') and exists (select 1 from f where f.pkg_id = p.pkg_id and f.path = p.route || '.wxml') as has_pair from p""")
def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.page_pairs(_pages(spark, sf_dir), _files(spark, sf_dir)).select("pkg_id", "ord", "route", "has_pair")


@query("jn1_page_assets", f"""with {FILES}, {PAGES} select p.pkg_id, p.ord, p.route, (select min(path) from f where f.pkg_id = p.pkg_id and f.path = p.route || '.js') as js_path,
       (select min(path) from f where f.pkg_id = p.pkg_id and f.path = p.route || '.wxml') as wxml_path, (select min(path) from f where f.pkg_id = p.pkg_id and f.path = p.route || '.json') as json_path from p""")
def page_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = spark.createDataFrame([], "pkg_id string, page string, chunk string")
    return manifest.page_assets(_pages(spark, sf_dir), _files(spark, sf_dir), chunks).select("pkg_id", "ord", "route", "js_path", "wxml_path", "json_path")


RATIO = "cast(trunc(case when {1} <= 0 then 0 else ({0})::double / ({1})::double * 100 end) as integer)"
FACTS = f"""with {FILES}, {PAGES}, {STATUS}, {SUMMARY},
    l as (select d.source || '-' || (d.doc_id // {PACKAGE}) as pkg_id, count(*) as n, count(*) filter (quality = 1) as good, count(*) filter (toxic = 1) as toxic from documents d left join labels b on b.doc_id = d.doc_id group by 1),
    x as (select m.*, m.issues = 0 as manifest_ok, l.n as files, l.good, l.toxic, m.missing as missing_pairs, m.issues = 0 and l.toxic = 0 as gate_ok, ends_with(split_part(m.pkg_id, '-', 1), '7') as fallback from m join l on l.pkg_id = m.pkg_id),
    r as (select *, least(greatest(issues, missing), page_count) as bad from x),
    c as (select *, {RATIO.format('page_count - bad', 'page_count')} as manifest_raw, {RATIO.format('good', 'greatest(page_count, files)')} as js, {RATIO.format('good', 'greatest(page_count, files)')} as wxml_raw,
          {RATIO.format('files - toxic', 'greatest(page_count, files)')} as clean, {RATIO.format('good', 'files')} as wxss, {RATIO.format('missing_pairs', 'page_count')} as generated_ratio from r),
    k as (select * replace (case when page_count = 0 then 0 else js end as js, case when page_count = 0 then 0 else wxml_raw end as wxml_raw, case when page_count = 0 then 0 else wxss end as wxss) from c),
    o as (select *, case when not manifest_ok and bad = 0 then least(manifest_raw, 80) else manifest_raw end as manifest, case when toxic > 0 then least(wxml_raw, clean) else wxml_raw end as wxml from k),
    z as (select *, greatest(cast(floor(manifest * 0.3::double + js * 0.2::double + wxml * 0.2::double + wxss * 0.2::double + case when gate_ok then 100.0::double else 0.0::double end * 0.1::double) as integer)
          - case when fallback then 10 else 0 end - generated_ratio // 4, 0) as raw from o)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "documents").select("doc_id", _pkg().alias("pkg_id")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    per = labels.groupBy("pkg_id").agg(F.count("*").alias("files"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    m = _summary(spark, sf_dir).join(per, "pkg_id")
    return m.select(
        "pkg_id", "page_count", F.col("issues").alias("manifest_issues"), F.col("missing").alias("missing_pages"), F.lit(0).alias("invalid_tabs"), "manifest_ok", F.col("page_count").alias("total_pages"),
        F.col("files").alias("js_files"), F.col("good").alias("js_ok"), F.col("files").alias("wxml_files"), F.col("good").alias("wxml_ok"), F.col("files").alias("wxss_files"), F.col("good").alias("wxss_ok"),
        F.col("toxic").alias("issue_files"), F.col("missing").alias("missing_pairs"), (F.col("manifest_ok") & (F.col("toxic") == 0)).alias("gate_ok"), F.split_part("pkg_id", F.lit("-"), F.lit(1)).endswith("7").alias("fallback_used"),
    )


@query("v6_score", FACTS + " select pkg_id, manifest, js, wxml, wxss, generated_ratio, cast(case when gate_ok then raw else least(raw, 79) end as integer) as overall from z")
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of each package: labels stand for files that parse and files with issues."""
    return integrity.score(_facts(spark, sf_dir)).select("pkg_id", "manifest", "js", "wxml", "wxss", "generated_ratio", "overall")


@query("v7_status", FACTS + """ select pkg_id, case when page_count = 0 then 'failed' when files > 0 and good = 0 then 'failed' when not manifest_ok or toxic > 0 or not gate_ok then 'partial' else 'completed' end as status,
       case when page_count = 0 then 'manifest_incomplete' when files > 0 and good = 0 then 'artifact_critical' else '' end as error_code from z""")
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir)
    c = F.col
    bad = integrity.critical(c("total_pages"), (c("js_files"), c("js_ok")), (c("wxml_files"), c("wxml_ok")), (c("wxss_files"), c("wxss_ok")))
    return f.select("pkg_id", integrity.final_status(c("page_count"), bad, c("manifest_ok"), F.lit(False), c("issue_files"), c("gate_ok")).alias("status"), integrity.error_code(c("page_count"), bad).alias("error_code"))


def _markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with event attributes and markers added by number, so that each counter has something to count."""
    k = F.col("page_id") % 4
    extra = F.when(k == 0, '<b bindtap="Empty">Empty</b><i a=\'Empty\'>').when(k == 1, '<b bind:tap="{{f}}" catchtap="a b"/>').when(k == 2, "<!-- x-recovery: unresolved text omitted --><b bindtap='ok'/>").otherwise("")
    return table(spark, sf_dir, "pages").select(F.lit("p").alias("pkg_id"), F.col("page_id").cast("string").alias("path"), F.concat("html", extra).alias("text"))


@query("ag5_markup_quality", r"""with t as (select page_id, page_id % 4 as k, regexp_replace(html || case page_id % 4 when 0 then '<b bindtap="Empty">Empty</b><i a=''Empty''>' else '' end, '<!--.*?-->', '', 'gs') as bare from pages)
       select cast(page_id as varchar) as path, cast(case when length(bare) - length(regexp_replace(bare, '>(\s*)Empty(\s*)<', '>\1mpty\2<', 'g')) + len(regexp_extract_all(bare, '(?i)\b[a-z][a-z0-9:_-]*\s*=\s*"Empty"')) + len(regexp_extract_all(bare, '(?i)\b[a-z][a-z0-9:_-]*\s*=\s*''Empty''')) >= 3
              then length(bare) - length(regexp_replace(bare, '>(\s*)Empty(\s*)<', '>\1mpty\2<', 'g')) + len(regexp_extract_all(bare, '(?i)\b[a-z][a-z0-9:_-]*\s*=\s*"Empty"')) + len(regexp_extract_all(bare, '(?i)\b[a-z][a-z0-9:_-]*\s*=\s*''Empty''')) else 0 end as integer) as placeholders,
              case when k = 2 then 1 else 0 end as text_markers, case when k in (0, 1) then 1 else 0 end as suspicious, case when k = 1 then 1 else 0 end as dynamic, k < 3 as has_issue from t""")
def markup_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.markup_quality(_markup(spark, sf_dir)).select("path", "placeholders", "text_markers", "suspicious", "dynamic", "has_issue")


CLASSES = """c as (select d.source || '-' || (d.doc_id // 999) as pkg_id, d.doc_id, case d.doc_id % 3 when 0 then 'js' when 1 then 'wxml' else 'wxss' end as class, d.doc_id % 14 < 2 as skipped,
       case d.doc_id % 3 when 1 then d.doc_id % 2 = 0 else coalesce(l.quality = 1, false) end as fine from documents d left join labels l on l.doc_id = d.doc_id)"""


@query("v2_parse", f"""with {CLASSES} select pkg_id, count(*) filter (class = 'js') as js_files, count(*) filter (class = 'js' and (fine or skipped)) as js_ok, count(*) filter (class = 'wxml') as wxml_files,
       count(*) filter (class = 'wxml' and (fine or skipped)) as wxml_ok, count(*) filter (class = 'wxss') as wxss_files, count(*) filter (class = 'wxss' and (fine or skipped)) as wxss_ok, count(*) filter (skipped) as skipped from c group by pkg_id""")
def parse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scripts, markup and styles: labels stand for what parsers said, unlabelled ones weren't parsed, odd markup isn't nested."""
    k = F.col("doc_id")
    path = F.concat(k.cast("string"), F.when(k % 3 == 0, ".js").when(k % 3 == 1, ".wxml").otherwise(".wxss"))
    d = table(spark, sf_dir, "documents").select(_pkg().alias("pkg_id"), "doc_id", path.alias("path"), F.when(k % 14 < 2, 3 << 20).otherwise(F.octet_length("text")).alias("size"), F.when(k % 2 == 0, "<a></a>").otherwise("<a>").alias("text"))
    said = d.join(table(spark, sf_dir, "labels"), "doc_id").select("pkg_id", "path", F.when(F.col("quality") != 1, "unexpected token").alias("error"))
    return integrity.parse_counts(integrity.checked_files(d, said))


@query("jn6_markup_refs", """with r as (select page_id, 'import' as tag, './' || ((page_id + 1) % 400) || '.wxml' as src, 'p/' || ((page_id + 1) % 400) || '.wxml' as target from pages
       union all select page_id, 'include', '/p/' || (page_id * 2), 'p/' || (page_id * 2) || '.wxml' from pages)
       select 'p' as pkg_id, 'p/' || page_id || '.wxml' as path, tag, src from r where target not in (select 'p/' || page_id || '.wxml' from pages)""")
def markup_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of markup files that name no file; the tags are scanned in Arrow batches, the rest is joins."""
    k = F.col("page_id")
    text = F.concat(F.lit('<import src="./'), ((k + 1) % 400).cast("string"), F.lit('.wxml"/><include src="/p/'), (k * 2).cast("string"), F.lit('"/><wxs src="{{x}}"/>'))
    rows = table(spark, sf_dir, "pages").select(F.lit("p").alias("pkg_id"), F.concat(F.lit("p/"), k.cast("string"), F.lit(".wxml")).alias("path"), text.alias("text"))
    kind = ArrayType(StructType([StructField("tag", StringType()), StructField("src", StringType())]))
    found = markup.with_text_function(rows, "text", "refs", kind, pa.list_(pa.struct([("tag", pa.string()), ("src", pa.string())])), markup.references)
    refs = found.select("pkg_id", "path", F.explode("refs").alias("r")).select("pkg_id", "path", "r.*")
    return integrity.missing_references(refs, rows)


@query("v3_nesting")
def nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each page's tags aren't nested, or null."""
    return markup.with_text_function(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "error", StringType(), pa.string(), markup.nesting_error).select("page_id", "error")


@query("f2_format")
def format_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags formatted, text untouched; whether that changed the page."""
    done = markup.with_text_function(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "formatted", StringType(), pa.string(), markup.format_tags)
    return done.select("page_id", F.when(F.col("html") == F.col("formatted"), "unchanged").otherwise("formatted").alias("status"), F.md5("formatted").alias("digest"))


@query("sc12_scrub", "select page_id, 'at src/a' || page_id || '.js from ' || url || case when page_id % 2 = 0 then ' x.txt' else ' y.js' end as public from pages")
def scrub_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without host paths."""
    k = F.col("page_id")
    message = F.concat(F.lit("at /srv/tasks/"), k.cast("string"), F.lit("/result/src/a"), k.cast("string"), F.lit(".js from "), F.col("url"), F.when(k % 2 == 0, " file:///root/x.txt").otherwise(r" C:\work\y.js"))
    rows = table(spark, sf_dir, "pages").select("page_id", message.alias("message"))
    return markup.with_text_function(rows, "message", "public", StringType(), pa.string(), scrub.text).select("page_id", "public")


@query("sc13_scrub_json", """select page_id, '{"files":["home/a.js","c.js"],"metrics":{"pageCount":' || page_id || '},"path":"' || regexp_extract(url, '([^/]*)/*$', 1) || '"}' as public from pages""")
def scrub_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.to_json(F.struct(F.struct(F.col("page_id").alias("pageCount"), F.lit("/tmp/x").alias("zipPath")).alias("metrics"), F.array(F.lit("home/a.js"), F.lit("/home/b/c.js")).alias("files"), F.concat(F.lit("/opt/"), "url").alias("path")))
    rows = table(spark, sf_dir, "pages").select("page_id", doc.alias("doc"))
    return markup.with_text_function(rows, "doc", "public", StringType(), pa.string(), scrub.json_text).select("page_id", "public")


@query("sc13_trees", """select page_id as doc_id, '{"a":[{"files":["home/a' || page_id || '.js","c.js"],"n":' || page_id || '}],"b":{"c":{"d":["at src/a' || page_id || '.js from ' || url || '",[' || page_id || ',null]]},"metrics":{"pageCount":' || page_id || case when page_id % 2 = 0 then ',"used":true' else '' end || '}},"e":"' || regexp_extract(url, '([^/]*)/*$', 1) || '"}' as text from pages""")
def published_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents nested at several levels, cut into rows, changed by column rules and put together again."""
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    files = F.struct(F.array(F.concat(F.lit("home/a"), n, F.lit(".js")), F.lit("/home/b/c.js")).alias("files"), k.alias("n"))
    said = F.concat(F.lit("at /srv/tasks/"), n, F.lit("/result/src/a"), n, F.lit(".js from "), F.col("url"))
    metrics = F.struct(k.alias("pageCount"), F.lit("/tmp/x").alias("zipPath"), F.when(k % 2 == 0, F.lit("true")).otherwise(F.lit('"no"')).alias("used"))
    inner = F.concat(F.lit('{"c":{"d":['), trees.json_string(said), F.lit(",["), n, F.lit(',null]]},"metrics":'), F.regexp_replace(F.to_json(metrics), r'"used":"(.*)"\}$', '"used":$1}'), F.lit("}"))
    inner = F.replace(inner, F.lit('\\"no\\"'), F.lit('"no"'))
    whole = F.concat(F.lit('{"e":'), trees.json_string(F.concat(F.lit("/opt/"), "url")), F.lit(',"metrics":{"odd":1},"b":'), inner, F.lit(',"a":['), F.to_json(files), F.lit("]}"))
    return trees.published(table(spark, sf_dir, "pages").select(k.alias("doc_id"), whole.alias("text")))


@query("ag11_common_dir", f"""with p as (select regexp_extract(url, '://([^/]*)', 1) as host, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') as path from pages), g as (select host, min(path) as a, max(path) as b from p group by host)
       select host, case when a = b then regexp_replace(a, '/[^/]*$', '') when split_part(a, '/', 2) = split_part(b, '/', 2) then '/' || split_part(a, '/', 2) else '' end as folder from g""")
def common_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest common folder of each host's paths."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    return merge.common_folder(table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("host"), path.alias("path")), "host", "path")


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of each source's documents, PACKAGE ids at a time."""
    return container.encode_table(_files(spark, sf_dir).withColumn("content", F.col("text").cast("binary")))


FILE_TABLE = f"select {PKG} as pkg_id, {NAME} as path, cast(strlen(text) as bigint) as size, sha256(text) as sha256 from documents"


@query("src3_scan", FILE_TABLE)
def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages encoded, their indexes scanned, files cut out: what went in comes out."""
    packs = _packages(spark, sf_dir)
    return container.files(container.extract(packs, container.scan(packs, strict=True))).select("pkg_id", "path", "size", "sha256")


@query("cls6_profile", f"select {PKG} as pkg_id, false as is_encrypted, true as is_standard, count(*) as index_file_count, 'standard' as variant from documents group by 1")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = _packages(spark, sf_dir)
    return container.profile(packs, container.extract(packs, container.scan(packs))).select("pkg_id", "is_encrypted", "is_standard", "index_file_count", "variant")


@query("cls5_decrypt", f"select {PKG} as pkg_id, true as same from documents group by 1")
def decrypt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages enciphered with Spark's AES, deciphered again with the key id."""
    import hashlib

    key_id = "wx0123456789abcdef"
    key = hashlib.pbkdf2_hmac("sha1", key_id.encode(), crypt.SALT, crypt.ROUNDS, crypt.KEY_BYTES)
    packs = _packages(spark, sf_dir)
    head = F.aes_encrypt(F.substring("content", 1, crypt.KEPT), F.lit(key), F.lit("CBC"), F.lit("PKCS"), F.lit(crypt.VECTOR))

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = [(np.frombuffer(c, np.uint8) ^ np.uint8(ord(key_id[-2]))).tobytes() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tails, pa.binary())], ["pkg_id", "head", "tail"])

    parts = packs.select("pkg_id", F.expr(f"substring(content, {crypt.KEPT + 1})").alias("rest"), F.expr("cast(null as binary)").alias("x"), head.alias("e"))
    parts = parts.select("pkg_id", "rest", F.expr("substring(e, 17)").alias("head")).mapInArrow(mask, "pkg_id string, head binary, tail binary")
    sealed = parts.select("pkg_id", F.concat(F.lit(container.MARKER), "head", "tail").alias("content"), F.lit(key_id).alias("key_id"))
    opened = crypt.decrypted(sealed).select("pkg_id", F.sha2("content", 256).alias("a"))
    return opened.join(packs.select("pkg_id", F.sha2("content", 256).alias("b")), "pkg_id").select("pkg_id", (F.col("a") == F.col("b")).alias("same"))


@query("m1_manifest", f"""select {PKG} as pkg_id, cast(row_number() over (partition by {PKG} order by doc_id) - 1 as integer) as ord, 'd' || doc_id as route, case when source = 'src7' then 'app-config.json' else 'app.json' end as src, 'authoritative' as confidence from documents""")
def manifest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages out of each package's application document, routes normalised."""
    d = table(spark, sf_dir, "documents").groupBy(_pkg().alias("pkg_id"), "source").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    pages = F.transform("ids", lambda i: F.concat(F.lit("/d"), i.cast("string"), F.lit(".html")))
    docs = d.select("pkg_id", F.lit(0).alias("ord"), F.when(F.col("source") == "src7", "app-config.json").otherwise("app.json").alias("path"), F.to_json(F.struct(pages.alias("pages"))).alias("text"))
    return manifest.pages(docs).select("pkg_id", "ord", "route", F.col("source").alias("src"), "confidence")


_SHARED = "select {pkg} as pkg_id, cast(row_number() over (partition by {pkg} order by {name}) - 1 as integer) as ord, {prefix}{name} as path, octet_length(encode(coalesce(text, ''))) as size, sha256(coalesce(text, '')) as sha256 from documents"


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("pkg_id", "path", F.coalesce("text", F.lit("")).cast("binary").alias("content"))


@query("src2_package_files", f"select pkg_id, ord, path, cast(size as bigint) as size, sha256 from ({_SHARED.format(pkg=PKG, name=NAME, prefix='')}) where starts_with(path, 'd1')")
def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages written as files and read by ranges; the prefix is the source's, so other contents aren't read."""
    path = f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}"
    blobs.write_packages(container.encode_table(_contents(spark, sf_dir)), path)
    entries = blobs.read_packages(spark, path, prefix="d1")
    return entries.select("pkg_id", "ord", "path", "size", F.sha2("content", 256).alias("sha256"))


@query("snk3_archives", f"select pkg_id, ord, path, cast(size as bigint) as size, sha256 from ({_SHARED.format(pkg=PKG, name=NAME, prefix=chr(39) + 'src/' + chr(39) + ' || ')})")
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ZIP for each package, streamed to files, and its entries read from directories and ranges."""
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    blobs.write_archives(_contents(spark, sf_dir), path)
    return blobs.read_archives(spark, path).select("pkg_id", "ord", "path", "size", F.sha2("content", 256).alias("sha256"))


@query("v10_acceptance", """select o_orderkey as task_id, 'recovery-report' as name, array_to_string(list_filter([case when o_orderkey % 5 = 0 then 'host path' end, case when o_orderkey % 7 = 0 then 'status' end,
       case when o_orderkey % 3 = 0 then 'verifier' end, case when o_orderkey % 11 = 0 then 'manifest' end, case when o_custkey % 4 <> 2 then 'files' end, case when o_custkey % 4 <> 3 then 'sources' end,
       case when o_orderkey % 7 <> 1 and o_custkey % 2 = 0 then 'archive' end], lambda x: x is not null), ',') as broken from orders""")
def acceptance_of_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each order, each broken in other ways."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(k % 7 == 0, "odd").when(k % 7 == 1, "failed").otherwise("completed")
    score = F.struct((k % 3 != 0).alias("verifierPassed"), F.when(k % 11 == 0, 99).otherwise(100).alias("manifest"))
    artifacts = F.struct((c % 4).alias("fileCount"), F.array(F.lit("a"), F.lit("b")).alias("files"), F.create_map(F.lit("native"), F.lit(2), F.lit("fallback"), F.lit(1)).alias("sourceBreakdown"))
    note = F.when(k % 5 == 0, F.concat(F.lit("in /home/"), F.col("o_orderstatus"), F.lit("/x"))).otherwise("https://host/home/x/y")
    whole = F.struct(status.alias("status"), score.alias("score"), artifacts.alias("artifacts"), F.struct((c % 2 == 1).alias("downloadReady"), F.lit(5).alias("archiveSize")).alias("packaging"), note.alias("note"))
    told = acceptance.broken(table(spark, sf_dir, "orders").select(k.alias("task_id"), F.lit(acceptance.MAIN).alias("name"), F.to_json(whole).alias("text")))
    return told.select("task_id", "name", F.array_join("broken", ",").alias("broken"))
