"""Classification, projection and text rules over documents and pages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import paths, scalars
from tarn.operators import diagnostics, tasks
from tarn.plans.catalog import query
from tarn.session import table
from tarn.sources.container import flags_to_variant

SOURCES = ", ".join(f"'{s}'" for s in ("src0", "src1", "src2", "src3", "src4", "src5"))
PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '')"


def _path() -> F.Column:
    return F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")


@query("ag1_source_breakdown", f"select case when source in ({SOURCES}) then source else 'other' end as public_source, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by 1")
def source_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source; those outside the allowed list are folded into "other" with their sums."""
    d = table(spark, sf_dir, "documents")
    public = F.when(F.col("source").isin("src0", "src1", "src2", "src3", "src4", "src5"), F.col("source")).otherwise("other")
    return d.groupBy(public.alias("public_source")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "cls7_variant",
    """with f as (select lower(regexp_extract(url, '://([^/]*)', 1)) as host, bool_or(contains(html, '<table')) as game, bool_or(contains(url, 'page=')) as sub,
              bool_or(contains(html, '<script')) as like4, bool_or(starts_with(url, 'https')) as std, bool_or(contains(url, '#top')) as enc from pages group by 1)
       select host, case when game then 'game' when sub then 'subpackage' when like4 then 'wechat4x' when std then 'standard' when enc then 'encrypted' else 'unknown' end as variant from f""",
)
def variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each host's pages by conditional aggregates, then the variant by precedence."""
    html, url = F.col("html"), F.col("url")
    f = table(spark, sf_dir, "pages").groupBy(F.lower(F.regexp_extract("url", "://([^/]*)", 1)).alias("host")).agg(
        F.bool_or(html.contains("<table")).alias("game"), F.bool_or(url.contains("page=")).alias("sub"), F.bool_or(html.contains("<script")).alias("like4"),
        F.bool_or(url.startswith("https")).alias("std"), F.bool_or(url.contains("#top")).alias("enc"),
    )
    return f.select("host", flags_to_variant(game=F.col("game"), subpackage=F.col("sub"), like_4x=F.col("like4"), standard=F.col("std"), encrypted=F.col("enc")).alias("variant"))


@query(
    "cls8_kinds",
    f"""with p as (select {PATH} || case page_id % 7 when 0 then '.js' when 1 then '.wxs' when 2 then '.WXSS' when 3 then '.css' when 4 then '.wxml' when 5 then '.html' else '.json' end as path from pages),
            e as (select path, lower(regexp_extract(path, '\\.([^./]*)$', 1)) as ext from p)
       select ext, case when ext in ('js', 'wxs') then 'script' when ext in ('wxss', 'css') then 'style' when ext in ('wxml', 'html') then 'template' else 'asset' end as kind,
              case when ext = 'wxml' then 'page' else 'file' end as template_kind, case when ends_with(path, '.wxs') then 'wxs' else 'page' end as script_kind,
              ext in ('js', 'json', 'wxml', 'wxss', 'wxs', 'html', 'css') as is_text, count(*) as n from e group by all""",
)
def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File kinds by extension."""
    exts = F.element_at(F.array(*(F.lit(x) for x in (".js", ".wxs", ".WXSS", ".css", ".wxml", ".html", ".json"))), (F.col("page_id") % 7 + 1).cast("int"))
    p = table(spark, sf_dir, "pages").select(F.concat(_path(), exts).alias("path"))
    path = F.col("path")
    return p.groupBy(
        scalars.extension(path).alias("ext"), scalars.file_kind(path).alias("kind"), scalars.template_kind(path).alias("template_kind"), scalars.script_kind(path).alias("script_kind"), scalars.is_text_artifact(path).alias("is_text")
    ).agg(F.count("*").alias("n"))


@query(
    "cls12_text_predicates",
    r"""select doc_id, strlen(split_part(text, chr(0), 1)) >= least(512, strlen(text)) as likely, strlen(regexp_extract(text, '^[^\x00-\x08\x0B\x0C\x0E-\x1F]*')) >= least(512, strlen(text)) as head_clean,
               not regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') as clean, not regexp_matches(left(text, 512), '[#*$%&|<>!]') as no_symbols from documents""",
)
def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", scalars.likely_text(t).alias("likely"), scalars.no_control_in_head(t).alias("head_clean"), scalars.no_control_anywhere(t).alias("clean"), (~F.left(t, F.lit(512)).rlike("[#*$%&|<>!]")).alias("no_symbols")
    )


@query(
    "prj5_routes",
    f"""with r as (select page_id, {PATH} || case when page_id % 3 = 0 then '.html' when page_id % 3 = 1 then '.js.WXML' else '' end as raw from pages),
            n as (select page_id, regexp_replace(regexp_replace(trim(replace(raw, '\\', '/')), '^/+', ''), '\\.(html|wxml|js)$', '', 'i') as route from r)
       select page_id, route, route <> '' and not regexp_matches(route, '(^|/)(\\.\\.?)?(/|$)|[\\\\?#]|^\\s|\\s$') and lower(regexp_extract(route, '\\.([^./]*)$', 1)) not in ('html', 'js', 'json', 'wxml', 'wxss', 'wxs') as valid from n""",
)
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(_path(), F.when(F.col("page_id") % 3 == 0, ".html").when(F.col("page_id") % 3 == 1, ".js.WXML").otherwise(""))
    n = table(spark, sf_dir, "pages").select("page_id", scalars.normal_route(raw).alias("route"))
    return n.withColumn("valid", scalars.valid_route(F.col("route")))


@query(
    "prj2_zip_paths",
    f"""with p as (select page_id, case page_id % 5 when 0 then {PATH} when 1 then ltrim({PATH}, '/') when 2 then 'a/../' || ltrim({PATH}, '/') when 3 then 'c:' || {PATH} else ltrim({PATH}, '/') || '/x' end as path from pages)
        select page_id, path, path <> '' and not regexp_matches(path, '[\\\\:]') and not starts_with(path, '/') and not regexp_matches(path, '(^|/)(\\.|\\.\\.)?(/|$)') as ok from p""",
)
def zip_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which archive entries are safe."""
    bare = F.ltrim(_path(), F.lit("/"))
    k = F.col("page_id") % 5
    path = F.when(k == 0, _path()).when(k == 1, bare).when(k == 2, F.concat(F.lit("a/../"), bare)).when(k == 3, F.concat(F.lit("c:"), _path())).otherwise(F.concat(bare, F.lit("/x")))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("ok", paths.zip_entry_ok(F.col("path")))


@query(
    "prj9_resolve",
    f"""select page_id, case when page_id % 3 = 0 then null when page_id % 3 = 1 then 'shared/card' else regexp_replace(ltrim({PATH}, '/'), '/?[^/]*$', '') || case when contains(ltrim({PATH}, '/'), '/') then '/' else '' end || 'card' end as path from pages""",
)
def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component references as seen from a page: URLs drop out, rooted and relative ones resolve."""
    ref = F.when(F.col("page_id") % 3 == 0, "https://x/card").when(F.col("page_id") % 3 == 1, "/shared/./card").otherwise("./x/../card")
    return table(spark, sf_dir, "pages").select("page_id", paths.resolve(F.ltrim(_path(), F.lit("/")), ref).alias("path"))


@query("prj11_guides", f"select count(*) as n, count(*) filter (not ends_with(lower({PATH}), '/5')) as kept from pages")
def guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files left when guide pages are dropped by suffix."""
    p = table(spark, sf_dir, "pages").select(_path().alias("p"))
    return p.agg(F.count("*").alias("n"), F.count_if(~F.lower("p").endswith("/5")).alias("kept"))


@query(
    "prj12_handlers",
    """with t as (select event_id, case event_type when 'click' then 'bindtap' when 'view' then 'bind:' || event_type when 'purchase' then 'binding' when 'error' then 'catchError' else 'capture-bind:' end as name,
              case event_id % 6 when 0 then 'onTap' when 1 then 'card active' when 2 then '' when 3 then '{{h}}' when 4 then ' a.b ' else 'Empty' end as value from events)
       select name, value, name in ('bindtap', 'bind:view', 'catchError') as is_event, starts_with(trim(value), '{{') as is_dynamic, value in ('card active', '', 'Empty') as suspicious, count(*) as n from t group by all""",
)
def handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event attributes and their handlers."""
    t, k = F.col("event_type"), F.col("event_id") % 6
    name = F.when(t == "click", "bindtap").when(t == "view", F.concat(F.lit("bind:"), t)).when(t == "purchase", "binding").when(t == "error", "catchError").otherwise("capture-bind:")
    value = F.when(k == 0, "onTap").when(k == 1, "card active").when(k == 2, "").when(k == 3, "{{h}}").when(k == 4, " a.b ").otherwise("Empty")
    rows = table(spark, sf_dir, "events").select(name.alias("name"), value.alias("value"))
    n, v = F.col("name"), F.col("value")
    return rows.groupBy("name", "value", scalars.event_attribute(n).alias("is_event"), scalars.dynamic_handler(v).alias("is_dynamic"), scalars.suspicious_handler(v).alias("suspicious")).agg(F.count("*").alias("n"))


@query(
    "sc1_ratio",
    """select o_orderstatus, cast(count(*) filter (o_totalprice > 150000) as bigint) as ok, count(*) as total, cast(trunc(count(*) filter (o_totalprice > 150000)::double / count(*)::double * 100) as integer) as percent
       from orders group by o_orderstatus""",
)
def ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 150000).alias("ok"), F.count("*").alias("total"))
    return o.withColumn("percent", scalars.ratio(F.col("ok"), F.col("total")))


@query("sc2_digests", "select doc_id, sha256(text) as sha, left(sha256(text), 16) as token, md5(text) as md from documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.left(F.sha2("text", 256), F.lit(16)).alias("token"), F.md5("text").alias("md"))


@query(
    "sc4_bytes",
    """with b as (select doc_id, n_chars * n_chars as n from documents)
       select doc_id, n, case when n < 1024 then n || ' B' when n < 1048576 then cast(floor(n / 1024.0 * 10 + 0.5) as bigint) // 10 || '.' || cast(floor(n / 1024.0 * 10 + 0.5) as bigint) % 10 || ' KB'
              else cast(floor(n / 1048576.0 * 10 + 0.5) as bigint) // 10 || '.' || cast(floor(n / 1048576.0 * 10 + 0.5) as bigint) % 10 || ' MB' end as size_text from b""",
)
def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * F.col("n_chars")).alias("n"))
    return b.withColumn("size_text", scalars.bytes_text(F.col("n")))


@query(
    "sc5_duration",
    """with b as (select event_id, event_id * 137 as ms from events)
       select event_id, case when ms < 1000 then ms || ' ms' when ms < 10000 then cast(floor(ms / 100.0 + 0.5) as bigint) // 10 || '.' || cast(floor(ms / 100.0 + 0.5) as bigint) % 10 || ' s'
              when ms < 60000 then cast(floor(ms / 1000.0 + 0.5) as bigint) || ' s' when cast(floor(ms % 60000 / 1000.0 + 0.5) as bigint) > 0 then ms // 60000 || ' min ' || cast(floor(ms % 60000 / 1000.0 + 0.5) as bigint) || ' s'
              else ms // 60000 || ' min' end as took from b""",
)
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = (F.col("event_id") * 137).cast("long")
    return table(spark, sf_dir, "events").select("event_id", scalars.duration_text(ms).alias("took"))


@query("sc8_escape", """select page_id, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) as escaped_chars,
       md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) as escaped from pages""")
def escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scalars.xml_escape(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(e).cast("long").alias("escaped_chars"), F.md5(e).alias("escaped"))


@query("sc10_attributes", r"""with a as (select page_id, unnest(regexp_extract_all(html, '\b([a-z][a-z0-9:_-]*)\s*=\s*"([^"]*)"', 1, 'i')) as name from pages)
       select lower(name) as name, count(*) as n, count(distinct page_id) as pages from a group by 1""")
def attribute_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.operators.integrity import ATTRIBUTE_DOUBLE

    names = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(ATTRIBUTE_DOUBLE), F.lit(1))).alias("name"))
    return names.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query("sc11_occurrences", "select doc_id, cast((length(text) - length(replace(text, 'th', ''))) / 2 as integer) as n from documents")
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.occurrences(F.col("text"), "th").alias("n"))


@query("x18_request_gate", """with d as (select doc_id, strlen(text) as bytes, strlen(text) * (1 + doc_id % 64) as body from documents)
       select doc_id, bytes, case when body > 4096 * 6 + 65536 then 'body too large' when bytes > 4096 then 'content too large' end as refused from d""")
def request_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size limits count UTF-8 bytes, not characters; a document's number stands for how much its request's body grew."""
    n = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("bytes"), tasks.format_request_error(n * (1 + F.col("doc_id") % 64), n, 4096).alias("refused"))


@query("so3_warnings", "select event_id, left(props, 120) as message from events where event_type = 'error' order by event_id limit 10")
def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten by order, cut in code points."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "if(event_type = 'error', 'warn', 'info') as severity", "props as message")
    return diagnostics.short_list(e, seq="event_id").select("event_id", "message")
