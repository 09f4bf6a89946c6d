"""Package configurations made of the driver's tables, taken through the operators on configurations and formats."""

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tarn.functions import markup, tree
from tarn.operators import config, tasks
from tarn.plans.catalog import query
from tarn.session import table

PKG = "source || '-' || (doc_id // 333)"


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of each source's documents among 333 ids: even ones and those not divisible by three are main pages, those divisible by three pages of a
    subpackage, those divisible by nine unsafe there; the last document is the entry page."""
    d = table(spark, sf_dir, "documents").withColumn("pkg_id", F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 333).cast("string")))
    name = F.concat(F.lit("s/p"), F.col("doc_id").cast("string"))
    main = F.when((F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 3 != 0), F.concat(F.lit("/"), name, F.lit(".html")))
    sub = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("../"), name)).when(F.col("doc_id") % 6 == 0, name).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit(".js")))
    listed = lambda page: F.sort_array(F.collect_list(F.when(page.isNotNull(), F.struct(F.col("doc_id"), page.alias("page")))))["page"]
    whole = F.struct(F.concat(F.lit("s/p"), F.max("doc_id").cast("string")).alias("entryPagePath"), listed(main).alias("pages"), F.array(F.struct(F.lit("s").alias("root"), listed(sub).alias("pages"))).alias("subPackages"))
    return d.groupBy("pkg_id").agg(F.to_json(whole).alias("text"))


@query("r6_pages", f"""with d as (select {PKG} as pkg_id, doc_id, max(doc_id) over (partition by {PKG}) as last from documents),
       m as (select pkg_id, doc_id, case when doc_id = last then -1 else doc_id end as place from d where (doc_id % 2 = 0 or doc_id % 3 <> 0 or doc_id = last) and not (doc_id % 3 = 0 and doc_id % 9 <> 0))
       select pkg_id, cast(null as varchar) as root, cast(row_number() over (partition by pkg_id order by place) - 1 as integer) as ord, 's/p' || doc_id as page from m
       union all select pkg_id, 's/', cast(row_number() over (partition by pkg_id order by doc_id) - 1 as integer), 'p' || doc_id from d where doc_id % 3 = 0 and doc_id % 9 <> 0""")
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.package_pages(_configs(spark, sf_dir))


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as packages and their lines as files; what a package is follows from its order's number."""
    k, n = F.col("l_orderkey") % 3, F.col("l_linenumber")
    name = F.when((n == 1) & (k == 0), "app-service.js").when((n == 1) & (k == 1), "game.js").when(n == 2, "app-config.json").otherwise(F.concat(F.lit("f"), n.cast("string")))
    text = F.when(n == 2, F.concat(F.lit('{"a":'), F.col("l_orderkey").cast("string"), F.lit(',"subContext":{"b":[1]}}'))).otherwise("x")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("pkg_id"), name.alias("path"), text.alias("text"))


ROOTS = """f as (select l_orderkey, l_linenumber as n, case when l_linenumber = 1 and l_orderkey % 3 = 0 then 'app-service.js' when l_linenumber = 1 and l_orderkey % 3 = 1 then 'game.js' when l_linenumber = 2 then 'app-config.json' else 'f' || l_linenumber end as path from lineitem),
       r as (select l_orderkey, case when bool_or(path = 'app-service.js') then 'app' when bool_or(path = 'game.js') then 'game' else 'subpackage' end as route from f group by 1)"""


@query("x24_route", f"with {ROOTS} select cast(l_orderkey as varchar) as pkg_id, route from r")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.package_route(_roots(spark, sf_dir))


@query("r21_game", f"""with {ROOTS} select cast(f.l_orderkey as varchar) as pkg_id, case when n = 2 and route = 'game' then 'game.json' else path end as path,
       case when n <> 2 then 'x' when route = 'game' then '{{"a":' || f.l_orderkey || '}}' else '{{"a":' || f.l_orderkey || ',"subContext":{{"b":[1]}}}}' end as text from f join r on r.l_orderkey = f.l_orderkey""")
def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.game_files(_roots(spark, sf_dir))


@query("jn11_modules", """with r as (select page_id, page_id % 4 as k from pages)
       select 'p' as pkg_id, 'a/p' || page_id as page, 'm&quot;' || page_id as module, case k when 0 then 'inline' when 1 then 'written' else 'named' end as kind,
              case k when 0 then 'code' || page_id when 1 then '../w/' || page_id || '.wxs' else 'n/' || page_id || '.wxs' end as target from r where k < 3""")
def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that include a module each: inline, by where it was written, by name, or by a path outside the package."""
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    ref = F.when(k == 0, F.concat(F.lit("m:"), n)).when(k == 1, F.concat(F.lit("w:"), n)).when(k == 2, F.concat(F.lit("./n/"), n, F.lit(".wxs"))).otherwise(F.concat(F.lit("../../"), n))
    refs = table(spark, sf_dir, "pages").select("page_id", F.lit("p").alias("pkg_id"), F.concat(F.lit("a/p"), n).alias("page"), F.concat(F.lit('m"'), n).alias("module"), ref.alias("ref"))
    inline = refs.where("page_id % 4 = 0").select("pkg_id", "ref", F.concat(F.lit("code"), F.col("page_id").cast("string")).alias("source"))
    outputs = refs.where("page_id % 4 = 1").select("pkg_id", "ref", F.concat(F.lit("w/"), F.col("page_id").cast("string"), F.lit(".wxs")).alias("path"))
    return config.module_tags(refs.drop("page_id"), inline, outputs)


@query("f1_status", """with f as (select page_id, page_id % 6 as k from pages)
       select 'd' || page_id || case k when 0 then '.json' when 1 then '.json' when 2 then '.js' when 3 then '.wxml' when 4 then '.wxml' else '.css' end as path,
              case k when 0 then 'unchanged' when 1 then 'failed' when 3 then 'formatted' when 4 then 'unchanged' else 'skipped' end as status,
              case k when 1 then 'invalid JSON' when 2 then 'formatter unavailable' when 5 then 'control characters' end as reason,
              case k when 0 then '{"a":1}' when 1 then '{"a":' when 2 then 'a=1' when 3 then '<view a="1" b />' when 4 then '<view>x</view>' else 'a' || chr(1) end as output from f""")
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each kind: what is formatted, what stays and why."""
    k = F.col("page_id") % 6
    ext, text = F.lit(".css"), F.lit("a\x01")
    for number, (e, t) in enumerate(((".json", '{"a":1}'), (".json", '{"a":'), (".js", "a=1"), (".wxml", '<view  a="1"\n b/>'), (".wxml", "<view>x</view>"))):
        ext, text = F.when(k == number, e).otherwise(ext), F.when(k == number, t).otherwise(text)
    files = table(spark, sf_dir, "pages").select(F.lit("p").alias("pkg_id"), F.concat(F.lit("d"), F.col("page_id").cast("string"), ext).alias("path"), text.alias("text"))
    return tasks.formatted_files(files).select("path", "status", "reason", "output")


@query("r14_markup", """select page_id, '<view id="' || page_id || '" wx:if="c">' || case when page_id % 3 = 0 then chr(10) || '<!-- x: text -->    <b></b>' else 't' || page_id || '<b></b>' end || chr(10) || '</view>' || chr(10) as text,
       cast(case when page_id % 3 = 0 then 1 else 0 end as bigint) as lost_texts from pages""")
def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An element tree for each page: a block that folds into its element, and a text that every third page lacks."""
    n = F.col("page_id").cast("string")
    text = F.when(F.col("page_id") % 3 == 0, '{"unresolved":true}').otherwise(F.concat(F.lit('"t'), n, F.lit('"')))
    source = F.concat(F.lit('[{"tag":"block","attributes":{"wx:if":"c"},"children":[{"tag":"view","attributes":{"id":"'), n, F.lit('"},"children":[{"text":'), text, F.lit('},{"tag":"b"}]}]}]'))
    kind = StructType([StructField("text", StringType()), *(StructField(c, LongType()) for c in ("lost_texts", "lost_attributes", "lost_events"))])
    arrow = pa.struct([("text", pa.string()), *((c, pa.int64()) for c in ("lost_texts", "lost_attributes", "lost_events"))])
    rows = table(spark, sf_dir, "pages").select("page_id", source.alias("tree"))
    done = markup.with_text_function(rows, "tree", "done", kind, arrow, partial(tree.markup, marker="<!-- x: {} -->"))
    return done.select("page_id", "done.text", "done.lost_texts")
