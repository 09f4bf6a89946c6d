"""Graphs and trees made of the driver's tables: style sheets that import each other, expression trees, components of components."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.operators import config, expressions, styles
from tarn.plans.catalog import query
from tarn.session import discard, settled, table

_STYLES = """o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i from orders),
    s as (select o_custkey, o_custkey || '-' || (i // 5) as pkg, o_orderkey, o_orderkey::varchar as sheet, (i % 5)::integer as j from o),
    k as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as n from lineitem),
    l as (select s.pkg, s.sheet, n as ord, case n when 1 then j + 1 when 2 then j + 3 when 5 then case when s.o_custkey % 4 = 0 then j - 2 end end as to_j, l_quantity::integer as q from s join k on l_orderkey = s.o_orderkey),
    p as (select l.pkg, l.sheet, ord::integer as ord, case when t.sheet is not null or ord = 6 then 'import' when ord = 3 then 'rpx' when ord = 5 then 'suffix' else 'text' end as kind,
          case when t.sheet is not null then t.sheet when ord = 6 then 'none' when ord = 3 then q::varchar else 'q' || q || ';' end as value from l left join s t on t.pkg = l.pkg and t.j = l.to_j),
    f as (select pkg, 'a.wxss' as file, 0 as file_ord, 0 as call, 0 as ord, 'text' as kind, 'a' as value from s where j = 0
          union all select pkg, case when j = 1 then 'd/b.wxss' else 'a.wxss' end, case when j = 1 then 1 else 0 end, case when j = 2 then 1 else 0 end, case when j = 0 then 1 else 0 end, 'import', sheet from s where j < 3),
    e as (select p.pkg, p.sheet, p.ord, value as target from p join s on s.pkg = p.pkg and s.sheet = value where kind = 'import'),
    v as (select pkg, value as sheet, [file_ord, call, ord] as place, []::varchar[] as above from f where kind = 'import'
          union all select v.pkg, e.target, list_append(place, e.ord), list_append(above, v.sheet) from v join e on e.pkg = v.pkg and e.sheet = v.sheet where e.target <> v.sheet and not list_contains(above, e.target)),
    b as (select pkg, sheet, arg_min(above, place) as above from v group by pkg, sheet),
    r as (select pkg, value as sheet from f where kind = 'import' union all select b.pkg, e.target from b join e on e.pkg = b.pkg and e.sheet = b.sheet where e.target <> b.sheet and not list_contains(above, e.target)),
    n as (select pkg, sheet, count(*) as imports from r group by pkg, sheet),
    h as (select s.pkg, s.sheet, coalesce(imports, 0) as imports, case when j in (1, 2) then 'own' when imports > 1 then 'file' when imports = 1 then 'inline' else 'unused' end as action,
          case j when 1 then 'd/b.wxss' when 2 then 'a.wxss' else case when imports > 1 then '__shared__/' || s.sheet || '.wxss' end end as file from s left join n on n.pkg = s.pkg and n.sheet = s.sheet)"""


def _pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A package of five orders of a customer, each a shared sheet, its lines the pieces (an order may have none): lines 1 and 2 import later orders, line 5 of
    every fourth customer an earlier one, line 6 none that is there. Two files import the first three orders, two of them alone. Both are settled."""
    i, j, n = F.col("i"), F.col("i") % 5, F.col("n")
    by_customer = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    numbered = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(by_customer) - 1).alias("i"),
        F.lead("o_orderkey").over(by_customer).alias("next"), F.lead("o_orderkey", 3).over(by_customer).alias("third"), F.lag("o_orderkey", 2).over(by_customer).alias("back"))
    pkg = F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.floor(i / 5).cast("string")).alias("pkg_id")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("int").cast("string").alias("q"), F.row_number().over(order).cast("int").alias("n"))
    target = F.when((n == 1) & (j < 4), F.col("next")).when((n == 2) & (j < 2), F.col("third")).when((n == 5) & (F.col("o_custkey") % 4 == 0) & (j > 1), F.col("back"))
    met = numbered.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(pkg, F.col("o_orderkey").cast("string").alias("sheet"), n.alias("ord"), F.when(F.col("o_custkey").isNotNull(), target).cast("string").alias("target"), "q")
    there, ord_ = F.col("target").isNotNull(), F.col("ord")
    kind = F.when(ord_.isNull(), None).when(there | (ord_ == 6), "import").when(ord_ == 3, "rpx").when(ord_ == 5, "suffix").otherwise("text")
    value = F.when(there, F.col("target")).when(ord_ == 6, "none").when(ord_ == 3, F.col("q")).otherwise(F.concat(F.lit("q"), F.col("q"), F.lit(";")))
    shared = met.select("pkg_id", "sheet", "ord", kind.alias("kind"), value.alias("value"))
    sheets = numbered.select(pkg, F.col("o_orderkey").cast("string").alias("sheet"), j.alias("j"))
    text = F.when(F.col("j") == 0, F.struct(F.lit(0).alias("ord"), F.lit("text").alias("kind"), F.lit("a").alias("value")))
    piece = F.struct(F.when(F.col("j") == 0, 1).otherwise(0).alias("ord"), F.lit("import").alias("kind"), F.col("sheet").alias("value"))
    own = sheets.where("j < 3").select("pkg_id", F.expr("if(j = 1, 'd/b.wxss', 'a.wxss') as file"), F.expr("if(j = 1, 1, 0) as file_ord"), F.expr("if(j = 2, 1, 0) as call"), F.explode(F.array_compact(F.array(text, piece))).alias("x"))
    return settled(own.select("pkg_id", "file", "file_ord", "call", "x.*")), settled(shared)


@query("r17_imports", f"with recursive {_STYLES} select pkg as pkg_id, sheet, imports, action, file from h")
def style_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, shared = _pieces(spark, sf_dir)
    sheets = styles.sheet_files(own, shared)
    discard(own, shared)
    return sheets


@query("r17_styles", f"""with recursive {_STYLES},
    x as (select pkg, file, [call, ord] as place, []::varchar[] as above, kind, value from f
          union all select h.pkg, h.file, [0, p.ord], [h.sheet], kind, value from h join p on p.pkg = h.pkg and p.sheet = h.sheet where action = 'file'
          union all (select y.pkg, y.file, list_append(y.place, y.pos), case when y.is_comment then y.above else list_append(y.above, y.sheet) end, y.kind, y.text
                     from (select x.pkg, x.file, x.place, x.above, x.value as sheet, p.ord as pos, p.kind as kind, p.value as text, false as is_comment, h.file as home from x join h on h.pkg = x.pkg and h.sheet = x.value join p on p.pkg = h.pkg and p.sheet = h.sheet
                           where x.kind = 'import' and not list_contains(x.above, x.value) and (h.file is null or h.file = x.file)
                           union all select x.pkg, x.file, x.place, x.above, x.value, w.pos, 'text', case when w.pos < 0 then '/*! sheet ' || x.value || ' */' else '/*! end of sheet */' end, true, h.file from x join h on h.pkg = x.pkg and h.sheet = x.value, (values (-1), (2147483647)) w(pos)
                           where x.kind = 'import' and not list_contains(x.above, x.value) and h.file is null) y)),
    t as (select x.pkg, x.file, place, case x.kind when 'text' then value when 'rpx' then value || 'rpx' when 'suffix' then ''
          else case when h.sheet is null then '/*! import of an unknown sheet left out */' when list_contains(above, value) then '/*! import cycle left out */' when h.file is null or h.file = x.file then ''
               else '@import "' || case when not contains(x.file, '/') then h.file when split_part(x.file, '/', 1) = split_part(h.file, '/', 1) then split_part(h.file, '/', 2) else '../' || h.file end || '";' || chr(10) end end as text
          from x left join h on x.kind = 'import' and h.pkg = x.pkg and h.sheet = x.value)
    select n.pkg as pkg_id, n.file, coalesce(string_agg(text, '' order by place), '') as text from (select distinct pkg, file from f union select pkg, file from h where file is not null) n left join t on t.pkg = n.pkg and t.file = n.file group by all""")
def style_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, shared = _pieces(spark, sf_dir)
    sheets = styles.sheet_files(own, shared)
    files, _ = styles.rebuilt(own, shared, sheets)
    discard(own, shared, sheets)
    return files


_TREE = """k as (select o_orderkey, o_orderkey % 6 as i, o_custkey % 5 as j, 'a' || o_orderkey as a, o_custkey as c from orders),
    x as (select *, case i when 0 then a || '+' || c when 1 then a || '.m' when 2 then '[' || a || ']' when 3 then '!' || a when 4 then '{k:' || a || '}' end as x from k)"""


@query("r11_expressions", f"""with {_TREE} select o_orderkey as tree_id, i = 5 as unresolved,
       case j when 0 then case i when 4 then '{{' || x || '}}' else '{{{{' || x || '}}}}' end when 1 then '{{{{' || case i when 0 then '(' || x || ')' else x end || '*2}}}}'
       when 2 then '{{{{f(' || case when i in (2, 4) then ' ' || x || ' ' else x end || ')}}}}' when 3 then 't-' || case i when 4 then '{{' || x || '}}' else '{{{{' || x || '}}}}' end
       else '{{{{' || x || '?''it\\''s "' || c || '"'':z}}}}' end as text from x""")
def expression_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of two to four levels for each order: one of six forms inside one of five; one form holds a mark of what is lost."""
    i, j, c = F.col("o_orderkey") % 6, F.col("o_custkey") % 5, F.col("o_custkey").cast("string")
    a = F.concat(F.lit('[[7],[3,"a'), F.col("o_orderkey").cast("string"), F.lit('"]]'))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    inner = F.when(i == 0, text('[[2,"+"],', a, ",[1,", c, "]]")).when(i == 1, text("[[6],", a, ',[3,"m"]]')).when(i == 2, text("[[5],", a, "]")).when(i == 3, text('[[2,"!"],', a, "]")).when(i == 4, text('[[8],"k",', a, "]")).otherwise(text('[[2,"+"],', a, ',{"unresolved":true}]'))
    outer = F.when(j == 0, inner).when(j == 1, text('[[2,"*"],', inner, ",[1,2]]")).when(j == 2, text('[[12],[[7],[3,"f"]],[[5],', inner, "]]")).when(j == 3, text('[11,[3,"t-"],', inner, "]")).otherwise(text('[[2,"?:"],', inner, ',[1,"it\'s \\"', c, '\\""],[3,"z"]]'))
    return expressions.restored(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tree_id"), outer.alias("ops")))


_USES = """d as (select source || '-' || (doc_id // 333) as pkg_id, doc_id, doc_id % 7 = 3 as unsafe from documents),
    p as (select pkg_id, 's/p' || doc_id || '.html' as page, doc_id from d where not unsafe),
    u as (select pkg_id, page, 's/p' || (doc_id + 20) || '.html' as component from p where doc_id // 20 % 5 < 4),
    c as (select distinct pkg_id, component as page from u)"""


def _page_configs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A package of each source's documents among 333 ids: a page for each, every seventh at an unsafe path; most use the page twenty
    ids on as a component, and all name one outside the package."""
    n, later = F.col("doc_id").cast("string"), (F.col("doc_id") + 20).cast("string")
    name = F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("../p"), n)).otherwise(F.concat(F.lit("/s/p"), n, F.lit(".html")))
    known = F.when(F.floor(F.col("doc_id") / 20) % 5 < 4, F.concat(F.when(F.col("doc_id") % 2 == 0, "p").otherwise("/s/p"), later))
    uses = F.map_filter(F.create_map(F.lit("c"), known, F.lit("x"), F.lit("../../out")), lambda _, v: v.isNotNull())
    page = F.struct(F.struct(F.col("doc_id").alias("t"), uses.alias("usingComponents")).alias("window"))
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 333).cast("string")).alias("pkg_id"), F.struct(name.alias("name"), page.alias("page")).alias("x"))
    listed = d.groupBy("pkg_id").agg(F.collect_list("x").alias("x"))
    whole = F.struct(F.map_from_entries("x").alias("page"))
    return config.page_configurations(listed.select("pkg_id", F.to_json(whole).alias("text")))


@query("r6_page_configs", f"""with {_USES} select coalesce(p.pkg_id, c.pkg_id) as pkg_id, coalesce(p.page, c.page) as page,
       '{{' || concat_ws(',', case when doc_id is not null then '"t":' || doc_id || ',"usingComponents":{{' || case when doc_id // 20 % 5 < 4 then '"c":"' || case when doc_id % 2 = 0 then 'p' else '/s/p' end || (doc_id + 20) || '",' else '' end || '"x":"../../out"}}' end, case when c.page is not null then '"component":true' end) || '}}' as window,
       c.page is not null as component from p full join c on c.pkg_id = p.pkg_id and c.page = p.page""")
def page_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_configs(spark, sf_dir)[0]


@query("r6_config_issues", f"""with {_USES} select pkg_id, 'page_config_unsafe' as code, cast(null as varchar) as page, '../p' || doc_id as value from d where unsafe
       union all select pkg_id, 'component_path_unsafe', page, '../../out' from p""")
def config_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_configs(spark, sf_dir)[2]


@query("jn10_components", f"""with recursive {_USES},
    w as (select pkg_id, page, 0 as depth from p where doc_id % 3 = 0 union select u.pkg_id, u.component, depth + 1 from w join u on u.pkg_id = w.pkg_id and u.page = w.page)
    select pkg_id, page as path, min(depth) as depth from w group by pkg_id, page""")
def component_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every third page, the components of components."""
    pages, uses, _ = _page_configs(spark, sf_dir)
    number = F.regexp_extract("page", "([0-9]+)", 1).cast("long")
    own = table(spark, sf_dir, "documents").where("doc_id % 7 <> 3").select(F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 333).cast("string")).alias("pkg_id"), F.col("doc_id").alias("number"))
    roots = pages.withColumn("number", number).where("number % 3 = 0").join(own, ["pkg_id", "number"], "left_semi")
    return config.component_closure(roots, uses)
