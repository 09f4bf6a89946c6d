"""Joins, set operations, windows and aggregates over the driver's tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import labels, scalars
from tarn.operators import config, diagnostics, manifest, merge, tasks
from tarn.plans.catalog import query
from tarn.session import table
from tarn.sources import container


@query("jn1_left_assets", "select d.doc_id, coalesce(l.quality, -1) as quality, coalesce(l.toxic, 0) as toxic, l.doc_id is not null as labelled from documents d left join labels l on d.doc_id = l.doc_id")
def left_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, or defaults."""
    labels = table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").fillna({"quality": -1, "toxic": 0}).fillna(False, ["labelled"])


@query("jn2_semi", "select lang, count(*) as n from documents where doc_id in (select doc_id from labels) group by lang")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))


@query("jn3_anti", "select p_brand, count(*) as n from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49 and l_partkey is not null) group by 1")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no line has in a large quantity, by brand."""
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return merge.without(table(spark, sf_dir, "part"), large, ["p_partkey"]).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("jn5_pairs", """select source, count(*) filter (q and t) as pairs, count(*) filter (not (q and t)) as missing from
       (select d.source, coalesce(bool_or(l.quality = 1), false) as q, coalesce(bool_or(l.toxic = 0), false) as t from documents d left join labels l on d.doc_id = l.doc_id group by d.doc_id, d.source) group by source""")
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with both of two facts, and rows that lack one."""
    facts = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("q"), F.bool_or(F.col("toxic") == 0).alias("t"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(facts, "doc_id", "left").fillna(False, ["q", "t"])
    both = F.col("q") & F.col("t")
    return d.groupBy("source").agg(F.count_if(both).alias("pairs"), F.count_if(~both).alias("missing"))


HREFS = """select page_id, regexp_replace(regexp_replace(h, '^[a-z]+://[^/]*', ''), '[?#].*$', '') as target from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as h from pages)"""


@query("jn6_missing_refs", f"""with r as ({HREFS}), k as (select distinct regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') as target from pages)
       select page_id, count(*) as missing, count(distinct target) as targets from r where target not in (select target from k) group by page_id""")
def missing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that lead to no known path."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    pages = table(spark, sf_dir, "pages")
    refs = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h")).select("page_id", bare("h").alias("target"))
    known = pages.select(bare("url").alias("target")).distinct()
    return refs.join(known, "target", "left_anti").groupBy("page_id").agg(F.count("*").alias("missing"), F.count_distinct("target").alias("targets"))


TRACKS = """n as (select doc_id // 3 as k, min(text) as text from documents group by 1), f as (select doc_id // 2 as k, min(text) as text from documents group by 1)"""


def _tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document in both tracks, under other keys: three share one in the first track, two in the second."""
    d = table(spark, sf_dir, "documents")
    track = lambda by: d.groupBy(F.floor(F.col("doc_id") / by).alias("k")).agg(F.min("text").alias("text"))
    return track(3), track(2)


@query("jn7_merge", f"with {TRACKS} select case when n.k is null then 'added' when n.text = f.text then 'identical' else 'preserved' end as outcome, count(*) as n from f left join n on f.k = n.k group by 1")
def merge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recovery tracks: what the second adds, repeats, or loses to the first."""
    return merge.merge_outcome(*_tracks(spark, sf_dir), ["k"], "text").groupBy("outcome").agg(F.count("*").alias("n"))


@query("st1_insert_only", f"with {TRACKS} select cast(k as bigint) as k, md5(text) as digest from n union all select cast(k as bigint), md5(text) from f where k not in (select k from n)")
def insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.insert_only(*_tracks(spark, sf_dir), ["k"]).select("k", F.md5("text").alias("digest"))


@query("jn8_provenance", "select d.doc_id, case when l.doc_id is null then 'native' else 'label' || l.quality end as source from documents d left join labels l on l.doc_id = d.doc_id")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = table(spark, sf_dir, "documents").select(F.lit("p").alias("pkg_id"), F.col("doc_id").alias("path"))
    known = table(spark, sf_dir, "labels").select(F.lit("p").alias("pkg_id"), F.col("doc_id").alias("path"), F.concat(F.lit("label"), F.col("quality").cast("string")).alias("source"))
    return merge.with_provenance(scanned, known).select(F.col("path").alias("doc_id"), "source")


@query("jn9_digest", """with k as (select md5(text) as m, min('d' || doc_id) as path from documents group by 1)
       select doc_id, case when doc_id % 10 <> 0 then k.path end as icon_path from documents d left join k on k.m = md5(d.text)""")
def digest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, and each as an icon written inline in base64; every tenth icon is no base64."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("p").alias("pkg_id"), F.col("text").cast("binary").alias("content"))
    icon = F.when(F.col("doc_id") % 10 == 0, "?").otherwise(F.concat(F.lit("data:image/png;base64,"), F.base64("content")))
    icons = d.select("pkg_id", F.col("doc_id").alias("item"), icon.alias("icon"))
    files = d.select("pkg_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "content")
    return config.icon_matches(icons, files).select(F.col("item").alias("doc_id"), "icon_path")


@query("jn12_stage_times", """select e.user_id, e.event_type, e.event_id as at_ms, coalesce(e.event_id - (select max(s.event_id) from events s where s.user_id = e.user_id and s.event_type = e.event_type and s.event_id % 2 = 0 and s.event_id <= e.event_id), 0) as duration_ms
       from events e where e.event_id % 2 = 1""")
def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as starts and finishes of a user's stages: a finish is timed from the stage's last start."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("at_ms"))
    done = tasks.stage_durations(e.where("at_ms % 2 = 0"), e.where("at_ms % 2 = 1"))
    return done.select(F.col("task_id").alias("user_id"), F.col("stage").alias("event_type"), "at_ms", "duration_ms")


@query("jn2_components", """with d as (select source as pkg_id, doc_id from documents)
       select distinct a.pkg_id, 's/c' || b.doc_id as path from d a join d b on b.pkg_id = a.pkg_id and b.doc_id = a.doc_id + 20 where b.doc_id % 2 = 0 or b.doc_id % 3 = 0""")
def component_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document refers to the one twenty ids on, which is a file of a kind that makes a component, or not."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("pkg_id"), "doc_id")
    end = F.when(F.col("doc_id") % 2 == 0, ".wxml").when(F.col("doc_id") % 3 == 0, ".js").otherwise(".json")
    files = d.select("pkg_id", F.concat(F.lit("s/c"), F.col("doc_id").cast("string"), end).alias("path"))
    refs = d.select("pkg_id", F.concat(F.lit("s/p"), F.col("doc_id").cast("string")).alias("page"), F.concat(F.lit("./c"), (F.col("doc_id") + 20).cast("string")).alias("ref"))
    return manifest.components(files, refs)


@query("ag2_public_sources", """with f as (select lang, ['fallback', 'generated', 'inferred', 'manifest', 'native', 'runtime', '', null, 'odd'][doc_id % 9 + 1] as source from documents),
       b as (select lang, coalesce(nullif(source, ''), 'native') as source, count(*) as n from f group by 1, 2)
       select lang, case when source = 'odd' then 'other' else source end as source, cast(sum(n) as bigint) as n from b group by 1, 2""")
def public_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of nine origins, one of them none and one unknown, counted as a report shows them."""
    names = F.array(*(F.lit(x) for x in ("fallback", "generated", "inferred", "manifest", "native", "runtime", "", None, "odd")))
    files = table(spark, sf_dir, "documents").select("lang", F.element_at(names, (F.col("doc_id") % 9 + 1).cast("int")).alias("source"))
    return merge.source_breakdown(files, "lang").groupBy("lang", scalars.public_source(F.col("source")).alias("source")).agg(F.sum("n").alias("n"))


_ENTRIES = """c as (select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) - 1 as ord from conversations)"""


@query("jn13_entries", f"""with {_ENTRIES}, f as (select *, row_number() over w as nth, first_value(text) over w as first_text from c window w as (partition by conv_id, role order by ord))
       select cast(conv_id as varchar) as pkg_id, cast(ord as integer) as ord, role as path, sha256(text) as sha256, case when nth > 1 then 'skip' else 'write' end as action, case when nth > 1 and text <> first_text then 'divergent duplicate' end as error from f""")
def duplicate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a package, its turns the entries, a role their path: later ones of a role repeat the first or diverge from it."""
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.octet_length("text").cast("long").alias("size"))
    ends = turns.withColumn("ord", F.row_number().over(before) - 1).withColumn("end", F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    entries = ends.select(F.col("conv_id").cast("string").alias("pkg_id"), F.col("ord").cast("int").alias("ord"), F.col("role").alias("name"), (F.col("end") - F.col("size") + container.HEADER).alias("offset"), "size", F.lit(None).cast("string").alias("error"))
    head = F.concat(F.unhex(F.lit("be" + "00" * 12 + "ed")))
    bodies = ends.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("x"))
    packages = bodies.select(F.col("conv_id").cast("string").alias("pkg_id"), F.concat(head, F.array_join("x.text", "").cast("binary")).alias("content"))
    done = container.extract(packages, entries)
    return done.select("pkg_id", "ord", "path", F.sha2("content", 256).alias("sha256"), "action", "error")


@query("jn13_dups", """select conv_id, role, count(*) as entries, count(distinct sha256(text)) as contents, count(distinct sha256(text)) > 1 as divergent from conversations group by conv_id, role having count(*) > 1""")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with several entries: identical or divergent."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("entries"), F.count_distinct(F.sha2("text", 256)).alias("contents"))
    return g.where("entries > 1").withColumn("divergent", F.col("contents") > 1)


ENTRIES = """select l_orderkey, l_linenumber, cast(trunc(l_quantity) as bigint) * 7 % 50 as start_at, cast(trunc(l_quantity) as bigint) * 7 % 50 + cast(trunc(l_quantity) as bigint) as end_at,
       l_partkey, l_extendedprice from lineitem"""


ENTRY_ORDER = ("l_linenumber", "l_partkey", "l_extendedprice")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (q * 7 % 50).alias("start_at"), (q * 7 % 50 + q).alias("end_at"), "l_partkey", "l_extendedprice")


@query("wn2_running_max", f"with e as ({ENTRIES}) select *, max(end_at) over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice rows between unbounded preceding and 1 preceding) as seen_end from e")
def running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.running_end(_entries(spark, sf_dir), ["l_orderkey"], ENTRY_ORDER, "end_at")


@query("jn14_alias", f"""with e as ({ENTRIES}), s as (select *, max(end_at) over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice rows between unbounded preceding and 1 preceding) as seen_end from e)
       select l_orderkey, count(*) as entries, count(*) filter (coalesce(end_at <= seen_end, false)) as inside, cast(sum(case when coalesce(end_at <= seen_end, false) then 0 else end_at - start_at end) as bigint) as extracted from s group by l_orderkey""")
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that lie within what earlier ones referenced, and the size of all others."""
    s = merge.running_end(_entries(spark, sf_dir), ["l_orderkey"], ENTRY_ORDER, "end_at")
    inside = F.coalesce(F.col("end_at") <= F.col("seen_end"), F.lit(False))
    return s.groupBy("l_orderkey").agg(F.count("*").alias("entries"), F.count_if(inside).alias("inside"), F.sum(F.when(inside, 0).otherwise(F.col("end_at") - F.col("start_at"))).alias("extracted"))


@query("wn3_first_wins", "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events) where n = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.first_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("wn4_ranked", """with r as (select *, case event_type when 'purchase' then 3 when 'signup' then 3 when 'click' then 2 when 'view' then 1 else 0 end as rank from events),
       n as (select *, row_number() over (partition by user_id order by rank desc, event_id) as n, min(event_id) over (partition by user_id) as first_seen from r) select user_id, event_id, event_type, first_seen from n where n = 1""")
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events the best source's, the earliest of equals, in order of first appearance."""
    source = F.when(F.col("event_type").isin("purchase", "signup"), "native").when(F.col("event_type") == "click", "generated").when(F.col("event_type") == "view", "fallback").otherwise("")
    e = table(spark, sf_dir, "events").select(F.lit("p").alias("pkg_id"), F.col("event_id").alias("ord"), F.col("user_id").alias("path"), source.alias("source"), "event_id", "event_type")
    return merge.best_source(e).select(F.col("path").alias("user_id"), "event_id", "event_type", F.col("ord").alias("first_seen"))


@query("wn5_attempts", "select user_id, event_type, event_id, cast(row_number() over (partition by user_id, event_type order by event_id) as integer) as attempt from events")
def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq"))
    return merge.attempts(e).select(F.col("task_id").alias("user_id"), F.col("stage").alias("event_type"), F.col("seq").alias("event_id"), "attempt")


@query("wn6_lag_dedup", """select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as was, row_number() over (partition by user_id order by ts, event_id) as n from events)
       where n = 1 or event_type is distinct from was""")
def lag_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type differs from the user's event before."""
    return merge.changed(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@query("wn7_tail", "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 256")
def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.tail(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], merge.TAIL).select("user_id", "event_id")


@query("ag3_status_counts", """select user_id, count(*) filter (event_type = 'view') as formatted, count(*) filter (event_type = 'click') as unchanged, count(*) filter (event_type = 'purchase') as skipped,
       count(*) filter (event_type not in ('view', 'click', 'purchase')) as failed, count(*) filter (event_type not in ('view', 'click', 'purchase')) > 0 as partial from events group by user_id""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files that were formatted: types without a status of that kind are unknown, thus failures."""
    status = F.when(F.col("event_type") == "view", "formatted").when(F.col("event_type") == "click", "unchanged").when(F.col("event_type") == "purchase", "skipped").otherwise(F.col("event_type"))
    return tasks.status_counts(table(spark, sf_dir, "events").select("user_id", status.alias("status")), "user_id")


CODE = "case event_type when 'click' then 'recover.js.page.' || event_id % 3 when 'error' then 'verify.js.unparsable' when 'signup' then 'manifest.x' when 'purchase' then 'odd' else 'format.files.y' end"
SEVERITY = "case when event_type = 'error' then 'error' when event_type = 'view' then 'info' else 'warn' end"
CLASS = "case event_type when 'click' then 'page-logic' when 'error' then 'source-parse' when 'signup' then 'app-config' else 'other-warn' end"


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id as seq", "user_id", f"{CODE} as code", f"{SEVERITY} as severity", "'s' as stage", "cast(user_id % 7 as string) as file", "event_type as message")


@query("ag8_diag_groups", f"""select {CLASS} as class, count(*) as n, case when bool_or(event_type = 'error') then 'danger' else 'warning' end as tone, min(event_id) as first_seq from events where event_type <> 'view' group by 1""")
def diag_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics by the first class that matches, infos left out."""
    return diagnostics.grouped(_diagnostics(spark, sf_dir))


@query("so2_group_order", f"""with g as (select {CLASS} as class, count(*) as n, bool_or(event_type = 'error') as danger, min(event_id) as f from events where event_type <> 'view' group by 1)
       select cast(row_number() over (order by danger desc, n desc, f) as integer) as place, class from g""")
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.placed(diagnostics.grouped(_diagnostics(spark, sf_dir))).select("place", "class")


@query("st2_diag_dedup", f"""select seq, code, file from (select event_id as seq, {CODE} as code, cast(user_id % 7 as varchar) as file, row_number() over (partition by {CODE}, {SEVERITY}, user_id % 7, event_type order by event_id) as n from events) where n = 1""")
def diag_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.dedupe(_diagnostics(spark, sf_dir)).select("seq", "code", "file")


@query("st3_fallback_dedup", f"""select seq, code, file from (select event_id as seq, {CODE} as code, cast(user_id % 7 as varchar) as file, row_number() over (partition by {CODE}, user_id % 7 order by event_id) as n from events) where n = 1""")
def fallback_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.dedupe_fallback(_diagnostics(spark, sf_dir)).select("seq", "code", "file")


@query("st4_claimed", "select p_partkey, p_brand from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49 and l_discount > 0.05 and l_partkey is not null)")
def claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = table(spark, sf_dir, "lineitem").where("l_quantity > 49 and l_discount > 0.05").select(F.col("l_partkey").alias("p_partkey"))
    return merge.without(table(spark, sf_dir, "part"), taken, ["p_partkey"]).select("p_partkey", "p_brand")


@query("st5_set_equality", """with a as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), b as (select o_custkey as k from orders where o_orderstatus = 'O')
       select (select count(*) from (select k from a except select k from b)) as only_first, (select count(*) from (select k from b except select k from a)) as only_second,
              (select count(*) from (select k from b group by k having count(*) > 1)) as repeated""")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with finished orders against those with open ones, which are listed once for each order."""
    o = table(spark, sf_dir, "orders")
    key = lambda status: o.where(F.col("o_orderstatus") == status).select("o_custkey")
    return merge.set_differences(key("F").distinct(), key("O"), ["o_custkey"])


@query("st6_distinct_list", """select conv_id, string_agg(role, ',' order by first_turn) as roles from (select conv_id, role, min(turn) as first_turn from conversations group by conv_id, role) group by conv_id""")
def distinct_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of a conversation, each once, in order of appearance."""
    return merge.distinct_list(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role").select("conv_id", F.array_join("values", ",").alias("roles"))


@query("prj17_retention", """select event_type, count(*) as n from events where ts <= (select max(ts) - interval 24 hour from events) and user_id not in (select c_custkey from customer where c_acctbal > 5000) group by 1""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events older than a day before the last one whose user isn't protected."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("m")).first()["m"]
    protected = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    cutoff = F.lit(last) - F.expr("interval 24 hours")
    return merge.expired(e, "ts", cutoff, protected, "user_id").groupBy("event_type").agg(F.count("*").alias("n"))


@query("so6_oldest_job", """with j as (select event_type, event_id, event_id * 10 as t, case when event_id % 4 = 0 then 'claimed' when event_id % 4 = 1 then 'done' else 'waiting' end as state from events),
       c as (select event_type, event_id, t from j where (state = 'waiting' and t <= 2000000) or (state = 'claimed' and t + 1800000 < 2000000))
       select event_type, arg_min(event_id, t) as event_id from c group by event_type""")
def oldest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs, each type a queue: the oldest job that waits or whose lease ran out."""
    from tarn.streaming.folds import next_job

    t, k = F.col("event_id") * 10, F.col("event_id") % 4
    state = F.when(k == 0, "claimed").when(k == 1, "done").otherwise("waiting")
    jobs = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("task_id"), state.alias("state"), t.alias("available_ms"), t.alias("claimed_ms"))
    return next_job(jobs, F.lit(2_000_000), "event_type").select("event_type", F.col("task_id").alias("event_id"))


@query("s7_latest", "select user_id, event_type as status, event_id as seq from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.streaming.folds import latest as fold

    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), F.lit(0).alias("percent"), F.col("event_id").alias("seq"))
    return fold(e, "user_id").select("user_id", "status", "seq")


@query("s6_retries", """with j as (select user_id, list(event_type <> 'error' order by event_id)[1:3] as o from events group by user_id), n as (select user_id, o, list_position(o, true) as p from j)
       select user_id, cast(coalesce(p, len(o)) as integer) as attempts, case when p is not null then 'done' when len(o) >= 3 then 'dead' else 'waiting' end as state from n""")
def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.streaming.folds import MAX_ATTEMPTS, retried

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    first = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"), nth.alias("nth")).where(F.col("nth") <= MAX_ATTEMPTS)
    e = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "ok"))).alias("x"))
    return retried(e.select("user_id", F.col("x.ok").alias("outcomes"))).select("user_id", "attempts", "state")


@query("s8_breaker")
def breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user as a service's, errors as failures: a fold in order of time."""
    from tarn.streaming.folds import breaker as fold

    e = table(spark, sf_dir, "events")
    return fold(e.select((F.col("user_id") % 50).cast("string").alias("service"), (F.col("event_id") * 1000).alias("t_ms"), (F.col("event_type") != "error").alias("ok")))


STAGE = "case event_type when 'view' then 'unpacking' when 'click' then 'formatting' when 'purchase' then 'packaging' else event_type end"
ENGINE = "case event_type when 'view' then 'native' when 'click' then 'parser' else event_type end"


@query("sc21_labels", f"""with e as (select {STAGE} as stage, {ENGINE} as engine, count(*) as n from events group by 1, 2)
       select stage, case stage when 'unpacking' then '解包文件' when 'formatting' then '整理代码格式' when 'packaging' then '生成下载文件' else '处理当前步骤' end as stage_label,
              case engine when 'native' then '内置反编译' when 'parser' then '语法与引用检查' else engine end as engine_label, n from e""")
def stage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stages and engines, with the labels that a report shows."""
    e = table(spark, sf_dir, "events").selectExpr(f"{STAGE} as stage", f"{ENGINE} as engine").groupBy("stage", "engine").agg(F.count("*").alias("n"))
    return e.select("stage", labels.stage_label(F.col("stage")).alias("stage_label"), labels.engine_label(F.col("engine")).alias("engine_label"), "n")


@query("x10_metrics", """select event_id, cast(trunc(value) as bigint) as v, case when event_id % 3 <> 0 then event_id // 2 end as k, case when event_id % 3 = 0 then 'e' || event_id else '' end as t from events""")
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and texts out of a JSON map; what isn't of the kind asked for is null or empty."""
    odd = F.col("event_id") % 3 == 0
    k = F.when(odd, F.concat(F.lit('"e'), F.col("event_id").cast("string"), F.lit('"'))).otherwise((F.col("event_id") / 2).cast("string"))
    doc = F.try_parse_json(F.concat(F.lit('{"v":'), F.coalesce(F.col("value").cast("string"), F.lit("null")), F.lit(',"k":'), k, F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", scalars.metric_number(doc, "v").alias("v"), scalars.metric_number(doc, "k").alias("k"), scalars.metric_text(doc, "k").alias("t"))


@query("x28_unpivot", """with s as (select l_orderkey as pkg_id, count(*) as n, max(l_linenumber) as most, cast(sum(l_linenumber) as integer) as total, bool_and(l_linestatus = 'O') as passed from lineitem group by 1)
       select pkg_id, cast(unnest([0, 1, 2, 3, 4, 5, 6, 7]) as integer) as place, unnest(['manifest', 'js', 'wxml', 'wxss', 'missing-page-files', 'verifier', 'fallback', 'fallback-adjustment']) as metric,
              unnest([n || '/100', most || '/100', total || '/100', '100/100', (n - 1) || '%', cast(passed as varchar), cast(not passed as varchar), '-10']) as value,
              unnest([null, null, null, null, case when n > 1 then 'warning' else 'success' end, case when passed then 'success' else 'warning' end, case when passed then 'neutral' else 'warning' end, 'neutral']) as tone
       from s where not passed union all
       select pkg_id, cast(unnest([0, 1, 2, 3, 4, 5, 6]) as integer), unnest(['manifest', 'js', 'wxml', 'wxss', 'missing-page-files', 'verifier', 'fallback']),
              unnest([n || '/100', most || '/100', total || '/100', '100/100', (n - 1) || '%', cast(passed as varchar), cast(not passed as varchar)]),
              unnest([null, null, null, null, case when n > 1 then 'warning' else 'success' end, 'success', 'neutral']) from s where passed""")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as packages with scores: a row for each figure, one more where there is a penalty."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pkg_id")).agg(
        F.count("*").alias("manifest"), F.max("l_linenumber").alias("js"), F.sum("l_linenumber").alias("wxml"), F.bool_and(F.col("l_linestatus") == "O").alias("verifier_passed"))
    ready = g.select("*", F.lit(100).alias("wxss"), (F.col("manifest") - 1).alias("generated_ratio"), (~F.col("verifier_passed")).alias("fallback_used"), F.when(F.col("verifier_passed"), 0).otherwise(10).alias("penalty"))
    return tasks.score_rows(ready)
