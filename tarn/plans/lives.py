"""Tasks made of the events table, taken through the lifecycle that keyed state keeps."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.plans.catalog import query
from tarn.session import table
from tarn.streaming import feed, lifecycle

#: Events in a row that are one task, and the statuses they report unless something else happens.
SIZE = 14
PATH = (*(s for s in lifecycle.STAGES if s != "fallback_recovering"), "completed", "queued")

_REPORTS = f"""q as (select [{", ".join(f"'{s}'" for s in PATH)}] as path, [{", ".join(f"'{s}'" for s in lifecycle.STAGES)}] as stages, [{", ".join(map(str, lifecycle.STAGES.values()))}] as percents),
    e as (select cast(event_id // {SIZE} as varchar) as task_id, event_id % {SIZE} as seq, case when event_type = 'error' and event_id % 3 = 0 then 'failed' when event_type = 'click' and event_id % 5 = 0 then 'queued'
          when event_type = 'view' and event_id % 7 = 0 then 'packaging' else path[(event_id % {SIZE})::integer + 1] end as status from events, q),
    n as (select *, row_number() over (partition by task_id order by seq, status) as i from e),
    w as (select task_id, 0::bigint as i, null::bigint as seq, null::varchar as status, null::varchar as was, null::varchar as now, null::integer as percent, null::integer as attempt, null::varchar as refused from (select distinct task_id from n)
          union all select task_id, i, seq, status, now as was, case when why is null then status else now end, case when why is not null then percent when status = 'queued' then 0 when status = 'failed' then percent when there > 0 then percents[there] else 100 end,
                 case when why is null and status = 'queued' then coalesce(attempt, 0) + 1 else attempt end, why
          from (select n.task_id, n.i, n.seq, n.status, w.now, w.percent, w.attempt, percents, there,
                       case when w.now is null then case when n.status <> 'queued' then 'not queued' end when w.now in ('completed', 'partial', 'failed') then 'already ended' when n.status = 'failed' then null
                            when n.status in ('completed', 'partial') then case when w.now <> 'packaging' then 'too early' end when n.status = 'queued' then case when w.now = 'queued' then 'already queued' end
                            when there = here then 'repeated' when there < here then 'backwards' when there = here + 1 or (here >= 9 and there <= 12) then null else 'skips a stage' end as why
                from (select n.*, q.percents, coalesce(list_position(q.stages, n.status), 0) as there from n, q) n join (select w.*, coalesce(list_position(q.stages, w.now), 0) as here from w, q) w on w.task_id = n.task_id and n.i = w.i + 1))"""


@query("s7_lifecycle", f"with recursive {_REPORTS} select task_id, seq, status, was, percent, attempt, refused from w where i > 0")
def lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of fourteen events in a row: most go their way, some fail, start over or jump."""
    feed.enable(spark)
    i, kind = F.col("event_id"), F.col("event_type")
    plain = F.element_at(F.array(*map(F.lit, PATH)), (i % SIZE + 1).cast("int"))
    status = F.when((kind == "error") & (i % 3 == 0), "failed").when((kind == "click") & (i % 5 == 0), "queued").when((kind == "view") & (i % 7 == 0), "packaging").otherwise(plain)
    return lifecycle.lifecycle(table(spark, sf_dir, "events").select(F.floor(i / SIZE).alias("task_id"), (i % SIZE).alias("seq"), status.alias("status")))
