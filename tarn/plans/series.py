"""Daily series over events: counts, running sums, extent, axis and ticks."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import scalars
from tarn.plans.catalog import query
from tarn.session import table

DAYS = "select cast(ts as date) as day, count(*) as added from events where ts is not null group by cast(ts as date)"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("ts is not null").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("added"))


@query("wn1_daily_cumulative", f"select day, added, cast(sum(added) over (order by day) as bigint) as cumulative from ({DAYS})")
def daily_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day and their running sum. The window sees one row a day, after the aggregate."""
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days(spark, sf_dir).withColumn("cumulative", F.sum("added").over(so_far))


@query("ag7_daily_count", DAYS)
def daily_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days(spark, sf_dir)


EXTENT = """select cast(count(*) as bigint) as total, min(cast(ts as date)) as first_day, max(cast(ts as date)) as last_day,
       cast(12 * (year(max(ts)) - year(min(ts))) + month(max(ts)) - month(min(ts)) + 1 as integer) as months from events"""


@query("ag10_extent", EXTENT)
def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    months = (F.year(F.max("ts")) - F.year(F.min("ts"))) * 12 + F.month(F.max("ts")) - F.month(F.min("ts")) + 1
    return e.agg(F.count("ts").alias("total"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"), months.cast("int").alias("months"))


@query(
    "so5_ticks",
    f"""with x as ({EXTENT}), n as (select first_day, last_day - first_day as span, least(6, last_day - first_day + 1) as ticks from x)
        select distinct first_day + cast(floor(span * i / (ticks - 1.0) + 0.5) as integer) as tick from n, unnest(generate_series(0, ticks - 1)) as g(i)""",
)
def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most six evenly spaced days of the extent."""
    x = extent(spark, sf_dir).withColumn("span", F.datediff("last_day", "first_day")).withColumn("n", F.least(F.lit(6), F.col("span") + 1))
    offset = F.floor(F.col("span") * F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)) + F.lit(0.5)).cast("int")
    return x.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select(F.date_add("first_day", offset).alias("tick")).distinct()


@query(
    "sc6_axis",
    """with t as (select event_type, count(*) as total from events group by event_type),
            r as (select *, greatest(1.0, total / 6.0) as rough from t), p as (select *, pow(10.0, floor(log10(rough))) as power from r),
            s as (select *, cast(greatest(1.0, case when rough / power <= 1 then 1.0 when rough / power <= 2 then 2.0 when rough / power <= 5 then 5.0 else 10.0 end * power) as bigint) as step from p)
       select event_type, total, step, cast(ceil(total * 1.0 / step) as bigint) * step as maximum from s""",
)
def axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rounded axis step and maximum for the number of events of each type."""
    t = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("total")).withColumn("step", scalars.nice_step(F.col("total")))
    return t.withColumn("maximum", (F.ceil(F.col("total") / F.col("step")) * F.col("step")).cast("long"))


@query("src9_flatten", "select user_id, cast(count(*) as bigint) as n, cast(count(distinct cast(ts as date)) as bigint) as days from events group by user_id")
def flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of events, each an array, flattened again: one page a user."""
    pages = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.to_date("ts")).alias("page"), F.count("*").alias("n"))
    return pages.select("user_id", "n", F.explode("page").alias("day")).groupBy("user_id", "n").agg(F.count_distinct("day").alias("days"))
