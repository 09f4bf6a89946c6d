"""Tasks and their reports: request checks, public projections, archives' states, formatter decisions."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarn.functions import markup, scalars
from tarn.operators import merge

# Limits of requests and of stored records, named reports, formats of ids.
MAX_UPLOAD = 50 << 20
MAX_AGE_S, MAX_AHEAD_S = 12 * 3600, 60
FORMAT_LIMIT, SCRIPT_LIMIT = 8 << 20, 4 << 20
JSON_GROWTH, REQUEST_FIELDS = 6, 64 << 10
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
REPORTS = {"report": "recovery-report.json", "diagnostics": "diagnostics.json", "artifacts": "artifacts.json", "profile": "package-profile.json"}
TERMINAL = ("completed", "partial", "failed")


def request_error(name: Column, size: Column, key_id: Column) -> Column:
    """Why a request is refused: no file, too large, wrong suffix, bad key id; null if it isn't."""
    bad_id = key_id.isNotNull() & (key_id != "") & ~key_id.rlike("^wx[a-f0-9]{16}$")
    return F.when(bad_id, "bad key id").when(name.isNull(), "no file").when(size > MAX_UPLOAD, "too large").when(~F.lower(name).endswith(".wxapkg"), "wrong suffix")


def stored_record_ok(task_id: Column, saved_at: Column, now: Column) -> Column:
    """A record kept by a client: a UUID, at most 12 hours old and at most a minute ahead."""
    age = F.unix_timestamp(now) - F.unix_timestamp(saved_at)
    return F.coalesce(F.lower(task_id).rlike(UUID) & (age <= MAX_AGE_S) & (age >= -MAX_AHEAD_S), F.lit(False))


def downloadable(has_summary: Column, ready: Column, status: Column) -> Column:
    return F.coalesce(has_summary & ready & status.isin("completed", "partial"), F.lit(False))


def packaging_state(status: Column, archive_size: Column) -> Column:
    """ready once an archive exists; unavailable for a failed task; else pending."""
    return F.when(archive_size > 0, "ready").when(status == "failed", "unavailable").otherwise("pending")


def ui_state(status: Column) -> Column:
    """What a client shows: terminal states by name, processing for any other, idle without one."""
    return F.when(status.isin(*TERMINAL), status).when(F.coalesce(status, F.lit("")) != "", "processing").otherwise("idle")


def recovery_reports(tasks: DataFrame, profiles: DataFrame, scores: DataFrame, stages: DataFrame, summaries: DataFrame) -> DataFrame:
    """(task_id, report JSON): a task with what is known of it; parts that aren't there are left out.

    profiles and scores have a row a task; stages(task_id, seq, stage, success, partial, engine, ...) are listed in
    order with their public engines; summaries are those of artifact_summary. What the score measures is stated.
    """
    whole = lambda df: df.select("task_id", F.struct(*(c for c in df.columns if c != "task_id")).alias("x"))
    run = stage_attempts(stages).withColumn("engine", scalars.public_engine(F.coalesce("engine", F.lit(""))))
    listed = run.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("seq", "stage", "status", "attempt", "engine"))).alias("stages"))
    joined = tasks.select("task_id", "status").join(whole(profiles).withColumnRenamed("x", "profile"), "task_id", "left").join(whole(scores).withColumnRenamed("x", "score"), "task_id", "left")
    joined = joined.join(listed, "task_id", "left").join(summaries, "task_id", "left")
    packaging = F.struct(packaging_state(F.col("status"), F.col("archive_size")).alias("status"), F.coalesce("ready", F.lit(False)).alias("downloadReady"), F.when(F.col("archive_size") > 0, F.col("archive_size")).alias("archiveSize"))
    artifacts = F.when(F.col("file_count").isNotNull(), F.struct(F.col("file_count").alias("fileCount"), F.col("sources").alias("sourceBreakdown")))
    basis = F.struct(F.lit("static-artifact-quality").alias("basis"))
    body = F.struct(F.col("task_id").alias("taskId"), "status", F.lit("live-task").alias("snapshotScope"), "profile", "score", basis.alias("scoreDisclosure"), F.col("stages").alias("stageResults"), artifacts.alias("artifacts"), packaging.alias("packaging"))
    return joined.select("task_id", F.to_json(body).alias("report"))


def public_tasks(tasks: DataFrame) -> DataFrame:
    """The fields of a task that are published; errors only of failed tasks; report links by id."""
    failed = F.col("status") == "failed"
    links = [F.when(F.col("status").isin(*TERMINAL), F.concat(F.lit("/api/tasks/"), "task_id", F.lit(f"/{n}"))).alias(f"{n}_url") for n in REPORTS]
    return tasks.select("task_id", "status", "percent", F.when(failed, F.col("error_code")).alias("error_code"), F.when(failed, F.left("error", F.lit(500))).alias("error"), *links)


def named_report(requests: DataFrame) -> DataFrame:
    """requests(task_id, name) that resolve to a file: a known name, an id of one path component."""
    names = F.create_map(*(F.lit(x) for kv in REPORTS.items() for x in kv))
    ok = ~F.col("task_id").rlike(r"[/\\\x00]|^\.{0,2}$")
    return requests.withColumn("file", F.when(ok, names[F.col("name")])).where("file is not null")


def events(tasks: DataFrame) -> DataFrame:
    """Tasks as events: terminal states have types of their own."""
    s = F.col("status")
    kind = F.when(s == "completed", "complete").when(s == "partial", "partial").when(s == "failed", "error").otherwise("progress")
    return tasks.select("task_id", kind.alias("type"), "status", "percent", "message", s.isin(*TERMINAL).alias("terminal"))


def artifact_summary(tasks: DataFrame, files: DataFrame, archives: DataFrame) -> DataFrame:
    """(task_id, file_count, sources map, ready, archive_size): an archive counts only if it has bytes."""
    public = files.withColumn("source", scalars.public_source(F.coalesce(F.nullif("source", F.lit("")), F.lit("native"))))
    per = public.groupBy("task_id", "source").agg(F.count("*").alias("n"))
    sources = per.groupBy("task_id").agg(F.sum("n").alias("file_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("sources"))
    size = F.coalesce(F.col("archive_size"), F.lit(0))
    joined = tasks.select("task_id").join(sources, "task_id", "left").join(archives.select("task_id", "archive_size"), "task_id", "left")
    return joined.select("task_id", F.coalesce("file_count", F.lit(0)).alias("file_count"), "sources", (size > 0).alias("ready"), size.alias("archive_size"))


def format_decision(enabled: Column, size: Column, healthy: Column, breaker_open: Column, kind: Column) -> Column:
    """Why a file is left as it is, in the order in which that is found out; null: the formatter is called."""
    limit = F.when(kind == "js", SCRIPT_LIMIT).otherwise(FORMAT_LIMIT)
    return F.when(~enabled, "formatter disabled").when(size > limit, "file exceeds formatter limit").when(~healthy, "formatter unavailable").when(breaker_open, "formatter circuit breaker open")


def format_request_error(body_bytes: Column, content_bytes: Column, limit: int) -> Column:
    """Why the formatter refuses a request, null if it doesn't. JSON may write a byte of content in six, beside the request's own fields."""
    return F.when(body_bytes > JSON_GROWTH * limit + REQUEST_FIELDS, "body too large").when(content_bytes > limit, "content too large")


def format_status(skipped: Column, reported: Column, failed: Column, before: Column, after: Column) -> Column:
    """skipped, failed, what the formatter reported, or by comparing contents; a failure keeps the original bytes."""
    return F.when(skipped.isNotNull(), "skipped").when(failed, "failed").when(reported != "", reported).when(before == after, "unchanged").otherwise("formatted")


def repack(tasks: DataFrame, entries: DataFrame) -> DataFrame:
    """Tasks whose archive holds anything outside src/ are packed again: (task_id, action)."""
    outside = entries.groupBy("task_id").agg(F.bool_or(~F.col("path").startswith("src/")).alias("odd"))
    joined = tasks.join(outside, "task_id", "left")
    return joined.select("task_id", F.when(F.col("odd").isNull(), "none").when(F.col("odd"), "repack").otherwise("keep").alias("action"))


def reports_without_host_paths(reports: DataFrame, pattern: str) -> DataFrame:
    """Acceptance check: reports whose text still shows a host path."""
    return reports.where(F.col("text").rlike(pattern))


def accepted(facts: DataFrame) -> DataFrame:
    """Acceptance of a task's outcome: gate passed, manifest at 100, counts that agree, a safe and complete archive."""
    ok = F.col("gate_ok") & (F.col("manifest") == 100) & (F.col("file_count") == F.col("archive_count")) & (F.col("unsafe_entries") == 0) & (F.col("leaks") == 0)
    return facts.withColumn("accepted", ok)


def status_counts(files: DataFrame, *keys: str) -> DataFrame:
    """files(..., status) counted: formatted, unchanged, skipped, failed and partial; an unknown status is a failure, only failures are partial."""
    known = ("formatted", "unchanged", "skipped")
    s = F.coalesce("status", F.lit(""))
    counts = files.groupBy(*keys).agg(*(F.count_if(s == k).alias(k) for k in known), F.count_if(~s.isin(*known)).alias("failed"))
    return counts.withColumn("partial", F.col("failed") > 0)


def formatted_files(files: DataFrame) -> DataFrame:
    """files(pkg_id, path, text) with output, status and reason: what is formatted here, and why the rest keeps its bytes.

    Markup is laid out by markup.format_tags; JSON is checked. Scripts and styles need a formatter of their own and are skipped.
    Files of no formatter's type are left out. A file beyond its limit, or with control characters, is skipped.
    """
    kind = scalars.sniffed_type(F.col("text"), F.col("path"))
    listed = files.where(scalars.is_text_artifact(F.col("path"))).select("pkg_id", "path", "text", kind.alias("kind"))
    size = F.octet_length("text")
    why = F.coalesce(format_decision(F.lit(True), size, F.lit(True), F.lit(False), F.col("kind")), F.when(~scalars.no_control_anywhere(F.col("text")), "control characters"), F.when(F.col("kind").isin("js", "css"), "formatter unavailable"))
    marked = listed.withColumn("reason", why).withColumn("__in", F.when((F.col("kind") == "html") & why.isNull(), F.col("text")))
    done = markup.with_text_function(marked, "__in", "__out", StringType(), pa.string(), markup.format_tags).drop("__in")
    invalid = (F.col("kind") == "json") & F.col("reason").isNull() & F.try_parse_json("text").isNull()
    output = F.coalesce("__out", "text")
    status = format_status(F.col("reason"), F.lit(""), invalid, F.col("text"), output)
    return done.select("pkg_id", "path", output.alias("output"), status.alias("status"), F.coalesce("reason", F.when(invalid, "invalid JSON")).alias("reason"))


def stage_durations(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """finishes(task_id, stage, at_ms) with duration_ms since the stage's last start that isn't later; 0 without any start.

    Starts and finishes run in one order of time by task and stage, so this is a running maximum and no join.
    """
    both = starts.select("task_id", "stage", "at_ms", F.lit(0).alias("end")).union(finishes.select("task_id", "stage", "at_ms", F.lit(1)))
    before = Window.partitionBy("task_id", "stage").orderBy("at_ms", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = both.withColumn("started", F.max(F.when(F.col("end") == 0, F.col("at_ms"))).over(before)).where("end = 1")
    return timed.select("task_id", "stage", "at_ms", F.coalesce(F.col("at_ms") - F.col("started"), F.lit(0)).alias("duration_ms"))


def score_rows(scores: DataFrame) -> DataFrame:
    """scores(pkg_id, manifest, js, wxml, wxss, generated_ratio, verifier_passed, fallback_used, penalty) as rows for display:
    (pkg_id, place, metric, value, tone). A penalty has a row only where there is one."""
    c = F.col
    passed, used = F.coalesce("verifier_passed", F.lit(False)), F.coalesce("fallback_used", F.lit(False))
    row = lambda metric, value, tone=None: F.struct(F.lit(metric).alias("metric"), value.alias("value"), (tone if tone is not None else F.lit(None).cast("string")).alias("tone"))
    percent = lambda x: F.concat(x.cast("string"), F.lit("/100"))
    ratio = F.coalesce("generated_ratio", F.lit(0))
    rows = [
        *(row(name, percent(c(name))) for name in ("manifest", "js", "wxml", "wxss")),
        row("missing-page-files", F.concat(ratio.cast("string"), F.lit("%")), F.when(ratio > 0, "warning").otherwise("success")),
        row("verifier", passed.cast("string"), F.when(passed, "success").otherwise("warning")),
        row("fallback", used.cast("string"), F.when(used, "warning").otherwise("neutral")),
        F.when(c("penalty") > 0, row("fallback-adjustment", (-c("penalty")).cast("string"), F.lit("neutral"))),
    ]
    return scores.select("pkg_id", F.posexplode(F.array_compact(F.array(*rows))).alias("place", "x")).select("pkg_id", "place", "x.*")


def stage_attempts(stages: DataFrame) -> DataFrame:
    """Stage rows with attempt and status: partial before success before failed."""
    return merge.attempts(stages).withColumn("status", scalars.stage_status(F.col("success"), F.col("partial")))


def without_work_files(files: DataFrame, tasks: DataFrame, folders: tuple[str, ...] = ("input/", "fallback/", "raw/")) -> DataFrame:
    """files(task_id, path) after clean-up: finished tasks lose their input, fallback and raw trees."""
    done = tasks.where(F.col("status").isin(*TERMINAL)).select("task_id", F.lit(True).alias("__done"))
    work = F.lit(False)
    for f in folders:
        work = work | F.col("path").startswith(f)
    return files.join(done, "task_id", "left").where(F.col("__done").isNull() | ~work).drop("__done")


def stage_metrics(facts: DataFrame, stage: str, *names: str) -> DataFrame:
    """(task_id, stage, metric, value): a row for each number a stage reports."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value")) for n in names)))
    return facts.select("task_id", F.lit(stage).alias("stage"), pairs.alias("x")).select("task_id", "stage", "x.*").where("value is not null")
