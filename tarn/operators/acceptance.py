"""Acceptance of a run's reports: expectations that are counted in the pass that writes them.

EXPECTATIONS names conditions over a report's JSON; each is true where the report breaks it. broken() lists them by report. judged() writes the
reports and observes, in the same pass, how many break each expectation: nothing is read again, and nothing but the counts reaches
the driver. A run with any broken expectation is refused by an exception that carries the counts; what was written then isn't to be published.

reports are (task_id, name, text). A text that isn't a JSON object breaks "object" and nothing else; a field that a report lacks breaks what asks for
it. Only reports named MAIN are asked for their status, score and files; all are asked for host paths.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# The report that carries the outcome, statuses, what a URL and a path of the host look like.
MAIN = "recovery-report"
STATUSES = ("completed", "partial", "failed")
URL = r"(?i)\b(?:https?|wss?|ftp)://[^\s\"'<>]+"
HOST_PATH = r"(?i)(?:/(?:app|data|etc|home|mnt|opt|output|root|run|srv|tmp|usr|users|var|workspace)/|[A-Z]:[\\/]|\\\\[^\\\s]+\\[^\\\s]+\\)"
UNCLEAN = ("wxmlPlaceholderCount", "wxmlUnresolvedMarkers", "wxmlSuspiciousEventBindings")


class Rejected(Exception):
    """counts: how many reports break each expectation."""

    def __init__(self, counts: dict[str, int]):
        super().__init__(", ".join(f"{k}: {n}" for k, n in counts.items() if n))
        self.counts = counts


def expectations() -> dict[str, Column]:
    """Conditions over text and name, true where a report breaks them."""
    v = F.try_parse_json("text")
    whole = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    count, files = get("$.artifacts.fileCount", "bigint"), get("$.artifacts.files", "array<string>")
    by_source = F.aggregate(F.map_values(get("$.artifacts.sourceBreakdown", "map<string,bigint>")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    unclean = [F.coalesce(get(f"$.verification.{m}", "bigint"), F.lit(0)) != 0 for m in UNCLEAN]
    finished = get("$.status", "string") != "failed"
    main = {
        "status": ~F.coalesce(get("$.status", "string").isin(*STATUSES), F.lit(False)),
        "verifier": ~F.coalesce(get("$.score.verifierPassed", "boolean"), F.lit(False)),
        "manifest": ~get("$.score.manifest", "bigint").eqNullSafe(F.lit(100)),
        "files": ~count.eqNullSafe(F.coalesce(F.size(files), F.lit(0)).cast("bigint")),
        "sources": ~count.eqNullSafe(F.coalesce(by_source, F.lit(0))),
        "unclean": reduce(lambda a, b: a | b, unclean),
        "archive": F.coalesce(finished, F.lit(False)) & ~F.coalesce(get("$.packaging.downloadReady", "boolean") & (get("$.packaging.archiveSize", "bigint") > 0), F.lit(False)),
    }
    leaks = F.coalesce(F.regexp_replace("text", URL, "").rlike(HOST_PATH), F.lit(False))
    is_main = F.coalesce(F.col("name") == MAIN, F.lit(False))
    return {"object": ~whole, "host path": whole & leaks} | {k: whole & is_main & c for k, c in main.items()}


def broken(reports: DataFrame) -> DataFrame:
    """(task_id, name, broken): the names of the expectations that each report breaks, in their order."""
    named = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in expectations().items())))
    return reports.select("task_id", "name", named.alias("broken"))


def judged(reports: DataFrame, path: str) -> dict[str, int]:
    """Writes the reports as Parquet below path, which must be new, and returns how many there are ("reports"); raises Rejected."""
    seen = Observation("acceptance")
    counted = [F.count_if(c).alias(k) for k, c in expectations().items()]
    reports.observe(seen, F.count(F.lit(1)).alias("reports"), *counted).write.parquet(path)
    counts = dict(seen.get)
    total = counts.pop("reports")
    if any(counts.values()):
        raise Rejected(counts)
    return {"reports": total}
