"""Diagnostics: deduplication and grouping into classes that a reader can act on."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.merge import first_wins

# Classes in the order in which they are tried; "x.*" stands for a prefix.
CLASSES = (
    ("app-entry", "recover.js.app.missing"),
    ("page-logic", "recover.js.page.*"),
    ("unresolved-structure", "fallback.wxml.unresolved_fragments", "verify.wxml.unresolved_recovery_marker"),
    ("event-binding", "fallback.wxml.suspicious_event_bindings", "verify.wxml.suspicious_event_binding"),
    ("dynamic-event-binding", "verify.wxml.dynamic_event_binding"),
    ("recovery-placeholder", "verify.wxml.placeholder_sentinel"),
    ("page-structure-check", "verify.wxml.unparsable", "verify.wxml.missing_ref"),
    ("page-structure", "recover.wxml.*"),
    ("dynamic-structure", "fallback.wxml.opcode_skipped"),
    ("runtime-style", "fallback.wxss.data_parse_failed"),
    ("fallback-gap", "recover.fallback.*"),
    ("app-config", "manifest.*", "verify.manifest.*"),
    ("page-files", "verify.artifacts.partial"),
    ("source-parse", "verify.js.unparsable", "verify.wxss.unparsable"),
    ("formatting", "format.files.*"),
)
KEY = ("code", "severity", "stage", "file", "message")


def diagnostic_class(code: Column, severity: Column) -> Column:
    out = F.concat(F.lit("other-"), severity)
    for name, *patterns in reversed(CLASSES):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | (code.startswith(p[:-1]) if p.endswith("*") else code == p)
        out = F.when(hit, name).otherwise(out)
    return out


def dedupe(rows: DataFrame, *keys: str, seq: str = "seq") -> DataFrame:
    """The first of each (code, severity, stage, file, message); metadata doesn't count."""
    return first_wins(rows, [*keys, *KEY], [seq])


def dedupe_fallback(rows: DataFrame, *keys: str, seq: str = "seq") -> DataFrame:
    return first_wins(rows, [*keys, "code", "file"], [seq])


def grouped(rows: DataFrame, *keys: str, seq: str = "seq") -> DataFrame:
    """(class, n, tone, first_seq) by class, without infos; danger if any is an error. Order: danger, count, first seen."""
    shown = rows.where("severity <> 'info'").withColumn("class", diagnostic_class(F.col("code"), F.col("severity")))
    tone = F.when(F.bool_or(F.col("severity") == "error"), "danger").otherwise("warning")
    return shown.groupBy(*keys, "class").agg(F.count("*").alias("n"), tone.alias("tone"), F.min(seq).alias("first_seq"))


def _order() -> list[Column]:
    return [F.when(F.col("tone") == "danger", 0).otherwise(1), F.desc("n"), F.asc("first_seq")]


def in_order(groups: DataFrame) -> DataFrame:
    return groups.orderBy(*_order())


def placed(groups: DataFrame, *keys: str) -> DataFrame:
    """grouped() rows with their place in that order, from 1: a row for each class, so one window without keys is small."""
    window = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return groups.withColumn("place", F.row_number().over(window.orderBy(*_order())))


def short_list(rows: DataFrame, n: int = 10, width: int = 120, seq: str = "seq") -> DataFrame:
    """The first n warnings, their messages cut to width code points."""
    return rows.where("severity = 'warn'").orderBy(seq).limit(n).withColumn("message", F.left("message", F.lit(width)))
