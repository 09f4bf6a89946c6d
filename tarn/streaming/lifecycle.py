"""The life of a task as keyed state: each status it reports is accepted, or refused with a reason.

A task is queued, goes through STAGES in order, and ends. Stages in OPTIONAL may be left out. A task that hasn't ended may fail at any time, and
may be queued again, which starts it over (an interrupted attempt); it ends as completed or partial only from the last stage. What has ended
stays so: whatever comes later is refused. State is one row a task, kept in the state store; it is never removed, as a late report must find the end.
"""

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tarn.session import ship

# Statuses in the order of a task's life with the percentage each begins at, those that may be left out, those that end it.
STAGES = {
    "queued": 0, "classifying": 5, "decrypting": 15, "unpacking": 32, "normalizing": 48, "recovering_manifest": 58, "recovering_js": 66, "recovering_wxml": 72,
    "recovering_wxss": 78, "fallback_recovering": 82, "formatting": 84, "verifying": 86, "packaging": 94,
}
OPTIONAL = ("fallback_recovering", "formatting")
ENDED = ("completed", "partial", "failed")

STATE = "status string, percent int, attempt int"
OUTPUT = "task_id string, seq long, status string, was string, percent int, attempt int, refused string"
_ORDER = list(STAGES)


def refusal(was: str | None, status: str | None) -> str | None:
    """Why a task of status `was` (None: unknown) can't become `status`; None if it can."""
    if status not in STAGES and status not in ENDED:
        return "unknown status"
    if was is None:
        return None if status == "queued" else "not queued"
    if was in ENDED:
        return "already ended"
    if status == "failed":
        return None
    if status in ENDED:
        return None if was == _ORDER[-1] else "too early"
    if status == "queued":
        return "already queued" if was == "queued" else None
    here, there = _ORDER.index(was), _ORDER.index(status)
    if there <= here:
        return "repeated" if there == here else "backwards"
    return None if all(s in OPTIONAL for s in _ORDER[here + 1 : there]) else "skips a stage"


def moved(state: tuple[str, int, int] | None, status: str) -> tuple[str, int, int]:
    """The state after an accepted status: a failed task keeps its percentage, other ends have all of it."""
    _, percent, attempt = state or (None, 0, 0)
    if status == "queued":
        return status, 0, attempt + 1
    return status, percent if status == "failed" else STAGES.get(status, 100), attempt


class LifecycleProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = tuple(self.state.get()) if self.state.exists() else None
        names = [f.split()[0] for f in OUTPUT.split(", ")]
        for r in sorted(rows, key=lambda r: (r["seq"] is not None, r["seq"], str(r["status"]))):
            was = state[0] if state else None
            why = refusal(was, r["status"])
            if why is None:
                state = moved(state, r["status"])
            _, percent, attempt = state or (None, None, None)
            yield Row(*names)(key[0], r["seq"], r["status"], was, percent, attempt, why)
        if state is not None:
            self.state.update(state)

    def close(self) -> None:
        pass


def lifecycle(reports: DataFrame) -> DataFrame:
    """reports(task_id, seq, status), a stream or a table, with what each was met by: refused is null, or why it was.

    Reports of one batch count in the order of seq. Rows without a task are left out. accepted() and refused() tell the outputs apart.
    """
    ship(reports.sparkSession)
    rows = reports.selectExpr("cast(task_id as string) as task_id", "cast(seq as long) as seq", "cast(status as string) as status").where("task_id is not null")
    return rows.groupBy("task_id").transformWithState(statefulProcessor=LifecycleProcessor(), outputStructType=StructType.fromDDL(OUTPUT), outputMode="append", timeMode="none")


def accepted(told: DataFrame) -> DataFrame:
    return told.where("refused is null").drop("refused")


def refused(told: DataFrame) -> DataFrame:
    return told.where("refused is not null")
