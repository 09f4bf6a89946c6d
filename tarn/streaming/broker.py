"""Task events as a stream: bounded history by task, delivery to a slow reader, idle expiry.

A task's state is its open history. "create" opens it; events of a task that isn't open are dropped; a terminal
event is delivered and releases the state; a task idle for IDLE_MS of processing time is released, too. A
reader takes BUFFER events a micro-batch: when that is full, later ones are lost, but a terminal event takes
the place of the oldest.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarn.session import ship

# Bounds of histories and buffers, idle time, terminal types.
HISTORY, BUFFER, IDLE_MS = 256, 64, 600_000
TERMINAL = ("complete", "partial", "error")

OUT = "task_id string, seq long, type string, status string, percent int, message string, history int"
STATE = "history string"
_COLUMNS = ["seq", "type", "status", "percent", "message"]


def publish(history: list[dict] | None, events: list[dict]) -> tuple[list[dict] | None, list[dict]]:
    """One micro-batch of one task: (history after it, or None if the task isn't open; what the reader gets)."""
    out: list[dict] = []
    for e in events:
        if e["type"] == "create":
            history = [] if history is None else history
            continue
        if history is None:
            continue
        history = [*history, e][-HISTORY:]
        seen = {**e, "history": len(history)}
        if len(out) < BUFFER:
            out.append(seen)
        elif e["type"] in TERMINAL:
            out = [*out[1:], seen]
        if e["type"] in TERMINAL:
            history = None
    return history, out


def deliveries(events: DataFrame) -> DataFrame:
    """events(task_id, seq, type, status, percent, message), streaming, to what each task's reader gets."""
    ship(events.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        history = json.loads(state.get[0]) if state.exists else None
        history, out = publish(history, [{k: (None if pd.isna(v) else v.item() if hasattr(v, "item") else v) for k, v in r.items()} for r in rows[_COLUMNS].to_dict("records")])
        if history is None:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(history),))
            state.setTimeoutDuration(IDLE_MS)
        if out:
            frame = pd.DataFrame(out)
            frame.insert(0, "task_id", key[0])
            yield frame.astype({"percent": "Int32"})

    return events.groupBy("task_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def merged(history: DataFrame, snapshots: DataFrame, live: DataFrame) -> DataFrame:
    """History, then polled snapshots, then live events; a snapshot that repeats (status, percent, message) is left out."""
    from pyspark.sql import functions as F

    from tarn.operators.merge import changed

    shown = changed(snapshots, ["task_id"], ["seq"], ["status", "percent", "message"])
    rank = lambda df, n: df.withColumn("source", F.lit(n))
    return rank(history, 0).unionByName(rank(shown, 1)).unionByName(rank(live, 2))
