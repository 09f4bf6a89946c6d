"""A reader's view of each task as one stream: history, then the stored snapshot, then live events, polls and keep-alives.

Three sources run through one stateful operator, as rows of INPUT told apart by their column `source`:

    event       what a worker says; type "create" opens a task's history, other types are its events
    snapshot    the task as it is stored, which counts whatever became of its events
    reader      type "open" or "close": somebody reads the task from now on, or no longer

State of a task: its open history (a list of at most HISTORY events, which expires with the state's own time to live too), the last
snapshot, and the reader's place. Timers of processing time poll the snapshot, keep the reader's connection alive and release a task
that is idle. State lives in the state store, so a restart from the checkpoint goes on where the stream was.

Rules: a task that isn't open drops its events. A reader first gets the history, then the snapshot if it says something else than the
last row did. A micro-batch delivers at most BUFFER events to a reader; of more the later ones are lost, but a terminal event takes the place
of the oldest. A poll delivers the snapshot if it is news, and a terminal one always ends the reading, so the end of a task reaches its
reader even where its events were lost. After a terminal row a task's state is released; a snapshot that comes later is kept for a later reader.

Needs the RocksDB state store (enable() sets it). Null task ids are left out; rows of one batch count in the order of seq.
"""

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tarn.session import ship
from tarn.streaming.broker import BUFFER, HISTORY, IDLE_MS, TERMINAL

# How often a snapshot is polled and a quiet connection kept alive; statuses that end a task.
POLL_MS, KEEP_ALIVE_MS = 1000, 15_000
ENDED = ("completed", "partial", "failed")

INPUT = "task_id string, source string, seq long, type string, status string, percent int, message string"
OUTPUT = "task_id string, via string, seq long, type string, status string, percent int, message string"
_EVENT = "seq long, type string, status string, percent int, message string"
_PLACE = "open boolean, reading boolean, told boolean, status string, percent int, message string, idle_at long, poll_at long, alive_at long"
_FIELDS = ("seq", "type", "status", "percent", "message")
_SAID = ("status", "percent", "message")


def enable(spark: SparkSession) -> None:
    """The state store that keyed state needs. Asking for the streams starts the store's coordinator, which a table's run needs, too."""
    assert spark.streams.active is not None
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Reading:
    """One task's state while a call of the processor works on it, apart from where it is stored."""

    def __init__(self, history: list[tuple], snapshot: tuple | None, place: dict[str, Any], limits: tuple[int, int, int]):
        self.history, self.snapshot, self.place = history, snapshot, place
        self.poll_ms, self.alive_ms, self.idle_ms = limits
        self.out: list[tuple] = []
        self.live = 0

    def say(self, via: str, row: tuple) -> None:
        self.out.append((via, *row))
        self.place.update(zip(_SAID, row[2:], strict=True), told=True)

    def news(self) -> bool:
        return self.snapshot is not None and not (self.place["told"] and self.snapshot[2:] == tuple(self.place[f] for f in _SAID))

    def touch(self, now: int) -> None:
        self.place["idle_at"] = now + self.idle_ms

    def close(self) -> None:
        """Nobody reads any more, or there is nothing left to read."""
        self.place.update(reading=False, told=False, status=None, percent=None, message=None, poll_at=None, alive_at=None)

    def release(self) -> None:
        self.history = []
        self.place.update(open=False, idle_at=None)
        self.close()

    def show(self, via: str) -> None:
        """The snapshot, if it says something new; a terminal one ends the reading."""
        if self.news():
            self.say(via, self.snapshot)
        if self.snapshot is not None and self.snapshot[2] in ENDED:
            self.release()

    def reader(self, kind: str, now: int) -> None:
        self.touch(now)
        if kind == "close":
            self.close()
            return
        self.close()
        self.place["reading"] = True
        for event in self.history:
            self.say("history", event)
        self.show("snapshot")
        if self.place["reading"]:
            self.place.update(poll_at=now + self.poll_ms, alive_at=now + self.alive_ms)

    def event(self, row: tuple, now: int) -> None:
        kind = row[1]
        if kind == "create":
            self.place["open"] = True
            self.touch(now)
            return
        if not self.place["open"]:
            return
        self.history = [*self.history, row][-HISTORY:]
        self.touch(now)
        ends = kind in TERMINAL
        if self.place["reading"]:
            if self.live >= BUFFER and ends:
                self.out.pop(next(i for i, r in enumerate(self.out) if r[0] == "live"))
                self.live -= 1
            if self.live < BUFFER:
                self.say("live", row)
                self.live += 1
        if ends:
            self.release()

    def due(self, now: int) -> None:
        """What timers that have run out ask for."""
        p = self.place
        if p["reading"] and p["poll_at"] is not None and p["poll_at"] <= now:
            p["poll_at"] = now + self.poll_ms
            self.show("poll")
        if p["reading"] and p["alive_at"] is not None and p["alive_at"] <= now:
            p["alive_at"] = now + self.alive_ms
            self.out.append(("keep-alive", None, None, None, None, None))
        if p["idle_at"] is not None and p["idle_at"] <= now:
            if p["reading"]:
                self.touch(now)
            else:
                self.release()


class FeedProcessor(StatefulProcessor):
    """Keeps each task's Reading in list and value state, and one timer for the next time at which something is due."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getListState("history", _EVENT, ttlDurationMs=2 * self.limits[2])
        self.snapshot = handle.getValueState("snapshot", _EVENT)
        self.place = handle.getValueState("place", _PLACE)

    def load(self) -> Reading:
        found = self.place.get() if self.place.exists() else None
        names = [f.split()[0] for f in _PLACE.split(", ")]
        place = dict(zip(names, found, strict=True)) if found else dict.fromkeys(names) | {"open": False, "reading": False, "told": False}
        history = [tuple(r) for r in self.history.get()] if place["open"] else []
        return Reading(history, tuple(self.snapshot.get()) if self.snapshot.exists() else None, place, self.limits)

    def store(self, key: tuple, reading: Reading) -> Iterator[Row]:
        p = reading.place
        if reading.history:
            self.history.put(reading.history)
        else:
            self.history.clear()
        if reading.snapshot is not None:
            self.snapshot.update(reading.snapshot)
        if p["open"] or p["reading"] or p["idle_at"] is not None:
            self.place.update(tuple(p.values()))
        else:
            self.place.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = [p[t] for t in ("idle_at", "poll_at", "alive_at") if p[t] is not None]
        if due:
            self.handle.registerTimer(min(due))
        names = OUTPUT.split(", ")
        for row in reading.out:
            yield Row(*(n.split()[0] for n in names))(key[0], *row)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        reading, now = self.load(), timerValues.getCurrentProcessingTimeInMs()
        order = {"snapshot": 0, "event": 1, "reader": 1}
        for r in sorted(rows, key=lambda r: (order.get(r["source"], 2), r["seq"] is not None, r["seq"])):
            row = tuple(r[f] for f in _FIELDS)
            if r["source"] == "snapshot":
                reading.snapshot = row
            elif r["source"] == "event":
                reading.event(row, now)
            elif r["source"] == "reader":
                reading.reader(r["type"], now)
        reading.due(now)
        yield from self.store(key, reading)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        reading = self.load()
        reading.due(max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()))
        yield from self.store(key, reading)

    def close(self) -> None:
        pass


def sources(events: DataFrame, snapshots: DataFrame, readers: DataFrame) -> DataFrame:
    """The three sources as one frame of INPUT: each has task_id, seq, and what it has of type, status, percent and message."""
    from pyspark.sql import functions as F

    kinds = {f.split()[0]: f.split()[1] for f in INPUT.split(", ")}
    shape = lambda df, name: df.select(*((F.lit(name) if c == "source" else F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))
    return shape(events, "event").unionByName(shape(snapshots, "snapshot")).unionByName(shape(readers, "reader"))


def feed(rows: DataFrame, poll_ms: int = POLL_MS, keep_alive_ms: int = KEEP_ALIVE_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """What the readers get, from the rows of sources(); via is history, snapshot, live, poll or keep-alive."""
    ship(rows.sparkSession)
    processor = FeedProcessor((poll_ms, keep_alive_ms, idle_ms))
    return rows.where("task_id is not null").groupBy("task_id").transformWithState(statefulProcessor=processor, outputStructType=StructType.fromDDL(OUTPUT), outputMode="append", timeMode="ProcessingTime")
