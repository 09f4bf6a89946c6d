"""Folds over ordered events: retries, circuit breaker, task state. Groups are walked in order, never gathered whole."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.session import ship

# Attempts and backoff of the queue, thresholds of the breaker, order of terminal states.
MAX_ATTEMPTS, BACKOFF_MS = 3, 2000
LEASE_MS = 30 * 60 * 1000
FAILURES, SUCCESSES, OPEN_MS = 5, 2, 30_000
FINISHED = ("completed", "partial")


def retried(jobs: DataFrame) -> DataFrame:
    """jobs(task_id, outcomes array<boolean>) with attempts, wait_ms and state: done, dead or waiting.

    Attempt k that fails waits k times the backoff; the third failure goes to the dead letters.
    """
    tried = F.slice("outcomes", 1, MAX_ATTEMPTS)
    first = F.array_position(tried, True)
    n = F.when(first > 0, first).otherwise(F.size(tried)).cast("int")
    fails = F.when(first > 0, n - 1).otherwise(n)
    state = F.when(first > 0, "done").when(n >= MAX_ATTEMPTS, "dead").otherwise("waiting")
    backoffs = F.least(fails, F.lit(MAX_ATTEMPTS - 1))
    return jobs.withColumns({"attempts": n, "wait_ms": (backoffs * (backoffs + 1) / 2 * BACKOFF_MS).cast("long"), "state": state})


def claimable(jobs: DataFrame, now_ms: Column) -> DataFrame:
    """Jobs that may be taken: waiting ones whose time has come, and claimed ones whose lease ran out."""
    return jobs.where(((F.col("state") == "waiting") & (F.col("available_ms") <= now_ms)) | ((F.col("state") == "claimed") & (F.col("claimed_ms") + LEASE_MS < now_ms)))


def next_job(jobs: DataFrame, now_ms: Column, *keys: str) -> DataFrame:
    """The oldest job of each queue that may be taken."""
    return claimable(jobs, now_ms).groupBy(*keys).agg(F.min_by("task_id", F.struct("available_ms", "task_id")).alias("task_id"))


def breaker(calls: DataFrame) -> DataFrame:
    """calls(service, t_ms, ok) with allowed and state, in order of time for each service.

    Closed until FAILURES failures without a success between; then open for OPEN_MS after the last failure;
    then one probe at a time: SUCCESSES in a row close it, a failure opens it again. Calls end before the next.
    """
    ship(calls.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service, state, fails, wins, last = None, "closed", 0, 0, 0
        for batch in batches:
            allowed, states = [], []
            for s, t, ok in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != service:
                    service, state, fails, wins, last = s, "closed", 0, 0, 0
                if state == "open" and t - last > OPEN_MS:
                    state, wins = "half-open", 0
                go = state != "open"
                if go and ok:
                    fails, wins = 0, wins + 1
                    state = "closed" if state == "half-open" and wins >= SUCCESSES else state
                elif go:
                    last, fails = t, fails + 1
                    state = "open" if state == "half-open" or fails >= FAILURES else state
                allowed.append(go)
                states.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_()), pa.array(states, pa.string())], ["service", "t_ms", "ok", "allowed", "state"])

    ordered = calls.select("service", "t_ms", "ok").repartition("service").sortWithinPartitions("service", "t_ms")
    return ordered.mapInArrow(run, "service string, t_ms long, ok boolean, allowed boolean, state string")


def latest(events: DataFrame, key: str = "task_id") -> DataFrame:
    """The state of each task: its last event, but a finished task never goes back."""
    done = F.col("status").isin(*FINISHED)
    rank = F.struct(done, F.when(done, -F.col("seq")).otherwise(F.col("seq")))
    return events.groupBy(key).agg(F.max_by("status", rank).alias("status"), F.max("percent").alias("percent"), F.max("seq").alias("seq"))
