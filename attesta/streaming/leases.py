"""Leases and stalls of jobs as a stream: what the queue's batch rules find at a clock, found when event time gets there.

Events are (job_id, event, at): queued, claimed, done, failed or stopped. Each job keeps its state, attempts and the time
of its last change; a timer stands at the end of its lease, or of the time in which a queued job should be claimed. Jobs
that have ended leave no state. Events of a job in one batch are taken in their order, and what was due between two of
them is told between them. State lies with RocksDB: run such queries within ``rocksdb``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.jobs import ATTEMPTS, LEASE_MINUTES

STALL_SECONDS = 90
OUT = "job_id long, what string, state string, attempts int, at timestamp"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for the queries started within; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class Leases(StatefulProcessor):
    def __init__(self, lease_ms: int, stall_ms: int, attempts: int) -> None:
        self.lease_ms, self.stall_ms, self.attempts = lease_ms, stall_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, attempts int, since long, told boolean")

    def _due(self, job: tuple | None) -> int | None:
        """When something is to be told of the job."""
        if job is None:
            return None
        state, attempts, since, told = job
        if state == "running":
            return since + self.lease_ms
        return since + self.stall_ms if attempts == 0 and not told else None

    def _until(self, job_id: int, job: tuple | None, now: int, out: list[Row]) -> tuple | None:
        """The job as it is at ``now``, what was due before being told."""
        while (due := self._due(job)) is not None and due < now:
            state, attempts, since, _ = job
            if state == "running":
                ended = attempts >= self.attempts
                out.append(Row(job_id=job_id, what="lease expired", state="failed" if ended else "queued", attempts=attempts, at_ms=due))
                job = None if ended else ("queued", attempts, due, True)
            else:
                out.append(Row(job_id=job_id, what="stalled", state=state, attempts=attempts, at_ms=due))
                job = (state, attempts, since, True)
        return job

    def _keep(self, job: tuple | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job is None:
            self.job.clear()
            return
        self.job.update(job)
        if (due := self._due(job)) is not None:
            self.handle.registerTimer(due + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        job = tuple(self.job.get()) if self.job.exists() else None
        out: list[Row] = []
        for r in sorted(rows, key=lambda r: (r.at_ms, r.event)):
            job = self._until(key[0], job, r.at_ms, out)
            attempts = job[1] if job else 0
            job = ("queued", attempts, r.at_ms, False) if r.event == "queued" else ("running", attempts + 1, r.at_ms, False) if r.event == "claimed" else None
        self._keep(job)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        out: list[Row] = []
        if self.job.exists():
            job = self._until(key[0], tuple(self.job.get()), expiredTimerInfo.getExpiryTimeInMs(), out)
            self._keep(job)
        yield from out

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if initialState.state in ("queued", "running"):
            self._keep((initialState.state, initialState.attempts, initialState.since_ms, False))

    def close(self) -> None:
        pass


def lease_events(events: DataFrame, jobs: DataFrame | None = None, late: str = "1 minute", minutes: int = LEASE_MINUTES, stall_seconds: int = STALL_SECONDS, attempts: int = ATTEMPTS) -> DataFrame:
    """(job_id, what, state, attempts, at): leases that expire and jobs that stall, each once, when event time is past it.

    ``jobs`` (job_id, state, attempts, since) is what the queue holds before the stream begins.
    """
    rows = events.withWatermark("at", late).select("job_id", "event", "at", F.unix_millis("at").alias("at_ms"))
    known = None if jobs is None else jobs.select("job_id", "state", "attempts", F.unix_millis("since").alias("since_ms")).groupBy("job_id")
    out = rows.groupBy("job_id").transformWithState(
        Leases(minutes * 60_000, stall_seconds * 1000, attempts), OUT.replace("at timestamp", "at_ms long"), outputMode="Append", timeMode="EventTime", initialState=known
    )
    return out.withColumn("at", F.timestamp_millis("at_ms")).drop("at_ms")
