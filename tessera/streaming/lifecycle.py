"""The life of jobs as a stream: each job's state is kept, by blocks of jobs, and waiting ends by a timer.

The rules are those of ``workflow.settle`` and ``workflow.recover``, applied to one job's events
in their order as they come.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.operators.workflow import TERMINAL

#: What comes in, and what goes out for each change of a state.
EVENTS = "job_id long, seq long, at timestamp, kind string, attempt long, outcome string, error_class string, max_attempts long"
CHANGES = "job_id long, seq long, kind string, state string, attempts long, next_run_at long, cancel_asked boolean"
_STATES = "jobs array<struct<job_id:bigint,state:string,attempts:bigint,max_attempts:bigint,next_run_at:bigint,cancel_asked:boolean,seq:bigint>>"
_change = Row(*(c.split()[0] for c in CHANGES.split(", ")))
#: So many ids of jobs are one key of the stream at most.
BLOCK = 64
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def delay_ms(job_id: int, attempt: int, base: float = 1000.0, factor: float = 2.0, most: float = 300_000.0) -> int:
    """hashing.backoff_delay() of one job."""
    share = int(hashlib.sha256(f"{job_id}:{attempt}".encode()).hexdigest()[:12], 16) / float(1 << 48)
    return int(share * min(most, base * factor ** (attempt - 1)))


def step(job_id: int, now: tuple | None, event) -> tuple | None:
    """The state after one event, the same if the event does not apply; None for a job not queued yet.

    Terminal states stay. An outcome of another attempt than the current is stale; a transient
    failure waits while attempts are left; a runner that is lost gives its job back, unless it
    was asked to stop or has no attempts left.
    """
    kind, seq = event.kind, int(event.seq)
    if now is None:
        return ("pending", 0, int(event.max_attempts), None, False, seq) if kind == "queued" else None
    state, attempts, most, due, asked, last = now
    if seq <= last:  # delivered again
        return now
    if state in TERMINAL:
        return (*now[:5], seq)
    if kind == "claimed" and state == "pending" and attempts < most:
        state, attempts, due = "running", attempts + 1, None
    elif kind == "cancel":
        asked = True
        state = "cancelled" if state == "pending" else state
    elif kind == "ended" and state == "running" and event.attempt == attempts:
        again = event.error_class == "transient" and attempts < most
        if event.outcome == "ok":
            state = "succeeded"
        elif event.error_class == "cancelled":
            state = "cancelled"
        elif again:
            state, due = "pending", int(event.at.timestamp() * 1000) + delay_ms(job_id, attempts)
        else:
            state = "failed"
    elif kind == "lost" and state == "running":
        state = "cancelled" if asked else "failed" if attempts >= most else "pending"
    return state, attempts, most, due, asked, seq


def _event(text: str) -> SimpleNamespace:
    told = SimpleNamespace(**json.loads(text))
    told.at = None if told.at is None else _EPOCH + timedelta(microseconds=told.at)
    return told


class Lifecycle(StatefulProcessor):
    """The states of a block of jobs, and a timer for when one that failed may run again.

    A state is asked for and written by a call to the JVM, which costs more than the steps of
    a job; so jobs whose ids lie together, ``BLOCK`` at most, have one value. Each job's steps
    are its own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", _STATES)

    def _held(self) -> dict[int, tuple]:
        held = self.jobs.get()
        return {} if held is None else {j[0]: tuple(j[1:]) for j in held[0]}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, out = self._held(), []
        states, due = dict(before), set()
        for event in sorted((_event(r["event"]) for r in rows), key=lambda e: e.seq):
            job_id = event.job_id
            now = states.get(job_id)
            after = step(job_id, now, event)
            if after is None:
                continue
            if now is None or after[:5] != now[:5]:
                out.append(_change(job_id, int(event.seq), event.kind, after[0], after[1], after[3], after[4]))
                if after[3] is not None:
                    due.add(after[3])
            states[job_id] = after
        for at in due:
            self.handle.registerTimer(at)
        if states != before:
            self.jobs.update(([(j, *state) for j, state in states.items()],))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        return iter([_change(j, now[5], "due", now[0], now[1], due, now[4]) for j, now in self._held().items() if now[0] == "pending" and now[3] == due])

    def close(self) -> None:
        pass


def changes(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The changes of state of a stream of ``events``; timers go by the events' own time.

    The events of one block of jobs in one batch are put in order in memory; the source's options,
    such as ``maxFilesPerTrigger``, bound a batch. Events that come again, or after later ones, change nothing.
    An event goes to Python as one text, since there each cell of a row is read by itself.
    """
    told = F.struct("job_id", "seq", F.unix_micros("at").alias("at"), "kind", "attempt", "outcome", "error_class", "max_attempts")
    watched = events.withWatermark("at", late).select("at", F.floor(F.col("job_id") / BLOCK).alias("block"), F.to_json(told, {"ignoreNullFields": "false"}).alias("event"))
    return watched.groupBy("block").transformWithState(Lifecycle(), CHANGES, "Append", "EventTime")


def follow_jobs(spark: SparkSession, events: DataFrame, folder: str, late: str = "0 seconds") -> StreamingQuery:
    """Start changes() into Parquet below ``folder``, where its checkpoint is too; it takes what is there and ends."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return changes(events, late).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
