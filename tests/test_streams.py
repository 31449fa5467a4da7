"""Streams that keep state: the index kept up by batches, and the life of jobs."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tessera.operators import segments, workflow
from tessera.operators.publication import Store
from tessera.plans import commands
from tessera.streaming import lifecycle, sync


def changed(spark, folder, rows, name):
    spark.createDataFrame([(p, at, None if t is None else bytearray(t.encode())) for p, at, t in rows], "path string, at long, content binary").coalesce(1).write.parquet(f"{folder}/{name}")


def test_a_stream_keeps_the_index_up_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    from test_commands import NOTES, note

    source, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    stream = lambda: spark.readStream.schema("path string, at long, content binary").option("recursiveFileLookup", True).parquet(str(source))
    run = lambda: sync.keep_indexed(stream(), store, str(tmp_path / "checkpoint")).awaitTermination()
    texts = lambda: sorted((r["note_id"], r["text"].split("\n\n")[-1].strip()) for r in segments.served(store)[0].collect())
    changed(spark, source, [(p, 1, t) for p, t in NOTES.items()], "a")
    run()
    first = store.snapshot()
    assert first.version == 1 and first.facts == {"stream:vault": "0"} and len(texts()) == 5
    batch = [("alone.md", 2, note("alone", "First try.\n")), ("alone.md", 3, note("alone", "Second try.\n")), ("person.md", 2, None), ("bad.md", 2, "no fields"), ("meridian.md", 2, NOTES["meridian.md"]), ("retrieval.md", 2, note("renamed", "Another note in this file.\n"))]
    changed(spark, source, batch, "b")
    run()
    second, after = store.snapshot(), texts()
    assert second.version == 2 and second.facts == {"stream:vault": "1"}
    assert {n for n, _ in after} == {"alone", "meridian", "renamed"} and ("alone", "Second try.") in after
    again = spark.createDataFrame([(p, at, None if t is None else bytearray(t.encode())) for p, at, t in batch], "path string, at long, content binary")
    assert not sync.apply_batch(again, 1, store, "stream:vault") and not sync.apply_batch(again, 0, store, "stream:vault")
    assert store.snapshot() == second and texts() == after
    run()  # nothing new came
    assert store.snapshot() == second
    assert sync.apply_batch(again, 2, store, "stream:vault") and texts() == after


T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def scripted(n=60):
    r, events = random.Random(7), []
    for job in range(n):
        seq, attempt = 0, 0

        def add(kind, **x):
            nonlocal seq
            seq += 1
            events.append({"job_id": job, "seq": seq, "at": T0 + timedelta(seconds=seq), "kind": kind} | x)

        add("queued", max_attempts=r.randint(1, 3))
        for _ in range(r.randint(0, 5)):
            kind = r.choice(["claimed", "claimed", "claimed", "ended", "ended", "lost", "cancel"])
            attempt += kind == "claimed"
            add(kind, **({"attempt": r.choice([attempt, attempt, attempt - 1]), "outcome": r.choice(["ok", "failed", "failed"]), "error_class": r.choice(["transient", "permanent", "cancelled", None])} if kind == "ended" else {}))
    return events


class Event:
    def __init__(self, **x):
        self.__dict__.update({"attempt": None, "outcome": None, "error_class": None, "max_attempts": None} | x)


def rows_of(events):
    return [(e["job_id"], e["seq"], e["at"], e["kind"], e.get("attempt"), e.get("outcome"), e.get("error_class"), e.get("max_attempts")) for e in events]


@pytest.fixture(scope="module")
def followed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("jobs")
    events = scripted()
    late = [e for e in events if e["seq"] > 3]
    for k, part in enumerate(([e for e in events if e["seq"] <= 3], late, [late[0] | {"job_id": 10**6, "kind": "queued", "max_attempts": 1, "at": T0 + timedelta(days=1)}])):
        spark.createDataFrame(rows_of(part), lifecycle.EVENTS).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(lifecycle.EVENTS).parquet(str(folder / "in"))
        lifecycle.follow_jobs(spark, stream, str(folder / "out")).awaitTermination()
    return events, [r.asDict() for r in spark.read.parquet(str(folder / "out" / "changes")).collect()]


def test_streamed_states_are_those_of_the_steps(followed):
    events, out = followed
    want = {}
    for e in events:
        want[e["job_id"]] = lifecycle.step(e["job_id"], want.get(e["job_id"]), Event(**e))
    got = {}
    for r in sorted((r for r in out if r["kind"] != "due"), key=lambda r: r["seq"]):
        got[r["job_id"]] = (r["state"], r["attempts"], r["next_run_at"], r["cancel_asked"])
    got.pop(10**6)
    assert got == {j: (s[0], s[1], s[3], s[4]) for j, s in want.items()}
    assert len({s[0] for s in want.values()}) == 5
    due = {(r["job_id"], r["next_run_at"]) for r in out if r["kind"] == "due"}
    waiting = {(j, s[3]) for j, s in want.items() if s[0] == "pending" and s[3] is not None}
    assert waiting and waiting <= due  # the watermark has passed all of them


def test_steps_are_settle_and_recover(spark):
    jobs, outcomes = [], []
    r = random.Random(11)
    for j in range(200):
        jobs.append((j, r.choice(["running", "running", "running", "pending", "failed"]), r.randint(1, 3), 3, None))
        outcomes.append((j, r.choice([jobs[-1][2], jobs[-1][2], 9]), r.choice(["ok", "failed"]), r.choice(["transient", "permanent", "cancelled", None])))
    table = spark.createDataFrame(jobs, "job_id long, state string, attempts long, max_attempts long, next_run_at long")
    told = spark.createDataFrame(outcomes, "job_id long, attempt long, outcome string, error_class string")
    ms = int((T0 + timedelta(seconds=1)).timestamp() * 1000)
    want = {x["job_id"]: (x["state"], x["next_run_at"]) for x in workflow.settle(table, told, F.lit(ms)).collect()}
    for (j, state, n, most, due), (_, attempt, outcome, error) in zip(jobs, outcomes, strict=True):
        e = Event(job_id=j, seq=2, at=T0 + timedelta(seconds=1), kind="ended", attempt=attempt, outcome=outcome, error_class=error)
        s = lifecycle.step(j, (state, n, most, due, False, 1), e)
        assert (s[0], s[3]) == want[j]
    asked = spark.createDataFrame([(j,) for j in range(0, 200, 3)], "job_id long")
    want = {x["job_id"]: x["state"] for x in workflow.recover(table, asked).collect()}
    for j, state, n, most, due in jobs:
        s = lifecycle.step(j, (state, n, most, due, j % 3 == 0, 1), Event(job_id=j, seq=2, kind="lost"))
        assert s[0] == want.get(j, state)


def test_jobs_of_a_block_share_calls_and_keep_their_own_states_and_timers():
    class State:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    class Handle:
        def __init__(self):
            self.state, self.timers = State(), set()

        def getValueState(self, name, schema):
            return self.state

        def registerTimer(self, at):
            self.timers.add(at)

    class Expired:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

    handle, block = Handle(), lifecycle.Lifecycle()
    block.init(handle)
    scripts = [e for e in scripted() if e["job_id"] < lifecycle.BLOCK]
    want, out = {}, []
    for part in ([e for e in scripts if e["seq"] <= 3], [e for e in scripts if e["seq"] > 2]):  # one seq comes again
        told = [dict(zip((c.split()[0] for c in lifecycle.EVENTS.split(", ")), r, strict=True)) for r in rows_of(part)]
        out += block.handleInputRows((0,), iter([{"event": json.dumps(e | {"at": int(e["at"].timestamp() * 1_000_000)})} for e in told]), None)
    for e in scripts:
        want[e["job_id"]] = lifecycle.step(e["job_id"], want.get(e["job_id"]), Event(**e))
    assert handle.state.calls == 4 and {j[0]: tuple(j[1:]) for j in handle.state.value[0]} == want
    got = {r["job_id"]: (r["state"], r["attempts"], r["next_run_at"], r["cancel_asked"]) for r in out}
    assert got == {j: (s[0], s[1], s[3], s[4]) for j, s in want.items()}
    due = [(r["job_id"], r["next_run_at"]) for at in handle.timers for r in block.handleExpiredTimer((0,), None, Expired(at))]
    assert sorted(due) == sorted((j, s[3]) for j, s in want.items() if s[0] == "pending" and s[3] is not None) and due
