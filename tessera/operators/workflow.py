"""Queues, runs, evidence and pages: the relational reads and state transitions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import backoff_delay
from tessera.operators.durable import run_once

#: Exit codes from most to least urgent, fixed values.
EXIT_ORDER = (4, 2, 1, 7, 6, 5, 0)
TERMINAL = ("succeeded", "failed", "cancelled")
#: Operations that a change plan may hold, and those kept for later, fixed values.
OPERATIONS = ("CreateNote", "UpdateSection", "AppendSection", "SetFrontmatterField", "AddAlias", "SetLink", "CreateRelationship", "ProposeMerge", "ProposeRename", "ProposeArchive")
RESERVED = ("CreateTask", "UpdateTaskState")


def page(df: DataFrame, order: Sequence[Column | str], limit: int = 50, offset: int = 0, total: int | None = None) -> tuple[DataFrame, dict]:
    """One page in order and its envelope; an offset at or past the end, other than 0, is an error."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be from 1 to 500 and offset not negative")
    total = df.count() if total is None else total
    if offset and offset >= total:
        raise ValueError(f"offset {offset} is past the end, {total}")
    rows = max(0, min(limit, total - offset))
    return df.orderBy(*order).offset(offset).limit(limit), {"limit": limit, "offset": offset, "total": total, "hasMore": offset + rows < total}


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal each value that is given; None asks for nothing."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def needs_attention(evidence: DataFrame) -> DataFrame:
    """Evidence that is not resolved; no status needs attention too."""
    return evidence.where(~F.col("status").eqNullSafe("resolved"))


def effective_evidence(evidence: DataFrame, notes: DataFrame) -> DataFrame:
    """What evidence is worth now: its note may be gone, then its section, then the note may have changed."""
    n = notes.select("note_id", F.lit(True).alias("found"), "section_paths", F.col("content_hash").alias("now_hash"))
    joined = evidence.join(n, "note_id", "left")
    state = (
        F.when(F.col("found").isNull(), "note-missing")
        .when(F.col("section_path").isNotNull() & ~F.coalesce(F.array_contains("section_paths", F.col("section_path")), F.lit(False)), "section-missing")
        .when(~F.col("source_note_hash").eqNullSafe(F.col("now_hash")), "stale")
        .otherwise(F.coalesce("status", F.lit("pending")))
    )
    return joined.withColumn("effective", state).drop("found", "section_paths", "now_hash")


def fold_evidence(notes: DataFrame) -> DataFrame:
    """Evidence rows of ``notes(note_id, content_hash, evidence array)``, stamped with the note's hash; a bad row fails the fold."""
    e = notes.select("note_id", F.col("content_hash").alias("source_note_hash"), F.explode("evidence").alias("e"))
    bad = F.col("e.id").isNull() | (F.col("e.id") == "") | ~F.coalesce("e.status", F.lit("pending")).isin("pending", "resolved", "failed", "needs-review") | (F.coalesce("e.attempts", F.lit(0)) < 0)
    e = e.withColumn("id", F.when(bad, F.raise_error(F.concat(F.lit("bad evidence in "), "note_id"))).otherwise(F.col("e.id")))
    return e.select("id", "note_id", "source_note_hash", F.coalesce("e.status", F.lit("pending")).alias("status"), F.coalesce("e.attempts", F.lit(0)).alias("attempts"))


def eligible(jobs: DataFrame, now: Column, taken: DataFrame | None = None) -> DataFrame:
    ready = jobs.where((F.col("state") == "pending") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= now)) & (F.col("attempts") < F.col("max_attempts")))
    return ready if taken is None else ready.join(taken.select("job_id"), "job_id", "left_anti")


def claim(jobs: DataFrame, now: Column, n: int = 1, taken: DataFrame | None = None) -> DataFrame:
    """The next n jobs: those never scheduled first, then by due time and id."""
    return eligible(jobs, now, taken).orderBy(F.col("next_run_at").asc_nulls_first(), "job_id").limit(n)


def enqueue(jobs: DataFrame, fresh: DataFrame) -> DataFrame:
    """Jobs to append: of each workflow and key not queued yet, the one of least id."""
    key = ["workflow", "idempotency_key"]
    rest = [c for c in fresh.columns if c not in (*key, "job_id")]
    first = fresh.groupBy(*key).agg(F.min(F.struct("job_id", *rest)).alias("r")).select(*key, "r.*")
    return first.join(jobs.select(*key), key, "left_anti").select(*fresh.columns)


def settle(jobs: DataFrame, outcomes: DataFrame, now_ms: Column) -> DataFrame:
    """The next state of each running job for ``outcomes(job_id, attempt, outcome, error_class)``.

    An outcome of another attempt than the current is stale and changes nothing; a
    cancellation wins over failure; a transient failure runs again after a backoff while
    attempts are left.
    """
    o = outcomes.select("job_id", F.col("attempt").alias("of"), "outcome", "error_class")
    joined = jobs.join(o, "job_id", "left")
    live = (F.col("state") == "running") & (F.col("of") == F.col("attempts"))
    again = (F.col("error_class") == "transient") & (F.col("attempts") < F.col("max_attempts"))
    state = F.when(
        F.coalesce(live, F.lit(False)),
        F.when(F.col("outcome") == "ok", "succeeded").when(F.col("error_class") == "cancelled", "cancelled").when(again, "pending").otherwise("failed"),
    ).otherwise(F.col("state"))
    due = F.when(F.coalesce(live & again & (F.col("outcome") != "ok"), F.lit(False)), now_ms + backoff_delay(F.col("job_id"), F.col("attempts"))).otherwise(F.col("next_run_at"))
    return joined.withColumn("next_run_at", due).withColumn("state", state).select(*jobs.columns)


def recover(jobs: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Running jobs of dead runners: cancelled if asked for, failed without attempts left, else pending."""
    asked = cancelled.select("job_id", F.lit(True).alias("asked")).distinct()
    state = F.when(F.col("asked"), "cancelled").when(F.col("attempts") >= F.col("max_attempts"), "failed").otherwise("pending")
    return jobs.where("state = 'running'").join(asked, "job_id", "left").withColumn("state", state).drop("asked")


def with_last_error(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Each job with the error of the last attempt that had one: the correlated lookup as one group and a left join. job_order() orders them."""
    last = attempts.where("error_code is not null").groupBy("job_id").agg(F.max_by("error_code", "attempt_no").alias("last_error"))
    return jobs.join(last, "job_id", "left")


def newest_first(at: str, id_: str) -> list[Column]:
    """The order of lists and histories: latest first, without a time last, then by id."""
    return [F.col(at).desc_nulls_last(), F.col(id_).asc()]


def job_order() -> list[Column]:
    """The order of the list of jobs: newest first, of equal ones the greater id."""
    return [F.col("created_at").desc_nulls_last(), F.col("job_id").desc()]


def evidence_order() -> list[Column]:
    """The order of evidence in projections: by note, then oldest first, without a time before all, then by id."""
    return [F.col("note_id").asc(), F.col("created_at").asc_nulls_first(), F.col("id").asc()]


def rollup(outcomes: DataFrame) -> DataFrame:
    """Counts of a drain's outcomes and the exit code that stands for all."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, EXIT_ORDER)), F.col("exit_code").cast("int")), F.lit(0)), F.lit(99))
    return outcomes.agg(
        F.count("*").alias("jobs"),
        *(F.count_if(F.col("state") == s).alias(s) for s in (*TERMINAL, "pending")),
        F.coalesce(F.min_by("exit_code", place), F.lit(0)).alias("exit_code"),
    )


def run_all(jobs: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], now: Column) -> tuple[DataFrame, DataFrame]:
    """(the next jobs table, ``items(job_id, outcome, error_code, exit_code)``) of one drain of the queue.

    Every job that is due is claimed once and given, with those of its workflow, to the
    workflow's handler, which returns ``(job_id, outcome, error_class, error_code)``. A job
    without a handler or without an answer fails as ``internal``, to be tried again while
    attempts are left; of several answers the least counts. A lost executor may have a handler
    see a job twice, so handlers must be idempotent.
    """
    claimed = eligible(jobs, now).withColumn("state", F.lit("running")).withColumn("attempts", F.col("attempts") + 1)
    answers = claimed.where("false").select("job_id", *(F.lit(None).cast("string").alias(c) for c in ("outcome", "error_class", "error_code")))
    for workflow, handler in handlers.items():
        answers = answers.unionByName(handler(claimed.where(F.col("workflow") == workflow)).select(*answers.columns))
    answers = answers.where("outcome is not null").groupBy("job_id").agg(F.min(F.struct("outcome", "error_class", "error_code")).alias("a")).select("job_id", "a.*")
    missing = F.col("outcome").isNull()
    answered = claimed.join(answers, "job_id", "left").select(
        *claimed.columns,
        F.coalesce("outcome", F.lit("failed")).alias("outcome"),
        F.when(missing, "transient").otherwise(F.col("error_class")).alias("error_class"),
        F.when(missing, "internal").otherwise(F.col("error_code")).alias("error_code"),
    )
    answered = run_once(answered)
    settled = settle(answered.select(*jobs.columns), answered.select("job_id", F.col("attempts").alias("attempt"), "outcome", "error_class"), now)
    code = F.coalesce("error_code", F.lit("internal"))
    exit_code = F.when(F.col("state") != "failed", 0).when(code == "internal", 4).when(code.startswith("locked:"), 2).when(F.col("error_class") == "transient", 7).otherwise(1)
    items = settled.select("job_id", "state").join(answered.select("job_id", "error_class", "error_code"), "job_id")
    items = items.select("job_id", F.when(F.col("state") == "pending", "retry-scheduled").otherwise(F.col("state")).alias("outcome"), "error_code", exit_code.alias("exit_code"))
    return jobs.join(answered.select("job_id"), "job_id", "left_anti").select(*jobs.columns).unionByName(settled), items


def refused_operations(operations: DataFrame) -> DataFrame:
    """Operations of ``(op, ...)`` that may not run, each with its ``code``; an unknown or missing name is refused."""
    op = F.coalesce("op", F.lit(""))
    return operations.withColumn("code", F.when(op.isin(*RESERVED), "reserved-operation").when(~op.isin(*OPERATIONS), "operation-forbidden")).where("code is not null")


def event_kind(status: Column) -> Column:
    return F.when(status == "integrated", "changed").when(status == "failed", "attempt-failed").when(status == "cancelled", "attempt-cancelled").otherwise("in-progress")


def note_history(runs: DataFrame, git_operations: DataFrame) -> DataFrame:
    """Runs with the commit that integrated each; newest_first() orders them. What the join asks of the right side stays in the join."""
    g = git_operations.where("op_type = 'integrate' and status = 'done'").select("run_id", "commit_id")
    return runs.join(g, "run_id", "left").select("run_id", "note_id", "started_at", event_kind(F.col("status")).alias("kind"), "commit_id")


def latest_by(df: DataFrame, key: str, order: Sequence[str], *columns: str) -> DataFrame:
    """The last row of each key."""
    return df.groupBy(key).agg(F.max(F.struct(*order, *(c for c in columns if c not in order))).alias("r")).select(key, *(f"r.{c}" for c in columns))


def latest_plans(patches: DataFrame, plans: DataFrame) -> DataFrame:
    """Each run's newest patch of those whose plan is known."""
    return latest_by(patches.join(plans.select("plan_id", "run_id"), "plan_id"), "run_id", ("created_at", "patch_id"), "patch_id", "plan_id", "created_at")


def orphan_worktrees(git_operations: DataFrame, runs: DataFrame) -> DataFrame:
    return git_operations.where("op_type = 'worktree' and status = 'open'").join(runs.where(F.col("status").isin("failed", "cancelled", "integrated")).select("run_id"), "run_id")


def run_report(git_operations: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Operations of each run by type, the types in columns."""
    return git_operations.groupBy("run_id").pivot("op_type", list(kinds)).agg(F.count(F.lit(1))).fillna(0)


def stale_slots(slots: DataFrame, runs: DataFrame) -> DataFrame:
    """Idempotency slots in progress whose run is unknown or over."""
    r = runs.select("run_id", F.col("status").alias("run_status"))
    return slots.where("state = 'in-progress'").join(r, "run_id", "left").where(F.col("run_status").isNull() | F.col("run_status").isin("failed", "cancelled", "integrated"))


def claim_slot(asked: DataFrame, slots: DataFrame) -> DataFrame:
    """started, replay, conflict or in-progress for requests ``(command, idempotency_key, request_hash)``."""
    s = slots.select("command", "idempotency_key", F.col("request_hash").alias("held"), "state")
    verdict = F.when(F.col("held").isNull(), "started").when(F.col("held") != F.col("request_hash"), "conflict").when(F.col("state") == "done", "replay").otherwise("in-progress")
    return asked.join(s, ["command", "idempotency_key"], "left").select("command", "idempotency_key", verdict.alias("verdict"))


#: Statuses that a run may go to from each, fixed values.
TRANSITIONS = {
    "created": ("planning", "failed", "cancelled"),
    "planning": ("planned", "failed", "cancelled"),
    "planned": ("validating", "failed", "cancelled"),
    "validating": ("validated", "failed", "cancelled"),
    "validated": ("applying", "failed", "cancelled"),
    "applying": ("applied", "failed", "cancelled"),
    "applied": ("integrating", "failed", "cancelled"),
    "integrating": ("integrated", "failed"),
}


def invalid_transitions(log: DataFrame) -> DataFrame:
    """Steps of ``log(run_id, seq, status)`` that the table of transitions does not have."""
    before = F.lag("status").over(Window.partitionBy("run_id").orderBy("seq"))
    good = F.concat_ws(">", "previous", "status").isin(*(f"{a}>{b}" for a, bs in TRANSITIONS.items() for b in bs))
    return log.withColumn("previous", before).where(F.col("previous").isNotNull() & ~good)


def maintenance_issues(notes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Orphan notes and notes with evidence to look at, once each."""
    from tessera.operators.graph import orphan_notes

    orphans = orphan_notes(notes, edges).select("note_id", F.lit("orphan").alias("issue"))
    open_ = needs_attention(evidence).select("note_id", F.concat(F.lit("evidence-"), F.coalesce("status", F.lit("unknown"))).alias("issue"))
    return orphans.unionByName(open_).dropDuplicates(["note_id", "issue"])


def register_sources(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Sources to append, one for each locator that is not registered; a locator with a scheme is a URL."""
    kind = F.when(F.col("locator").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), "url").otherwise("file")
    new = fresh.join(stored.select("locator"), "locator", "left_anti").groupBy("locator").agg(F.min_by("title", "added_at").alias("title"), F.min("added_at").alias("added_at"))
    return new.select(F.concat(F.lit("src_"), F.substring(F.sha2("locator", 256), 1, 16)).alias("id"), kind.alias("kind"), "locator", "title", "added_at")
