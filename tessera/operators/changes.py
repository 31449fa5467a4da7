"""Changes before they are written: what may be added, resolved, planned or shown, and why not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import valid_destination
from tessera.operators.workflow import refused_operations


def judged_additions(fresh: DataFrame, notes: DataFrame, keys: DataFrame, normalize: Callable[[Column], Column]) -> DataFrame:
    """``(path, note_id, code)`` of notes to add, ``fresh(path, note_id, type, aliases, error_kind)``; code is null for those that may be.

    ``notes(note_id, path)`` and ``keys(key)`` are what is there. Notes of one batch that claim
    the same id, path or key are all refused, so that no order among them decides.
    """

    def taken(column: str, flag: str) -> DataFrame:
        twice = fresh.groupBy(column).agg(F.count("*").alias("n")).where("n > 1").select(column)
        return notes.select(column).union(twice).distinct().withColumn(flag, F.lit(True))

    names = F.concat(F.array("note_id"), F.coalesce("aliases", F.array().cast("array<string>")))
    claims = fresh.where("error_kind is null").select("path", F.explode(names).alias("name")).select("path", normalize(F.col("name")).alias("key")).where("key <> ''").distinct()
    shared = claims.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    collides = claims.join(keys.select("key").union(shared).distinct(), "key").select("path").distinct().withColumn("same_key", F.lit(True))
    joined = fresh.join(taken("note_id", "same_id"), "note_id", "left").join(taken("path", "same_path"), "path", "left").join(collides, "path", "left")
    code = (
        F.when(~valid_destination(F.col("path")), "invalid-destination")
        .when(F.col("error_kind").isNotNull(), F.col("error_kind"))
        .when((F.col("type") == "source") | F.col("note_id").startswith("source-"), "reserved-identity")
        .when(F.col("same_id"), "duplicate-id")
        .when(F.col("same_path"), "duplicate-path")
        .when(F.col("same_key"), "duplicate-identity")
    )
    return joined.select("path", "note_id", code.alias("code"))


def reverified(evidence: DataFrame, entries: DataFrame, asked: DataFrame) -> DataFrame:
    """``(id, note_id, outcome, status, attempts)`` of evidence checked again, ``asked(id, retry)``.

    Evidence is resolved if its note still has the entry, ``entries(note_id, id)``; else its
    target is missing and it stays for review. An id that is not known is not-found. A retry
    counts as an attempt where it resolves.
    """
    known = evidence.select("id", "note_id", "attempts", F.lit(True).alias("known"))
    there = entries.select("note_id", "id").distinct().withColumn("there", F.lit(True))
    joined = asked.groupBy("id").agg(F.max("retry").alias("retry")).join(known, "id", "left").join(there, ["id", "note_id"], "left")
    return joined.select(
        "id",
        "note_id",
        F.when(F.col("known").isNull(), "not-found").when(F.col("there"), "resolved").otherwise("target-missing").alias("outcome"),
        F.when(F.col("there"), "resolved").when(F.col("known"), "needs-review").alias("status"),
        (F.col("attempts") + F.when(F.col("there") & F.col("retry"), 1).otherwise(0)).alias("attempts"),
    )


#: Operations that author text, and so must name a source; fixed values.
AUTHORING = ("CreateNote", "UpdateSection", "AppendSection")


#: Operations on a note that must be there; fixed values.
TARGETING = (*AUTHORING[1:], "SetFrontmatterField", "AddAlias", "SetLink", "CreateRelationship", "ProposeMerge", "ProposeRename", "ProposeArchive")


def plan_findings(plans: DataFrame, require_sources: bool = True) -> DataFrame:
    """``(plan_id, code, severity)`` of plans ``(plan_id, op, note_type, sources, evidence_states)`` that their own fields give.

    An error blocks a plan; a gate only keeps it from being applied without review.
    """
    code = F.when(F.col("code") == "operation-forbidden", "schema-invalid").otherwise(F.col("code"))
    found = refused_operations(plans).select("plan_id", code.alias("code"), F.lit("error").alias("severity"))
    none = F.coalesce(F.size("sources"), F.lit(0)) < 1
    rules = [
        ((F.col("op") == "CreateNote") & (F.trim(F.coalesce("note_type", F.lit(""))) == ""), "path-policy-violation", "error"),
        (F.col("op").isin(*AUTHORING) & none & F.lit(require_sources), "missing-provenance", "error"),
        (F.exists("evidence_states", lambda s: ~s.eqNullSafe("valid")), "evidence-not-valid", "gate"),
    ]
    checks = F.filter(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for when, code, severity in rules)), lambda x: x.isNotNull())
    return found.unionByName(plans.select("plan_id", F.explode(checks).alias("f")).select("plan_id", "f.code", "f.severity"))


def target_findings(plans: DataFrame, notes: DataFrame, keys: DataFrame, normalize: Callable[[Column], Column]) -> DataFrame:
    """``(plan_id, code, severity)`` of plans ``(plan_id, op, target, alias, object)`` against the notes and ``keys(key, note_id)`` that are there.

    A new note's id and a new alias may not be another note's; what an operation works on or
    points to must be there.
    """
    error = F.lit("error").alias("severity")
    owners = keys.groupBy("key").agg(F.min("note_id").alias("first"), F.max("note_id").alias("last"))
    claims = plans.where(F.col("op").isin("CreateNote", "AddAlias")).select("plan_id", "op", "target", normalize(F.when(F.col("op") == "AddAlias", F.col("alias")).otherwise(F.col("target"))).alias("key"))
    own = (F.col("op") == "AddAlias") & (F.col("first") == F.col("target")) & (F.col("last") == F.col("target"))
    clash = claims.join(owners, "key").where(~own).select("plan_id")
    ids = notes.select(F.col("note_id").alias("named")).distinct()
    again = plans.where("op = 'CreateNote'").select("plan_id", F.col("target").alias("named")).join(ids, "named", "left_semi").select("plan_id")
    named = F.when(F.col("op") == "CreateRelationship", F.array("target", "object")).when(F.col("op").isin(*TARGETING), F.array("target"))
    absent = plans.select("plan_id", F.explode(named).alias("named")).join(ids, "named", "left_anti").select("plan_id")
    return clash.union(again).distinct().select("plan_id", F.lit("identity-collision").alias("code"), error).unionByName(absent.distinct().select("plan_id", F.lit("dangling-note").alias("code"), error))


def plan_verdicts(plans: DataFrame, findings: DataFrame) -> DataFrame:
    """``(plan_id, ok, unattended)``: ok without an error, to be applied unattended without a gate either."""
    f = findings.groupBy("plan_id").agg(F.max(F.col("severity") == "error").alias("error"), F.max(F.col("severity") == "gate").alias("gate"))
    ok = ~F.coalesce("error", F.lit(False))
    return plans.select("plan_id").join(f, "plan_id", "left").select("plan_id", ok.alias("ok"), (ok & ~F.coalesce("gate", F.lit(False))).alias("unattended"))


def applicable(plans: DataFrame, verdicts: DataFrame, notes: DataFrame) -> DataFrame:
    """Plans ``(plan_id, note_id, grounded_hash, ...)`` with the ``outcome`` of their grounding: refused, target-missing, stale or ready.

    A plan holds for the text that it was made from; where the note has changed since, it is stale and nothing is written.
    """
    now = notes.select("note_id", F.col("content_hash").alias("now_hash"))
    joined = plans.join(verdicts.select("plan_id", "ok"), "plan_id", "left").join(now, "note_id", "left")
    outcome = F.when(~F.coalesce("ok", F.lit(False)), "refused").when(F.col("now_hash").isNull(), "target-missing").when(~F.col("grounded_hash").eqNullSafe(F.col("now_hash")), "stale").otherwise("ready")
    return joined.withColumn("outcome", outcome).select(*plans.columns, "outcome")


def shown_sources(sources: DataFrame, handles: DataFrame) -> DataFrame:
    """The source that each of ``handles(handle)`` names by id or else by locator, ``found`` false where none does."""
    rows = sources.select("id", "kind", "locator", "title", "added_at")
    named = rows.select(F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.col("id").alias("handle")), F.struct(F.lit(1).alias("tier"), F.col("locator").alias("handle")))).alias("n"), F.struct(*rows.columns).alias("s"))
    hit = named.groupBy(F.col("n.handle").alias("handle")).agg(F.min_by("s", F.struct("n.tier", "s.id")).alias("s"))
    return handles.select("handle").distinct().join(hit, "handle", "left").select("handle", F.col("s").isNotNull().alias("found"), "s.*")
