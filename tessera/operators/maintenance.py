"""Incremental maintenance: snapshot diff, generations, index upkeep.

State is versioned tables; an update is a join that gives the next version. One writer at a
time is assumed: a compare-and-swap is decided by the join and published by the caller's swap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(note_id, change)`` between two ``(note_id, path, content_hash)``: new, dropped, changed, moved.

    A note both edited and moved is changed; what is the same is left out.
    """
    a = old.select("note_id", F.col("path").alias("old_path"), F.col("content_hash").alias("old_hash"), F.lit(True).alias("before"))
    b = new.select("note_id", F.col("path").alias("new_path"), F.col("content_hash").alias("new_hash"), F.lit(True).alias("after"))
    change = (
        F.when(F.col("before").isNull(), "new")
        .when(F.col("after").isNull(), "dropped")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "changed")
        .when(~F.col("old_path").eqNullSafe(F.col("new_path")), "moved")
    )
    return a.join(b, "note_id", "full_outer").select("note_id", change.alias("change")).where("change is not null")


def diff_counts(diff: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(F.col("change") == c).alias(c)
    return diff.agg(*map(count, ("changed", "new", "dropped", "moved")), (F.count("*") == 0).alias("noop"))


def apply_notes(stored: DataFrame, touched: DataFrame) -> DataFrame:
    """The next notes table: rows of ``touched`` replace those of the same note_id, others stay."""
    return stored.join(touched.select("note_id"), "note_id", "left_anti").unionByName(touched)


def archive_missing(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """Notes that are gone keep their hash and become archived."""
    marked = gone.select("note_id", F.lit(True).alias("gone")).distinct()
    return stored.join(marked, "note_id", "left").withColumn("status", F.when(F.col("gone"), "archived").otherwise(F.col("status"))).drop("gone")


def config_epochs(adoptions: DataFrame) -> DataFrame:
    """Revision of each adoption of ``(owner, at, seq, config_key)``: the same config again changes nothing, another is the next number."""
    order = Window.partitionBy("owner").orderBy("at", "seq")
    step = F.coalesce((F.col("config_key") != F.lag("config_key").over(order)).cast("int"), F.lit(1))
    return adoptions.withColumn("step", step).withColumn("revision", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def activate(notes: DataFrame, proposals: DataFrame) -> DataFrame:
    """Each proposal ``(note_id, generation_id, content_hash, revision)`` taken if the note's hash is still that and no newer revision is active.

    Of several proposals for a note the one of the newest revision stands, of equal ones the least generation.
    """
    last = F.min_by(F.struct("generation_id", "content_hash", "revision"), F.struct(-F.col("revision"), "generation_id", "content_hash"))
    p = proposals.groupBy("note_id").agg(last.alias("p")).select("note_id", "p.*")
    p = p.select("note_id", F.col("generation_id").alias("proposed"), F.col("content_hash").alias("seen_hash"), "revision")
    ok = (F.col("seen_hash") == F.col("content_hash")) & (F.col("revision") >= F.coalesce("active_generation", F.lit(0)))
    return notes.join(p, "note_id").select(
        "note_id",
        F.coalesce(ok, F.lit(False)).alias("activated"),
        F.when(ok, F.col("revision")).otherwise(F.col("active_generation")).alias("active_generation"),
        F.when(ok, F.col("proposed")).otherwise(F.col("active_generation_id")).alias("active_generation_id"),
    )


def needs_index(notes: DataFrame, revision: int) -> DataFrame:
    return notes.where((F.col("active_generation") < revision) | F.col("active_generation_id").isNull())


def orphan_chunks(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """Chunks of generations that no note has active; with none active, all."""
    active = notes.where("active_generation_id is not null").select(F.col("active_generation_id").alias("generation_id"))
    return chunks.join(active, "generation_id", "left_anti")


def retire(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    active = notes.where("active_generation_id is not null").select(F.col("active_generation_id").alias("generation_id")).distinct()
    return chunks.join(active, "generation_id", "left_semi")


def merge_chunks(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of ``fresh`` whose chunk_id is not stored yet, once each: what an idempotent write appends."""
    return fresh.dropDuplicates(["chunk_id"]).join(stored.select("chunk_id"), "chunk_id", "left_anti")


def missing_chunks(expected: DataFrame, stored: DataFrame) -> DataFrame:
    return expected.join(stored.select("chunk_id"), "chunk_id", "left_anti")


def staleness(notes: DataFrame, expected: DataFrame) -> DataFrame:
    """indexed, stale with its triggers, or missing, for notes against ``expected(note_id, generation_id, content_hash, config_key)``."""
    e = expected.select("note_id", F.col("generation_id").alias("want"), F.col("content_hash").alias("want_hash"), F.col("config_key").alias("want_config"))
    joined = notes.join(e, "note_id", "left")
    triggers = F.filter(
        F.array(
            F.when(~F.col("content_hash").eqNullSafe(F.col("want_hash")), "content"),
            F.when(~F.col("config_key").eqNullSafe(F.col("want_config")), "config"),
        ),
        lambda t: t.isNotNull(),
    )
    state = F.when(F.col("active_generation_id").isNull(), "missing").when(F.col("active_generation_id").eqNullSafe(F.col("want")), "indexed").otherwise("stale")
    return joined.select("note_id", state.alias("state"), F.when(state == "stale", F.array_join(triggers, ",")).otherwise("").alias("triggers"))


def divergences(notes: DataFrame, chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """``(kind, subject)``: active notes without chunks, active generations that are out of date, generations nobody has active."""
    present = chunks.select("generation_id").distinct()
    active = notes.where("active_generation_id is not null").select("note_id", F.col("active_generation_id").alias("generation_id"))
    missing = active.join(present, "generation_id", "left_anti").select(F.lit("missing-chunks").alias("kind"), F.col("note_id").alias("subject"))
    want = expected.select("note_id", F.col("generation_id").alias("want"))
    stale = active.join(want, "note_id").where("generation_id <> want").select(F.lit("stale-active").alias("kind"), F.col("note_id").alias("subject"))
    orphan = present.join(active, "generation_id", "left_anti").select(F.lit("orphaned-generation").alias("kind"), F.col("generation_id").alias("subject"))
    return missing.unionByName(stale).unionByName(orphan)


def index_plan(notes: DataFrame, chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """What indexing does for each note, decided for all at once: empty, tombstone, unchanged, reattach or embed.

    ``expected(note_id, generation_id, chunk_id)`` has a row for each chunk that a note ought
    to have; ``chunks(generation_id, chunk_id)``. A generation is whole when every expected id
    is stored. Only notes to embed go to the embedder.
    """
    stored = chunks.select("generation_id", "chunk_id", F.lit(1).alias("there")).distinct()
    counts = expected.distinct().join(stored, ["generation_id", "chunk_id"], "left").groupBy("note_id", F.col("generation_id").alias("want"))
    counts = counts.agg(F.count("chunk_id").alias("n_chunks"), (F.count("chunk_id") - F.count("there")).alias("lacking"))
    joined = notes.join(counts, "note_id", "left")
    whole = F.coalesce(F.col("lacking") == 0, F.lit(False))
    action = (
        F.when(F.col("status") == "archived", "tombstone")
        .when(F.coalesce("n_chunks", F.lit(0)) == 0, "empty")
        .when(whole & F.col("active_generation_id").eqNullSafe(F.col("want")), "unchanged")
        .when(whole, "reattach")
        .otherwise("embed")
    )
    return joined.select("note_id", action.alias("action"), F.col("want").alias("generation_id"))


#: Outcomes of indexing that leave a note to be looked at, fixed values.
FAILED = ("embedding-failed", "write-incomplete")


def repaired(outcomes: DataFrame) -> DataFrame:
    """``(note_id, action)`` of the notes that a pass mended, for ``outcomes(note_id, kind, reattached, retired_chunks, chunk_count)``, one row a note.

    Notes that were right already, or that another writer got to first, need no entry.
    """
    retired = F.coalesce("retired_chunks", F.lit(0)) > 0
    action = F.when(F.col("kind") == "indexed", F.when(F.col("reattached"), "re-activated").otherwise("re-embedded")).when((F.col("kind") == "empty") & retired, "retired-orphan")
    return outcomes.select("note_id", action.alias("action")).where("action is not null")


def unresolved(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("kind").isin(*FAILED))


def rebuild_tally(outcomes: DataFrame) -> DataFrame:
    """One row: notes indexed, chunks written, generations retired, notes unresolved, and whether the pass converged."""
    done = F.col("kind") == "indexed"
    failed = F.count_if(F.col("kind").isin(*FAILED))
    return outcomes.agg(
        F.count_if(done | (F.col("kind") == "unchanged")).alias("notes_indexed"),
        F.coalesce(F.sum(F.when(done, F.col("chunk_count"))), F.lit(0)).cast("long").alias("chunks_written"),
        F.count_if(done & (F.col("retired_chunks") > 0)).alias("generations_retired"),
        failed.alias("unresolved"),
        F.when(failed > 0, "partial").otherwise("converged").alias("outcome"),
    )


def reconciled(asked: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(note_id, result)`` of the notes asked for: reembedded, unchanged or removed.

    A note without an outcome is not in the vault any more; one that could not be indexed fails the whole.
    """
    found = asked.select("note_id").distinct().join(outcomes, "note_id", "left")
    retired = F.coalesce("retired_chunks", F.lit(0)) > 0
    result = (
        F.when(F.col("kind").isNull() | (F.col("kind") == "empty") & retired, "removed")
        .when(F.col("kind") == "indexed", "reembedded")
        .when(F.col("kind").isin(*FAILED), F.raise_error(F.concat_ws(" ", F.lit("not converged:"), F.col("note_id").cast("string"), "kind")).cast("string"))
        .otherwise("unchanged")
    )
    return found.select("note_id", result.alias("result"))


def reconcile_tally(results: DataFrame) -> DataFrame:
    count = lambda r: F.count_if(F.col("result") == r).alias(r)
    return results.agg(F.count("*").alias("scanned"), *map(count, ("reembedded", "unchanged", "removed")))


def retire_superseded(chunks: DataFrame, active: DataFrame) -> DataFrame:
    """Chunks without those of a note's other generations; a note that has none active keeps all."""
    a = active.where("generation_id is not null").groupBy("note_id").agg(F.min("generation_id").alias("now"))
    return chunks.join(a, "note_id", "left").where("now is null or generation_id = now").drop("now")


def remove_notes(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks without any generation of the notes that are gone."""
    return chunks.join(gone.select("note_id"), "note_id", "left_anti")
