"""Additions beyond batch: a vault followed as a stream, a stored index kept up by one, and job events by the hour."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import segments
from tessera.operators.publication import Store
from tessera.plans import commands
from tessera.sources import vault
from tessera.sources.vault import parse_notes

_FILES = "path string, modificationTime timestamp, length long, content binary"


def follow_vault(spark: SparkSession, root: str, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Parse new files as they come and hand each batch's notes to ``apply``; a batch that comes again has the same id."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)

    def each(batch: DataFrame, number: int) -> None:
        apply(parse_notes(batch.select("path", "content")), number)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_indexed(changes: DataFrame, store: Store, checkpoint: str, name: str = "vault", **config) -> StreamingQuery:
    """A stored index kept up by a stream of ``changes(path, at, content)``; a null content is a note that is gone.

    Each batch is diffed against the stored notes, indexed, activated and retired in one version
    that also holds the batch's number, so a batch that comes again, after a failure between the
    commit and the stream's own log, changes nothing. Of several changes of a path in a batch the
    last counts; files that don't parse leave what is stored.
    """
    key = f"stream:{name}"

    def each(batch: DataFrame, number: int) -> None:
        apply_batch(batch, number, store, key, **config)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_batch(batch: DataFrame, number: int, store: Store, key: str, **config) -> bool:
    """One batch of keep_indexed(); False where the ledger has it already."""
    before = store.snapshot()
    if int(before.facts.get(key, -1)) >= number:
        return False
    last = batch.groupBy("path").agg(F.max_by(F.struct("content"), "at").alias("c")).select("path", "c.content").persist()
    notes, _ = vault.snapshot(parse_notes(last.where("content is not null")))
    wanted = notes.join(commands.expected_generations(notes, **config).select("note_id", "generation_id"), "note_id")

    def delta(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
        same = stored.select("note_id", "path", F.col("generation_id").alias("g"))
        touched = wanted.join(same.select("note_id", F.col("path").alias("p"), "g"), "note_id", "left").where("not (g <=> generation_id and p <=> path)").drop("p", "g")
        named = last.where("content is null").select("path").unionByName(notes.select("path"))  # a file that is another note now ends the old one
        return touched, same.join(named, "path", "left_semi").select("note_id").join(notes.select("note_id"), "note_id", "left_anti")

    try:
        segments.index_changes(store, delta, lambda needed: commands.build_index(needed.drop("generation_id"), **config), facts={key: str(number)}, done=lambda base: int(base.facts.get(key, -1)) >= number)
    finally:
        last.unpersist()
    return True


def windowed_outcomes(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Outcomes of job events by hour and kind; events over ``late`` behind are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
