"""Constraint and content checks. Each gives the rows that break it; a batch is good when all are empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_unique(df: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has. Nulls are equal here, as in the stored partial indexes."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def keys_per_note(notes: DataFrame, keys: DataFrame, kind: str = "slug") -> DataFrame:
    """Notes that do not have exactly one key of a kind."""
    n = keys.where(F.col("kind") == kind).groupBy("note_id").agg(F.count("*").alias("n"))
    return notes.select("note_id").join(n, "note_id", "left").select("note_id", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def unknown_references(df: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    return df.join(parents.select(F.col(key).alias(column)), column, "left_anti").where(F.col(column).isNotNull())


def not_in(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def failure_without_checkpoint(runs: DataFrame) -> DataFrame:
    """Runs where having failed and naming the failed step do not go together."""
    return runs.where(F.col("status").isin("failed", "cancelled") != F.col("failed_checkpoint").isNotNull())


def several_current(configs: DataFrame) -> DataFrame:
    return configs.where("is_current").groupBy(F.lit("current").alias("flag")).agg(F.count("*").alias("rows")).where("rows > 1")


def payload_mismatches(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.sha2("payload", 256) != F.col("payload_hash"))


def verdict(findings: DataFrame) -> DataFrame:
    """ok without errors, and tier 2 only without any finding of weight."""
    error = F.col("severity") == "error"
    return findings.agg(F.coalesce(~F.bool_or(error), F.lit(True)).alias("ok"), F.coalesce(~F.bool_or(error | (F.col("severity") == "warning")), F.lit(True)).alias("tier2_eligible"))


#: Link labels that say nothing, fixed values.
VAGUE = ("here", "click here", "link", "this", "read more", "more")


def accessibility(lines: DataFrame) -> DataFrame:
    """Findings ``(note_id, ord, code)`` over ``lines(note_id, ord, line)`` without code.

    More than one top heading, skipped heading levels, link labels that say nothing, images
    without text, and list items indented by over four more than the one before.
    """
    from pyspark.sql import Window

    from tessera.functions.text import heading_level

    by_note = Window.partitionBy("note_id").orderBy("ord")
    heads = lines.select("note_id", "ord", heading_level(F.col("line")).alias("level")).where("level is not null")
    tops = heads.where("level = 1").withColumn("n", F.row_number().over(by_note)).where("n > 1")
    skips = heads.withColumn("before", F.lag("level").over(by_note)).where("level > before + 1")
    labels = F.regexp_extract_all("line", F.lit(r"(?<!!)\[([^\]\[]+)\]\([^)]*\)"), F.lit(1))
    vague = lines.where(F.exists(labels, lambda x: F.lower(F.trim(x)).isin(*VAGUE)))
    bare = lines.where(F.col("line").rlike(r"!\[\s*\]\([^)]*\)"))
    items = lines.where(F.col("line").rlike(r"^\s*(?:[-*+]|\d+[.)])\s")).select("note_id", "ord", F.length(F.regexp_extract("line", r"^(\s*)", 1)).alias("indent"))
    jumps = items.withColumn("before", F.lag("indent").over(by_note)).where("indent > before + 4")
    found = [("multiple-top-headings", tops), ("skipped-heading-level", skips), ("vague-link-label", vague), ("missing-alt-text", bare), ("list-jump", jumps)]
    out = None
    for code, rows in found:
        part = rows.select("note_id", "ord", F.lit(f"accessibility:{code}").alias("code"))
        out = part if out is None else out.unionByName(part)
    return out
