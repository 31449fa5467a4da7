"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import config_key, content_hash, generation_id
from tessera.operators.durable import shared_folder


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes: id, type, path, hash, alias."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("doc-"), "doc_id").alias("note_id"),
        "doc_id",
        F.col("source").alias("type"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"),
        F.concat_ws("-", "lang", (F.col("doc_id") % 100).cast("string")).alias("alias"),
        "text",
        "lang",
    )


def document_generations(df: DataFrame) -> DataFrame:
    model, dims, version = F.lit("hash-embed"), F.lit(64), F.lit(1)
    return df.withColumns(
        {"config_key": config_key(model, dims, version), "generation_id": generation_id(F.col("note_id"), F.col("content_hash"), model, dims, version)}
    )


def active_notes(df: DataFrame) -> DataFrame:
    """Notes of which every fifth was edited since it was indexed, every seventh moved on in config and every eleventh never indexed."""
    old = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("old-"), "generation_id")).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("cfg-"), "generation_id")).otherwise(F.col("generation_id"))
    return document_generations(df).select(
        "note_id",
        "doc_id",
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("old-"), "content_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("doc_id") % 7 == 0, "older").otherwise(F.col("config_key")).alias("config_key"),
        F.when(F.col("doc_id") % 11 != 0, old).alias("active_generation_id"),
        F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") % 3).cast("long").alias("active_generation"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as jobs, with states, attempts and due times by rules of the id."""
    e = read(spark, sf_dir, "events")
    state = F.element_at(F.array(*map(F.lit, ("pending", "running", "succeeded", "failed", "cancelled", "pending"))), (F.col("event_id") % 6 + 1).cast("int"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("job_id"),
        F.col("event_type").alias("workflow"),
        state.alias("state"),
        (F.col("event_id") % 4).cast("long").alias("attempts"),
        F.lit(3).cast("long").alias("max_attempts"),
        F.when(F.col("event_id") % 3 != 0, at).alias("next_run_at"),
        at.alias("created_at"),
        "user_id",
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    error = F.when(F.col("event_id") % 5 > 1, F.concat(F.col("event_type"), F.lit("-error")))  # other attempts went well
    return e.select((F.col("event_id") / 3).cast("long").alias("job_id"), (F.col("event_id") % 3).cast("long").alias("attempt_no"), error.alias("error_code"))


def _marked_lines():
    """Lines of a document; every third of every seventh document's as a heading."""
    mark = lambda line, i: F.when((F.col("doc_id") % 7 == 0) & (i % 3 == 0), F.concat(F.repeat(F.lit("#"), (i % 6 + 1).cast("int")), F.lit(" "), line, F.lit(" ##"))).otherwise(line)
    return F.transform(F.split("text", "\n"), mark)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of each document, some as headings."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(_marked_lines()).alias("ord", "line"))
    return d.select(F.concat(F.lit("doc-"), "doc_id").alias("note_id"), F.col("ord").cast("long").alias("ord"), "line")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as one text for each document, made in place."""
    return read(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("doc-"), "doc_id").alias("note_id"), F.array_join(_marked_lines(), "\n").alias("body"))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct supplier-to-part links of lineitem."""
    x = read(spark, sf_dir, "lineitem")
    x = x.select("l_suppkey", "l_partkey").distinct()  # before they are made names, which are longer
    return x.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.lit(None).cast("string").alias("predicate"))


_INDEXES: dict[tuple[str, str], str] = {}


def index_folder(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """The stored text index of documents, written on first use and again when the table's files change.

    It lies in the shared folder of ``spark.checkpoint.dir``; in a temporary one only where
    that is unset and all of Spark runs in this process.
    """
    from tessera.operators import index

    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    files = java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    state = f"{java}:{files.getFileStatus(java).getModificationTime()}:{files.getContentSummary(java).getLength()}:{kind}"
    key = (spark.sparkContext.applicationId, state)
    if key not in _INDEXES:
        folder = f"{shared_folder(spark)}/text-index-{hashlib.sha256(repr(key).encode()).hexdigest()[:24]}"
        d = read(spark, sf_dir, "documents")
        chunks = d.select(F.col("doc_id").alias("note_id"), F.col("doc_id").alias("chunk_id"), F.lit("").alias("section_path"), "text")
        index.write_index((index.analyzed_postings if kind == "analyzed" else index.plain_postings)(chunks), folder)
        _INDEXES[key] = folder
    return _INDEXES[key]
