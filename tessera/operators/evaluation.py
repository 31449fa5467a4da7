"""Retrieval quality over many queries at once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_and_mrr(queries: DataFrame, retrieved: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """Mean recall at k and mean reciprocal rank, zero for no queries.

    ``queries(query_id)``, ``retrieved(query_id, rank, note_id)``, ``expected(query_id,
    note_id)``. Hits count retrieved places, recall divides by the labels as listed, and a
    query without labels scores zero.
    """
    wanted = expected.groupBy("query_id").agg(F.count("*").alias("labels"))
    hits = (
        retrieved.where(F.col("rank") <= k)
        .join(expected.distinct(), ["query_id", "note_id"], "left_semi")
        .groupBy("query_id")
        .agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    )
    each = queries.select("query_id").join(wanted, "query_id", "left").join(hits, "query_id", "left")
    return each.agg(
        F.count("*").alias("queries"),
        F.coalesce(F.round(F.avg(F.coalesce(F.col("hits") / F.col("labels"), F.lit(0.0))), 9), F.lit(0.0)).alias("recall"),
        F.coalesce(F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 9), F.lit(0.0)).alias("mrr"),
    )


#: Runs of words of the items that are broadcast at most: some 24 MB.
BROADCAST_RUNS = 1 << 20


def quoted(items: DataFrame, docs: DataFrame, words: int = 8) -> DataFrame:
    """``(query_id, note_id)``: which of ``docs(note_id, text)`` quote ``items(query_id, text)``, by a run of so many words in both.

    Items of fewer words are quoted by nothing. Runs are compared by 64-bit hashes, once each
    on either side. Where those of the items are few, by count, they go to the documents and
    no document is shuffled; else both sides meet by hash.
    """

    def runs(df: DataFrame, key: str) -> DataFrame:
        w = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
        each = df.select(key, w.alias("w")).where(F.size("w") >= words)
        starts = F.sequence(F.lit(1), F.size("w") - (words - 1))
        return each.select(key, F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " "))))).alias("run"))

    asked = runs(items, "query_id")
    if asked.count() <= BROADCAST_RUNS:
        asked = F.broadcast(asked)
    return runs(docs, "note_id").join(asked, "run").select("query_id", "note_id").distinct()


def passes(metrics: DataFrame, least_recall: float = 0.85, least_mrr: float = 0.7) -> DataFrame:
    return metrics.withColumn("pass", (F.col("recall") >= least_recall) & (F.col("mrr") >= least_mrr))
