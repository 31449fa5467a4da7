"""Exact nearest neighbours without a full scan: vectors in cells around centroids, pruned by the triangle inequality.

A vector at distance t from its cell's centroid c is at least |d(q, c) - t| from a question q.
So once k notes are known, a cell whose whole range of t lies further than the k-th of them
can't hold a better one and its files are not read; within a cell the same bound is a range of
t, pushed down to files that are sorted by it. Centroids are fitted on a bounded sample, which
decides only how much is pruned; every vector has its cell, and answers are those of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import retrieval

#: Vectors that centroids are fitted on at most.
SAMPLE = 20_000
_SLACK = 1e-9  # for rounding of square roots, relative to the distances


def fit_centroids(vectors: np.ndarray, n: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm from distinct vectors of the sample; fewer of them than n give fewer centroids."""
    distinct = np.unique(vectors, axis=0)
    centroids = distinct[np.random.default_rng(seed).permutation(len(distinct))[:n]]
    for _ in range(rounds if len(centroids) else 0):
        nearest = ((vectors**2).sum(axis=1)[:, None] - 2 * vectors @ centroids.T + (centroids**2).sum(axis=1)).argmin(axis=1)
        counts = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def _sample(chunks: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors: those of least hash, the same at every run."""
    rows = chunks.where("embedding is not null").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(most).select("embedding").collect()
    size = {len(r["embedding"]) for r in rows}
    if len(size) > 1:
        raise ValueError("vectors must have one length")
    return np.array([r["embedding"] for r in rows], np.float64) if rows else np.zeros((0, 1))


def write_cells(chunks: DataFrame, folder: str, n_cells: int = 64, sample: int = SAMPLE) -> None:
    """``chunks(note_id, chunk_id, section_path, embedding)`` in folders by cell, sorted by distance to the centroid, and the table of cells.

    Chunks without a vector are left out.
    """
    spark = chunks.sparkSession
    centroids = fit_centroids(_sample(chunks, sample), n_cells)
    kinds = dict(chunks.dtypes)
    columns = ("note_id", "chunk_id", "section_path", "embedding")
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", cell int, reach double"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (centroids**2).sum(axis=1)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                cell = (squares - 2 * x @ centroids.T).argmin(axis=1)
                reach = np.sqrt(((x - centroids[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(reach, pa.float64())], names=[*columns, "cell", "reach"])

    placed = chunks.where("embedding is not null").select(*columns).mapInArrow(assign, schema)
    # By range of cell and distance: a large cell has several files, each a range of distances.
    placed.repartitionByRange("cell", "reach").sortWithinPartitions("cell", "reach").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")
    stored = spark.read.schema(schema).parquet(f"{folder}/vectors")
    numbered = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    about = stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high"))
    about.join(F.broadcast(numbered), "cell").coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")  # a row a cell


@dataclass(frozen=True)
class Found:
    """The ranked chunks, and how many of the cells were read for them."""

    ranked: DataFrame
    read: int
    cells: int


def nearest(spark: SparkSession, folder: str, query: Sequence[float], k: int = 10) -> Found:
    """What ``retrieval.vector_layer`` gives, from the cells that can hold it.

    The nearest cells with room for k notes are read first; their k-th note bounds what else is.
    """
    retrieval.check_k(k)
    cells = spark.read.parquet(f"{folder}/cells").collect()  # one row a cell
    if not cells:
        none = spark.createDataFrame([], "note_id string, chunk_id string, section_path string, relevance double")
        return Found(none.withColumn("rank", F.lit(0)), 0, 0)
    vectors = spark.read.parquet(f"{folder}/vectors")
    q = np.array(query, np.float64)
    from_q = {c["cell"]: float(np.sqrt(((np.array(c["centroid"]) - q) ** 2).sum())) for c in cells}
    least = {c["cell"]: max(0.0, from_q[c["cell"]] - c["high"], c["low"] - from_q[c["cell"]]) for c in cells}
    scored = vectors.withColumn("relevance", retrieval.squared_distance(F.col("embedding"), query)).drop("embedding")
    order = sorted(cells, key=lambda c: (from_q[c["cell"]], c["cell"]))
    first, edge, taken = [], None, 0
    while taken < len(order) and edge is None:  # more cells while fewer than k notes are known
        step = max(1, taken)
        first += [c["cell"] for c in order[taken : taken + step]]
        taken += step
        best = scored.where(F.col("cell").isin(first)).groupBy("note_id").agg(F.min("relevance").alias("r")).orderBy("r").limit(k).collect()
        edge = float(np.sqrt(best[-1]["r"])) if len(best) == k else None
    if edge is None:
        return Found(retrieval.rank_chunks(scored.drop("cell", "reach"), k, True), len(cells), len(cells))
    bound = edge * (1 + _SLACK) + _SLACK
    kept = [c for c in cells if least[c["cell"]] <= bound * (1 + _SLACK)]
    near = F.lit(False)
    for c in kept:
        near = near | ((F.col("cell") == c["cell"]) & F.col("reach").between(from_q[c["cell"]] - bound, from_q[c["cell"]] + bound))
    inside = scored.where(F.col("cell").isin([c["cell"] for c in kept])).where(near)
    return Found(retrieval.rank_chunks(inside.drop("cell", "reach"), k, True), len({*first, *(c["cell"] for c in kept)}), len(cells))
