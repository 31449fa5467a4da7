"""Connected components of a distributed edge list.

Large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce
and Beyond"): each round is two group-minimum joins, so no vertex's neighbours are ever
gathered in one row, and the number of rounds grows with the logarithm of the longest path.
Rounds end once all components are stars, which one count over the ends of the edges tells.
The minima are tables of their own, so that both sides of a join are read through a shuffle
and Spark may split the centre of a large star over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import delete, written


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return written(edges.groupBy("a").agg(F.min("b").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each vertex's larger neighbours to the least of its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least_neighbour(both)
    low = least.select("a", F.least("a", "m").alias("m"))
    out = written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    delete(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each vertex and its smaller neighbours to the least of these. Edges are (larger, smaller)."""
    low = _least_neighbour(edges)
    moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = written(moved.union(low.select("a", F.col("m").alias("b"))).distinct())
    delete(low)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex of ``edges`` (larger, smaller) has one smaller neighbour or only larger ones: then all are stars."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] == 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every vertex of ``edges(a, b)`` with the least vertex of its component.

    Self-loops and rows with a null end are ignored; an empty edge list gives no rows.
    Returns ``(id, component)`` for vertices other than the least of each component.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if _settled(edges):
            break
        stars = _large_star(edges)
        after_small = _small_star(stars)
        delete(edges, stars)
        edges = after_small
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
