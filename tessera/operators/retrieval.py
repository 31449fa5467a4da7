"""Ranked retrieval: vector and full-text layers, fusion, packing.

A layer is ``(layer, note_id, section_path, chunk_id, rank)``. Many queries run at once where
the frames carry a ``query_id``; every window and group below then includes it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import estimate_tokens
from tessera.operators.durable import run_once

#: English function words that the plain analyzer leaves out, fixed values.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


def keyed(df: DataFrame, *names: str) -> list[str]:
    """The columns to group by: the names, and the question before them where the frame has many."""
    return [*(["query_id"] if "query_id" in df.columns else []), *names]


def check_k(k: int, most: int = 100) -> int:
    if not 1 <= k <= most:
        raise ValueError(f"k must be from 1 to {most}")
    return k


def squared_distance(vector: Column, query: Sequence[float]) -> Column:
    """Exact squared Euclidean distance, summed in order in double precision."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)


def fence(chunks: DataFrame, active: DataFrame) -> DataFrame:
    """Only chunks of active generations; no active ones, no chunks."""
    return chunks.join(active.select("generation_id"), "generation_id", "left_semi")


def rank_chunks(scored: DataFrame, k: int, ascending: bool) -> DataFrame:
    """Chunks of the first k notes by their best chunk, with each chunk's place among all.

    ``scored(note_id, chunk_id, relevance, ...)`` is first cut to the k best notes by a
    distributed top-k of each note's best; these k rows come to the driver and go into the
    second pass as literals, so that only the few chunks that count are ordered. With a
    ``query_id`` each question has its own k notes, found and joined without the driver.
    """
    key = F.col("relevance") if ascending else -F.col("relevance")
    if "query_id" in scored.columns:
        top = Window.partitionBy("query_id").orderBy("best")
        notes = scored.groupBy("query_id", "note_id").agg(F.min(F.struct(key.alias("key"), "chunk_id")).alias("best"))
        notes = notes.withColumn("place", F.row_number().over(top)).where(F.col("place") <= check_k(k))
        notes = notes.select("query_id", "note_id", F.max("best.key").over(Window.partitionBy("query_id")).alias("edge"))
        kept = scored.join(notes, ["query_id", "note_id"]).where(key <= F.col("edge")).drop("edge")
        return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(key, "chunk_id")))
    best = scored.groupBy("note_id").agg(F.min(F.struct(key.alias("key"), "chunk_id")).alias("best"))
    first = best.orderBy("best").limit(check_k(k)).collect()
    kept = scored.where(key <= max(r["best"]["key"] for r in first)) if first else scored.where("false")
    kept = kept.where(F.col("note_id").isin([r["note_id"] for r in first]))
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(key, "chunk_id")))


def vector_layer(chunks: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
    """The nearest notes of ``chunks(note_id, chunk_id, section_path, embedding)``."""
    return rank_chunks(chunks.withColumn("relevance", squared_distance(F.col("embedding"), query)).drop("embedding"), k, True)


@dataclass(frozen=True)
class Layers:
    """What each layer found; ``text`` is None where full text is switched off or failed."""

    vector: DataFrame
    text: DataFrame | None
    degraded: bool
    used: tuple[str, ...]


def search_layers(chunks: DataFrame, active: DataFrame | None, query: Sequence[float], text_layer: Callable[[DataFrame, int], DataFrame] | None, k: int = 10) -> Layers:
    """Both layers over chunks of active generations; without ``text_layer``, or if it fails, vectors alone answer.

    ``text_layer`` takes the fenced chunks and k. Where ``active`` has no generations nothing is
    served and no layer is asked; None fences nothing.
    """
    served = chunks if active is None else fence(chunks, active)
    if active is not None and active.isEmpty():
        none = served.withColumn("rank", F.lit(0)).where("false")
        return Layers(none, none if text_layer else None, text_layer is None, ())
    near = vector_layer(served, query, k)
    if text_layer is not None:
        try:
            # The few chunks that the layer gives are computed here, so that a read that fails is met here too.
            return Layers(near, run_once(text_layer(served, k)), False, ("fts", "vector"))
        except (PySparkException, Py4JJavaError):  # the index is missing or can't be read
            pass
    return Layers(near, None, True, ("vector",))


def plain_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits without function words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def postings(chunks: DataFrame, terms: Column) -> DataFrame:
    """The inverted index ``(term, note_id, chunk_id, section_path, tf, length)`` of chunks."""
    tokens = chunks.withColumn("terms", terms)
    return (
        tokens.select("note_id", "chunk_id", "section_path", F.size("terms").alias("length"), F.explode("terms").alias("term"))
        .groupBy("term", "note_id", "chunk_id", "section_path", "length")
        .agg(F.count("*").alias("tf"))
    )


def bm25(index: DataFrame, stats: DataFrame, query_terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Scores of the chunks that hold a query term; ``stats(n, mean_length)`` is one row.

    Only the query terms' postings are read; their number is that of a term's documents.
    """
    hits = index.where(F.col("term").isin(*dict.fromkeys(query_terms)))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(stats))  # one row a query term, one row
    return scored.groupBy("note_id", "chunk_id", "section_path").agg(F.round(F.sum(idf * tf), 9).alias("relevance"))


def fold(layers: DataFrame) -> DataFrame:
    """Chunks to notes: in each layer a note's best chunk, with dense ranks from 1."""
    best = layers.groupBy(*keyed(layers, "layer", "note_id")).agg(F.min("rank").alias("raw_rank"), F.min_by("section_path", "rank").alias("section_path"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*keyed(layers, "layer")).orderBy("raw_rank")))


def fuse(folded: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion: each note's sum of weight / (k + rank), best first, ties by id bytes."""
    weight = F.lit(1.0)
    for layer, w in (weights or {}).items():
        weight = F.when(F.col("layer") == layer, F.lit(float(w))).otherwise(weight)
    parts = folded.withColumn("contribution", weight / (k + F.col("rank")))
    fused = parts.groupBy(*keyed(folded, "note_id")).agg(
        F.round(F.sum("contribution"), 12).alias("score"),
        F.sort_array(F.collect_list(F.struct("layer", "rank", "contribution"))).alias("contributions"),
        F.min_by("section_path", F.struct("rank", "layer")).alias("section_path"),
    )
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(*keyed(folded)).orderBy(F.desc("score"), "note_id")))


def primary_channel(folded: DataFrame, order: Sequence[str] = ("fts", "vector"), k: int = 60) -> DataFrame:
    """The layer that gave a note most; of equal ones the earlier in ``order``."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("layer"))
    return folded.groupBy(*keyed(folded, "note_id")).agg(F.max_by("layer", F.struct(1 / (k + F.col("rank")), -place)).alias("channel"))


def best_sections(layers: DataFrame) -> DataFrame:
    """Each note's sections by their best rank in any layer, ties by path."""
    best = layers.groupBy(*keyed(layers, "note_id", "section_path")).agg(F.min("rank").alias("best_rank"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(*keyed(layers, "note_id")).orderBy("best_rank", "section_path")))


def run_mode(identity: str | None, layers: Sequence[str]) -> str:
    """id, alias, hybrid, fts or vector."""
    if identity:
        return "id" if identity == "id" else "alias"
    return "hybrid" if len(set(layers)) > 1 else next(iter(layers), "vector")


def identity_matches(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """The first tier in which a query names a note, id before slug before alias, and how many notes it names there.

    ``queries(query, exact, normalized)``; ``keys(tier, key, note_id)`` with tier 0 exact ids,
    1 normalised slugs and 2 normalised aliases. More than one note in a tier is ambiguous.
    """
    asked = queries.select("query", F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), F.col("exact" if t == 0 else "normalized").alias("key")) for t in range(3)))).alias("a")).select("query", "a.tier", "a.key").where("key <> ''")
    # Owners are counted for each key before the join, so that a shared name asked often is one row a question.
    owned = keys.groupBy("tier", "key").agg(F.countDistinct("note_id").alias("owners"), F.min("note_id").alias("note_id"))
    by_tier = asked.join(owned, ["tier", "key"])
    return by_tier.groupBy("query").agg(F.min(F.struct("tier", "owners", "note_id")).alias("m")).select(
        "query", "m.tier", F.when(F.col("m.owners") == 1, F.col("m.note_id")).alias("note_id"), (F.col("m.owners") > 1).alias("ambiguous")
    )


def with_metadata(ranked: DataFrame, notes: DataFrame) -> DataFrame:
    """Type, sensitivity and trust of each note; a note without metadata is untyped, restricted and unverified."""
    meta = notes.select("note_id", F.col("type").alias("note_type"), "sensitivity", F.lit("verified").alias("trust"))
    return ranked.join(meta, "note_id", "left").withColumns(
        {"note_type": F.coalesce("note_type", F.lit("")), "sensitivity": F.coalesce("sensitivity", F.lit("restricted")), "trust": F.coalesce("trust", F.lit("unverified"))}
    )


def pack_context(sections: DataFrame, budget: int = 6000) -> DataFrame:
    """Sections in order of note and section rank while their tokens fit; the first that does not ends the pack.

    ``sections(item_rank, section_rank, text, ...)`` are those of one answer, at most some hundred.
    """
    order = Window.partitionBy(*keyed(sections)).orderBy("item_rank", "section_rank").rowsBetween(Window.unboundedPreceding, 0)
    counted = sections.withColumn("tokens", estimate_tokens(F.col("text")))
    return counted.withColumn("running", F.sum("tokens").over(order)).where(F.col("running") <= budget)


def provenance(ranked: DataFrame, retrieval_id: str) -> DataFrame:
    return ranked.select(F.lit(retrieval_id).alias("retrieval_id"), *keyed(ranked, "rank", "note_id", "score"))


def answer_prompt(question: str, context: DataFrame) -> DataFrame:
    """One prompt that holds the packed context only and asks for [[id]] citations."""
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_rank", "section_rank", F.concat(F.lit("[["), "note_id", F.lit("]]\n"), "text").alias("t")))), lambda x: x["t"]), "\n\n")
    head = "Answer from the context alone and cite notes as [[id]].\n\nContext:\n"
    return context.agg(F.concat(F.lit(head), F.coalesce(blocks, F.lit("")), F.lit(f"\n\nQuestion: {question}")).alias("prompt"))
