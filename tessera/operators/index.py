"""A stored inverted index of chunks.

Postings are one Parquet table sorted by term over all its files, so that a query reads the
few row groups that its terms fall into; a frequent term has several files. A posting of
the empty term in each chunk holds its length, which makes the corpus statistics one more
term to read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.stemmer import stem_terms
from tessera.operators import retrieval

_KEYS = ("note_id", "chunk_id", "section_path")


def _postings(chunks: DataFrame, keys: Sequence[str], terms: Column) -> DataFrame:
    tokens = chunks.select(*keys, terms.alias("terms"))
    each = tokens.select(*keys, F.size("terms").alias("length"), F.explode(F.array_append("terms", "")).alias("term"))
    return each.groupBy("term", *keys, "length").agg(F.count("*").alias("tf"))


def plain_postings(chunks: DataFrame, keys: Sequence[str] = _KEYS) -> DataFrame:
    """``(term, note_id, chunk_id, section_path, length, tf)`` of ``chunks(note_id, chunk_id, section_path, text)``, lower-case words; ``keys`` may name more columns."""
    return _postings(chunks, keys, retrieval.plain_terms(F.coalesce("text", F.lit(""))))


def _analyzed_terms() -> Column:
    return stem_terms(retrieval.plain_terms(F.coalesce("text", F.lit(""))), tuple(retrieval.STOP_WORDS))


def postings_in_place(chunks: DataFrame, keys: Sequence[str], analyzed: bool = True) -> DataFrame:
    """``(term, *keys, length, tf)`` where each row is a chunk of its own by ``keys``: runs of its sorted terms, so nothing is shuffled.

    The length stands with the empty term only.
    """
    terms = _analyzed_terms() if analyzed else retrieval.plain_terms(F.coalesce("text", F.lit("")))
    tokens = chunks.select(*keys, F.sort_array(terms).alias("terms"))
    n = F.size("terms")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tokens = tokens.select("*", F.filter(places, lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1))).alias("starts"))
    none, count = F.lit(None).cast("int"), lambda c: c.cast("long").alias("tf")
    runs = F.transform("starts", lambda i, j: F.struct(F.get("terms", i).alias("term"), none.alias("length"), count(F.coalesce(F.get("starts", j + 1), n) - i)))
    each = F.array_append(runs, F.struct(F.lit("").alias("term"), n.alias("length"), count(F.lit(1))))
    return tokens.select(*keys, F.explode(each).alias("p")).select("p.term", *keys, "p.length", "p.tf")


def analyzed_postings(chunks: DataFrame, keys: Sequence[str] = _KEYS) -> DataFrame:
    """The same of folded and stemmed words without function words."""
    return _postings(chunks, keys, _analyzed_terms())


def write_index(postings: DataFrame, folder: str) -> None:
    """Write postings sorted by term over all files."""
    postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(folder)


def scored(spark: SparkSession, folder: str, terms: Sequence[str], restrict: DataFrame | None = None) -> DataFrame:
    """BM25 scores of the chunks that hold a term, of an index or of the part of it whose note_id ``restrict`` has."""
    index = spark.read.parquet(folder)
    if restrict is not None:
        index = index.join(restrict.select("note_id").distinct(), "note_id", "left_semi")
    stats = index.where("term = ''").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    return retrieval.bm25(index, stats, [t for t in terms if t])


