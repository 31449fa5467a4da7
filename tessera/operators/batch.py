"""Many questions at once through both ranked layers.

Each layer gives ``(query_id, note_id, chunk_id, section_path, relevance, rank)``, the k best
notes of each question with their best chunk. Questions are a stated set: they go to the tasks
in blocks of bounded size, and one pass over the chunks or over the postings of a block's terms
answers a block. A task keeps the k best notes of each question of the block and nothing else,
so what is shuffled is k rows for each task and question, however frequent a term is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import retrieval

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
#: Numbers that the questions of one block may hold: terms, or elements of vectors.
BLOCK = 1 << 19


class Best:
    """The k best notes of each of n questions so far; the smaller key is the better, equal ones go by chunk."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.edge = k, np.full(n, np.inf)  # the key of a question's k-th note
        self.limit = max(1 << 16, 4 * n * k)
        self.parts: list[pd.DataFrame] = []
        self.rows = 0

    def add(self, question: np.ndarray, key: np.ndarray, row: np.ndarray, held: pd.DataFrame) -> None:
        good = key <= self.edge[question]
        if good.any():
            part = held.iloc[row[good]].reset_index(drop=True)
            self.parts.append(part.assign(question=question[good], key=key[good]))
            self.rows += len(part)
            if self.rows > self.limit:
                self.settle()

    def settle(self) -> pd.DataFrame | None:
        if not self.parts:
            return None
        all_ = pd.concat(self.parts, ignore_index=True).sort_values(["question", "key", "chunk_id"], kind="stable").drop_duplicates(["question", "note_id"])
        kept = all_.groupby("question", sort=False).head(self.k)
        full = kept.groupby("question")["key"].agg(["size", "max"])
        full = full[full["size"] == self.k]
        self.edge[full.index.to_numpy()] = full["max"].to_numpy()
        self.parts, self.rows = [kept], len(kept)
        return kept


def _blocks(questions: DataFrame, weight: str, limit: int) -> Iterator[list]:
    """The questions in blocks of about ``limit`` numbers; one that has more stands with few others."""
    n, total, most = questions.agg(F.count("*"), F.sum(weight), F.max(weight)).first()
    blocks = max(1, -(-int(total or 0) // max(limit, int(most or 0)))) if n else 0
    for b in range(blocks):
        rows = questions.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).drop(weight).collect() if blocks > 1 else questions.drop(weight).collect()
        if rows:
            yield rows


def _schema(questions: DataFrame, chunks: DataFrame) -> tuple[str, pa.Schema]:
    kinds = {"query_id": dict(questions.dtypes)["query_id"], **{c: dict(chunks.dtypes)[c] for c in ("note_id", "chunk_id", "section_path")}}
    return ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", key double", pa.schema([*((c, _ARROW[t]) for c, t in kinds.items()), ("key", pa.float64())])


def _given(kept: pd.DataFrame | None, ids: list, schema: pa.Schema) -> pa.RecordBatch:
    if kept is None:
        return pa.RecordBatch.from_pylist([], schema=schema)
    out = {c: kept[c].tolist() for c in ("note_id", "chunk_id", "section_path", "key")} | {"query_id": [ids[i] for i in kept["question"]]}
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def _ranked(found: list[DataFrame], k: int, sign: int) -> DataFrame:
    """The tasks' best notes merged: partial maxima first, then a rank whose limit Spark applies before it shuffles."""
    each = found[0]
    for f in found[1:]:
        each = each.unionByName(f)
    best = each.groupBy("query_id", "note_id").agg(F.min(F.struct("key", "chunk_id", "section_path")).alias("b")).select("query_id", "note_id", "b.*")
    top = Window.partitionBy("query_id").orderBy("key", "chunk_id")
    ranked = best.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return ranked.select("query_id", "note_id", "chunk_id", "section_path", (sign * F.col("key")).alias("relevance"), "rank")


def vector_layer(chunks: DataFrame, questions: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """The nearest notes of ``chunks(note_id, chunk_id, section_path, embedding)`` for each of ``questions(query_id, vector)``.

    Distances are exact: a product of matrices only leaves out what is too far by a margin for
    its rounding. Chunks without a vector, or with one of another length, are not found.
    """
    retrieval.check_k(k)
    schema, kind = _schema(questions, chunks)
    asked = questions.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("w"))
    found = []
    for rows in _blocks(asked, "w", block):
        for size in sorted({len(r["vector"]) for r in rows}):
            own = [r for r in rows if len(r["vector"]) == size]
            found.append(_nearest(chunks, [r["query_id"] for r in own], np.array([r["vector"] for r in own]), k, schema, kind))
    if not found:
        return _ranked([chunks.sparkSession.createDataFrame([], schema)], k, 1)
    return _ranked(found, k, 1)


def _nearest(chunks: DataFrame, ids: list, vectors: np.ndarray, k: int, schema: str, kind: pa.Schema) -> DataFrame:
    d = vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, length = Best(len(ids), k), (vectors**2).sum(axis=1)
        step = 64  # few at first, until there is an edge
        for batch in batches:
            held = batch.select(["note_id", "chunk_id", "section_path"]).to_pandas()
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            at = 0
            while at < len(x):
                part = x[at : at + step]
                sums = (part**2).sum(axis=1)[:, None] + length[None, :]
                near = sums - 2 * (part @ vectors.T) <= best.edge[None, :] + 1e-9 * (1 + sums)
                row, question = np.nonzero(near)
                exact = np.zeros(len(row))
                for j in range(d):  # in order, as a fold over the array would sum
                    exact += (part[row, j] - vectors[question, j]) ** 2
                best.add(question, exact, row + at, held)
                if step == 64:
                    best.settle()
                at, step = at + step, 1024
        yield _given(best.settle(), ids, kind)

    there = chunks.where(F.size("embedding") == d).select("note_id", "chunk_id", "section_path", "embedding")
    return there.mapInArrow(run, schema)


def text_layer(index: DataFrame, questions: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, block: int = BLOCK) -> DataFrame:
    """The best notes by BM25 of ``index(term, note_id, chunk_id, section_path, tf, length)`` for ``questions(query_id, terms)``.

    The index holds a posting of the empty term for each chunk. A block's terms are counted in
    one pass, and in another their postings meet by chunk, one row each, and are added up for
    all questions that have the term. A term counts once in a question.
    """
    retrieval.check_k(k)
    spark = index.sparkSession
    schema, kind = _schema(questions, index)
    terms = F.array_distinct(F.filter("terms", lambda t: t.isNotNull() & (t != "")))
    asked = questions.select("query_id", terms.alias("terms")).where("size(terms) > 0").withColumn("w", F.size("terms"))
    n, mean = index.where("term = ''").agg(F.count("*"), F.avg("length")).first()
    found = []
    for rows in _blocks(asked, "w", block) if n else ():
        words = {t: i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
        numbered = F.broadcast(spark.createDataFrame(list(words.items()), "term string, t int"))  # at most a block's terms
        hits = index.join(numbered, "term")
        df = {r["t"]: r["df"] for r in hits.groupBy("t").agg(F.count("*").alias("df")).collect()}  # one row a term of the block
        weight = F.broadcast(spark.createDataFrame([(t, float(np.log(1 + (n - c + 0.5) / (c + 0.5)))) for t, c in df.items()], "t int, idf double"))
        tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
        chunks = hits.join(weight, "t").groupBy("note_id", "chunk_id", "section_path").agg(F.sort_array(F.collect_list(F.struct("t", (F.col("idf") * tf).alias("v")))).alias("held"))
        found.append(_matched(chunks, [r["query_id"] for r in rows], [[words[t] for t in r["terms"]] for r in rows], len(words), k, schema, kind))
    if not found:
        return _ranked([spark.createDataFrame([], schema)], k, -1)
    return _ranked(found, k, -1)


def _matched(chunks: DataFrame, ids: list, terms: list[list[int]], n_terms: int, k: int, schema: str, kind: pa.Schema) -> DataFrame:
    """Scores of each chunk for the questions that share a term with it; a chunk's row holds the block's terms in it, at most all of them."""
    pairs = sorted((t, q) for q, ts in enumerate(terms) for t in ts)
    owner = np.array([q for _, q in pairs], np.int64)
    first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(n_terms + 1))
    step = max(1, (1 << 21) // max(1, len(ids)))  # chunks at a time: some 16 MB of sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in batches:
            held = batch.select(["note_id", "chunk_id", "section_path"]).to_pandas()
            lists = batch.column(3)
            t, v = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            for at in range(0, len(held), step):
                stop = min(at + step, len(held))
                a, z = ends[at], ends[stop]
                row = np.repeat(np.arange(stop - at), np.diff(ends[at : stop + 1]))
                many = first[t[a:z] + 1] - first[t[a:z]]
                which = np.repeat(np.arange(z - a), many)
                place = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                question = owner[first[t[a:z]][which] + place]
                sums = np.bincount(row[which] * len(ids) + question, weights=v[a:z][which], minlength=(stop - at) * len(ids)).reshape(stop - at, len(ids))
                sums = np.round(sums, 9)
                r, q = np.nonzero((sums > 0) & (-sums <= best.edge[None, :]))
                best.add(q, -sums[r, q], r + at, held)
        yield _given(best.settle(), ids, kind)

    return chunks.select("note_id", "chunk_id", "section_path", "held").mapInArrow(run, schema)


def hybrid(layers: dict[str, DataFrame], k: int = 10, constant: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """The fused ranking of each question from its layers, by name: fuse() over all questions at once, cut to k."""
    parts = None
    for name, layer in layers.items():
        one = layer.select("query_id", F.lit(name).alias("layer"), "note_id", "section_path", "rank")
        parts = one if parts is None else parts.unionByName(one)
    return retrieval.fuse(retrieval.fold(parts), constant, weights).where(F.col("rank") <= retrieval.check_k(k))
