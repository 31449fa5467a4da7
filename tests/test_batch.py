"""Many questions at once against one at a time and against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import batch, evaluation, index, retrieval

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(5)
    chunks = []
    for c in range(300):
        text = " ".join(r.choices(WORDS, weights=[1 / (i + 1) for i in range(40)], k=r.randint(0, 30)))
        vector = None if c % 50 == 49 else [float(r.randint(-2, 2)) for _ in range(3 if c % 60 == 7 else 4)]
        chunks.append((f"n{c % 90:02d}", f"c{c:03d}", f"s{c % 4}", text, vector))
    questions = [(q, list(dict.fromkeys(r.choices(WORDS, k=r.randint(0, 6)))) + ["", None, "w0"], [float(r.randint(-2, 2)) for _ in range(4)]) for q in range(30)]
    questions += [(30, [], None), (31, None, [0.0, 0.0, 0.0]), (32, ["unknown"], [1e9] * 4)]
    df = spark.createDataFrame(chunks, "note_id string, chunk_id string, section_path string, text string, embedding array<float>").repartition(5).cache()
    return chunks, questions, df, spark.createDataFrame(questions, "query_id int, terms array<string>, vector array<double>")


def best(scores, k):
    """First k notes of (key, chunk, note, section), by their best chunk."""
    seen, out = set(), []
    for key, chunk, note, section in sorted(scores):
        if note not in seen:
            seen.add(note)
            out.append((note, chunk, section, key))
    return out[:k]


@pytest.mark.parametrize("k, block", [(10, 1 << 19), (3, 40), (100, 1)])
def test_vectors_by_brute_force(made, k, block):
    chunks, questions, df, asked = made
    got = {}
    for r in batch.vector_layer(df, asked, k, block).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["note_id"], r["chunk_id"], r["section_path"], r["relevance"])
    for q, _, vector in questions:
        scores = [(sum((a - b) ** 2 for a, b in zip(v, vector, strict=True)), c, n, s) for n, c, s, _, v in chunks if vector and v and len(v) == len(vector)]
        assert got.get(q, {}) == dict(enumerate(best(scores, k), 1))


@pytest.mark.parametrize("k, block", [(10, 1 << 19), (3, 9), (100, 1)])
def test_texts_by_brute_force(made, k, block):
    chunks, questions, df, asked = made
    counts = [Counter(t.split()) for *_, t, _ in chunks]
    length = [sum(c.values()) for c in counts]
    mean, df_ = sum(length) / len(chunks), Counter(w for c in counts for w in c)
    got = {}
    for r in batch.text_layer(index.plain_postings(df), asked, k, block=block).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["note_id"], r["chunk_id"], r["section_path"], r["relevance"])
    for q, terms, _ in questions:
        scores = []
        for (n, c, s, *_), tf, size in zip(chunks, counts, length, strict=True):
            score = sum(math.log(1 + (len(chunks) - df_[t] + 0.5) / (df_[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * size / mean)) for t in sorted({t for t in terms or () if t}) if tf[t])
            if score:
                scores.append((-round(score, 9), c, n, s))
        assert got.get(q, {}) == {i: (n, c, s, -key) for i, (n, c, s, key) in enumerate(best(scores, k), 1)}


def test_a_batch_fuses_as_each_question_alone(spark, made):
    _, questions, df, asked = made
    postings = index.plain_postings(df).cache()
    fused = batch.hybrid({"fts": batch.text_layer(postings, asked), "vector": batch.vector_layer(df.where("size(embedding) = 4"), asked)})
    got = {}
    for r in fused.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["note_id"], r["score"]))
    stats = postings.where("term = ''").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    for q, terms, vector in questions[:3]:
        text = retrieval.rank_chunks(retrieval.bm25(postings, stats, [t for t in terms if t]), 10, False)
        near = retrieval.vector_layer(df.where("size(embedding) = 4"), vector, 10)
        layers = text.select(F.lit("fts").alias("layer"), "note_id", "section_path", "rank").unionByName(near.select(F.lit("vector").alias("layer"), "note_id", "section_path", "rank"))
        alone = retrieval.fuse(retrieval.fold(layers)).where("rank <= 10").select("rank", "note_id", "score").collect()
        assert sorted(got[q]) == sorted(map(tuple, alone))


def test_no_questions_no_chunks(made):
    _, _, df, asked = made
    empty = index.plain_postings(df.where("false"))
    assert batch.text_layer(empty, asked).collect() == [] == batch.text_layer(index.plain_postings(df), asked.where("false")).collect()
    assert batch.vector_layer(df.where("false"), asked).collect() == [] == batch.vector_layer(df, asked.where("false")).collect()
    with pytest.raises(ValueError):
        batch.vector_layer(df, asked, 0)


def test_frames_with_a_question_group_by_it(spark):
    scored = spark.createDataFrame([(1, "a", "c1", 2.0), (1, "a", "c2", 5.0), (1, "b", "c3", 3.0), (1, "z", "c9", 9.0), (2, "a", "c1", 1.0)], "query_id int, note_id string, chunk_id string, relevance double")
    rows = sorted(tuple(r) for r in retrieval.rank_chunks(scored, 2, True).select("query_id", "rank", "chunk_id").collect())
    assert rows == [(1, 1, "c1"), (1, 2, "c3"), (2, 1, "c1")]
    sections = spark.createDataFrame([(q, i, 1, "x" * 40) for q in (1, 2) for i in range(4)], "query_id int, item_rank int, section_rank int, text string")
    assert retrieval.pack_context(sections, 25).count() == 4
    layers = spark.createDataFrame([(q, n, "v", "s", r) for q in (1, 2) for r, n in enumerate("ab" if q == 1 else "ba", 1)], "query_id int, note_id string, layer string, section_path string, rank int")
    assert {(r["query_id"], r["note_id"]) for r in retrieval.fuse(retrieval.fold(layers)).where("rank = 1").collect()} == {(1, "a"), (2, "b")}
    assert retrieval.best_sections(layers).count() == 4 and retrieval.primary_channel(retrieval.fold(layers)).count() == 4


def test_quotations(spark):
    items = spark.createDataFrame([(1, "One two, three four five six seven EIGHT nine"), (2, "too short"), (3, None)], "query_id int, text string")
    docs = spark.createDataFrame([("a", "x one two three four five six seven eight y"), ("b", "two three four five six seven eight nine"), ("c", "one two three four five six seven"), ("d", None)], "note_id string, text string")
    assert sorted(map(tuple, evaluation.quoted(items, docs).collect())) == [(1, "a"), (1, "b")]
