"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, html_text, mixing, passages, quality, repeats, secrets, simhash, token_counts, toxicity

WORDS = "the quick brown fox jumps over the lazy dog and runs away from all of the other animals in the wood".split()
LONG = " ".join(f"{w}{i % 977}" for i in range(6000) for w in WORDS[i % 7 : i % 7 + 2])
TEXT = " ".join(WORDS * 3)
ROWS = [
    (1, TEXT, "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, LONG, "en", "b", 1),
    (5, TEXT, "en", None, 5),
    (5, TEXT, "en", None, 5),
    (None, TEXT, None, "a", None),
    (7, " \n\t\x0b ", "en", "b", 3),
    (8, "é😀 ünïcode — text", "fr", "b", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for their own columns.
CLASHES = ("id", "h", "p", "fp", "key", "doc", "score", "kept", "size", "component_id", "spans", "node", "range", "taken", "x", "n", "__text", "html_", "held_out", "digest", "kept_id", "label", "secret_text", "secret_base", "mix_size", "mix_row_key", "copies", "__id", "__kept")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for i, c in enumerate(CLASHES):
        df = df.withColumn(c, F.lit(i))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(WORDS)), (2, None), (3, ""), (None, TEXT), (1, " ".join(WORDS))], "item_id long, text string")


OPERATORS = {
    "leaks": lambda d, x, b: decontaminate.leaks(d, b),
    "without_leaks": lambda d, x, b: decontaminate.without_leaks(d, b),
    "tokens": lambda d, x, b: token_counts.count_tokens(d, [b" the", b" qu", b"ick"]),
    "secrets": lambda d, x, b: secrets.find_secrets(d),
    "redact": lambda d, x, b: secrets.redact(d),
    "simhash": lambda d, x, b: simhash.near_duplicates(d),
    "similar": lambda d, x, b: simhash.similar_documents(d),
    "keep_one": lambda d, x, b: simhash.keep_one(d),
    "plan_mix": lambda d, x, b: mixing.plan_mix(d),
    "mix": lambda d, x, b: mixing.mix(d),
    "repeats": lambda d, x, b: repeats.remove_repeats(d),
    "passages": lambda d, x, b: passages.repeated_passages(d),
    "toxicity": lambda d, x, b: toxicity.score_toxicity(d, x),
    "quality": lambda d, x, b: quality.score_quality(d, x),
    "keep_good": lambda d, x, b: quality.keep_good(d, x),
    "html": lambda d, x, b: html_text.extract(d.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), F.lit(1).alias("text"), F.lit(2).alias("n_chars"))),
}
ONE_FOR_ONE = {"tokens", "secrets", "redact", "simhash", "similar", "plan_mix", "repeats", "toxicity", "quality", "html"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, docs, labels, benchmark):
    rows = OPERATORS[name](docs, labels, benchmark).collect()
    if name in ONE_FOR_ONE:
        assert len(rows) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, docs, labels, benchmark):
    assert OPERATORS[name](docs.where("false"), labels.where("false"), benchmark.where("false")).collect() == []


def test_empty_side_tables(docs, labels, benchmark):
    assert decontaminate.without_leaks(docs, benchmark.where("false")).count() == len(ROWS)
    assert quality.score_quality(docs, labels.where("false")).count() == len(ROWS)
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, labels.where("false")).collect()} == {0}


def test_defined_results(docs, labels, benchmark):
    marks = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert (5, 1) in marks and (1, 1) in marks and (None, 1) in marks
    assert (3, 2) in marks and (7, 2) in marks and (2, 2) in marks  # no words: fingerprint zero
    left = {r["doc_id"]: r for r in repeats.remove_repeats(docs).collect()}
    assert left[1]["n_removed"] > 0 and left[2]["n_bytes"] == 0 and left[None]["n_removed"] == 0
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs).where("doc_id is not null").collect())
    assert kept == [1, 2, 4, 8]
    assert {r["doc_id"] for r in decontaminate.leaks(docs, benchmark).collect()} == {1, 5, None}
    verdicts = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    assert verdicts[2]["base_failed"] and not verdicts[2]["kept"] and verdicts[7]["n_words"] == 0
    plan = mixing.plan_mix(docs).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in plan) and {r["size"] for r in plan if r["doc_id"] in (2, 3, 7)} == {0}
    out = OPERATORS["redact"](docs, labels, benchmark)
    assert out.columns == docs.columns


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    other = " ".join(f"z{i}" for i in range(80))
    rows = [(1, TEXT), (1, other), (1, other), (2, TEXT), (None, other + " y"), (None, LONG), (None, LONG), (None, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()), key=repr)
    assert kept == sorted([(1, TEXT), (1, other), (None, LONG), (9, "")], key=repr)


def test_the_mix_takes_each_row_by_its_own_text(spark):
    rows = [(1, "a b c", "s"), (1, "d e f", "s"), (1, "d e f", "s"), (None, "g h", "s"), (None, "i j", None), (None, "i j", None), (2, "k " * 9, "t"), (3, None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan, out = mixing.plan_mix(df).collect(), mixing.mix(df).collect()
    assert len(plan) == len(rows) and sum(r["taken"] for r in plan) == sum(r["taken"] for r in out)
    assert sorted((r["doc_id"] or 0, r["size"], r["taken"]) for r in plan if r["copies"]) == sorted((r["doc_id"] or 0, r["size"], r["taken"]) for r in out)


def test_redaction_covers_a_run_around_a_base_span(spark):
    key = "Zk3Qx9Lp2Vb7Rt5Yw8" + "0123456789abcdef0123456789abcdef" + "Hj4Nm6Kd1Sf3Gc8Xz5QwErTyUiOp" * 3
    df = spark.createDataFrame([(1, f"see {key} here")], "doc_id long, text string")
    assert secrets.redact(df).first()["text"] == "see [REDACTED] here"
    assert {"hex", "random"} == {x.split(":")[0] for x in secrets.find_secrets(df).first()["spans"].split(",")}


def test_the_pipeline_takes_odd_tables(spark, tmp_path, docs, labels, benchmark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, df in {"documents": docs, "labels": labels, "benchmark": benchmark}.items():
        df.write.parquet(str(tmp_path / "odd" / f"{name}.parquet"))
        df.where("false").write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert set(docs.columns) <= set(out.columns) and all(r["text"] for r in out.collect())
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
