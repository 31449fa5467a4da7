"""Infilling: rank and select against counting, the operator against a brute-force version."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import fill_middle

SF = "/root/testdata/sf0.001"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="a\né€😀", max_size=700))
def test_rank_and_select_by_counting(text):
    raw = text.encode()
    index = fill_middle.Boundaries(np.frombuffer(raw, np.uint8))
    starts = [i for i, x in enumerate(raw) if x & 0xC0 != 0x80] + [len(raw)]
    assert index.select(np.arange(len(text) + 1)).tolist() == starts
    assert index.rank(np.arange(len(raw) + 1)).tolist() == [len([s for s in starts[:-1] if s < i]) for i in range(len(raw) + 1)]


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(text) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(text), "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, len(text), "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(text), "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_rows():
    texts = [None, "", " ", "é", "😀" * 3, "a<P>b", "<S>", "x<M", "<<P", "<P", "P><S", "line\n\nline\r\n", "é€😀a" * 5000, "nul\x00nul", "<M<P<S"]
    rows = [(i, t) for i, t in enumerate(texts * 8)]
    return rows + [(None, "no id at all"), (None, None), (3, "é"), (3, "é"), (10**15, "far <S" * 50)]


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_forms_and_cuts_by_brute_force(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), "doc_id long, text string").withColumns({c: F.lit(7) for c in ("n", "form", "output", "draw_0", "draw_3", "prefix_chars")})
    made = fill_middle.fill_in_middle(df)
    assert key(made.collect()) == key(brute(*r) for r in odd_rows())
    back = made.select("doc_id", fill_middle.restored(made["output"], made["form"])).collect()
    assert key(back) == key((i, t or "") for i, t in odd_rows())
    assert {"plain", "psm", "spm"} == {r["form"] for r in made.collect()}


def test_a_very_long_text_and_an_empty_table(spark):
    text = "пример " * 700_000
    df = spark.createDataFrame([(5, text)], "doc_id long, text string")
    assert tuple(fill_middle.fill_in_middle(df).first()) == brute(5, text)
    assert fill_middle.fill_in_middle(df.where("false")).collect() == []


@pytest.mark.parametrize("cut, late", [(0, 50), (100, 0), (100, 100)])
def test_rates(spark, cut, late):
    df = spark.range(40).selectExpr("id AS doc_id", "repeat('ab ', 20) AS text")
    forms = {r["form"] for r in fill_middle.fill_in_middle(df, "2", cut, late).collect()}
    assert forms == {"plain"} if cut == 0 else forms == {"spm" if late else "psm"}


def test_the_query_is_the_brute_force_version(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = fill_middle.op13_fill_in_middle(spark, SF).collect()
    assert len(rows) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        *head, out = brute(r["doc_id"], docs[r["doc_id"]])
        assert tuple(r) == (*head, sha(out), sha(docs[r["doc_id"]] or ""))
