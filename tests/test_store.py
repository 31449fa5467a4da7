"""Versions of tables, and a stored index kept up by increments against one made anew."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import index, segments
from tessera.operators.publication import Conflict, Snapshot, Store
from tessera.plans import commands
from tessera.sources import vault as v


def test_all_tables_of_a_version_or_none(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.snapshot() == Snapshot() and store.versions() == []
    one = store.commit(store.snapshot(), {"a": [store.stage("a", spark.range(3))], "b": [store.stage("b", spark.range(2))]})
    two = store.commit(one, append={"a": [store.stage("a", spark.range(3, 5))]}, replace={"b": []}, facts={"x": "1"})
    assert [store.read("a").count(), store.read("b").count(), store.read("a", one).count()] == [5, 0, 3]
    assert store.snapshot(1) == one and store.snapshot() == two and two.facts == {"x": "1"}
    with pytest.raises(LookupError):
        store.read("c")
    with pytest.raises(LookupError):
        store.snapshot(9)


def test_of_two_writers_one_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    base = store.commit(store.snapshot(), {"a": [store.stage("a", spark.range(1))]})
    staged = [store.stage("a", spark.range(i)) for i in (10, 20)]
    gate, outcome = threading.Barrier(2), []

    def write(part):
        gate.wait()
        try:
            outcome.append(("done", store.commit(base, append={"a": [part]}).version))
        except Conflict:
            outcome.append(("refused", None))

    writers = [threading.Thread(target=write, args=(s,)) for s in staged]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(outcome, key=str) == [("done", 2), ("refused", None)] and store.versions() == [1, 2]
    assert store.read("a").count() in (11, 21)


def test_a_refused_change_is_made_again_on_what_is_there(spark, tmp_path):
    store, tries = Store(spark, str(tmp_path)), []

    def change(base):
        tries.append(base.version)
        if len(tries) == 1:  # another writer comes in between
            store.commit(base, {"a": [store.stage("a", spark.range(7))]})
        return {"append": {"a": [store.stage("a", spark.range(1))]}}

    assert store.publish(change).version == 2 and tries == [0, 1] and store.read("a").count() == 8
    with pytest.raises(Conflict):
        store.publish(lambda base: [store.commit(base), {"facts": {}}][1], attempts=2)
    assert store.publish(lambda base: None) == store.snapshot()


def test_old_versions_expire_with_their_folders(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for i in range(4):
        store.commit(store.snapshot(), {"a": [store.stage("a", spark.range(i + 1))]})
    assert store.expire(2) == [] and store.versions() == [3, 4]
    pending = store.stage("a", spark.range(9))
    assert len(store.expire(1, 0)) == 4 and store.versions() == [4] and store.read("a").count() == 4 and pending


def chunks_of(notes):
    """One chunk for each paragraph."""
    each = notes.select("note_id", "generation_id", F.posexplode(F.split("text", "\n\n")).alias("i", "text"))
    return each.select("note_id", F.concat_ws("/", "generation_id", F.col("i").cast("string")).alias("chunk_id"), F.col("i").cast("string").alias("section_path"), "generation_id", "text")


def snapshot(spark, texts):
    rows = [(n, f"{n}.md", str(hash(t)), f"{n}-{hash(t)}", t) for n, t in texts.items()]
    return spark.createDataFrame(rows, "note_id string, path string, content_hash string, generation_id string, text string")


def answers(postings, terms):
    return [tuple(r) for r in segments.ranked(postings, terms, 5).select("rank", "note_id", "chunk_id", "section_path", "relevance").orderBy("rank").collect()]


def test_increments_answer_as_a_fresh_index(spark, tmp_path):
    r = random.Random(3)
    words = [f"word{i}" for i in range(25)]
    text = lambda: "\n\n".join(" ".join(r.choices(words, k=8)) for _ in range(r.randint(1, 3)))
    store, texts = Store(spark, str(tmp_path)), {f"n{i}": text() for i in range(12)}
    first = dict(texts)
    for step in range(6):
        if step == 1:
            texts |= {"n1": text(), "n2": text(), "new": text()}
            del texts["n3"], texts["n4"]
        elif step == 2:
            texts["n1"] = first["n1"]  # an earlier generation again
            texts["n3"] = first["n3"]
        elif step == 3:
            assert len(store.snapshot().tables["postings"]) == 3
            segments.merge(store, most=2)
            assert len(store.snapshot().tables["postings"]) == 2
        elif step == 4:
            texts = {"n1": text(), "n2": first["n2"], "n4": first["n4"]} | {k: t for k, t in texts.items() if k not in ("n1", "n2")}
        elif step == 5:
            segments.merge(store, whole=True)
            assert store.read("tombstones").count() == 0 and len(store.snapshot().tables["chunks"]) == 1
        wanted = snapshot(spark, texts)
        before = store.snapshot()
        after, tally = segments.index_pass(store, wanted, chunks_of, analyzed=False)
        assert (after == before) == (step in (3, 5))
        row = tally.first()
        assert row["outcome"] == "converged" and row["unresolved"] == 0
        if step == 2:
            assert row["notes_indexed"] == 2 and row["chunks_written"] == 0  # both come back without a chunk written
        chunks, postings = segments.served(store)
        fresh = index.plain_postings(chunks_of(wanted))
        assert {x["chunk_id"] for x in chunks.collect()} == {x["chunk_id"] for x in chunks_of(wanted).collect()}
        for terms in (["word2", "word3"], words[:9]) if step % 2 else (["word1", "none"],):
            assert answers(postings, terms) == answers(fresh, terms)


def test_stored_postings_name_chunks_by_numbers_and_texts_are_written_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    texts = {"a": "the red fox and the red hen\n\nfox", "b": "", "c": "hen Hen hen\n\nof the", "d": None}
    wanted = spark.createDataFrame([(n, f"{n}.md", f"h{n}", f"g{n}", t) for n, t in texts.items()], segments.NOTES + ", text string")
    make = lambda notes: chunks_of(notes.withColumn("text", F.coalesce("text", F.lit(""))))
    for analyzed in (False, True):
        segments.index_pass(store, wanted, make, analyzed=analyzed)
        assert sorted(x.name for x in tmp_path.iterdir()) == ["_versions", "chunks", "notes", "postings", "tombstones"]
        assert len(list((tmp_path / "chunks").iterdir())) == 1
        assert set(store.read("postings").columns) == {"term", "segment", "chunk_no", "length", "tf"}
        want = segments.postings_of(make(wanted), analyzed)
        rows = lambda df: sorted(map(tuple, df.select(sorted(want.columns)).collect()))
        assert rows(segments.served(store)[1]) == rows(want) and want.count() > 10
        assert set(segments.served(store)[0].columns) == set(chunks_of(wanted).columns)
        tmp_path = tmp_path / "second"
        store = Store(spark, str(tmp_path))


def test_a_note_that_cannot_be_embedded_keeps_what_is_stored(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    make = lambda notes: chunks_of(notes).withColumn("embedding", F.when(~F.col("text").contains("bad"), F.array(F.lit(1.0))))
    segments.index_pass(store, snapshot(spark, {"a": "good one", "b": "fine"}), make)
    _, tally = segments.index_pass(store, snapshot(spark, {"a": "bad now", "b": "fine too", "c": "bad"}), make)
    row = tally.first()
    assert (row["notes_indexed"], row["unresolved"], row["generations_retired"], row["outcome"]) == (1, 2, 1, "partial")
    assert sorted(r["text"] for r in segments.served(store)[0].collect()) == ["fine too", "good one"]
    _, tally = segments.index_pass(store, snapshot(spark, {"a": "mended", "b": "fine too"}), make)
    assert tally.first()["outcome"] == "converged" and sorted(r["text"] for r in segments.served(store)[0].collect()) == ["fine too", "mended"]


def test_commands_over_a_stored_index(spark, tmp_path):
    from test_commands import NOTES, files, note

    store = Store(spark, str(tmp_path))
    vault = commands.derive(v.parse_notes(files(spark, NOTES)))
    version, tally = commands.index_vault(store, vault.notes)
    assert version.version == 1 and tally.first()["notes_indexed"] == 4
    edited = NOTES | {"alone.md": note("alone", "Harbours and lighthouses.\n"), "fifth.md": note("fifth", "More gardening.\n")}
    del edited["person.md"]
    vault = commands.derive(v.parse_notes(files(spark, edited)))
    commands.index_vault(store, vault.notes)
    assert commands.index_vault(store, vault.notes)[0].version == 2
    fresh = commands.build_index(vault.notes).cache()
    for question, kind in (("lighthouses", None), ("launch in spring", "project"), ("search", None)):
        a = commands.ask(store, vault, question, kind=kind).orderBy("rank").collect()
        assert a == commands.retrieve(vault, fresh, question, kind=kind).orderBy("rank").collect()
    asked = spark.createDataFrame([("q1", "gardening notes"), ("q2", "lighthouses"), ("q3", "")], "query_id string, text string")
    many = {(r["query_id"], r["rank"]): (r["note_id"], r["score"]) for r in commands.ask_many(store, asked).collect()}
    for q, text in (("q1", "gardening notes"),):
        for r in commands.ask(store, vault, text).collect():
            assert many[q, r["rank"]] == (r["note_id"], r["score"])
    labels = spark.createDataFrame([("q1", "fifth"), ("q2", "alone")], "query_id string, note_id string")
    row = commands.evaluate(store, asked.where("query_id <> 'q3'"), labels).first()
    assert row["queries"] == 2 and row["recall"] == 1.0


def test_failures_of_an_embedder_have_a_code(spark):
    from tessera.functions.embedding import embed, embedded

    def model(texts):
        if any("bad" in t for t in texts):
            raise ConnectionError("down")
        return [[float("nan")] if t == "odd" else [float(len(t))] for t in texts]

    df = spark.createDataFrame([("ok",), ("bad",), (None,), ("odd",), ("fine",)], "t string").coalesce(1)
    rows = {r["t"]: (r["e"]["vector"], r["e"]["code"]) for r in df.select("t", embedded(F.col("t"), model).alias("e")).collect()}
    assert rows == {"ok": ([2.0], None), "fine": ([4.0], None), None: (None, None), "bad": (None, "embedding-failed:ConnectionError"), "odd": (None, "embedding-failed:ValueError")}
    assert {r[0]: r[1] for r in df.select("t", embed(F.col("t"), model)).collect()}["bad"] is None
