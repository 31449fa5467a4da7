"""Operators on small cases with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, graph, maintenance, retrieval, validation, workflow


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    "retrieved,labels,k,expected",
    [
        ([("a", "ABC"), ("b", "XBY"), ("c", "XYZ")], [("a", "A"), ("b", "B"), ("c", "C")], 10, (3, 0.666666667, 0.5)),
        ([("t", "AXYB")], [("t", "A"), ("t", "B")], 2, (1, 0.5, 1.0)),
        ([("t", "A")], [], 10, (1, 0.0, 0.0)),
        ([], [], 10, (0, 0.0, 0.0)),
    ],
)
def test_metrics(spark, retrieved, labels, k, expected):
    q = spark.createDataFrame([(i,) for i, _ in retrieved], "query_id string")
    r = spark.createDataFrame([(i, n + 1, x) for i, ids in retrieved for n, x in enumerate(ids)], "query_id string, rank int, note_id string")
    e = spark.createDataFrame(labels, "query_id string, note_id string")
    assert rows(evaluation.recall_and_mrr(q, r, e, k)) == [expected]


def test_ties_and_frontier(spark):
    scored = spark.createDataFrame([("n1", "c2", 1.0), ("n1", "c1", 1.0), ("n2", "c0", 2.0), ("n1", "c9", 3.0), ("n3", "c5", 5.0)], "note_id string, chunk_id string, relevance double")
    near = retrieval.rank_chunks(scored, 2, True)
    assert rows(near.select("rank", "chunk_id")) == [(1, "c1"), (2, "c2"), (3, "c0")]
    far = retrieval.rank_chunks(scored, 2, False)
    assert rows(far.select("rank", "chunk_id")) == [(1, "c5"), (2, "c9")]
    with pytest.raises(ValueError):
        retrieval.check_k(101)


def test_fusion_ties_go_by_id_bytes(spark):
    layers = spark.createDataFrame([("fts", "b", "s", 1), ("vector", "a", "t", 1), ("fts", "é", "s", 9), ("vector", "z", "t", 7)], "layer string, note_id string, section_path string, rank int")
    fused = retrieval.fuse(retrieval.fold(layers))
    assert [r["note_id"] for r in fused.orderBy("rank").collect()] == ["a", "b", "z", "é"]
    assert rows(retrieval.primary_channel(retrieval.fold(layers)))[0] == ("a", "vector")
    weighted = retrieval.fuse(retrieval.fold(layers), weights={"vector": 2.0})
    assert weighted.orderBy("rank").first()["note_id"] == "a"


def test_pack_stops_at_the_first_overflow(spark):
    s = spark.createDataFrame([(1, 1, "x" * 40), (1, 2, "x" * 400), (2, 1, "x")], "item_rank int, section_rank int, text string")
    assert rows(retrieval.pack_context(s, 50).select("item_rank", "section_rank")) == [(1, 1)]


def test_fence_serves_nothing_without_generations(spark):
    chunks = spark.createDataFrame([("g1", "c")], "generation_id string, chunk_id string")
    assert retrieval.fence(chunks, chunks.where("false")).count() == 0 and retrieval.fence(chunks, chunks).count() == 1


def test_content_change_wins_over_move(spark):
    old = spark.createDataFrame([("a", "p", "1"), ("b", "p", "1"), ("c", "p", "1"), ("d", "p", "1")], "note_id string, path string, content_hash string")
    new = spark.createDataFrame([("a", "q", "2"), ("b", "q", "1"), ("c", "p", "1"), ("e", "p", "1")], "note_id string, path string, content_hash string")
    diff = maintenance.snapshot_diff(old, new)
    assert rows(diff) == [("a", "changed"), ("b", "moved"), ("d", "dropped"), ("e", "new")]
    assert rows(maintenance.diff_counts(diff)) == [(1, 1, 1, 1, False)] and rows(maintenance.diff_counts(diff.where("false"))) == [(0, 0, 0, 0, True)]


def test_writes_are_idempotent(spark):
    stored = spark.createDataFrame([("c1", "g")], "chunk_id string, generation_id string")
    fresh = spark.createDataFrame([("c1", "g"), ("c2", "g"), ("c2", "g")], "chunk_id string, generation_id string")
    assert rows(maintenance.merge_chunks(stored, fresh)) == [("c2", "g")]
    notes = spark.createDataFrame([("n", None)], "note_id string, active_generation_id string")
    assert maintenance.orphan_chunks(fresh, notes).count() == 3 and maintenance.retire(fresh, notes).count() == 0


def test_links_resolve_by_tier(spark):
    keys = spark.createDataFrame([(0, "a", "a"), (1, "b", "x"), (2, "b", "y"), (2, "c", "y"), (2, "c", "z")], "tier int, key string, note_id string")
    links = spark.createDataFrame([("s", "a#part", 0), ("s", "b", 1), ("s", "c", 2), ("s", "q", 3)], "source string, target string, ord int")
    got = graph.resolve_links(links, keys).select("target", "target_id", "ambiguous")
    assert rows(got) == [("a#part", "a", False), ("b", "x", False), ("c", None, True), ("q", None, False)]
    assert graph.dangling(graph.resolve_links(links, keys, False)).count() == 3


def test_breadth_first_discovery(spark):
    edges = spark.createDataFrame([("a", "b", None), ("a", "c", "part_of"), ("b", "d", None), ("c", "d", None), ("d", "a", None)], "source string, target string, predicate string")
    found = rows(graph.related(edges, "a", 2).select("note_id", "distance", "from_id", "via"))
    assert found == [("b", 1, "a", "link"), ("c", 1, "a", "typed"), ("d", 1, "a", "backlink")]
    assert rows(graph.orphan_notes(spark.createDataFrame([("a",), ("q",)], "note_id string"), edges)) == [("q",)]


def test_a_search_deals_out_only_the_edges_of_its_frontier(spark, monkeypatch):
    r = random.Random(8)
    pairs = sorted({(f"n{r.randint(0, 60)}", f"n{r.randint(0, 60)}", r.choice([None, "p"])) for _ in range(90)}, key=str)
    edges = spark.createDataFrame([(*p, None) for p in pairs], "source string, target string, predicate string, alias string")
    seeds = spark.createDataFrame([("n1",), ("n7",), ("none",), (None,)], "seed string")
    found = graph.related_to_each(edges, seeds, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "FileScan parquet" in plan
    few = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(graph, "_FEW", 0)
    assert few and sorted(map(tuple, graph.related_to_each(edges, seeds, 3).collect())) == few


def test_what_a_stored_table_shuffled_is_deleted(spark):
    from tessera.operators import durable

    held = lambda: len(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").splitlines())
    before, conf = held(), spark.conf.get(durable._CLEAN, None)
    kept = durable.stored_once(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count().repartition(3, "k"))
    assert held() <= before and spark.conf.get(durable._CLEAN, None) == conf
    assert kept.count() == 700 and kept.agg(F.sum("count")).first()[0] == 5000


def test_colliders_all_go(spark):
    notes = spark.createDataFrame([("a",), ("b",), ("c",)], "note_id string")
    keys = spark.createDataFrame([("k", "a"), ("k", "b"), ("", "c"), ("", "a"), ("m", "c")], "key string, note_id string")
    assert rows(graph.without_colliders(notes, keys)) == [("c",)] and graph.identity_collisions(keys).count() == 1


def test_link_requests(spark):
    stored = spark.createDataFrame([("a", "b", None, "B"), ("a", "c", "p", None)], "source string, target string, predicate string, alias string")
    asked = spark.createDataFrame([("a", "b", None, "B", False), ("a", "b", None, "C", False), ("a", "d", None, None, False), ("a", "c", "q", None, False), ("a", "c", "p", None, True), ("a", "z", None, None, True)], "source string, target string, predicate string, alias string, remove boolean")
    assert sorted(r["change"] for r in graph.classify_link(stored, asked).collect()) == ["added", "noop", "noop", "related", "removed", "updated"]


def test_link_requests_by_cells_are_those_of_the_plain_join(spark):
    r = random.Random(5)
    names, predicates = ["a", "b", "c", "d", None], [None, "p", "q"]
    pick = lambda n, *more: sorted({(r.choice(names), r.choice(names), r.choice(predicates)) + tuple(r.choice(m) for m in more) for _ in range(n)}, key=str)
    stored = list({x[:3]: x for x in pick(40, [None, "A", "B"])}.values())
    stored = spark.createDataFrame(stored, "source string, target string, predicate string, alias string")
    asked = spark.createDataFrame(pick(150, [None, "A", "B"], [True, False]), "source string, target string, predicate string, alias string, remove boolean")
    cells = lambda df: df.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(2))).repartition(3, "target", "block")
    want = sorted(map(str, graph.classify_link(stored, asked).collect()))
    by_cells = graph.classify_link(cells(stored), cells(asked), ("target", "block"))
    assert sorted(map(str, by_cells.collect())) == want and len({w.split("change=")[1] for w in want}) == 5
    plan = by_cells._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "ENSURE_REQUIREMENTS" not in plan and "Sort" not in plan


JOBS = "job_id long, workflow string, idempotency_key string, state string, attempts long, max_attempts long, next_run_at long"


def test_queue(spark):
    jobs = spark.createDataFrame([(1, "w", "k", "pending", 0, 3, 50), (2, "w", "l", "pending", 0, 3, None), (3, "w", "m", "running", 1, 3, None), (4, "w", "n", "running", 3, 3, None), (5, "w", "o", "pending", 3, 3, None), (6, "w", "p", "pending", 0, 3, 500)], JOBS)
    assert [r["job_id"] for r in workflow.claim(jobs, F.lit(100), 5).collect()] == [2, 1]
    outcomes = spark.createDataFrame([(3, 1, "error", "transient"), (4, 3, "error", "transient"), (1, 0, "ok", None)], "job_id long, attempt long, outcome string, error_class string")
    after = {r["job_id"]: r["state"] for r in workflow.settle(jobs, outcomes, F.lit(0)).collect()}
    assert after == {1: "pending", 2: "pending", 3: "pending", 4: "failed", 5: "pending", 6: "pending"}
    fresh = spark.createDataFrame([(9, "w", "k", "pending", 0, 3, None), (8, "w", "new", "pending", 0, 3, None), (7, "w", "new", "pending", 0, 3, None)], JOBS)
    assert rows(workflow.enqueue(jobs, fresh).select("job_id")) == [(7,)]
    gone = {r["job_id"]: r["state"] for r in workflow.recover(jobs, jobs.where("job_id = 3").select("job_id")).collect()}
    assert gone == {3: "cancelled", 4: "failed"}


def test_pages(spark):
    df = spark.range(7)
    got, envelope = workflow.page(df, ["id"], 3, 6)
    assert rows(got) == [(6,)] and envelope == {"limit": 3, "offset": 6, "total": 7, "hasMore": False}
    assert workflow.page(df, ["id"], 3, 0)[1]["hasMore"] and workflow.page(df.where("false"), ["id"])[1]["total"] == 0
    for limit, offset in ((0, 0), (501, 0), (5, 7)):
        with pytest.raises(ValueError):
            workflow.page(df, ["id"], limit, offset)


def test_slots_and_transitions(spark):
    slots = spark.createDataFrame([("c", "1", "h", "done"), ("c", "2", "h", "in-progress")], "command string, idempotency_key string, request_hash string, state string")
    asked = spark.createDataFrame([("c", "1", "h"), ("c", "1", "x"), ("c", "2", "h"), ("c", "3", "h")], "command string, idempotency_key string, request_hash string")
    assert sorted(r["verdict"] for r in workflow.claim_slot(asked, slots).collect()) == ["conflict", "in-progress", "replay", "started"]
    log = spark.createDataFrame([("r", 1, "created"), ("r", 2, "planning"), ("r", 3, "applied")], "run_id string, seq int, status string")
    assert rows(workflow.invalid_transitions(log).select("seq")) == [(3,)]


def test_evidence_fold_fails_closed(spark):
    kind = "note_id string, content_hash string, evidence array<struct<id:string,status:string,attempts:int>>"
    good = spark.createDataFrame([("n", "h", [("e", None, None)])], kind)
    assert rows(workflow.fold_evidence(good)) == [("e", "n", "h", "pending", 0)]
    with pytest.raises(Exception, match="bad evidence"):
        workflow.fold_evidence(spark.createDataFrame([("n", "h", [("e", "odd", 0)])], kind)).collect()


def test_accessibility(spark):
    lines = ["# A", "### B", "# C", "[here](x)", "![](y)", "![ok](z)", "- a", "       - b"]
    df = spark.createDataFrame([("n", i, x) for i, x in enumerate(lines)], "note_id string, ord int, line string")
    assert rows(validation.accessibility(df).select("ord", "code")) == [(1, "accessibility:skipped-heading-level"), (2, "accessibility:multiple-top-headings"), (3, "accessibility:vague-link-label"), (4, "accessibility:missing-alt-text"), (7, "accessibility:list-jump")]


def test_constraints(spark):
    runs = spark.createDataFrame([("a", "failed", None), ("b", "failed", "x"), ("c", "created", "x")], "run_id string, status string, failed_checkpoint string")
    assert rows(validation.failure_without_checkpoint(runs).select("run_id")) == [("a",), ("c",)]
    findings = spark.createDataFrame([("warning",)], "severity string")
    assert rows(validation.verdict(findings)) == [(True, False)] and rows(validation.verdict(findings.where("false"))) == [(True, True)]
    configs = spark.createDataFrame([(True,), (True,), (False,)], "is_current boolean")
    assert validation.several_current(configs).count() == 1


def test_orphans_are_a_hash_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    edges = spark.range(10).selectExpr("id as source", "id + 1 as target")
    plan = graph.orphan_notes(spark.range(20).withColumnRenamed("id", "note_id"), edges)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "LeftAnti" in plan


def test_passes_over_the_index(spark):
    o = spark.createDataFrame(
        [("a", "indexed", True, 0, 2), ("b", "indexed", False, 3, 1), ("c", "empty", None, 2, 0), ("d", "empty", None, None, 0), ("e", "superseded", None, 0, 0), ("f", "write-incomplete", None, 0, 0)],
        "note_id string, kind string, reattached boolean, retired_chunks int, chunk_count int",
    )
    assert rows(maintenance.repaired(o)) == [("a", "re-activated"), ("b", "re-embedded"), ("c", "retired-orphan")]
    assert rows(maintenance.rebuild_tally(o)) == [(2, 3, 1, 1, "partial")]
    assert rows(maintenance.rebuild_tally(o.where("false"))) == [(0, 0, 0, 0, "converged")]
    asked = spark.createDataFrame([("a",), ("a",), ("c",), ("d",), ("e",), ("gone",)], "note_id string")
    got = maintenance.reconciled(asked, o)
    assert rows(got) == [("a", "reembedded"), ("c", "removed"), ("d", "unchanged"), ("e", "unchanged"), ("gone", "removed")]
    assert rows(maintenance.reconcile_tally(got)) == [(5, 1, 2, 2)]
    with pytest.raises(Exception, match="not converged: f"):
        maintenance.reconciled(o.select("note_id"), o).collect()


def test_retired_generations(spark):
    c = spark.createDataFrame([("a", "g1"), ("a", "g2"), ("b", "g3"), ("b", "g4")], "note_id string, generation_id string")
    active = spark.createDataFrame([("a", "g2"), ("b", None)], "note_id string, generation_id string")
    assert rows(maintenance.retire_superseded(c, active)) == [("a", "g2"), ("b", "g3"), ("b", "g4")]
    assert rows(maintenance.remove_notes(c, active.where("note_id = 'a'"))) == [("b", "g3"), ("b", "g4")]


def test_a_drain_runs_each_due_job_once(spark, tmp_path):
    jobs = spark.createDataFrame(
        [("a", "sync", "pending", 0, 3, None), ("b", "sync", "pending", 2, 3, 5), ("c", "none", "pending", 2, 3, 5), ("d", "sync", "pending", 0, 3, 50), ("e", "sync", "running", 1, 3, None), ("f", "sync", "pending", 0, 3, None), ("g", "sync", "pending", 0, 3, None)],
        "job_id string, workflow string, state string, attempts int, max_attempts int, next_run_at long",
    )
    seen = spark.sparkContext.accumulator(0)

    def handler(due):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b[["job_id"]]

        ran = due.mapInPandas(run, "job_id string").where("job_id <> 'g'")  # g gets no answer
        told = {"a": ("ok", None, None), "b": ("failed", "transient", "timeout"), "f": ("failed", "transient", "locked:x")}
        pick = lambda i: F.coalesce(*(F.when(F.col("job_id") == k, F.lit(v[i])) for k, v in told.items()))
        return ran.select("job_id", pick(0).alias("outcome"), pick(1).alias("error_class"), pick(2).alias("error_code"))

    after, items = workflow.run_all(jobs, {"sync": handler}, F.lit(10))
    assert rows(items) == [("a", "succeeded", None, 0), ("b", "failed", "timeout", 7), ("c", "failed", "internal", 4), ("f", "retry-scheduled", "locked:x", 0), ("g", "retry-scheduled", "internal", 0)]
    left = {r["job_id"]: r for r in after.collect()}
    assert {k: (r["state"], r["attempts"]) for k, r in left.items()} == {"a": ("succeeded", 1), "b": ("failed", 3), "c": ("failed", 3), "d": ("pending", 0), "e": ("running", 1), "f": ("pending", 1), "g": ("pending", 1)}
    assert left["f"]["next_run_at"] >= 10 and seen.value == 4
    drained = workflow.rollup(items.withColumnRenamed("outcome", "state")).first()
    assert drained["exit_code"] == 4
    assert workflow.run_all(jobs.where("false"), {}, F.lit(10))[1].count() == 0


def test_refused_operations(spark):
    ops = spark.createDataFrame([("AddAlias",), ("UpdateTaskState",), ("Erase",), (None,)], "op string")
    assert rows(workflow.refused_operations(ops)) == [("Erase", "operation-forbidden"), ("UpdateTaskState", "reserved-operation"), (None, "operation-forbidden")]


def test_layers_degrade(spark):
    chunks = spark.createDataFrame([("n1", "c1", "", "g", [1.0, 0.0]), ("n2", "c2", "", "old", [1.0, 0.0])], "note_id string, chunk_id string, section_path string, generation_id string, embedding array<double>")
    active = spark.createDataFrame([("g",)], "generation_id string")
    text = lambda served, k: served.select("note_id", F.lit(1).alias("rank"))
    both = retrieval.search_layers(chunks, active, [1.0, 0.0], text)
    assert (both.used, both.degraded, [r["note_id"] for r in both.vector.collect()]) == (("fts", "vector"), False, ["n1"])
    for broken in (None, lambda served, k: spark.read.parquet("/no/such/index")):
        x = retrieval.search_layers(chunks, active, [1.0, 0.0], broken)
        assert (x.used, x.degraded, x.text) == (("vector",), True, None)
    none = retrieval.search_layers(chunks, active.where("false"), [1.0, 0.0], text)
    assert (none.used, none.degraded, none.vector.count(), none.text.count()) == ((), False, 0, 0)


def test_a_text_layer_that_fails_when_it_is_read_is_left_out(spark, tmp_path):
    chunks = spark.createDataFrame([("n", "c", "s", "words", [1.0])], "note_id string, chunk_id string, section_path string, text string, embedding array<float>")
    folder = tmp_path / "index"
    scored = chunks.select("note_id", "chunk_id", "section_path", F.lit(1.0).alias("relevance"))
    scored.write.parquet(str(folder))
    stored = spark.read.parquet(str(folder))
    for f in folder.glob("*.parquet"):
        f.write_bytes(b"broken")
    for f in folder.glob(".*.crc"):
        f.unlink()
    found = retrieval.search_layers(chunks, None, [1.0], lambda served, k: retrieval.rank_chunks(stored.where("relevance > 0"), k, False).where("chunk_id is not null"))
    assert found.degraded and found.text is None and found.vector.count() == 1
    late = retrieval.search_layers(chunks, None, [1.0], lambda served, k: stored.withColumn("rank", F.lit(1)))
    assert late.degraded and late.used == ("vector",)


def test_words_are_stemmed_without_a_shuffle(spark):
    from tessera.functions import stemmer
    from tessera.operators import index

    df = spark.createDataFrame([(1, ["Running".lower(), "the", "naïve", "atlas", None, "runs"]), (2, []), (3, None), (4, ["the"])], "id int, w array<string>").coalesce(1)
    got = {r["id"]: r["t"] for r in df.select("id", stemmer.stem_terms(F.col("w"), ("the",)).alias("t")).collect()}
    assert got == {1: ["run", "naiv", "atlas", "run"], 2: [], 3: [], 4: []}
    chunks = spark.createDataFrame([(1, 1, "", "The runner runs, the runners run."), (2, 2, "", None)], "note_id int, chunk_id int, section_path string, text string")
    rows_ = {(r["term"], r["chunk_id"]): (r["tf"], r["length"]) for r in index.analyzed_postings(chunks).collect()}
    assert rows_ == {("runner", 1): (2, 4), ("run", 1): (2, 4), ("", 1): (1, 4), ("", 2): (1, 0)}
    assert "Join" not in index.analyzed_postings(chunks)._jdf.queryExecution().executedPlan().toString()
