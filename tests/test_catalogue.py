"""Every query of the catalogue against its SQL in DuckDB."""

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name in catalogue.ORACLE_SQL:
        out = duck.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == columns
        assert plain(got) == plain([tuple(r[names.index(c)] for c in columns) for r in out.fetchall()])
    else:
        assert got


def test_identity_keys_are_of_whole_texts(spark):
    from pyspark.sql import functions as F

    from tessera.functions import identity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {tuple(r) for r in docs.select("doc_id", identity.identity_key(F.coalesce("text", F.lit("")))).collect()}
    assert {tuple(r) for r in catalogue.QUERIES["identity_key_full"](spark, SF).collect()} == whole
    assert sum(len(k) > 200 for _, k in whole) > 100


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_are_pruned_and_pushed_down(spark):
    plan = catalogue.QUERIES["orphan_notes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint>" in plan and "NestedLoop" not in plan
    plan = catalogue.QUERIES["evidence_attention"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,quality:int>" in plan


def test_the_stored_index_answers_as_the_segments_do(spark):
    stored = catalogue.QUERIES["stored_index_topk"](spark, SF).collect()
    fresh = catalogue.QUERIES["fts_topk_after_edits"](spark, SF).collect()
    assert stored and {r["doc_id"] for r in stored} == {r["doc_id"] for r in fresh}


def test_the_lifecycle_of_all_events_by_brute_force(spark):
    from tessera.streaming import lifecycle

    states = {}

    class Event:
        pass

    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: r["event_id"]):
        e, i = Event(), r["event_id"]
        e.seq, e.at, e.attempt, e.max_attempts = i, r["ts"], 1, i % 2 + 1
        e.kind, e.outcome, e.error_class = ("queued", "claimed", "ended", "cancel")[i % 4], ("ok", "failed", "failed")[i % 3], "transient" if i % 5 < 3 else "permanent"
        states[i // 4] = lifecycle.step(i // 4, states.get(i // 4), e)
    got = {r["job_id"]: (r["state"], r["attempts"]) for r in catalogue.QUERIES["job_lifecycle"](spark, SF).collect()}
    assert got == {j: s[:2] for j, s in states.items() if s is not None} and len(got) > 100


def test_analyzed_postings_of_all_documents_by_brute_force(spark):
    from collections import Counter

    from tessera.functions.stemmer import analyze
    from tessera.operators.retrieval import STOP_WORDS

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(i, t): n for i, x in docs.items() for t, n in Counter(analyze(x, frozenset(STOP_WORDS))).items()}
    assert {(r["chunk_id"], r["term"]): r["tf"] for r in catalogue.QUERIES["fts_analyzed"](spark, SF).collect()} == want


def test_an_alias_that_several_notes_have_collides_for_each_of_them(spark):
    notes = {r["c_custkey"] for r in spark.read.parquet(f"{SF}/customer.parquet").collect() if r["c_custkey"] % 3}
    owners = {}
    for n in notes:
        owners.setdefault(n % 60, set()).add(n)
    want, own = set(), 0
    for r in spark.read.parquet(f"{SF}/events.parquet").collect():
        i, held = r["event_id"], owners.get(r["event_id"] % 40, set())
        if i % 7 == 5 and held - {r["user_id"]} or i % 7 == 0 and r["user_id"] in notes:
            want.add(i)
            own += i % 7 == 5 and r["user_id"] in held
    found = catalogue.QUERIES["plan_target_findings"](spark, SF).where("code = 'identity-collision'").collect()
    assert {r["plan_id"] for r in found} == want and len(found) == len(want) and own > 0
