"""A small vault from files to answers."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import commands
from tessera.sources import vault as v


def note(i, body, **extra):
    fields = {"id": i, "type": "concept", "schema_version": 1, "title": i.title(), "created": "2026-01-01", "updated": "2026-01-01"} | extra
    return "---\n" + "".join(f"{k}: {x}\n" for k, x in fields.items()) + f"---\n{body}"


NOTES = {
    "retrieval.md": note("retrieval", "Ranking with vectors and words. See [[meridian]].\n", aliases="[Search]"),
    "meridian.md": note("meridian", "A project about retrieval.\n\n# Plan\n\nLaunch the engine in spring.\n", type="project"),
    "person.md": note("aryeh", "Works on [[meridian|the project]] and [[Search]].\n", type="person"),
    "alone.md": note("alone", "Nobody links here; gardening notes.\n"),
}


def files(spark, notes):
    return spark.createDataFrame([(p, bytearray(t.encode())) for p, t in notes.items()], "path string, content binary")


@pytest.fixture(scope="module")
def parsed(spark):
    return v.parse_notes(files(spark, NOTES)).cache()


def test_rebuild(parsed):
    tables = commands.rebuild_projection(parsed)
    assert tables["notes"].count() == 4
    assert {(r["source"], r["target"]) for r in tables["note_links"].collect()} == {("retrieval", "meridian"), ("aryeh", "meridian"), ("aryeh", "retrieval")}
    assert [tuple(r) for r in tables["vault_schema_migrations"].collect()] == [(1, 4)]


def test_rebuild_refuses_or_leaves_gaps(spark):
    broken = v.parse_notes(files(spark, NOTES | {"x.md": note("x", "[[nowhere]]")}))
    with pytest.raises(commands.Invalid, match="dangling"):
        commands.rebuild_projection(broken)
    double = v.parse_notes(files(spark, NOTES | {"y.md": note("y", "", aliases="[Search]")}))
    with pytest.raises(commands.Invalid, match="collisions"):
        commands.rebuild_projection(double)
    assert {r["note_id"] for r in commands.rebuild_projection(double, True)["notes"].collect()} == {"meridian", "aryeh", "alone"}


def test_retrieve(parsed):
    vault = commands.derive(parsed)
    chunks = commands.build_index(vault.notes).cache()
    by_name = commands.retrieve(vault, chunks, "  SEARCH ").collect()
    assert [(r["note_id"], r["mode"]) for r in by_name] == [("retrieval", "alias")]
    assert commands.retrieve(vault, chunks, "meridian").first()["mode"] == "id"
    ranked = commands.retrieve(vault, chunks, "gardening notes", k=2).orderBy("rank").collect()
    assert "alone" in {r["note_id"] for r in ranked} and len(ranked) <= 2
    alone = commands.retrieve(vault, chunks, "gardening notes", k=2, full_text=False).collect()
    assert alone and {r["mode"] for r in alone} == {"vector"}
    current = vault.notes.where("note_id = 'meridian'").join(chunks, "note_id").select("generation_id")
    assert {r["note_id"] for r in commands.retrieve(vault, chunks, "gardening notes", active=current).collect()} == {"meridian"}
    assert commands.retrieve(vault, chunks, "gardening notes", active=current.where("false")).count() == 0
    only = commands.retrieve(vault, chunks, "launch in spring", kind="project").collect()
    assert {r["note_id"] for r in only} == {"meridian"}


def test_sync(spark, parsed):
    stored = parsed.select("note_id", "path", "content_hash")
    changed = dict(NOTES)
    changed["alone.md"] += "More.\n"
    changed["moved/person.md"] = changed.pop("person.md")
    del changed["retrieval.md"]
    vault = commands.derive(v.parse_notes(files(spark, changed)))
    diff, after = commands.sync(stored, vault)
    assert {tuple(r) for r in diff.collect()} == {("alone", "changed"), ("aryeh", "moved"), ("retrieval", "dropped")}
    assert {r["note_id"]: r["path"] for r in after.collect()} == {"alone": "alone.md", "aryeh": "moved/person.md", "meridian": "meridian.md"}
    assert commands.sync(after, vault)[1] is None and commands.sync(stored, vault, True)[1] is None


def test_reads(spark, parsed):
    vault = commands.derive(parsed)
    found, envelope = commands.related(vault, "Search", 2)
    assert {(r["note_id"], r["distance"]) for r in found.collect()} == {("meridian", 1), ("aryeh", 1)} and envelope["total"] == 2
    with pytest.raises(LookupError):
        commands.resolve_seed(vault, "unknown")
    assert commands.validate(vault).count() == 0
    active = commands.expected_generations(vault.notes).withColumnRenamed("generation_id", "active_generation_id")
    jobs = spark.createDataFrame([(1, "pending")], "job_id int, state string")
    evidence = spark.createDataFrame([("e", None)], "id string, status string")
    row = commands.status(vault, active, commands.build_index(vault.notes), jobs, evidence).first()
    assert row.asDict() == {"notes": 4, "errors": 0, "stale_notes": 0, "missing_notes": 0, "chunks": 5, "pending_jobs": 1, "open_evidence": 1, "ok": True}
    issues = spark.createDataFrame([("b", "x"), ("A", "x"), ("a", "x"), ("B", "x")], "note_id string, issue string")
    assert [r["note_id"] for r in commands.issues_in_order(issues).collect()] == ["a", "A", "b", "B"] and F


def test_migrations_run_once_and_in_order(spark):
    t = {"notes": spark.range(2).withColumnRenamed("id", "n")}
    add = lambda name: lambda tables: tables | {"notes": tables["notes"].withColumn(name, F.lit(1))}
    steps = [commands.Migration("0003", "c", add("z")), commands.Migration("0001", "a", add("x")), commands.Migration("0002", "b", add("y"))]
    before = spark.createDataFrame([("0001", "a"), ("0000", "?")], "id string, checksum string")
    after, report = commands.migrate(t, before, steps)
    assert after["notes"].columns == ["n", "y", "z"] and t["notes"].columns == ["n"]
    assert report == [("0001", "a", "skipped"), ("0002", "b", "applied"), ("0003", "c", "applied")]
    with pytest.raises(commands.Invalid, match="changed"):
        commands.migrate(t, before.withColumn("checksum", F.lit("q")), steps)
    with pytest.raises(commands.Invalid, match="duplicate"):
        commands.migrate(t, before, [*steps, steps[0]])


def test_notes_to_add_are_judged(spark, parsed):
    vault = commands.derive(parsed)
    fresh = {
        "in/a.md": note("fresh", "Words.\n"),
        "in/b.md": note("alone", "Taken id.\n"),
        "alone.md": note("other", "Taken path.\n"),
        "in/c.md": note("third", "Taken alias.\n", aliases="[search]"),
        "in/d.md": note("source-1", "Reserved.\n"),
        "in/e.md": "no fields\n",
        "sources/f.md": note("sixth", ""),
        "in/g.md": note("twin-1", "", aliases="[Same]"),
        "in/h.md": note("twin-2", "", aliases="[same]"),
    }
    added, refused = commands.add_notes(vault, files(spark, fresh))
    assert [r["note_id"] for r in added.collect()] == ["fresh"]
    codes = {r["path"]: r["code"] for r in refused.collect()}
    assert codes == {
        "in/b.md": "duplicate-id", "alone.md": "duplicate-path", "in/c.md": "duplicate-identity", "in/d.md": "reserved-identity", "in/e.md": "missing-frontmatter",
        "sources/f.md": "invalid-destination", "in/g.md": "duplicate-identity", "in/h.md": "duplicate-identity",
    }
    assert all(x.count() == 0 for x in commands.add_notes(vault, files(spark, fresh).where("false")))


def test_ingest_is_a_preview_unless_applied(spark):
    rows = [("a.txt", bytearray(b"Some words.\n"), 12), ("b.exe", bytearray(b"MZ"), 2), ("c.txt", None, 1 << 40)]
    given = spark.createDataFrame(rows, "path string, content binary, length long")
    report, texts = commands.ingest(spark, given)
    codes = {r["path"]: r["code"] for r in report.collect()}
    assert codes["a.txt"] is None and codes["b.exe"] and codes["c.txt"] == "too-large" and texts is None
    assert [r["path"] for r in commands.ingest(spark, given, True)[1].collect()] == ["a.txt"]


def test_sources_are_listed_and_shown(spark):
    rows = [("src_1", "url", "http://a", None, 1), ("src_2", "file", "b.txt", "B", 2), ("src_3", "file", "src_1", None, 2)]
    sources = spark.createDataFrame(rows, "id string, kind string, locator string, title string, added_at int")
    page, envelope = commands.list_sources(sources, 2)
    assert [r["id"] for r in page.collect()] == ["src_2", "src_3"] and envelope["hasMore"]
    assert commands.show_source(sources, "b.txt")["id"] == "src_2"
    assert commands.show_source(sources, "src_1") == {"id": "src_1", "kind": "url", "locator": "http://a", "added_at": 1}
    with pytest.raises(LookupError):
        commands.show_source(sources, "nothing")


def test_evidence_is_settled_in_the_note(spark):
    raw = note("lab", "Text.\n").replace("---\nText", "evidence:\n  - id: e1\n    status: pending\n    attempts: 2\n  - {id: e2, status: failed}\nowner: me # kept\n---\nText")
    vault = commands.derive(v.parse_notes(files(spark, {"lab.md": raw})))
    evidence = spark.createDataFrame([("e1", "lab", 2), ("e2", "lab", 0), ("e3", "lab", 1)], "id string, note_id string, attempts int")
    asked = spark.createDataFrame([("e1", True), ("e2", False), ("e3", True), ("e4", False)], "id string, retry boolean")
    report, edits = commands.settle_evidence(vault, evidence, asked, "2026-01-02")
    found = {r["id"]: (r["outcome"], r["status"], r["attempts"]) for r in report.collect()}
    assert found == {"e1": ("resolved", "resolved", 3), "e2": ("resolved", "resolved", 0), "e3": ("target-missing", "needs-review", 1), "e4": ("not-found", None, None)}
    (edit,) = edits.collect()
    again = v.parse_note("lab.md", edit["next"].encode())
    assert [(e["id"], e["status"], e["attempts"]) for e in again["evidence"]] == [("e1", "resolved", 3), ("e2", "resolved", None)]
    assert "owner: me # kept\n---\nText.\n" in edit["next"] and '{id: e2, status: "resolved", verdict' in edit["next"]


def test_plans_are_previewed(spark, parsed):
    vault = commands.derive(parsed)
    now = {r["note_id"]: r["content_hash"] for r in vault.notes.collect()}
    add = '{"ops":[{"kind":"append-to-section","path":"Plan","content":"More."}]}'
    bad = '{"ops":[{"kind":"append-to-section","path":"Nowhere","content":"More."}]}'
    rows = [
        (1, "AppendSection", "meridian", "project", None, None, ["s"], ["valid"], now["meridian"], add),
        (2, "AppendSection", "meridian", "project", None, None, [], [], now["meridian"], add),
        (3, "AppendSection", "gone", "project", None, None, ["s"], [], None, add),
        (4, "AppendSection", "meridian", "project", None, None, ["s"], [], "older", add),
        (5, "AppendSection", "meridian", "project", None, None, ["s"], ["stale"], now["meridian"], bad),
        (6, "AddAlias", "alone", "concept", "SEARCH", None, [], [], now["alone"], None),
    ]
    schema = "plan_id int, op string, target string, note_type string, alias string, object string, sources array<string>, evidence_states array<string>, grounded_hash string, patch string"
    findings, plans = commands.preview_plans(vault, spark.createDataFrame(rows, schema))
    assert {(r["plan_id"], r["code"]) for r in findings.collect()} == {(2, "missing-provenance"), (3, "dangling-note"), (5, "evidence-not-valid"), (6, "identity-collision")}
    found = {r["plan_id"]: r for r in plans.collect()}
    assert {k: r["outcome"] for k, r in found.items()} == {1: "ready", 2: "refused", 3: "refused", 4: "stale", 5: "section-not-found", 6: "refused"}
    assert "Launch the engine in spring.\n\nMore.\n" in found[1]["next"] and found[4]["next"] is None
    chunks = commands.build_index(vault.notes)
    _, enriched = commands.enrich(vault, chunks, "meridian", lambda context: spark.createDataFrame(rows[:1], schema))
    assert [r["outcome"] for r in enriched.collect()] == ["ready"]
    with pytest.raises(LookupError):
        commands.enrich(vault, chunks.where("false"), "x y", lambda context: context)


def test_a_revision_is_read_without_a_checkout(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", tmp_path, "-c", "user.name=n", "-c", "user.email=e@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a b").mkdir()
    for path, text in (NOTES | {"a b/twin.md": note("alone", "Same id.\n"), "bad.md": "no fields", "x.txt": "x"}).items():
        (tmp_path / path).write_text(text)
    git("add", "-A")
    git("commit", "-qm", "first")
    (tmp_path / "alone.md").write_text("changed later")
    from tessera.sources import revision

    scanned = revision.scan_revision(spark, str(tmp_path), "HEAD", partitions=3)
    assert {r["path"]: bytes(r["content"]).decode() for r in scanned.collect()}["alone.md"] == NOTES["alone.md"] and scanned.count() == 6
    assert {(r["note_id"], r["path"]) for r in revision.first_of_each_id(v.parse_notes(scanned)).collect()} >= {("alone", "a b/twin.md"), ("meridian", "meridian.md")}
    assert revision.scan_revision(spark, str(tmp_path), "nowhere").count() == 0
    tables, gaps = commands.rebuild_from_revision(spark, str(tmp_path), "HEAD")
    assert {r["note_id"] for r in tables["notes"].collect()} == {"retrieval", "meridian", "aryeh"}
    assert sorted((r["table"], r["reason"]) for r in gaps.collect() if r["detail"]) == [("notes", "identity-collision")] * 2 + [("notes", "unreadable")]
    assert gaps.count() == 5
