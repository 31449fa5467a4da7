"""Scalar functions against stated vectors."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import embedding, hashing, identity, markdown, patch, stemmer, text

VECTORS = [
    ("Aryeh Stark", "aryeh stark"), ("  Aryeh   Stark  ", "aryeh stark"), ("Aryeh-Stark!", "aryeh stark"), ("Project: Meridian (v2)", "project meridian v2"),
    ("Cafe\u0301", "café"), ("Café", "café"), ("Straße", "strasse"), ("STRASSE", "strasse"), ("oﬀice", "office"), ("ﬁle", "file"), ("eﬃcient", "efficient"), ("waﬄe", "waffle"),
    ("ﬅ", "st"), ("և", "եւ"), ("eﬀ", "eff"), ("Σοφος", "σοφοσ"), ("אריה  שטארק", "אריה שטארק"), ("Aryeh — אריה", "aryeh אריה"),
]


def column(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("out")).first()["out"]


@pytest.mark.parametrize("raw,key", VECTORS)
def test_identity_vectors(raw, key):
    assert identity.normalize_identity_key(raw) == key


def test_identity_paths_agree(spark):
    rows = spark.createDataFrame([(a,) for a, _ in VECTORS] + [(None,)], "v string").select("v", identity.identity_key(F.col("v")).alias("k")).collect()
    assert {r["v"]: r["k"] for r in rows} == dict(VECTORS) | {None: None}


@given(st.text(alphabet=st.characters(max_codepoint=126, min_codepoint=32), max_size=30))
@settings(max_examples=100, deadline=None)
def test_identity_is_idempotent(s):
    key = identity.normalize_identity_key(s)
    assert identity.normalize_identity_key(key) == key


def test_canonical_json():
    assert hashing.canonical_serialize({"b": 1, "a": 2, "c": {"z": 9, "y": 8, "x": 7}}) == '{"a":2,"b":1,"c":{"x":7,"y":8,"z":9}}'
    assert hashing.canonical_serialize("Cafe\u0301") == hashing.canonical_serialize("Café")
    for bad in (float("nan"), float("inf"), {"é": 1, "e\u0301": 2}, object()):
        with pytest.raises((ValueError, TypeError)):
            hashing.canonical_serialize(bad)


def test_fixed_digests_equal_canonical_ones(spark):
    import hashlib

    row = spark.range(1).select(
        hashing.generation_id(F.lit("n1"), F.lit("sha256:x"), F.lit("m"), F.lit(4), F.lit(1)).alias("g"), hashing.chunk_id(F.lit("g"), F.lit("A/B"), F.lit(0)).alias("c"), hashing.config_key(F.lit("m"), F.lit(4), F.lit(1)).alias("k")
    ).first()
    digest = lambda x: hashlib.sha256(hashing.canonical_serialize(x).encode()).hexdigest()
    assert row["g"] == digest({"noteId": "n1", "contentHash": "sha256:x", "embeddingModel": "m", "embeddingDimensions": 4, "chunkerVersion": 1})
    assert row["c"] == digest({"generationId": "g", "sectionPath": "A/B", "ordinal": 0})
    assert row["k"] == digest({"embeddingModel": "m", "embeddingDimensions": 4, "chunkerVersion": 1})


def test_section_hashes_agree(spark):
    for s in ("\n\na  \n b\t\n\n", "x", "", "\n \n a\n"):
        assert column(spark, s, hashing.section_content_hash) == patch.section_hash(s)


def test_handles_slugs_ids(spark):
    digest = "a" * 64
    assert column(spark, f"sha256:{digest}:text", identity.source_handle)["kind"] == "content"
    assert column(spark, f"sha256:{digest}:html:1:2", identity.source_handle)["normalizer_version"] == 2
    assert column(spark, f"sha256:{digest}:html:1", identity.source_handle) is None
    assert column(spark, "notes/Deep/My Note.MD", identity.file_slug) == "My Note"
    one, two = (column(spark, "x", lambda c, s=s: identity.opaque_id(c, s)) for s in ("salt", "other"))
    assert one != two and len(one) == 18
    assert identity.ulid(0, bytes(10)) == "0" * 26 and identity.ulid(1, bytes(10)) > identity.ulid(0, b"\xff" * 10)


def test_tokens_count_utf16(spark):
    assert [column(spark, s, text.estimate_tokens) for s in ("", "abcd", "abcde", "😀a", "😀😀a")] == [0, 1, 2, 1, 2]


def test_paths_globs_destinations(spark):
    rx = lambda g, p: column(spark, p, lambda c: c.rlike(text.glob_pattern(g)))
    assert rx("**/*.md", "a/b/c.md") and rx("**/*.md", "c.md") and rx("a/*.md", "a/b.md") and not rx("a/*.md", "a/b/c.md") and rx("?.md", "x.md") and not rx("*.md", "amd")
    good = ("a.md", "a/b.MD")
    bad = ("/a.md", "../a.md", "a/../b.md", "sources/a.md", ".git/a.md", "a.txt", "a//b.md", "C:/a.md")
    assert all(column(spark, p, text.valid_destination) for p in good) and not any(column(spark, p, text.valid_destination) for p in bad)


def test_terminal_text_is_harmless(spark):
    raw = "a\x1b[31mred\x1b[0m\x1b]0;title\x07b\u202ec\x9b1m\x00d\te\nf"
    assert column(spark, raw, text.sanitize_terminal) == "aredbcd\te\nf"


def test_headings_and_segments(spark):
    for line, level, title in (("# A", 1, "A"), ("   ###### b ## ", 6, "b"), ("### ###", 3, ""), ("#", 1, ""), ("# foo###", 1, "foo###")):
        assert column(spark, line, text.heading_level) == level and column(spark, line, text.heading_text) == title
        found = markdown.sections(line)
        assert (found[0]["level"], found[0]["heading"]) == (level, title)
    for line in ("    # code", "####### seven", "#tag"):
        assert column(spark, line, text.heading_level) is None and markdown.sections(line) == []
    assert [column(spark, s, text.encode_segment) for s in ("", "a/b%")] == ["%00", "a%2Fb%25"]


def test_sections_are_unique_and_nested():
    body = "intro\n# A\n## B\ntext\n## B\n## B-2\n```\n# not\n```\n# A/x\n#\n# A\n"
    found = markdown.sections(body)
    assert [s["path"] for s in found] == ["A", "A/B", "A/B-2", "A/B-2-2", "A%2Fx", "%00", "A-2"]
    assert body[found[0]["body_start"] : found[0]["body_end"]].startswith("## B") and body[found[1]["body_start"] : found[1]["own_end"]] == "text\n"


def test_code_hides_links(spark):
    body = "[[a]] `[[b]]` ``[[c]] ` `` [[d|D]] `[[e]]\n````\n[[f]]\n```\n[[g]]\n````\n[[ h ]]"
    rows = column(spark, markdown.strip_code(body), text.wiki_links)
    assert [(r["target"], r["alias"]) for r in rows] == [("a", None), ("d", "D"), ("e", None), ("h", None)]


def test_chunks():
    raw = "---\nid: x\n---\n\npre\n\n# One\n\n    code\n\n## Empty\n### Deep\nbody"
    got = list(markdown.chunks(raw, "Title", ["Alias", "Title", " "]))
    assert got == [("", 0, "Title\nAlias\n\npre"), ("One", 0, "One\n\nTitle\nAlias\n\n    code"), ("One/Empty/Deep", 0, "One › Empty › Deep\n\nTitle\nAlias\n\nbody")]


def test_frontmatter_split():
    assert markdown.split_frontmatter("---\na: 1\n---\nb") == ("a: 1", "b")
    assert markdown.split_frontmatter("---\r\na: 1\r\n---\r\nb")[1] == "b"
    for raw in ("x\n---\na\n---\n", "---\na: 1\n", " ---\na\n---\n"):
        assert markdown.split_frontmatter(raw)[0] is None


def test_backoff_stays_below_its_limit(spark):
    rows = spark.range(200).select(hashing.backoff_delay(F.col("id"), F.col("id") % 12 + 1).alias("d"), (F.col("id") % 12).alias("n")).collect()
    assert all(0 <= r["d"] < min(300_000, 1000 * 2 ** r["n"]) for r in rows)


STEMS = "running run consistent consist knack knack knightly knight consignment consign happiness happi relational relat flying fli dying die generously generous hopping hop hoping hope skies sky cries cri ties tie agreed agre luxuriating luxuri sensational sensat news news".split()


def test_stems():
    assert {a: stemmer.stem(a) for a in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2]))
    assert stemmer.analyze("The Runners are RUNNING to Zürich!", {"the", "are", "to"}) == ["runner", "run", "zurich"]


def test_hash_embedding(spark):
    v = embedding.hash_vector("a", 70)
    assert len(v) == 70 and v == embedding.hash_vector("a", 70) and v != embedding.hash_vector("b", 70) and max(map(abs, v)) <= 1
    out = spark.createDataFrame([("a",), (None,)], "t string").select(embedding.hash_embed(F.col("t"), 4).alias("v")).collect()
    assert len(out[0]["v"]) == 4 and out[1]["v"] is None

    def broken(texts):
        raise RuntimeError

    assert spark.createDataFrame([("a",)], "t string").select(embedding.embed(F.col("t"), broken).alias("v")).first()["v"] is None


NOTE = "---\nid: n\naliases: [one]\n---\n# A\n\nold\n\n## B\n\nx\n# C\nend\n"


def test_patches():
    out = patch.apply_patch(NOTE, [{"kind": "section-present", "path": "A/B"}], [{"kind": "replace-section-body", "path": "A/B", "newBody": "new"}])
    assert "## B\nnew\n# C" in out
    out = patch.apply_patch(NOTE, [], [{"kind": "append-to-section", "path": "A/D", "content": "more", "createIfAbsent": True}])
    assert [s["path"] for s in markdown.sections(markdown.split_frontmatter(out)[1])] == ["A", "A/B", "A/D", "C"]
    assert patch.aliases(patch.add_alias(NOTE, "two")) == ["one", "two"]
    for pre, code in (({"kind": "section-present", "path": "Z"}, "section-not-found"), ({"kind": "alias-absent", "alias": "one"}, "alias-exists"), ({"kind": "section-content-hash", "path": "C", "expectedContentHash": "0"}, "content-hash-mismatch"), ({"kind": "frontmatter-field-absent", "field": "id"}, "field-exists"), ({"kind": "frontmatter-field-present", "field": "q"}, "field-not-found"), ({"kind": "frontmatter-value-hash", "field": "id", "expectedValueHash": "0"}, "value-hash-mismatch")):
        with pytest.raises(patch.PatchFailed) as e:
            patch.apply_patch(NOTE, [pre], [])
        assert e.value.code == code


def test_links_are_edited_outside_code():
    linked = patch.add_link(NOTE, "other", "Other")
    assert "# Links\n\n- [[other|Other]]" in linked and patch.add_link(linked, "other", "New").count("[[other|New]]") == 1
    assert "[[other" not in patch.remove_link(linked, "other")
    assert patch.remove_link("see [[x|X]] and `[[x]]`\n```\n[[x]]\n```", "x").startswith("see X and")


def test_small_mappings(spark):
    assert [column(spark, s, text.error_class) for s in ("abort", "validation", "auth", "locked:x", "odd")] == ["cancelled", "permanent", "permanent", "transient", "transient"]
    assert [column(spark, s, text.map_sensitivity) for s in ("public", "restricted")] == ["public", "internal"]
    assert [column(spark, s, text.media_alt)["gap"] for s in (None, "", " ")] == ["image-no-alt", "decorative", None]
    assert column(spark, "  \n\n    a\n b \n \n", text.normalize_body) == "    a\n b "


def test_dates_of_frontmatter():
    from tessera.sources.vault import parse_frontmatter

    f = parse_frontmatter("id: a\ntype: t\nschema_version: 1\ntitle: T\ncreated: 2026-01-02\nupdated: '2026'\nextra: 1")
    assert f["created"] == "2026-01-02" and f["status"] == "active" and f["sensitivity"] == "internal" and datetime


@pytest.mark.parametrize("raw", ["no fields", "---\n---\nx", "---\njust text\n---\n", "---\nevidence: none\n---\n", "---\nevidence:\n  - id: other\n---\n", "---\na: [\n---\n"])
def test_evidence_that_is_not_there_is_a_code(raw):
    from tessera.functions.patch import PatchFailed, set_evidence

    with pytest.raises(PatchFailed):
        set_evidence(raw, "e", {"status": "resolved"})


def test_evidence_fields_are_set_in_place():
    from tessera.functions.patch import set_evidence

    raw = "---\nid: n # c\nevidence:\n- status:\n  id: e\n- id: f\n  attempts: 1\nz: 1\n---\nbody\n"
    assert set_evidence(raw, "e", {"status": "resolved", "attempts": 2}) == raw.replace("status:\n  id: e\n", 'status: "resolved"\n  id: e\n  attempts: 2\n')
    assert set_evidence(raw, "f", {"attempts": 2, "verdict": "ok"}) == raw.replace("attempts: 1\n", 'attempts: 2\n  verdict: "ok"\n')


JSON_TEXTS = [
    '{"b":1,"a":2}', '{"b":1.0,"a":1.50,"c":1e3,"e":0.1,"f":-0.0,"g":1e-7,"m":123456789.125,"p":-5E-7}', '[ 1 , {"y":{"b":[{"d":1,"c":2}],"a":0}} ]', "null", '"a"', "-0", "12.340",
    '{"\\u00e9":"\\u001f\\n\\t\\"\\\\/\\u2028","z":[1,[],{},null,true,false,"x"],"😀":1,"￿":2,"":3}', '{"é":1}', '{"a":1,"a":2}', '{"é":1,"é":2}', "{broken", "", '{"a": 9007199254740993}', '{"n": 123456789.123456789}', '{"n": 0.00000001}',
    '{"k": "\\\\u001F", "j": "\x7f"}', '{"x": 1e400}', "[" * 300 + "]" * 300,
]


def test_canonical_json_in_the_jvm_is_that_of_the_plain_function(spark):
    import json

    from pyspark.sql import functions as F

    from tessera.functions import hashing

    def plain(text):
        try:
            return hashing.canonical_serialize(json.loads(text, object_pairs_hook=hashing._once))
        except ValueError:
            return None

    df = spark.createDataFrame([(t,) for t in [*JSON_TEXTS, None]], "t string")
    got = {r["t"]: r["c"] for r in df.select("t", hashing.canonical(F.col("t")).alias("c")).collect()}
    assert got == {t: plain(t) for t in JSON_TEXTS} | {None: None}


def test_canonical_form_of_nested_columns(spark):
    from pyspark.sql import functions as F

    from tessera.functions import hashing

    df = spark.sql("SELECT named_struct('b', array(map('z', 1, 'a', 2)), 'a', named_struct('y', 'é', 'x', 1.50D, 'w', cast(null as string))) AS v")
    assert df.select(hashing.canonical_value(F.col("v"))).first()[0] == '{"a":{"w":null,"x":1.5,"y":"é"},"b":[{"a":2,"z":1}]}'
