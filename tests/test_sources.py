"""Vault scan, notes, normalisation by format, and the stream that follows a vault."""

import zlib

import pytest
from pyspark.sql import functions as F

from tessera.sources import normalize as N
from tessera.sources import vault
from tessera.sources.pdf import PdfRejected, pdf_text


def note(i, title="T", body="", **extra):
    fields = {"id": i, "type": "concept", "schema_version": 1, "title": title, "created": "2026-01-01", "updated": "2026-01-02"} | extra
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in fields.items()) + f"---\n{body}"


@pytest.fixture
def root(tmp_path):
    files = {
        "alpha.md": note("alpha", "Alpha", "See [[beta]] and [[Gamma Ray|g]] and `[[code]]`.\n\n# Part\n\nText\n", aliases="[First]", related="[{target: gamma, predicate: part_of}]"),
        "deep/gamma.md": note("gamma", "Gamma", "", aliases='["Gamma Ray"]', evidence="[{id: e1, status: resolved}]"),
        "beta.md": note("beta", "Beta", "[[nothing]]"),
        "bad.md": "no frontmatter",
        "new.md": note("new", schema_version=2),
        "broken.md": "---\n[\n---\n",
        ".hidden.md": note("hidden"),
        ".git/x.md": note("git"),
        "notes.txt": "text",
    }
    for name, content in files.items():
        path = tmp_path / "vault" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    (tmp_path / "vault/bytes.md").write_bytes(b"\xff\xfe\xfa")
    return str(tmp_path / "vault")


def test_vault(spark, root):
    from tessera.operators import graph, workflow

    parsed = vault.parse_notes(vault.scan(spark, root)).cache()
    notes, errors = vault.snapshot(parsed)
    assert sorted(r["path"] for r in notes.collect()) == ["alpha.md", "beta.md", "deep/gamma.md"]
    assert {r["path"]: r["kind"] for r in errors.collect()} == {"bad.md": "missing-frontmatter", "new.md": "unsupported-schema-version", "broken.md": "invalid-frontmatter", "bytes.md": "read-error"}
    links = graph.resolve_links(vault.note_links(notes), vault.identity_keys(notes))
    got = {(r["source"], r["target"], r["predicate"]): r["target_id"] for r in links.collect()}
    assert got[("alpha", "beta", None)] == "beta" and got[("alpha", "gamma", "part_of")] == "gamma" and got[("beta", "nothing", None)] is None
    chunks = {(r["note_id"], r["section_path"]): r["text"] for r in vault.chunk_notes(notes).collect()}
    assert chunks[("alpha", "Part")] == "Part\n\nAlpha\nFirst\n\nText" and ("gamma", "") not in chunks
    evidence = workflow.fold_evidence(notes.where("note_id = 'gamma'"))
    assert [tuple(r) for r in evidence.select("id", "status").collect()] == [("e1", "resolved")]
    assert vault.scan(spark, root, exclude=("deep/**",)).where("path like 'deep%'").count() == 0


def test_eval_set(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"version":1,\n"queries":[{"id":"a","text":"x"}]}')
    (tmp_path / "l.json").write_text('{"version":1,"labels":{"a":["n1","n2"]}}')
    q, x = vault.read_eval_set(spark, str(tmp_path / "q.json"), str(tmp_path / "l.json"))
    assert q.count() == 1 and sorted(r["note_id"] for r in x.collect()) == ["n1", "n2"]
    (tmp_path / "q.json").write_text('{"version":2,"queries":[]}')
    with pytest.raises(Exception, match="version"):
        vault.read_eval_set(spark, str(tmp_path / "q.json"), str(tmp_path / "l.json"))[0].collect()
    vault.write_json(x, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def pdf(content=b"BT /F1 12 Tf (Hello) Tj 0 -14 Td (W\\(o\\)rld) Tj ET", font=b"/Type /Font /Subtype /Type1", filters=b"", extra=b""):
    body = b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj\n3 0 obj <</Type /Page /Parent 2 0 R /Resources <</Font <</F1 5 0 R>>>> /Contents 4 0 R>> endobj\n"
    body += b"4 0 obj <<%s /Length %d>> stream\n%s\nendstream endobj\n5 0 obj <<%s>> endobj\n" % (filters, len(content), content, font)
    return b"%PDF-1.4\n" + body + b"trailer <</Root 1 0 R %s>>" % extra


def test_pdf():
    assert pdf_text(pdf()) == "Hello\nW(o)rld"
    packed = zlib.compress(b"BT /F1 1 Tf [(A) -300 <42>] TJ ET")
    assert pdf_text(pdf(packed, filters=b"/Filter /FlateDecode")) == "A B"
    for data, code in ((pdf(extra=b"/Encrypt 9 0 R"), "encrypted-source"), (pdf(b""), "no-extractable-text"), (pdf(font=b"/Type /Font /Subtype /Type0"), "partial-extraction"), (pdf(filters=b"/Filter /DCTDecode"), "partial-extraction"), (b"%PDF-", "partial-extraction")):
        with pytest.raises(PdfRejected) as e:
            pdf_text(data)
        assert e.value.code == code


def refused(data):
    with pytest.raises(PdfRejected) as e:
        pdf_text(data)
    return e.value.code


def test_pdf_is_never_half_read():
    text = b"BT /F1 1 Tf " + b"".join(b"(line %d) Tj T* " % i for i in range(400)) + b"ET"
    packed = zlib.compress(text)
    flate = b"/Filter /FlateDecode"
    assert pdf_text(pdf(packed, filters=flate)).count("line") == 400
    assert refused(pdf(packed[: len(packed) // 2], filters=flate)) == "partial-extraction"
    shown = b"BT /F1 1 Tf (caf\xe9 \x81) Tj ET"
    win = b"/Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding"
    assert refused(pdf(shown, font=win)) == "partial-extraction"
    assert pdf_text(pdf(shown.replace(b" \x81", b""), font=win)) == "café"
    assert refused(pdf(shown.replace(b" \x81", b""))) == "partial-extraction"
    for own in (b"/ToUnicode 9 0 R", b"/Encoding <</BaseEncoding /WinAnsiEncoding /Differences [65 /B]>>"):
        assert refused(pdf(font=b"/Type /Font /Subtype /Type1 " + own)) == "partial-extraction"


def test_pdf_resources_are_inherited():
    moved = b"/Resources <</Font <</F1 5 0 R>>>>"
    tree = pdf().replace(b" " + moved, b"").replace(b"/Count 1", b"/Count 1 " + moved)
    assert pdf_text(tree) == "Hello\nW(o)rld"
    assert refused(tree.replace(b"/Type1", b"/Type0")) == "partial-extraction"
    assert refused(tree.replace(b"/F1 5 0 R", b"/F1 8 0 R")) == "partial-extraction"


def test_pdf_goes_by_the_active_trailer():
    assert pdf_text(pdf(b"BT /F1 1 Tf (about /Encrypt) Tj ET % /Encrypt")) == "about /Encrypt"
    assert pdf_text(pdf(extra=b"/Info <</Encrypt 9 0 R>>")).startswith("Hello")
    other = b"7 0 obj <</Type /Catalog /Pages 6 0 R>> endobj\n"
    old = pdf().replace(b"%PDF-1.4\n", b"%PDF-1.4\n" + other)
    assert pdf_text(old) == "Hello\nW(o)rld"
    newer = old + b"\n8 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\nxref\n0 0\ntrailer <</Root 8 0 R>>\nstartxref\nAT"
    at = b"%d" % newer.index(b"xref\n0 0")
    assert pdf_text(newer.replace(b"AT", at)) == "Hello\nW(o)rld"
    assert refused(newer.replace(b"8 0 R", b"9 0 R").replace(b"AT", at)) == "partial-extraction"
    assert refused(newer.replace(b"/Root 8 0 R", b"/Root 8 0 R /Encrypt 3 0 R").replace(b"AT", at)) == "encrypted-source"
    assert refused(pdf().replace(b"/Kids [3 0 R]", b"/Kids [3 0 R 2 0 R]")) == "partial-extraction"


CASES = [
    ("a.md", "é".encode(), None, "é"),
    ("a.txt", b"\xef\xbb\xbfx", None, "x"),
    ("a.txt", "hé".encode("utf-16"), None, "hé"),
    ("a.txt", b"\xfe\xff\x00h", None, "h"),
    ("a.md", b"\xff\xfex", "signature-mismatch", None),
    ("a.txt", b"a\x00b", "signature-mismatch", None),
    ("a.txt", b"\xc3(", "unsupported-encoding", None),
    ("a.md", b"", "no-extractable-text", None),
    ("a.pdf", b"not", "signature-mismatch", None),
    ("a.html", b"<p>x", "signature-mismatch", None),
    ("a.html", b"<!DOCTYPE html><p>a <b>b</b><span> c</span><p>d<script>x</script><br>e&amp;f", None, "a b c\nd\ne&f"),
    ("a.html", b"<html><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>", None, "one\ntwo\na\nb"),
    ("a.html", b"<html><meta charset=iso-8859-1>caf\xe9", None, "café"),
    ("a.html", b"<html><meta charset=shift-jis>x", "unsupported-encoding", None),
    ("a.html", b"<html><!-- <meta charset=x> --><script><meta charset=y></script>ok", None, "ok"),
    ("a.html", b"<html><style>x</style><template>y</template>", "no-extractable-text", None),
    ("a.html", b"<html><p>x <img alt=' two  spaces '> y", None, "x  two  spaces  y"),
    ("a.exe", b"x", "usage-error", None),
]


@pytest.mark.parametrize("path,data,code,text", CASES)
def test_formats(path, data, code, text):
    row = N.normalize_bytes(path, data)
    assert (row["reject_code"], row["text"]) == (code, text)


def test_images_leave_gaps():
    row = N.normalize_bytes("a.html", b"<html><body><p><img src=1></p><img alt=''>")
    assert [(g["kind"], g["locator"]) for g in row["gaps"]] == [("image-no-alt", "dom:/html[1]/body[1]/p[1]/img[1]"), ("image-decorative", "dom:/html[1]/body[1]/img[1]")]


def test_large_files_are_refused_unread(spark):
    files = spark.createDataFrame([("a.md", 6 << 20), ("b.pdf", 6 << 20), ("c.html", 11 << 20)], "path string, length long")
    good, bad = N.within_limits(files)
    assert [r["path"] for r in good.collect()] == ["b.pdf"] and bad.count() == 2


def test_normalize_is_one_row_a_file(spark):
    df = spark.createDataFrame([(p, bytearray(d)) for p, d, _, _ in CASES], "path string, content binary")
    got = N.normalize(df).collect()
    assert len(got) == len(CASES) and sum(r["reject_code"] is None for r in got) == sum(c is None for _, _, c, _ in CASES)


def test_stream_follows_a_vault(spark, root, tmp_path):
    from tessera.streaming.sync import follow_vault, windowed_outcomes

    seen = []
    follow_vault(spark, root, lambda df, n: seen.extend(r["note_id"] for r in df.where("error_kind is null").collect()), str(tmp_path / "state")).awaitTermination()
    assert {"alpha", "beta", "gamma"} <= set(seen)
    events = spark.createDataFrame([("2026-01-01 00:10:00", "a", 1.0), ("2026-01-01 00:20:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [tuple(r)[1:] for r in windowed_outcomes(events).collect()] == [("a", 2, 3.0)]


@pytest.mark.parametrize(
    "body, text",
    [
        ("<p>one" + "<span>" * 9 + "two<div>three</div>", "onetwo\nthree"),  # a block ends a paragraph however deep
        ("<p>one<button>two<div>three</div></button>four", "onetwo\nthree\nfour"),
        ("<b>one<p>two</b>three</p>", "one\ntwothree"),  # a block inside formatting stays open
        ("<table><tr><td>a</p>b<td>c</table>d", "a\nb\nc\nd"),
        ("<ul><li>a<ul><li>b</ul></li><li>c</ul>", "a\nb\nc"),
        ("<div>a</span></p>b</div>", "a\nb"),
        ("<td>a<table><tr><td>x</td></tr></td></table>b", "a\nx\nb"),
        ("a</body></html><p>b", "a\nb"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\nd\nu"),
        ("<p>a<table><tr><td>b</table>", "a\nb"),
    ],
)
def test_elements_end_by_their_scopes(body, text):
    from tessera.sources.normalize import html_text

    assert html_text(f"<!doctype html><html><body>{body}".encode())[0] == text


def test_what_follows_the_body_is_in_it():
    from tessera.sources.normalize import html_text

    assert html_text(b"<!doctype html><body>a</body></html><p><img src=x>")[1] == [("image-no-alt", "dom:/html[1]/body[1]/p[1]/img[1]")]


def test_plain_blocks_read_the_same_by_both_parsers():
    import random

    import yaml

    from tessera.sources import vault

    r = random.Random(4)
    parts = ["id: ", "a", "b1", " ", "  ", "\n", "\n- ", "\n  - ", "\n  ", "[", "]", "{", "}", ", ", ",", ":", ": ", "-", "--", "---", "...", "1", "0x1f", "1_0", "1:30", "2026-01-01", "yes", "null", "\u00e9", "\u65e5\u672c", "=", "(a)", "+1", "1e3", "aliases: [", "evidence: [{id: e1, attempts: 2}]\n", "'", "# x", "&a ", "*a", "\t"]

    def read(load, text):
        try:
            return repr(load(text))
        except Exception as e:
            return type(e).__name__

    got = [(text, read(vault._load_yaml, text)) for text in ("id: x\n" * r.randint(0, 1) + "".join(r.choices(parts, k=r.randint(1, 12))) for _ in range(4000))]
    assert all(found == read(yaml.safe_load, text) for text, found in got)
    assert sum(found.startswith(("{", "[", "'")) for _, found in got) > 500


def test_a_rebuild_parses_each_file_once(spark):
    from test_commands import NOTES, files

    from tessera.plans import commands
    from tessera.sources import vault

    parsed = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            parsed.add(len(b))
            yield b

    notes = vault.parse_notes(files(spark, NOTES)).mapInPandas(count, vault.NOTE)
    tables = commands.rebuild_projection(notes, drop_colliders=True)
    assert all([t.collect() for t in tables.values()][:4]) and parsed.value == len(NOTES)
