"""Operators against brute force, held-out accuracy or exact round trips."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import components, decontaminate, html_text, mixing, passages, quality, repeats, secrets, simhash, token_counts, toxicity

SF = "/root/testdata/sf0.001"


def roots(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- SimHash ---------------------------------------------------------------------------------


def test_fingerprints_are_the_contract(spark):
    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    texts = ["", "One", "a b c d", "A b C d e É f", "x y\x0bz\x1cq w v u t s", "a b c d " * 5]
    rows = simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in rows} == {i: brute(t) for i, t in enumerate(texts)}


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4))
@settings(max_examples=200, deadline=None)
def test_every_pair_in_the_radius_meets(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    assert any(x & m == y & m for m in simhash.covering_masks(4))


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    draw = random.Random(1)
    fps = []
    for _ in range(40):
        fp = draw.getrandbits(64)
        for _ in range(draw.randrange(1, 30)):
            fps.append(fp)
            fp ^= sum(1 << draw.randrange(64) for _ in range(draw.randrange(0, 6)))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4)
    found = {r["id"]: r["component"] for r in components.connected_components(links).collect()}
    exact = roots([(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4], signed)
    assert {i: found.get(i, i) for i in signed} == exact


def test_long_chain_settles(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {tuple(r) for r in components.connected_components(edges).collect()} == {(i, 0) for i in range(1, n + 1)}


def test_similar_documents_follow_similarity(spark):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [[draw.choice(vocabulary) for _ in range(300)] for _ in range(12)]
    texts = []
    for b in base:
        texts.append(b)
        for edits in (1, 3, 60):
            c = b[:]
            for i in draw.sample(range(300), edits):
                c[i] = "new" + str(draw.random())
            texts.append(c)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert all(got[4 * k] == got[4 * k + 1] == got[4 * k + 2] == 4 * k for k in range(12))  # similarity 0.97, 0.9
    assert all(got[4 * k + 3] == 4 * k + 3 for k in range(12))  # about 0.2


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("kind", ["block", "append", "scattered"])
def test_every_kind_of_edit_is_joined(spark, kind):
    draw = random.Random(12)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(40):
        b = [draw.choice(vocabulary) for _ in range(300)]
        c = b[:]
        if kind == "block":
            c[100:128] = [f"new{draw.random()}" for _ in range(28)]
        elif kind == "append":
            c += [f"new{draw.random()}" for _ in range(66)]
        else:
            for i in range(20, 280, 52):
                c[i] = f"new{draw.random()}"
        texts += [" ".join(b), " ".join(c)]
    assert all(jaccard(texts[2 * k], texts[2 * k + 1]) >= 0.8 for k in range(40))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert all(got[2 * k + 1] == 2 * k for k in range(40))


@given(st.sets(st.integers(0, 200), min_size=1, max_size=60), st.sets(st.integers(0, 200), max_size=8), st.integers(0, 8), st.sets(st.integers(0, 200)))
@settings(max_examples=300, deadline=None)
def test_prefixes_of_similar_sets_meet(a, more, drop, hot):
    b = set(sorted(a)[drop:]) | more
    arrays = [np.array(sorted(x), np.uint64) for x in (a, b)]
    common = np.array(sorted(hot), np.uint64), np.arange(len(hot), 0, -1)
    if b and len(a & b) >= 0.8 * len(a | b):
        p, q = (simhash.prefix(x, 0.8, common).tolist() for x in arrays)
        assert set(p) & set(q)


@pytest.mark.parametrize("block", [3, 512])
def test_groups_equal_exact_similarity(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "SETS", block)
    draw = random.Random(13)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        b = [draw.choice(vocabulary) for _ in range(draw.randrange(5, 200))]
        for n in range(4):
            c = b[:]
            at = draw.randrange(len(c))
            c[at : at + n * len(c) // 24] = [draw.choice(vocabulary) for _ in range(n * len(c) // 24)]
            texts.append(" ".join(c))
    pairs = [p for p in itertools.combinations(range(len(texts)), 2) if p[0] // 4 == p[1] // 4]
    exact = roots([p for p in pairs if jaccard(texts[p[0]], texts[p[1]]) >= 0.8], range(len(texts)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == exact and len({*exact.values()}) not in (40, 160)


def test_fingerprints_find_candidates_and_sets_decide(spark, monkeypatch):
    text = _prose(36)
    long = text(4000)
    cut = [w for i, w in enumerate(long) if i % 12]  # similarity below 0.8, whatever the fingerprints
    docs = [(1, long), (2, long[:2000] + ["other"] + long[2001:]), (3, cut), (4, text(300))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    monkeypatch.setattr(simhash, "similar_links", lambda nodes, agree: nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false"))
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


# --- decontamination ---------------------------------------------------------------------------


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            before, row[j] = row[j], min(before + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


@pytest.mark.parametrize("rate", [0.08, 0.12])
def test_leaks_keep_their_whole_budget(rate):
    draw = random.Random(22)
    items = sorted({n: decontaminate.normalise("".join(draw.choice("abcdefghij klm") for _ in range(3 * n)))[:n].strip() for n in (6, 8, 11, 12, 13, 14, 18, 19, 20, 24, 25, 28, 29, 37, 38, 39, 49, 50, 90)}.items())
    parts = decontaminate.indexes([(n, x) for n, x in items], 10, rate)
    budget = {p.ids[i]: int(p.budget[i]) for p in parts for i in range(len(p.ids))}
    texts = []
    for _, item in items:
        for hits in (0, 1, 2, 3, 4, 7, 8):
            step = max(1, len(item) // (hits + 1))
            changed = "".join("Q" if hits and i % step == step - 1 and i // step < hits else c for i, c in enumerate(item))
            texts.append(f"xx yy {changed} zz ww")
    found = {(t, i): e for t, i, e, _, _ in decontaminate.find_all(texts, parts)}
    exact = {(t, n): e for t, x in enumerate(texts) for n, item in items if budget[n] and (e := edits(item, x)) <= budget[n]}
    short = {(t, n): 0 for t, x in enumerate(texts) for n, item in items if not budget[n] and re.search(rf"(?<!\w){re.escape(item)}(?!\w)", x)}
    assert found == exact | short and len(short) >= 1 and all(budget[n] == int(len(x) * rate) for n, x in items)


def test_short_items_are_whole_words():
    parts = decontaminate.indexes([(1, "ate"), (2, "he ate"), (3, "a"), (4, "?"), (5, "")], 10, 0.08)
    found = [(t, i) for t, i, *_ in decontaminate.find_all(["he ate it", "the ate", "plate", "ate.", "", "who?"], parts)]
    assert found == [(0, 1), (0, 2), (1, 1), (3, 1), (5, 4)]


def test_leaks_equal_brute_force():
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefgh ") for _ in range(6)) for _ in range(400)]
    items = [decontaminate.normalise(" ".join(draw.sample(words, 12))) for _ in range(6)]
    index = decontaminate.Items(list(range(6)), items, 6, 0.08)
    texts = []
    for k in range(60):
        item = list(items[k % 6])
        for _ in range(draw.randrange(0, 10)):
            at = draw.randrange(len(item))
            item[at : at + draw.randrange(0, 2)] = draw.choice("xyz") * draw.randrange(0, 2)
        texts.append(decontaminate.normalise(" ".join(draw.sample(words, 10)) + " " + "".join(item) + " " + " ".join(draw.sample(words, 10))))
    found = {(t, i): e for t, i, e, _, _ in decontaminate.find(texts, index)}
    exact = {(t, i): e for t, x in enumerate(texts) for i, item in enumerate(items) if (e := edits(item, x)) <= index.budget[i]}
    assert found == exact and len(exact) > 20


def test_a_short_item_with_one_letter_changed_is_found():
    for n in (13, 15, 19, 20):
        item = "the quick brown fox j"[:n]
        parts = decontaminate.indexes([(1, item)], 10, 0.08)
        assert [x[:3] for x in decontaminate.find_all([f"so {item[:6]}#{item[7:]} it is", "nothing here at all"], parts)] == [(0, 1, 1)]


@pytest.mark.parametrize("part", [60, 700])
def test_texts_cut_inside_give_the_same_matches(monkeypatch, part):
    draw = random.Random(4)
    items = [decontaminate.normalise("".join(draw.choice("ab c") for _ in range(n)))[:n].strip() for n in (12, 30, 45, 60, 61)] + ["ab" * 20, "a" * 35]
    texts = [decontaminate.normalise("".join(draw.choice("ab c") for _ in range(400))) + " " + x[: len(x) // 2] + "z" + x[len(x) // 2 + 1 :] for x in items] + ["a" * 90 + "b" + "a" * 90, "ab" * 80, ""]
    parts = decontaminate.indexes(list(enumerate(items)), 10, 0.08)
    whole = decontaminate.find_all(texts, parts)
    monkeypatch.setattr(decontaminate, "PART", part)
    cut = decontaminate.find_all(texts, parts)
    assert [x[:3] for x in cut] == [x[:3] for x in whole] and len(whole) >= 8


def test_a_long_repetitive_text_takes_little_memory():
    import resource

    parts = decontaminate.indexes([(1, "a" * 600), (2, "unlike any of it, " * 12)], 10, 0.08)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert [x[:3] for x in decontaminate.find_all(["a" * 10_000_000, "b" * 200_000], parts)] == [(0, 1, 0)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 2_500_000  # kB


def test_spans_point_into_the_text():
    raw = "Ähm  SOME Öther\n\ttext that is here"
    text = decontaminate.normalise(raw)
    s = text.find("some")
    assert raw[slice(*decontaminate.original_span(raw, s, s + len("some öther text")))] == "SOME Öther\n\ttext"


def test_blocks_of_items_agree(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {tuple(r) for r in decontaminate.leaks(docs, items).collect()}
    assert whole and whole == {tuple(r) for r in decontaminate.leaks(docs, items, block_chars=1500).collect()}
    kept = {r["doc_id"] for r in decontaminate.without_leaks(docs, items).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {r[0] for r in whole}


# --- pages -------------------------------------------------------------------------------------


def test_main_text_of_pages():
    para = "A sentence of the article that goes on for a while, long enough to matter. " * 3
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header><a href="/">Site name and slogan, long and long and long and long and long</a></header>
    <nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav><div class="cookie-notice">We use cookies {para}</div>
    <div id="content"><h1>Title &amp; more</h1><p>{para}<p>Short<br>line.<script>var x="</p>";</script><div class="ad">Buy {para}</div><p>{para} <a href=z>link</a> end&nbsp;.</div>
    <aside>{para}</aside><form><p>{para}</p></form><section id="comments"><article class="comment"><p>{para}</p></article></section><footer>{para}</footer></body></html>"""
    p = " ".join(para.split())
    assert html_text.main_text(page) == f"Title & more\n\n{p}\n\nShort line.\n\n{p} link end ."
    assert html_text.main_text(f"<body><p>out {para}</p><main><article><header><h2>H</h2><p>by x</p></header><p>tiny</p></article></main>") == "H\n\ntiny"
    for odd in ("", "<", "<p", "<!--", "<script>", "&amp", "</p></p>", "<b" * 50):
        html_text.main_text(odd)


PARA = "A sentence of the article that goes on for a while, long enough to matter, and then some more of it."


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<article><p class="share-price">{PARA}</p><div class="related-work">{PARA}</div><p id="comment-policy">{PARA}</p></article>', [PARA, PARA, PARA]),
        (f'<article><p>{PARA}</p><div class="ad">x</div><div class="ad-slot">y</div><div class="ad">z</div><p>The end.</p></article>', [PARA, "The end."]),
        (f"<article><p>{PARA}</p></article><article><p>A short second one.</p></article>", [PARA, "A short second one."]),
        (f"<article><header><h1>Title</h1><p>What it is about, in one sentence.</p><p>by A. Writer</p></header><p>{PARA}</p></article>", ["Title", "What it is about, in one sentence.", PARA]),
        (f"<body><div><p>{PARA}</p><ul>" + "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(5)) + f"</ul><p>{PARA}</p></div></body>", [PARA, *[f"Link number {i}" for i in range(5)], PARA]),
        (f'<body><div class="sidebar-nav"><a href=/>Home</a> and more of it</div><div><p class="share-price">{PARA}</p></div><div class="share-buttons">Tell your friends about us, all of them.</div></body>', [PARA]),
        (f'<article><p>{PARA}</p><div class="comments-section"><p>{PARA}</p></div><div class="share-buttons">{PARA}</div><ul class="related-posts"><li>{PARA}</li></ul></article>', [PARA]),
        (f"<article>{'<i><b>' * 9}<p>{PARA}{'<i>' * 20}x<p>{PARA}</article>", [PARA + "x", PARA]),
    ],
)
def test_pages_of_known_content(page, text):
    assert html_text.main_text(page) == "\n\n".join(text)


@given(st.text(alphabet="<>/ap\"'= !-&;div", max_size=200))
@settings(max_examples=300, deadline=None)
def test_no_markup_breaks_the_parser(s):
    html_text.main_text(s)


# --- tokens ------------------------------------------------------------------------------------


@given(st.lists(st.binary(min_size=1, max_size=5), max_size=30), st.lists(st.binary(max_size=12), max_size=10))
@settings(max_examples=200, deadline=None)
def test_lengths_equal_greedy_cutting(vocabulary, words):
    automaton = token_counts.Automaton(vocabulary)
    pieces = {*vocabulary, *(bytes([b]) for b in range(256))}
    for word in words:
        rest, n = word, 0
        while rest:
            k = max(i for i in range(1, len(rest) + 1) if rest[:i] in pieces)
            rest, n = rest[k:], n + 1
        assert automaton.length(word) == n


# --- secrets -----------------------------------------------------------------------------------


def test_base_spans_equal_the_patterns(spark):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

    def brute(t):
        out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])

    draw = random.Random(5)
    bits = ["token", "=", ":", " ", '"', "secret", "Api_Key", "abcdefgh", "AKIA", "ABCDEF012345", "0123456789abcdef", "é", "😀", "\n", "x", "password"]
    texts = ["".join(draw.choices(bits, k=draw.randrange(1, 40))) for _ in range(300)]
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        base = brute(texts[r["doc_id"]])
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_models_tell_random_from_ordinary(spark):
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(200)]
    import base64

    random_ = [base64.b64encode(k)[:30].decode() for k in keys] + [k.hex()[:24] for k in keys[:100]]
    plain = ["getUserAccountSettings" + w.title() for w in secrets._WORDS[:100]] + [f"static/{a}/{b}_handler" for a, b in zip(secrets._WORDS[100:200], secrets._WORDS[:100])]
    rows = [(i, f"see {t} here") for i, t in enumerate(random_ + plain)]
    got = {r["doc_id"]: r["n_random"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(len(random_))) >= 0.95 * len(random_)
    assert sum(got[i] for i in range(len(random_), len(rows))) == 0


def test_long_runs_are_scored(spark):
    import base64

    key = base64.b64encode(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(38))).decode()
    path = "/".join(secrets._WORDS[:120])
    assert len(key) > 1600 and len(path) > 700
    df = spark.createDataFrame([(1, f"a {key} b"), (2, f"a {path} b"), (3, f"a {key * 40} b")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()} == {1: "a [REDACTED] b", 2: f"a {path} b", 3: "a [REDACTED] b"}


def test_redaction_hides_every_span(spark):
    rows = [(1, 'a token = "5bbf0274eef70e05c644ebfa24bebaa8d5fe62a0" z'), (2, "nothing"), (3, None)]
    out = {r["doc_id"]: r["text"] for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 'a [REDACTED]" z', 2: "nothing", 3: None}


# --- mixing ------------------------------------------------------------------------------------


def test_mix_meets_its_targets(spark):
    draw = random.Random(6)
    rows = [(i, "w " * draw.randrange(0, 60), draw.choice("aaaaabcd") if draw.random() < 0.95 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mix(df).collect()
    again = {tuple(r) for r in mixing.plan_mix(df.repartition(7)).collect()}
    assert {tuple(r) for r in plan} == again
    source = {i: s for i, _, s in rows}
    taken, target = Counter(), {}
    for r in plan:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    total = sum(r["size"] for r in plan)
    assert abs(sum(target.values()) - total) < 1e-6 * total
    assert all(abs(taken[s] - target[s]) <= 120 for s in target)
    assert 0 <= total - sum(taken.values()) < 240


# --- repeats and passages ------------------------------------------------------------------------


def brute_repeats(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("together", [1, 3, 4096])
def test_repeats_equal_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    monkeypatch.setattr(repeats, "LONGEST", 20)
    draw = random.Random(7)
    rows = [(i, "".join(draw.choice("abé") for _ in range(draw.randrange(0, 90))) + "xyz" * draw.randrange(0, 30)) for i in range(80)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 12, 5).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == brute_repeats(rows, 12)


def test_a_hot_anchor_is_cut_finer(spark, monkeypatch):
    monkeypatch.setattr(repeats, "TOGETHER", 8)
    draw = random.Random(17)
    line = "common line of the corpus"
    tails = ["".join(draw.choice("abc") for _ in range(60)) for _ in range(6)]
    rows = [(i, draw.choice(tails) + "".join(draw.choice("abc") for _ in range(9)) + line + draw.choice(tails)) for i in range(120)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 30, 8).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == brute_repeats(rows, 30)


def test_chains_equal_brute_force():
    draw = random.Random(8)
    for _ in range(60):
        matches = [(draw.randrange(60), draw.randrange(60), 5) for _ in range(draw.randrange(1, 12))]
        order = sorted(set(matches))
        best = {}
        for x, y, n in order:
            best[x, y] = 12 + max([0.0] + [v - 0.3 * (x - a + y - b) for (a, b), v in best.items() if a < x and b < y])
        found = passages.chains(matches, gap=0.3, least=1)
        score = lambda c: sum(12 - (0.3 * (q[0] - p[0] + q[1] - p[1]) if p else 0) for p, q in zip([None, *c], c))
        assert abs(max(map(score, found)) - max(best.values())) < 1e-9
        assert sorted(m for c in found for m in c) == order


def test_planted_passages_are_found(spark):
    draw = random.Random(9)
    words = ["".join(draw.choices("abcdefghij", k=draw.randrange(2, 9))) for _ in range(4000)]
    text = lambda n: draw.choices(words, k=n)
    passage = text(60)
    fuzzy = passage[:]
    for i in (9, 25, 44):
        fuzzy[i] = "other"
    del fuzzy[33]
    docs = [(1, text(80) + passage + text(30)), (2, text(300)), (3, text(10) + fuzzy + text(99)), (4, passage), (5, text(50) + passage[:20] + text(50))]
    rows = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_id"]) for r in rows} == {(3, 1), (4, 1), (4, 3)}
    for r in rows:
        whole = " ".join(dict(docs)[r["doc_id"]])
        assert abs(len(whole[r["start_char"] : r["end_char"]].split()) - 60) <= 3


@pytest.mark.parametrize("gaps", [(100, 100), (200, 200), (400, 400), (0, 100), (150, 3)])
def test_two_passages_of_one_pair(spark, gaps):
    draw = random.Random(10)
    words = ["".join(draw.choices("abcdefghij", k=draw.randrange(2, 9))) for _ in range(4000)]
    text = lambda n: draw.choices(words, k=n)
    head, foot = text(60), text(60)
    docs = [(1, head + text(gaps[0]) + foot), (2, head + text(gaps[1]) + foot)]
    rows = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")).collect()
    whole = " ".join(docs[1][1])
    found = sorted((r["start_char"], r["end_char"], r["n_matched"]) for r in rows)
    assert len(found) == 2 and all(60 <= n <= 61 for *_, n in found)
    assert whole[: found[0][1]].startswith(" ".join(head)) and whole[found[1][0] :].endswith(" ".join(foot))


def _prose(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefghij", k=draw.randrange(2, 9))) for _ in range(4000)]
    return lambda n: draw.choices(words, k=n)


@pytest.mark.parametrize("few", [2, 8])
def test_pieces_in_earlier_documents_hide_no_copy(spark, monkeypatch, few):
    monkeypatch.setattr(passages, "FEW", few)
    text = _prose(31)
    whole = text(90)
    docs = [(i, text(40) + whole[15 * (i - 1) : 15 * (i - 1) + 30] + text(40)) for i in range(1, 6)]
    docs += [(11, text(50) + whole + text(20)), (12, text(9) + whole + text(70)), (13, text(33) + whole)]
    rows = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_id"]) for r in rows} >= {(12, 11), (13, 11)} and {r["doc_id"] for r in rows} == {12, 13}
    assert all(r["n_words"] >= 88 for r in rows if r["source_id"] == 11)


def test_frequent_seeds_drop_no_partner(spark):
    text = _prose(33)
    whole, docs = text(72), []
    for i in range(12):  # every seed has many holders, and its first is no copy
        docs += [(100 * i + at, text(30) + whole[at : at + 18] + text(30)) for at in range(0, 72, 9)]
    copies = []
    for i in range(2):
        copy = whole[:]
        for at in range(8 + i, 72, 13):
            copy[at] = "x" * (3 + 5 * i)
        copies.append((5000 + i, text(20 + i) + copy + text(40)))
    rows = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in docs + copies], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_id"]) for r in rows} == {(5001, 5000)} and max(r["n_words"] for r in rows) >= 60


@pytest.mark.parametrize("large", [3, 256])
def test_partners_behind_a_very_common_line(spark, monkeypatch, large):
    monkeypatch.setattr(passages, "LARGE", large)
    monkeypatch.setattr(passages, "BLOCK", 10)
    text = _prose(34)
    line, tail = text(24), text(30)
    docs = [(i, text(50) + line + text(50)) for i in range(40)]
    scattered = [w if i % 4 else "other" for i, w in enumerate(tail)]  # no five words in a row agree
    docs += [(50, text(40) + line + tail + text(9)), (51, text(30) + line + scattered + text(20))]
    rows = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["source_id"]) for r in rows] == [(51, 50)] and rows[0]["n_words"] >= 50


def test_contexts_of_many_texts_are_those_of_each():
    draw = random.Random(38)
    texts = [bytes(draw.choices(b"ab", k=draw.randrange(0, 60))) for _ in range(200)] + [b"", b"a" * 11, b"a" * 12, b"ab" * 700]
    got = list(zip(*(c.tolist() for c in repeats.contexts(texts, 12, 5))))
    assert got == [(i, *row) for i, x in enumerate(texts) for _, *row in zip(*(c.tolist() for c in repeats.contexts([x], 12, 5)))]
    for i, x in enumerate(texts):
        grams = repeats.gram_hashes(np.frombuffer(x, np.uint8), 5).tolist() if len(x) >= 12 else []
        at = 0
        for _, h, p, n, twice in (g for g in got if g[0] == i):  # every string once, with its least hash
            assert p == at and all(min(grams[s : s + 8]) == h % (1 << 64) for s in range(p, p + n))
            assert twice == (grams[p : p + n + 7].count(h) > 1)
            at += n
        assert at == max(0, len(x) - 11)


def test_near_seeds_of_one_class_are_not_paired(spark, monkeypatch):
    sizes, plain = [], passages.written

    def counted(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(passages, "written", counted)
    text = _prose(36)
    whole = text(400)
    docs = [(i, text(20) + whole[:200] + [f"other{i}"] + whole[200:] + text(20)) for i in range(30)]
    rows = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_id"]) for r in rows} >= {(i, 0) for i in range(1, 30)}
    assert max(sizes) < 2 * sizes[0]  # no table has many times the rows of that of the seeds


def test_alike_places_are_those_of_all_pairs():
    draw = random.Random(39)
    n, width = 300, 48
    base = [draw.choices(range(1, 30), k=60) for _ in range(3)]

    def side():
        words = draw.choice(base)[draw.randrange(0, 3) :][: draw.choice((3, 9, 15, 30, 50))]
        words = [w for w in words if draw.random() > 0.05] + draw.choices(range(1, 400), k=60)
        return [w if draw.random() > 0.05 else draw.randrange(1, 400) for w in words[:width]]

    places = {c: np.array([draw.choice(v) for _ in range(n)]) for c, v in (("own", (0, 1)), ("doc", range(60)), ("cls", range(40)), ("apart", (30, 200, 400)), ("size", (6, 8, 12, 20, 27, 45)))}
    places["group"] = np.sort(np.array([draw.randrange(3) for _ in range(n)]))
    places["cross"] = places["group"] == 1
    places |= {c: np.array([side() for _ in range(n)], np.uint64) for c in ("before", "after")}
    seeds = [[(draw.randrange(40), draw.randrange(0, 1400)) for _ in range(6)] for _ in range(n)]
    places |= {"row": np.repeat(np.arange(n), 6), "h": np.array([h for x in seeds for h, _ in x]), "off": np.array([o for x in seeds for _, o in x])}
    p, q, whole = passages.alike(places, 40, 0.75)
    place = lambda m: (int(places["group"][m]), int(places["doc"][m]), int(places["cls"][m]))
    pair = lambda a, b: tuple(sorted((place(a), place(b))))
    got = {pair(a, b): bool(w) for a, b, w in zip(p.tolist(), q.tolist(), whole.tolist())}
    a, b = np.triu_indices(n, 1)
    differ = lambda c: places[c][a] != places[c][b]
    asked = ~differ("group") & differ("doc") & differ("cls") & (places["apart"][a] + places["apart"][b] < passages.REACH) & (~places["cross"][a] | differ("own"))
    a, b = a[asked], b[asked]
    right, left = passages.growths(places["after"], a, b), passages.growths(places["before"], a, b)
    grown = np.stack([places["size"][a] + left[0] + right[0], places["size"][b] + left[1] + right[1]])
    good = (grown.max(0) >= 40) & (grown.min(0) >= 30)
    want = {pair(x, y) for x, y in zip(a[good].tolist(), b[good].tolist())}
    assert 20 < len(want) < len(a) and {k for k, w in got.items() if w} == want
    reach, far = passages.REACH, set()
    for x, y in zip(a.tolist(), b.tolist()):
        shared = len({h for h, o in seeds[x] if o < reach} & {h for h, o in seeds[y] if o < reach})
        behind = [[(h, o) for h, o in seeds[m] if o > places["apart"][m]] for m in (x, y)]
        if any(h == g and max(o, r) >= reach and o + r < reach * shared for h, o in behind[0] for g, r in behind[1]):
            far.add(pair(x, y))
    assert far and far <= set(got)


def test_places_of_a_common_line_are_not_all_compared(monkeypatch):
    draw, compared, plain = np.random.default_rng(40), [], passages.growths
    monkeypatch.setattr(passages, "growths", lambda words, p, q: compared.append(len(p)) or plain(words, p, q))
    n = 400
    none, each = np.zeros(n, np.int64), np.arange(n)
    places = {"group": none, "own": none, "cross": none > 0, "doc": each, "cls": each, "apart": none + 60, "size": none + 12, "row": none[:0], "h": none[:0], "off": none[:0]}
    places |= {c: draw.integers(1, 1 << 60, (n, 48)).astype(np.uint64) for c in ("before", "after")}
    places["after"][:, :2] = 7  # the rest of the line
    places["after"][1, :40] = places["after"][0, :40]
    assert [x.tolist() for x in passages.alike(places, 40, 0.75)] == [[0], [1], [True]]
    assert sum(compared) < 10


def test_seeds_of_many_texts_are_those_of_each():
    draw = random.Random(37)
    texts = [" ".join(draw.choices(("a", "b", "é", "dd"), k=draw.randrange(0, 40))).encode() for _ in range(200)]
    texts += [b"", b"  ", " é  b ".encode() * 30]
    got = list(zip(*(c.tolist() for c in passages.seeds(texts, 5, 8))))
    assert got == [(i, *row) for i, x in enumerate(texts) for _, *row in zip(*(c.tolist() for c in passages.seeds([x], 5, 8)))]
    for i, x in enumerate(texts):
        assert any(g[0] == i for g in got) == (len(x.split()) >= 5)
        assert all(len(x.decode()[s:e].split()) == 5 for j, _, s, e in got if j == i)


def test_growth_of_many_is_that_of_each():
    draw = random.Random(35)
    rows = np.array([[draw.choice((1, 1, 1, 2)) if i < 30 else draw.randrange(3, 6) for i in range(60)] for _ in range(60)], np.uint64)
    rows[:, 50:] = 0
    p, q = np.repeat(np.arange(60), 60), np.tile(np.arange(60), 60)
    i, j = passages.growths(rows, p, q)
    for a, b, x, y in zip(p.tolist(), q.tolist(), i.tolist(), j.tolist()):
        want = passages._grow(rows[a, :50].tolist(), rows[b, :50].tolist())[:2]
        assert (x, y) == want or x == y == 1 << 20


def test_a_passage_may_go_on_far_beyond_its_seeds(spark):
    text = _prose(32)
    passage = text(60) + [w for _ in range(120) for w in text(4)]
    fuzzy = [("other" if i >= 60 and i % 5 == 0 else w) for i, w in enumerate(passage)]
    df = spark.createDataFrame([(1, " ".join(text(300) + passage + text(300))), (2, " ".join(text(200) + fuzzy + text(200)))], "doc_id long, text string")
    rows = passages.repeated_passages(df).collect()
    assert len(rows) == 1 and rows[0]["n_words"] > 500


def test_batches_of_any_column_are_split(spark):
    import pyarrow as pa

    from tessera.llm import common

    lists = pa.array([[{"x": j} for j in range(i % 50)] for i in range(400)], pa.list_(pa.struct([("x", pa.int64())])))
    for column in (lists, pa.array(["x" * (i % 90) for i in range(400)]), pa.array([b"x" * (i % 90) for i in range(400)])):
        batch = pa.RecordBatch.from_pydict({"id": pa.array(range(400)), "c": column})
        parts = list(common.pieces([batch], "c", limit=900))
        assert len(parts) > 5 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30))
@settings(max_examples=200, deadline=None)
def test_matched_words_are_the_longest_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: max(left, row[j], row[j - 1] + (x == b[j - 1])), initial=0))
    assert passages._matched(a, b) == row[-1]


# --- toxicity and quality --------------------------------------------------------------------------


@pytest.mark.parametrize("label", ["both", "equal", "unequal"])
def test_pairs_of_terms_are_learnt(label):
    draw = np.random.default_rng(0)
    docs, labels = [], []
    rule = {"both": lambda a, b: a and b, "equal": lambda a, b: a == b, "unequal": lambda a, b: a != b}[label]
    for _ in range(1500):
        d = set(draw.integers(10, 400, 40).tolist())
        a, b = draw.random(2) < 0.5
        d |= {1} if a else set()
        d |= {2} if b else set()
        docs.append(np.array(sorted(d), np.uint64))
        labels.append(float(rule(a, b)))
    m = toxicity.fit(docs, np.array(labels), epochs=120)
    for a, b in itertools.product((0, 1), repeat=2):
        have = np.array([h for h, there in ((1, a), (2, b)) if there], np.uint64)
        assert (m.score(np.searchsorted(m.keys, have)) > 0.7) == bool(rule(a, b)), (a, b)
        assert rule(a, b) or m.score(np.searchsorted(m.keys, have)) < 0.3


def test_toxicity_on_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.1"
    out = toxicity.op9_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out and toxic is not null")
    rows = [tuple(r) for r in out.select("toxic", "predicted", "score").collect()]
    bad, good = ([x for t, _, x in rows if t == k] for k in (1, 0))
    auc = sum((b > g) + 0.5 * (b == g) for g in good for b in bad) / (len(good) * len(bad))
    right = sum(t == p for t, p, _ in rows) / len(rows)
    assert len(rows) > 300 and right > 0.97 > max(len(good), len(bad)) / len(rows) and auc > 0.97


@given(st.lists(st.integers(0, 4095), max_size=9), st.floats(0, 4))
@settings(max_examples=150, deadline=None)
def test_viterbi_is_the_best_labelling(codes, stay):
    odds = quality.emission_table(quality.PRIOR)
    value = lambda y: sum(odds[c] for c, v in zip(codes, y) if v) + sum(stay for a, b in zip(y, y[1:]) if a == b)
    best = max(map(value, itertools.product((0, 1), repeat=len(codes))), default=0)
    assert abs(value(quality.viterbi(codes, odds, stay)) - best) < 1e-9


@given(st.text(alphabet="ab \n#<", max_size=120))
@settings(max_examples=200, deadline=None)
def test_rule_counts_equal_brute_force(text):
    n, chars, symbols, doubles, again, failed, _, _ = quality.judge(text.encode(), quality.emission_table(quality.PRIOR), 1.0)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert (n, chars, symbols, doubles, again) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    assert failed == (n < 20 or 100 * again > 30 * n)


def test_lines_of_mixed_documents_are_told_apart():
    plain, junk = 1 << 6 | 1 << 7, 1 | 1 << 1  # long with a sentence's end; full of symbols
    draw = random.Random(3)
    documents = [([plain] * draw.randrange(3, 9) + [junk] * draw.randrange(0, 3), 0) for _ in range(300)]
    documents += [([junk] * draw.randrange(4, 9) + [plain] * draw.randrange(0, 3), 1) for _ in range(60)]
    weights = quality.train([s for s, _ in documents], [y for _, y in documents])
    assert quality.viterbi([plain] * 4 + [junk] * 4, quality.emission_table(weights), float(weights[-1])) == [0] * 4 + [1] * 4


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality is not null")
    fold = toxicity.held_out(F.col("doc_id"))
    out = quality.score_quality(spark.read.parquet(f"{folder}/documents.parquet"), labels.where(~fold))
    rows = [tuple(r) for r in out.join(labels.where(fold), "doc_id").where("not base_failed").select("quality", "kept", "content_share").collect()]
    good, bad = ([x for q, _, x in rows if q == k] for k in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    right = sum(k == (q == 1) for q, k, _ in rows) / len(rows)
    assert right > 0.99 > max(len(good), len(bad)) / len(rows) and auc > 0.99


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline_equals_its_stages_by_hand(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = set(docs)
    sample = quality.labelled_lines(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), 3000)
    weights = quality.train(*sample)
    odds = quality.emission_table(weights)
    left = {i for i in left if quality.judge(docs[i]["text"].encode(), odds, float(weights[-1]))[6]}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i in left for w in [docs[i]["text"].encode().lower().split()]}
    inverted = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    pairs = {(a, b) for x in inverted.values() for a, b in itertools.combinations(sorted(x), 2)}
    first = roots([(a, b) for a, b in pairs if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])], left)
    left = {i for i in left if first[i] == i}
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)

    def leaks(i):  # the item against the whole text, without bands
        text = decontaminate.normalise(docs[i]["text"])
        return any(decontaminate.banded_distance(codes(t), codes(text), int(len(t) * 0.08))[0] <= int(len(t) * 0.08) for t in items)

    left = {i for i in left if not leaks(i)}

    def redacted(text, spans):
        ends, pieces = 0, []
        for _, s, e in sorted((x.split(":") for x in spans.split(",") if x), key=lambda x: int(x[1])):
            if int(s) >= ends:
                pieces += [text[ends : int(s)], secrets.REDACTED]
            ends = max(ends, int(e))
        return "".join(pieces) + text[ends:]

    spans = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    clean = {i: redacted(docs[i]["text"], spans[i]) for i in left}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(list(clean), pa.int64()), "text": pa.array(list(clean.values()), pa.string()), "source": pa.array([docs[i]["source"] for i in clean], pa.string())}))
    taken = {i: n for i, n in con.execute(f"SELECT doc_id, taken FROM ({mixing.OP6_SQL})").fetchall() if n}
    assert {i: r["taken"] for i, r in out.items()} == taken and len(taken) > 50
    assert {i: r["text"] for i, r in out.items()} == {i: clean[i] for i in taken}


def test_the_filter_of_candidates_lets_all_of_them_through(spark):
    nodes = [-1, 0, 1, 63, 64, -(2**63), 2**63 - 1, 12345678901234567, (5 << 26) + 64]
    bits = simhash.member_bits(spark.createDataFrame([(n,) for n in nodes], "node long"))
    held = lambda n: bool(bits[(n & (simhash.FILTER_BITS - 1)) >> 6] >> np.uint64(n & 63) & np.uint64(1))
    assert all(map(held, nodes)) and not any(map(held, (2, 65, 130, 99999)))
    assert not simhash.member_bits(spark.createDataFrame([], "node long")).any()


@pytest.mark.parametrize("name", "social-policy share-price-analysis comments-on-budget menu-of-the-day alert-fatigue sponsor-story related-work".split())
def test_a_wrapper_named_after_its_subject_keeps_its_text(name):
    article = "".join(f"<p>This is sentence {i} of a long text about the subject, with words enough to be one.</p>" for i in range(6))
    aside = "Subscribe to all of our many newsletters today and get the best of everything, every single week of the year."
    rest = "".join(f"<div class='{c}'>{aside}</div>" for c in ("sidebar", "related-posts", "comments-area", "cookie-notice", "footer"))
    text = html_text.main_text(f"<html><body><div class='top-menu'><a href=/>Home</a></div><div class='{name}'>{article}</div>{rest}</body></html>")
    assert [text.count("sentence"), text.count("newsletters"), text.count("Home")] == [6, 0, 0]
