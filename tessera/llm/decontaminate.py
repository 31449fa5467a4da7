"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item of m characters that occurs in a document with at most e edits keeps at
least m + 1 - q (e + 1) of its q-grams, and insertions and deletions move these by at most
e diagonals (document position minus item position). Diagonals are therefore cut into
bands of 2 (e + 1) that overlap by half, each band counts the item positions whose q-gram
it holds, and only regions of bands that reach the bound go on to a banded alignment.
Text is compared in lower case with white space runs as one space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, table, written

_SPACE = re.compile(r"\S+")


def normalise(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):  # keep one character for one, so that positions map back
        low = "".join(y if len(y := x.lower()) == 1 else x for x in text)
    return " ".join(low.split())


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Code point span in ``text`` of a span of ``normalise(text)``."""
    first = last = None
    at = 0
    for word in _SPACE.finditer(text):
        size = word.end() - word.start()
        if first is None and start < at + size:
            first = word.start() + max(0, start - at)
        if at < end:
            last = word.start() + min(size, end - at)
        at += size + 1
    return (first or 0), (last or 0)


def banded_distance(item: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int, int]:
    """Least edits to turn ``item`` into some stretch of ``region``; (edits, start, end).

    The band is the region itself, which spans the item's length and 4 (e + 1) diagonals.
    Edits over ``most`` come back as ``most + 1``.
    """
    n = len(region)
    place = np.arange(n + 1)
    cost, begin = np.zeros(n + 1, np.int64), place.copy()
    for c in item:
        step = np.empty(n + 1, np.int64)
        came = np.empty(n + 1, np.int64)
        step[0], came[0] = cost[0] + 1, begin[0]
        by_match, by_drop = cost[:-1] + (region != c), cost[1:] + 1
        take = by_match <= by_drop
        step[1:] = np.where(take, by_match, by_drop)
        came[1:] = np.where(take, begin[:-1], begin[1:])
        slid = step - place  # insertions: the running minimum of what stands to the left
        low = np.minimum.accumulate(slid)
        source = np.maximum.accumulate(np.where(slid == low, place, 0))
        cost, begin = low + place, came[source]
        if cost.min() > most:
            return most + 1, 0, 0
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


@dataclass
class Items:
    """Benchmark items and the index of their q-grams; ``exact`` ones may have no edit and must be whole words."""

    ids: list[int]
    texts: list[str]
    q: int
    rate: float
    exact: bool = False

    def __post_init__(self) -> None:
        q = self.q
        sizes = np.array([len(x) for x in self.texts], np.int64)
        self.sizes = sizes
        self.budget = np.zeros_like(sizes) if self.exact else (sizes * self.rate).astype(np.int64)
        self.bound = sizes + 1 - q * (self.budget + 1)
        codes, starts = joined_codes(self.texts)
        grams = gram_hashes(codes, q)
        item = np.repeat(np.arange(len(sizes)), np.maximum(sizes - q + 1, 0))
        place = np.concatenate([np.arange(max(n - q + 1, 0)) for n in sizes]) if len(sizes) else np.empty(0, np.int64)
        keys = grams[starts[item] + place] if len(item) else np.empty(0, np.uint32)
        order = np.argsort(keys, kind="stable")
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(order)).astype(np.int64)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.keys >> np.uint32(10)] = True


def joined_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a zero after each, and where each text starts."""
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return codes, np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(texts) else np.empty(0, np.int64)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A polynomial hash of every q code points, by doubling."""
    base = 0x9E3779B1
    have, size, out, done = codes * np.uint32(0x85EBCA6B) ^ (codes >> np.uint32(3)), 1, None, 0
    bits = q
    while bits:
        if bits & 1:
            if out is None:
                out, done = have, size
            else:
                n = len(codes) - done - size + 1
                if n <= 0:
                    return np.empty(0, np.uint32)
                out, done = out[:n] * np.uint32(pow(base, size, 1 << 32)) + have[done : done + n], done + size
        bits >>= 1
        if bits:
            n = len(have) - size
            if n <= 0:
                return np.empty(0, np.uint32)
            have, size = have[:n] * np.uint32(pow(base, size, 1 << 32)) + have[size : size + n], 2 * size
    return out


def indexes(rows: list[tuple[int, str]], q: int, rate: float) -> list[Items]:
    """Normalised items ``(id, text)`` by the q that each can bear.

    Of an item of m characters at least m + 1 - q (e + 1) q-grams outlast e edits; q is
    lowered until that is 1, so that no edit of the budget is given up. An item whose budget
    is none must occur as it is, and as whole words.
    """
    kinds: dict[tuple[int, bool], list[tuple[int, str]]] = {}
    for i, x in rows:
        edits = int(len(x) * rate)
        exact = edits == 0
        if x:
            kinds.setdefault((max(1, min(q, len(x) // (edits + 1))), exact), []).append((i, x))
    return [Items([i for i, _ in held], [x for _, x in held], own, rate, exact) for (own, exact), held in sorted(kinds.items())]


def find_all(texts: list[str], parts: list[Items]) -> list[tuple[int, int, int, int, int]]:
    """Matches in normalised texts by place and item id: (text, item id, edits, start, end)."""
    return sorted((t, items.ids[i], e, s, end) for items in parts for t, i, e, s, end in find(texts, items))


def whole_words(text: str, item: str, lo: int, hi: int) -> int:
    """The first place of ``item`` in ``text[lo:hi]`` where no letter or digit goes on at either end of it, or -1."""
    at = text.find(item, lo, hi)
    while at >= 0:
        end = at + len(item)
        before = at > 0 and text[at - 1].isalnum() and item[0].isalnum()
        after = end < len(text) and text[end].isalnum() and item[-1].isalnum()
        if not before and not after:
            return at
        at = text.find(item, at + 1, hi)
    return -1


#: Postings that are expanded at a time.
PART = 4_000_000


def find(texts: list[str], items: Items) -> list[tuple[int, int, int, int, int]]:
    """Matches in normalised texts: (text, item, edits, start, end), the best one for each text and item."""
    if not texts or not len(items.keys):
        return []
    codes, starts = joined_codes(texts)
    grams = gram_hashes(codes, items.q)
    at = np.flatnonzero(items.seen[grams >> np.uint32(10)])
    key = np.searchsorted(items.keys, grams[at])
    key[key == len(items.keys)] = 0
    right = items.keys[key] == grams[at]
    at, key = at[right], key[right]
    if not len(at):
        return []
    text = np.searchsorted(starts, at, side="right") - 1
    much = items.first[key + 1] - items.first[key]
    own = np.bincount(text, weights=much, minlength=len(texts))
    heavy = own > PART  # long and repetitive texts, each by itself
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    light = np.flatnonzero(~heavy[text])
    # In parts of some million postings, cut between texts.
    edges = np.flatnonzero(np.diff(np.concatenate(([-1], np.cumsum(much[light]) // PART))))
    cuts = np.searchsorted(text[light], text[light][edges]) if len(edges) else np.array([0])
    cuts = [*np.unique(np.append(cuts, 0)).tolist(), len(light)]
    for s, e in zip(cuts, cuts[1:]):
        _part(texts, codes, starts, items, text, at, key, light[s:e], items.first, items.item, items.place, best)
    for t in np.flatnonzero(heavy).tolist():
        _heavy(texts, codes, starts, items, text, at, key, t, best)
    return [(t, i, *x) for (t, i), x in sorted(best.items())]


def _heavy(texts, codes, starts, items, text, at, key, t, best) -> None:
    """A text whose q-grams repeat: items that it holds as they are need no bands; the rest is cut inside the text.

    A match spans no more than the longest item and its budget, so parts that overlap by that
    hold each match whole, and memory is that of one part however long the text is.
    """
    own = np.flatnonzero(text == t)
    postings = np.concatenate([np.arange(items.first[k], items.first[k + 1]) for k in np.unique(key[own])])
    open_ = np.zeros(len(items.ids), bool)
    for i in np.unique(items.item[postings]).tolist():
        m = int(items.sizes[i])
        found = whole_words(texts[t], items.texts[i], 0, len(texts[t])) if items.exact else texts[t].find(items.texts[i])
        if found >= 0:
            best[t, i] = (0, found, found + m)
        elif not items.exact:
            open_[i] = True
    kept = open_[items.item]
    if not kept.any():
        return
    item, place = items.item[kept], items.place[kept]
    first = np.concatenate(([0], np.cumsum(kept)))[items.first]
    span = int((items.sizes + 2 * items.budget)[open_].max()) + items.q
    much = first[key[own] + 1] - first[key[own]]
    total = np.cumsum(much)
    s = 0
    while s < len(own):
        e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + PART, side="right")))
        back = int(np.searchsorted(at[own], at[own[s]] - span))
        _part(texts, codes, starts, items, text, at, key, own[back:e], first, item, place, best)
        s = e


def _part(texts, codes, starts, items, text, at, key, own, first, item_of, place_of, best) -> None:
    """Matches among the hits ``own``, with the postings of ``first``, into ``best``."""
    if not len(own):
        return
    n = first[key[own] + 1] - first[key[own]]
    posting = np.repeat(first[key[own]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    item, place = item_of[posting], place_of[posting]
    pair = np.repeat(text[own], n) * len(items.ids) + item
    # First by text and item: fewer hits than the bound can't reach it in any band.
    kinds, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
    enough = (count >= items.bound[kinds % len(items.ids)])[inverse]
    if enough.any():
        pos = np.repeat(at[own], n)[enough]
        for t, i, *x in _bands(texts, codes, starts, items, pair[enough], pos - place[enough], place[enough]):
            if (t, i) not in best or x[:2] < list(best[t, i][:2]):
                best[t, i] = tuple(x)


def _bands(texts, codes, starts, items, pair, diagonal, place):
    """Count each band's distinct item positions; align the regions that reach the bound."""
    item = pair % len(items.ids)
    width = items.budget[item] + 1
    rows = []
    low = diagonal // width
    for shift in (0, 1):  # a diagonal lies in the band that starts at its own cell and in the one before
        rows.append(np.stack([pair, low - shift, place]))
    found = np.unique(np.concatenate(rows, axis=1), axis=1)
    change = np.flatnonzero((found[:2, 1:] != found[:2, :-1]).any(0)) + 1
    first = np.concatenate(([0], change))
    count = np.diff(np.append(first, found.shape[1]))
    pair, band = found[0, first], found[1, first]
    full = count >= items.bound[pair % len(items.ids)]
    best: dict[int, tuple[int, int, int]] = {}
    for p, b in zip(pair[full].tolist(), band[full].tolist()):
        text, i = divmod(p, len(items.ids))
        e, m = int(items.budget[i]), int(items.sizes[i])
        if p in best and best[p][0] == 0:
            continue
        size, base = len(texts[text]), int(starts[text])
        lo = max(0, b * (e + 1) - base - e)
        hi = min(size, (b + 2) * (e + 1) - base + m + e)
        exact = whole_words(texts[text], items.texts[i], lo, hi) if items.exact else texts[text].find(items.texts[i], lo, hi)
        if exact >= 0:
            best[p] = (0, exact, exact + m)
        if exact >= 0 or items.exact:
            continue
        needle = np.frombuffer(items.texts[i].encode("utf-32-le", "surrogatepass"), np.uint32)
        edits, s, t = banded_distance(needle, codes[base + lo : base + hi], e)
        if edits <= e and (p not in best or edits < best[p][0]):
            best[p] = (edits, lo + s, lo + t)
    return [(p // len(items.ids), p % len(items.ids), *x) for p, x in sorted(best.items())]


def item_blocks(benchmark: DataFrame, q: int, rate: float, block_chars: int) -> tuple[int, Iterator[list[Items]]]:
    """The benchmark in blocks of about ``block_chars`` characters, one on the driver at a time, and their number."""
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null").distinct()
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))

    def each() -> Iterator[list[Items]]:
        for k in range(blocks):
            rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
            yield indexes(sorted((r["item_id"], normalise(r["text"])) for r in rows), q, rate)

    return blocks, each()


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, block_chars: int = 2_000_000) -> DataFrame:
    """Every document and benchmark item that it holds with at most ``rate`` edits a character.

    Returns ``(doc_id, item_id, edits, start_char, end_char)``, one row for each pair, with
    the best occurrence as a code point span of the text. Null and empty texts hold nothing.
    Items too short for one edit must occur exactly and as whole words; items without a
    character match nothing. Long and repetitive texts are cut inside, with memory of one part. Repeated documents repeat their rows; a null doc_id stays null;
    equal items with different ids each match; ties go to the first occurrence. Empty tables
    give no rows. Of several blocks of items each is sent, matched and written before the next.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    blocks, each = item_blocks(benchmark, q, rate, block_chars)
    for parts in each:
        sent = docs.sparkSession.sparkContext.broadcast(parts)

        def run(batch: pa.RecordBatch, sent=sent) -> dict:
            raw, ids = [x or "" for x in batch.column(1).to_pylist()], batch.column(0).to_pylist()
            rows = [(ids[t], item, edits, *original_span(raw[t], s, e)) for t, item, edits, s, e in find_all([normalise(x) for x in raw], sent.value)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return {n: pa.array([r[k] for r in rows], kinds[k]) for k, n in enumerate(("doc_id", "item_id", "edits", "start_char", "end_char"))}

        part = map_arrow(docs, run, "doc_id long, item_id long, edits long, start_char long, end_char long")
        if blocks > 1:
            part = written(part)
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, block_chars: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, as leaks() finds them, with all their columns and no shuffle."""
    at = docs.columns.index("text")
    blocks, each = item_blocks(benchmark, q, rate, block_chars)
    for parts in each:
        sent = docs.sparkSession.sparkContext.broadcast(parts)

        def run(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            hit = {x[0] for x in find_all([normalise(x or "") for x in batch.column(at).to_pylist()], sent.value)}
            return batch.filter(pa.array([k not in hit for k in range(batch.num_rows)], pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
        if blocks > 1:
            docs = written(docs)
            sent.destroy()
    return docs


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """leaks() of the whole documents table against the whole benchmark."""
    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
