"""Exact removal of repeated byte strings by a run-length index.

One index of the whole corpus would have to be built in one place, so the text is first cut
down to what can repeat, by a rule that loses nothing: every string of 100 bytes has an
anchor, the piece of 32 bytes in it whose hash is least. Equal strings have equal anchors,
so only strings around an anchor that occurs twice can repeat. Consecutive strings with one
anchor form a context; of equal contexts all but the first go whole. Where an anchor stands
in different contexts, these are indexed together; where it stands in too many, the contexts
are cut finer, by the two least hashes, the three least and so on, until few are together. Their Burrows-Wheeler transform is run
compressed, the suffixes at the ends of its runs are sampled, the matching statistics of
all other places stream from the samples, and strings that match for 100 bytes or more are
marked unless theirs is the first place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, map_arrow, pieces, raw_bytes, release, table, written

#: Strings that one context holds at most; longer runs of one anchor are cut.
LONGEST = 512
#: Contexts of one anchor that one index holds; where there are more, they are cut finer.
TOGETHER = 4096
#: Bytes of texts whose contexts are taken in one go.
READ = 1 << 17
#: Bytes of contexts from which an index is closed.
INDEXED = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k bytes: a polynomial by doubling, then mixed."""
    have = data.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    have ^= have >> np.uint64(32)
    out, done, size, bits = None, 0, 1, k
    while bits:
        if bits & 1:
            if out is None:
                out = have
            else:
                n = len(data) - done - size + 1
                out = out[:n] * np.uint64(pow(_MULTIPLIER, size, 1 << 64)) + have[done : done + n]
            done += size
        bits >>= 1
        if bits:
            n = max(0, len(have) - size)
            have = have[:n] * np.uint64(pow(_MULTIPLIER, size, 1 << 64)) + have[size : size + n]
            size *= 2
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(31))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    n, size, low = len(values) - width + 1, 1, values
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[:n], low[width - size : width - size + n]) if size < width else low[:n]


def contexts(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor hash, first string, strings, whether the anchor occurs in it twice) of each context of the texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    strings = np.maximum(sizes - length + 1, 0)
    if not strings.any():
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none, none.astype(bool)
    width = length - k + 1
    grams = gram_hashes(np.frombuffer(b"".join(texts), np.uint8), k)
    low = sliding_minimum(grams, width)
    # Contexts end with a text; what starts in its last bytes runs into the next and is none.
    has = np.flatnonzero(strings)
    begin = (np.cumsum(sizes) - sizes)[has]
    stop = begin + strings[has]
    turns = np.zeros(len(low) + 1, bool)
    turns[1:-1] = low[1:] != low[:-1]
    turns[begin] = turns[stop] = True
    starts = np.flatnonzero(turns)
    inside = np.searchsorted(begin, starts, "right") - 1
    good = (inside >= 0) & (starts < stop[inside])
    runs = np.diff(np.append(starts, len(low)))[good]
    starts, text = starts[good], has[inside[good]]
    if runs.max() > LONGEST:
        parts = -(-runs // LONGEST)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends, text = np.repeat(starts + runs, parts), np.repeat(text, parts)
        starts = np.repeat(starts, parts) + within * LONGEST
        runs = np.minimum(ends - starts, LONGEST)
    anchor = low[starts]
    # Places of the anchor: in the first string, and the last one of each string after it.
    new = np.concatenate(([0], np.cumsum(grams[width - 1 :] == low)))
    later = new[starts + runs] - new[starts + 1]
    early = (np.lib.stride_tricks.sliding_window_view(grams, width)[starts] == anchor[:, None]).sum(1)
    return text, anchor, starts - (np.cumsum(sizes) - sizes)[text], runs, early + later > 1


def finer(piece: bytes, length: int, k: int, least: int) -> list[tuple[int, int, int]]:
    """(key, first string, strings) of each run of strings of a context with the same ``least`` least hashes.

    Equal strings have equal hashes, so that no two of them get different keys.
    """
    grams = gram_hashes(np.frombuffer(piece, np.uint8), k)
    rows = np.sort(np.lib.stride_tricks.sliding_window_view(grams, length - k + 1), axis=1)[:, :least]
    key = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        key = (key ^ rows[:, j]) * np.uint64(_MULTIPLIER)
        key ^= key >> np.uint64(29)
    starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
    return list(zip(key[starts].view(np.int64).tolist(), starts.tolist(), np.diff(np.append(starts, len(key))).tolist()))


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes of all contexts in order, by prefix doubling; the end of a context sorts before every byte, by place."""
    n = len(text)
    place = np.arange(n)
    packed = np.zeros(n, np.int64)  # seven bytes to begin with
    for k in range(7):
        inside = place + k < ends
        packed = packed * 257 + np.where(inside, text[np.minimum(place + k, n - 1)].astype(np.int64) + 1, 0)
    size = 7
    second = np.where(place + size <= ends, 0, ends)
    order = np.lexsort((second, packed))
    first, other = packed[order], second[order]
    fresh = np.concatenate(([True], (first[1:] != first[:-1]) | (other[1:] != other[:-1])))
    rank = np.empty(n, np.int64)
    while True:
        starts = np.flatnonzero(fresh)
        rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
        alone = fresh & np.append(fresh[1:], True)
        slots = np.flatnonzero(~alone)  # only suffixes that are not told apart yet are sorted on
        if not len(slots):
            return order
        which = order[slots]
        beyond = which + size
        second = np.where(beyond < ends[which], rank[np.minimum(beyond, n - 1)] + n + 1, ends[which])
        mixed = rank[which] * (2 * n + 2) + second
        by = np.argsort(mixed, kind="stable")
        order[slots], mixed = which[by], mixed[by]
        fresh[slots] = np.concatenate(([True], mixed[1:] != mixed[:-1]))
        size *= 2


def common_lengths(text: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at each a and b."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        same = (x < ends[a[live]]) & (y < ends[b[live]])
        last = len(text) - 1
        for _ in range(16):
            same &= text[np.minimum(x, last)] == text[np.minimum(y, last)]
            out[live] += same
            x, y = x + 1, y + 1
            same = same & (x < ends[a[live]]) & (y < ends[b[live]])
        live = live[same]
    return out


def first_elsewhere(contexts: list[bytes], length: int) -> np.ndarray:
    """For each byte of the joined contexts: does the string of ``length`` bytes that starts there start further left too?"""
    text = np.frombuffer(b"".join(contexts), np.uint8)
    n = len(text)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    stops = np.cumsum(sizes)
    ends = np.repeat(stops, sizes)
    order = suffix_order(text, ends)
    # The transform: the byte before each suffix, a context's first suffix having one of its own.
    before = np.where(np.isin(order, stops - sizes), 256 + order, text[order - 1].astype(np.int64))
    heads = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
    # Sampled run ends: the suffix at the head of each run and the one above it, the end of the last run.
    head, above = order[heads[1:]], order[heads[1:] - 1]
    # Matching statistics: known at the samples, elsewhere one less than at the byte to the left.
    known = np.zeros(n, np.int64)
    known[head] = common_lengths(text, ends, head, above) + head
    statistics = np.maximum.accumulate(known) - np.arange(n)
    edges = np.flatnonzero(np.concatenate(([True], statistics[order[1:]] < length)))
    first = np.minimum.reduceat(order, edges)
    group = np.cumsum(np.bincount(edges, minlength=n)) - 1
    marked = np.zeros(n, bool)
    marked[order] = order != first[group]
    return marked & (ends - np.arange(n) >= length)


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def repeated_anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Hashes ``h`` of anchors that occur in more than one place."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [contexts(raw_bytes(part.column(1)), length, k) for part in pieces([batch], "text", READ)]
        h = np.concatenate([f[1] for f in found])
        again = np.concatenate([f[4] for f in found])
        h, place, n = np.unique(h, return_inverse=True, return_counts=True)
        n += np.bincount(place, again, minlength=len(h)).astype(np.int64) if len(h) else 0
        return {"h": pa.array(h.view(np.int64)), "n": pa.array(np.minimum(n, 2).astype(np.int8), pa.int8())}

    return map_arrow(docs, run, "h long, n tinyint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def placed_contexts(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Every context ``(h, c, doc, p, n, twice)``; c is a hash of all its bytes."""

    def run(batch: pa.RecordBatch) -> dict:
        out: list[list] = [[], [], [], [], [], []]
        for some in pieces([batch], "text", READ):
            texts = raw_bytes(some.column(1))
            text, h, p, n, twice = contexts(texts, length, k)
            cuts = zip(map(texts.__getitem__, text.tolist()), map(slice, p.tolist(), (p + n + length - 1).tolist()))
            c = np.fromiter((xxhash.xxh64_intdigest(x[s]) for x, s in cuts), np.uint64, len(h))
            for part, x in zip(out, (h.view(np.int64), c.view(np.int64), some.column(0).to_numpy()[text], p, n.astype(np.int32), twice)):
                part.append(x)
        return {name: pa.array(np.concatenate(part)) for name, part in zip(("h", "c", "doc", "p", "n", "twice"), out)}

    return map_arrow(docs, run, "h long, c long, doc long, p long, n int, twice boolean")


def _compare(asked: DataFrame, docs: DataFrame, length: int, k: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Spans ``(doc, s, e)`` of strings of the contexts ``asked(h, c, doc, p, n)`` that start earlier in another or the same, and the tables behind them."""
    wanted = asked.groupBy("doc").agg(F.collect_list(F.struct("h", "c", "p", "n")).alias("asked"))
    joined = wanted.join(docs, wanted["doc"] == docs["doc_id"]).select("doc", "text", "asked")

    def cut(batch: pa.RecordBatch) -> dict:
        rows = []
        for doc, text, asked in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), batch.column(2).to_pylist()):
            for a in asked:
                piece = text[a["p"] : a["p"] + a["n"] + length - 1]
                if xxhash.xxh64_intdigest(piece) == a["c"] & (1 << 64) - 1:  # else of another row with this id
                    rows.append((a["h"], doc, a["p"], piece))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return {n: pa.array([r[i] for r in rows], kinds[i]) for i, n in enumerate(("h", "doc", "p", "piece"))}

    cuts = written(map_arrow(joined, cut, "h long, doc long, p long, piece binary"))

    def together(batches):
        held: list[tuple[int, int, bytes]] = []
        size, last = 0, None

        def marks():
            out: list[list[int]] = [[], [], []]
            again = first_elsewhere([x[2] for x in held], length)
            at = 0
            for d, p, piece in held:
                inside = np.concatenate(([False], again[at : at + len(piece)], [False])).astype(np.int8)
                turns = np.flatnonzero(np.diff(inside))
                for s, e in zip(turns[::2].tolist(), turns[1::2].tolist()):
                    for part, x in zip(out, (d, p + s, p + e + length - 1)):
                        part.append(x)
                at += len(piece)
            return pa.RecordBatch.from_pydict({n: pa.array(x, pa.int64()) for n, x in zip(("doc", "s", "e"), out)})

        for batch in batches:
            for h, d, p, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if h != last and size >= INDEXED:  # an anchor's contexts stay in one index
                    yield marks()
                    held, size = [], 0
                last = h
                held.append((d, p, piece))
                size += len(piece)
        if held:
            yield marks()

    def recut(batch: pa.RecordBatch, least: int) -> dict:
        rows = []
        for h, d, p, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
            rows += [(key, d, p + at, piece[at : at + n + length - 1]) for key, at, n in finer(piece, length, k, least)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return {n: pa.array([r[i] for r in rows], kinds[i]) for i, n in enumerate(("h", "doc", "p", "piece"))}

    indexed = lambda df: df.repartition("h").sortWithinPartitions("h", "doc", "p").mapInArrow(together, "doc long, s long, e long")
    found, tables, least, place = [], [cuts], 1, F.struct("doc", "p")
    while least < length - k + 1:
        hot = written(cuts.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER).select("h"))
        tables.append(hot)
        if hot.isEmpty():
            break
        least = min(2 * least, length - k + 1)
        found.append(indexed(cuts.join(hot, "h", "left_anti")))
        pieces = written(map_arrow(cuts.join(hot, "h", "left_semi"), lambda batch, n=least: recut(batch, n), "h long, doc long, p long, piece binary", "piece"))
        first = written(pieces.groupBy("h", "piece").agg(F.min(place).alias("first"), F.count("*").alias("m")))
        again = pieces.join(first.where("m > 1").drop("m"), ["h", "piece"]).where(place != F.col("first"))
        found.append(again.select("doc", F.col("p").alias("s"), (F.col("p") + F.length("piece")).alias("e")))
        cuts = first.select("h", "first.doc", "first.p", "piece")
        tables += [pieces, first]
    found.append(indexed(cuts))
    return found, tables


def repeated_spans(docs: DataFrame, length: int = 100, k: int = 32) -> DataFrame:
    """Byte spans ``(doc, s, e)`` covered by strings of ``length`` bytes that also start earlier."""
    docs = _ids(docs).where("doc_id is not null and text is not null")
    twice = written(repeated_anchors(docs, length, k))
    release(docs.sparkSession)
    placed = written(placed_contexts(docs, length, k).join(twice, "h"))
    release(docs.sparkSession)
    place = F.struct("doc", "p")
    first = placed.groupBy("h", "c").agg(F.min(place).alias("first"), F.min("n").alias("n"), F.max("twice").alias("twice"), F.count("*").alias("m"))
    first = written(first)
    whole = placed.join(first.where("m > 1").select("h", "c", "first"), ["h", "c"]).where(place != F.col("first"))
    whole = written(whole.select("doc", F.col("p").alias("s"), (F.col("p") + F.col("n") + length - 1).alias("e")))
    kinds = first.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    asked = first.join(kinds, "h", "left").where("kinds > 1 or twice").select("h", "c", "first.doc", "first.p", "n")
    found, tables = _compare(asked, docs, length, k)
    for df in found:
        whole = whole.unionByName(written(df))
    discard(twice, placed, first, *tables)
    return whole


def remove_repeats(docs: DataFrame, length: int = 100, k: int = 32) -> DataFrame:
    """What is left of every row of ``docs(doc_id, text)`` once repeated strings are removed.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a
    smaller doc_id, or in the same document further left. Matches never cross documents and
    are judged on the input. Returns ``(doc_id, n_bytes, n_removed, n_spans, kept)``, kept
    being the remaining bytes. Null counts as an empty text. Rows that share an id count as
    one document with several texts. Rows without an id stay whole. Other columns are
    ignored; an empty table gives no rows.
    """
    spans = repeated_spans(docs, length, k).groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    joined = _ids(docs).join(spans, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans")

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for text, spans in zip(raw_bytes(batch.column(1)), batch.column(2).to_pylist()):
            kept, at, runs = [], 0, 0
            last = -1
            for s, e in sorted((x["s"], min(x["e"], len(text))) for x in spans or ()):
                if s > last:
                    runs += 1
                    kept.append(text[at:s])
                last = max(last, e)
                at = last
            kept.append(text[at:])
            rest = b"".join(kept)
            rows.append((len(text), len(text) - len(rest), runs, rest))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return {"doc_id": batch.column(0)} | {n: pa.array([r[i] for r in rows], kinds[i]) for i, n in enumerate(("n_bytes", "n_removed", "n_spans", "kept"))}

    return map_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_repeated_strings(spark, sf_dir: str) -> DataFrame:
    """remove_repeats() of the whole documents table, what is left as a digest."""
    left = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
