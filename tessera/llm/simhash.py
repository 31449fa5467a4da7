"""SimHash near-dedup by covering locality-sensitive hashing.

A document's fingerprint is the bitwise majority over the XXH64 hashes of its word
shingles. To link fingerprints within Hamming radius r, every bit position gets a random
vector of r + 1 bits; table v (one for each non-zero vector v) keeps the positions whose
vector has an odd inner product with v. The at most r vectors of the positions where two
fingerprints differ span a proper subspace, so some v is orthogonal to all of them and
in that table the two agree: no pair within the radius is ever missed (Pagh,
"CoveringLSH: Locality-sensitive Hashing without False Negatives").
"""

from __future__ import annotations

import random
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable, free_name, map_arrow, raw_bytes, written
from tessera.llm.components import connected_components

#: Fingerprints that one task compares at once, at most twice this many.
BLOCK = 4096
#: The same of shingle sets.
SETS = 512


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, ASCII upper case folded; fewer words make one shingle."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-words]))
    spans = map(slice, starts.tolist(), (ends[words - 1 :] - 1).tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(seed)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        rows = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        for k in range(8):  # a byte's eight bits at a time, from a histogram of its values
            ones[8 * k : 8 * k + 8] += np.bincount(rows[:, k], minlength=256) @ _BITS
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs(doc_id, text)``, fp as a signed long."""

    def run(batch: pa.RecordBatch) -> dict:
        fp = np.fromiter((majority(shingle_hashes(x, words)) for x in raw_bytes(batch.column(1))), np.uint64, batch.num_rows)
        return {"doc_id": batch.column(0), "fp": pa.array(fp.view(np.int64))}

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(docs, run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = 64, seed: int = 7) -> list[int]:
    """Masks of which one at least hides any ``radius`` or fewer chosen bit positions."""
    draw = random.Random(seed)
    vectors = [draw.randrange(1 << (radius + 1)) for _ in range(bits)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))
    ]


def spanning_links(members: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest, as pairs of places, of the graph of members within ``radius``; at most n - 1 links."""
    left, right, rest = [], [], np.arange(len(members))
    while len(rest):
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            p = stack.pop()
            near = np.bitwise_count(members[rest] ^ members[p]) <= radius
            found = rest[near]
            if len(found):
                left += repeat(p, len(found))
                right += found.tolist()
                stack += found.tolist()
                rest = rest[~near]
    return left, right


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links ``(a, b)`` that join the same fingerprints ``distinct(fp)`` as all pairs within ``radius`` do.

    Buckets of two are judged as they are counted. Larger ones are cut into blocks of
    fingerprints, each pair of blocks is one task's work, and a task returns a spanning
    forest, so neither a task nor the result grows with the square of a bucket.
    """
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = distinct.select(
        "fp",
        F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(signed)))).alias("x"),
    ).select("x.t", "x.k", "fp")
    buckets = durable(
        keys.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    )
    pairs = buckets.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    blocks = buckets.where("n > 2").select("t", "k", F.ceil(F.col("n") / BLOCK).cast("int").alias("c"))
    members = keys.join(blocks, ["t", "k"]).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    dealt = members.select(
        F.xxhash64("t", "k").alias("g"),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: F.struct(F.least("i", j).alias("i"), F.greatest("i", j).alias("j")))).alias("p"),
        "t", "k", "fp",
    ).select("t", "k", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "fp")
    dealt = dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")

    def run(batches):
        held, last = [], None

        def close():
            members = np.unique(np.concatenate(held))
            a, b = spanning_links(members.view(np.uint64), radius)
            return pa.RecordBatch.from_pydict({"a": pa.array(members[a]), "b": pa.array(members[b])})

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            fp = batch.column(4).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist(), len(fp)]
            for s, e in zip(cuts, cuts[1:]):
                key = tuple(group[:, s])
                if key != last and held:
                    yield close()
                    held = []
                last = key
                held.append(fp[s:e])
        if held:
            yield close()

    return pairs.unionByName(dealt.mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """Fingerprint and component of every row of ``docs(doc_id, text)``.

    Returns ``(doc_id, fp, component_id)``. component_id is the smallest doc_id that links
    of at most ``radius`` differing bits reach. Null and empty texts have fingerprint zero
    and link like any other. Repeated rows come back as often as they came. A null doc_id
    keeps its row and never names a component, unless all ids of the component are null.
    An empty table gives an empty result; other columns are ignored.
    """
    each = written(fingerprints(docs, words))
    distinct = written(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    named = _named(distinct, connected_components(links(distinct.select("fp"), radius)), "fp")
    return each.join(named, "fp").select("doc_id", "fp", "component_id")


def _named(nodes: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``(key, label, component_id)`` of ``nodes(key, first)``: the least ``first`` of the component of ``labels(id, component)``.

    Both sides of each join are tables, so that Spark may split a hot label or key over several tasks.
    """
    labelled = written(nodes.join(labels, nodes[key] == labels["id"], "left").select(key, "first", F.coalesce("component", key).alias("label")))
    least = written(labelled.groupBy("label").agg(F.min("first").alias("component_id")))
    return written(labelled.join(least, "label").select(key, "label", "component_id"))


#: Columns of a document's MinHash sketch, a byte each.
SKETCH = 128
_MIX = np.random.default_rng(11).integers(1, 1 << 63, SKETCH, np.uint64) | np.uint64(1)


def sketch(hashes: np.ndarray) -> bytes:
    """A MinHash sketch of a set of hashes: two sketches agree in a column with the sets' similarity."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[i : i + 2048, None] * _MIX).min(0))
    return (low >> np.uint64(24)).astype(np.uint8).tobytes()


def prefix(grams: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of a set's hashes, in an order that all sets share, of which similar sets have one at least in common.

    Two sets of ``similarity`` share that part of the larger one or more, so with all but the
    first n - ceil(similarity n) + 1 of either in other hands one is left (the prefix filter).
    Hashes of ``common`` (sorted, with their ranks) come last, the rest by value; the order
    decides how large groups are, not what is found.
    """
    n = len(grams)
    keys, ranks = common
    if len(keys):
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        grams = grams[np.argsort(np.where(keys[at] == grams, ranks[at], 0), kind="stable")]
    return grams[: n - int(np.ceil(similarity * n - 1e-9)) + 1] if n else grams


def common_shingles(texts: DataFrame, words: int, part: int = 50, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes that several texts of a sample hold, sorted, and their ranks by how many do."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = [np.unique(shingle_hashes(x, words)) for x in raw_bytes(batch.column(0))]
        return {"h": pa.array(np.concatenate(sets).view(np.int64))}

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0)
    rows = map_arrow(sample, run, "h long").groupBy("h").count().where("count >= 4").orderBy(F.desc("count"), "h").limit(most).collect()
    keys = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.arange(len(keys), 0, -1)[order]


def sketch_forest(rows: np.ndarray, agree: int) -> tuple[list[int], list[int]]:
    """As spanning_links(), of the graph of sketches that agree in ``agree`` columns."""
    left, right, rest = [], [], np.arange(len(rows))
    while len(rest):
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            p = stack.pop()
            near = (rows[rest] == rows[p]).sum(1) >= agree
            found = rest[near]
            if len(found):
                left += repeat(p, len(found))
                right += found.tolist()
                stack += found.tolist()
                rest = rest[~near]
    return left, right


def similar_links(nodes: DataFrame, agree: int) -> DataFrame:
    """Links ``(a, b)`` between ``nodes(node, sketch, prefix)`` that share a hash of their prefixes and ``agree`` columns.

    As in links(), every pair of blocks of a bucket is one task's work and gives a spanning forest.
    """
    keys = nodes.select("node", F.explode("prefix").alias("g"))
    buckets = keys.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g", F.ceil(F.col("n") / BLOCK).cast("int").alias("c"))
    members = keys.join(buckets, "g").join(nodes.select("node", "sketch"), "node").withColumn("i", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    return _forests(members, "sketch", lambda node, rows: sketch_forest(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, SKETCH), agree))


def least_agreement(similarity: float, chance: float = 1e-12) -> int:
    """Columns in which sketches of ``similarity`` agree, but for ``chance`` (Chernoff's bound)."""
    for t in range(int(similarity * SKETCH), 0, -1):
        q = t / SKETCH
        if SKETCH * (q * np.log(q / similarity) + ((1 - q) * np.log((1 - q) / (1 - similarity)) if q < 1 else 0)) >= -np.log(chance):
            return t
    return 0


def set_forest(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """As spanning_links(), of the graph of sorted sets of ``similarity`` or more, counted exactly."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    left, right, rest = [], [], np.arange(len(sets))
    while len(rest):
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            p = stack.pop()
            near = (size[rest] >= similarity * size[p] - 1e-9) & (size[p] >= similarity * size[rest] - 1e-9)
            if not near.any():
                continue
            asked = rest[near]
            values = np.concatenate([sets[q] for q in asked])
            at = np.minimum(np.searchsorted(sets[p], values), size[p] - 1)
            shared = np.add.reduceat((sets[p][at] == values).astype(np.int64), np.concatenate(([0], np.cumsum(size[asked])[:-1])))
            near[near] = shared >= similarity * (size[asked] + size[p] - shared) - 1e-9
            found = rest[near]
            if len(found):
                left += repeat(p, len(found))
                right += found.tolist()
                stack += found.tolist()
                rest = rest[~near]
    return left, right


#: Bits of the filter of nodes that have a candidate: 8 MB, however many there are. With more of them it lets more through.
FILTER_BITS = 1 << 26


def member_bits(nodes: DataFrame) -> np.ndarray:
    """``nodes(node)`` as bits of 64-bit words; what comes to the driver is a row a word, at most 2^20."""
    at = nodes.select((F.col("node").bitwiseAND(F.lit(FILTER_BITS - 1))).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("b")).collect()
    bits = np.zeros(FILTER_BITS >> 6, np.uint64)
    bits[np.array([r["w"] for r in rows], np.int64)] = np.array([r["b"] for r in rows], np.int64).view(np.uint64)
    return bits


def exact_links(docs: DataFrame, loose: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that join the same nodes as all pairs of ``similarity`` within a component of ``loose(id, component)`` do.

    Only sets of documents that have a candidate are sent on, but for a few that share a bit of
    a bounded filter with one, and those of one component are compared.
    """
    loose = written(loose)
    sent = docs.sparkSession.sparkContext.broadcast(member_bits(loose.select(F.explode(F.array("id", "component")).alias("node"))))

    def run(batch: pa.RecordBatch) -> dict:
        sets = [np.unique(shingle_hashes(x, words)).tobytes() for x in raw_bytes(batch.column(1))]
        node = np.fromiter(map(xxhash.xxh64_intdigest, sets), np.uint64, len(sets))
        at = node & np.uint64(FILTER_BITS - 1)
        there = (sent.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return {"node": pa.array(node[there].view(np.int64)), "grams": pa.array([x for x, t in zip(sets, there.tolist()) if t], pa.binary())}

    groups = loose.union(loose.select(F.col("component").alias("id"), "component").distinct())
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / SETS).cast("int").alias("c"))
    groups = groups.join(sizes, "component").select(F.col("id").alias("node"), F.col("component").alias("g"), "c", F.pmod(F.xxhash64("id"), F.col("c")).cast("int").alias("i"))
    sets = map_arrow(docs, run, "node long, grams binary").join(groups, "node").dropDuplicates(["node"])
    return _forests(sets, "grams", lambda node, rows: set_forest([np.frombuffer(r, np.uint64) for r in rows], similarity))


def _forests(members: DataFrame, column: str, forest) -> DataFrame:
    """Links that ``forest`` finds in each pair of blocks ``i`` of ``c`` of the groups ``g`` of ``members(g, c, i, node, column)``."""
    dealt = members.select(
        "g", F.explode(F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: F.struct(F.least("i", j).alias("i"), F.greatest("i", j).alias("j")))).alias("p"), "node", column
    ).select("g", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "node", column)
    dealt = dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")

    def run(batches):
        held: list[tuple[np.ndarray, list[bytes]]] = []
        last = None

        def close():
            node, rows = np.concatenate([x[0] for x in held]), [r for x in held for r in x[1]]
            a, b = forest(node, rows)
            return node[a], node[b]

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            node, rows = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_pylist()
            cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist(), len(node)]
            found = []
            for s, e in zip(cuts, cuts[1:]):
                key = tuple(group[:, s])
                if key != last and held:
                    found.append(close())
                    held = []
                last = key
                held.append((node[s:e], rows[s:e]))
            if found:
                yield pa.RecordBatch.from_pydict({n: pa.array(np.concatenate(x)) for n, x in zip("ab", zip(*found))})
        if held:
            yield pa.RecordBatch.from_pydict({n: pa.array(x) for n, x in zip("ab", close())})

    return dealt.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def fingerprint_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Links ``(a, b)`` that join the same ``nodes(node, fp)`` as all pairs of fingerprints within ``radius`` do, by covering hashing."""
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("b")))
    same = nodes.join(first, "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    near = links(first.select("fp"), radius).where("a <> b")
    left, right = (first.select(F.col("fp").alias(x), F.col("b").alias(f"node_{x}")) for x in "ab")
    return same.unionByName(near.join(left, "a").join(right, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def _grouped(docs: DataFrame, words: int, similarity: float, radius: int = 4) -> DataFrame:
    """``(doc_id, digest, label, component_id)`` of every row of ``docs(doc_id, text)``; digest is a hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("digest"))
    common = common_shingles(docs.select("text"), words)

    def run(batch: pa.RecordBatch) -> dict:
        node, rows, first, fp = [], [], [], []
        for text in raw_bytes(batch.column(1)):
            hashes = shingle_hashes(text, words)
            grams = np.unique(hashes)
            fp.append(majority(hashes))
            node.append(xxhash.xxh64_intdigest(grams.tobytes()))
            rows.append(sketch(grams))
            first.append(prefix(grams, similarity, common).view(np.int64))
        return {
            "doc_id": batch.column(0),
            "digest": batch.column(2),
            "node": pa.array(np.array(node, np.uint64).view(np.int64)),
            "sketch": pa.array(rows, pa.binary()),
            "prefix": pa.array(first, pa.list_(pa.int64())),
            "fp": pa.array(np.array(fp, np.uint64).view(np.int64)),
        }

    each = written(map_arrow(docs, run, "doc_id long, digest long, node long, sketch binary, prefix array<long>, fp long"))
    nodes = written(each.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix"), F.min("fp").alias("fp")))
    near = similar_links(nodes.select("node", "sketch", "prefix"), least_agreement(similarity))
    loose = connected_components(near.unionByName(fingerprint_links(nodes.select("node", "fp"), radius)))
    labels = connected_components(exact_links(docs.select("doc_id", "text"), loose, words, similarity))
    named = _named(nodes.select("node", "first"), labels, "node")
    return each.select("doc_id", "digest", "node").join(named, "node").select("doc_id", "digest", "label", "component_id")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)`` of near copies: ``similarity`` of their sets of ``words``-word shingles or more.

    Candidates are pairs whose SimHash fingerprints differ in 4 bits or less, by covering
    hashing, and, for those beyond, pairs that share a hash of their prefixes, which no similar
    pair fails to do. Of the latter MinHash sketches drop those far below, a similar one with a
    chance under 1e-12; within the components of all candidates the sets decide. Nulls, repeats and ties as in near_duplicates().
    """
    return _grouped(docs, words, similarity).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each group of near copies, the one of least doc_id, with all its columns.

    Rows are told apart by id and text, so that rows that share an id but not their words
    are judged each by itself, and of rows without an id one stays where its group has no
    other. Of rows that agree in id and text one stays. Ties of an id go to the text of
    least hash. An empty table gives no rows.
    """
    rows = _grouped(docs, words, similarity).groupBy("label", "doc_id", "digest").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), "digest", "n")).alias("r")
    own, id_, of = (free_name(x, docs) for x in ("digest", "kept_id", "kept_digest"))
    kept = durable(rows.groupBy("label").agg(least).select(F.col("r.id").alias(id_), F.col("r.digest").alias(of), "r.n"))
    keyed = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(of))
    out = keyed.join(kept.where("n = 1").drop("n"), same, "left_semi")
    several = kept.where("n > 1").drop("n")
    if not several.isEmpty():
        out = out.unionByName(keyed.join(several, same, "left_semi").dropDuplicates(["doc_id", own]))
    return out.drop(own)


def op5_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """near_duplicates() of the whole documents table, the fingerprint in hexadecimal digits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
