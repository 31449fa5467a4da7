"""The note graph: edges, resolution of link targets, neighbours."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.durable import stored_once

#: Up to so many notes of a frontier are broadcast.
_FEW = 1 << 17


def resolve_links(links: DataFrame, keys: DataFrame, strip_anchor: bool = True, normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """Targets of ``links(source, target, ...)`` by id, then slug, then alias of ``keys(tier, key, note_id)``.

    Ids (tier 0) are met as written, names of later tiers as ``normalize`` makes them. Adds
    ``target_id``, null where nothing or, with ``ambiguous``, more than one note has the name
    in the first tier that knows it. Owners are counted first, so that a name that many notes
    share stays one row.
    """
    owners = keys.select("tier", "key", "note_id").distinct().groupBy("key", "tier").agg(F.count("*").alias("owners"), F.min("note_id").alias("owner"))
    ids = owners.where("tier = 0").select(F.col("key").alias("raw"), F.struct("owners", "owner").alias("i"))
    names = owners.where("tier > 0").groupBy("key").agg(F.min(F.struct("tier", "owners", "owner")).alias("n")).select(F.col("key").alias("name"), F.struct("n.owners", "n.owner").alias("n"))
    raw = F.regexp_replace("target", r"#.*$", "") if strip_anchor else F.col("target")
    joined = links.withColumn("raw", raw).withColumn("name", normalize(F.col("raw")) if normalize else F.col("raw")).join(ids, "raw", "left").join(names, "name", "left")
    o = F.coalesce("i", "n")
    return joined.withColumns({"target_id": F.when(o["owners"] == 1, o["owner"]), "ambiguous": F.coalesce(o["owners"] > 1, F.lit(False))}).drop("raw", "name", "i", "n")


def dangling(resolved: DataFrame) -> DataFrame:
    return resolved.where("target_id is null")


def edges(links: DataFrame) -> DataFrame:
    """Stored edges of resolved links: one plain edge for each pair and one typed edge for each pair and predicate, the last alias wins."""
    return links.where("target_id is not null").groupBy("source", F.col("target_id").alias("target"), "predicate").agg(F.max_by("alias", "ord").alias("alias"))


def neighbours(stored: DataFrame) -> DataFrame:
    """Both directions of every edge: ``(note_id, target, via, predicate)``, via being link, backlink or typed."""
    forward = stored.select(F.col("source").alias("note_id"), "target", F.when(F.col("predicate").isNull(), "link").otherwise("typed").alias("via"), "predicate")
    back = stored.select(F.col("target").alias("note_id"), F.col("source").alias("target"), F.lit("backlink").alias("via"), "predicate")
    return forward.unionByName(back)


def via_rank(via: Column) -> Column:
    return F.array_position(F.array(F.lit("typed"), F.lit("link"), F.lit("backlink")), via)


def related_to_each(stored: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """``(seed, note_id, distance, from_id, via)``: notes within ``depth`` steps of each of ``seeds(seed)``, as each is first found.

    Breadth first, all seeds at once: a level's frontier in order, each note's edges by target,
    kind and predicate. The edges and each level are stored in the shared folder, so the next one
    starts from stored rows, whatever the depth; a lost executor costs one level's task. Where a
    frontier has few notes only their edges are dealt out. The search ends where no seed finds
    anything new. A seed is at distance 0 and left out.
    """
    start = seeds.select("seed", F.col("seed").alias("note_id")).where("seed is not null").distinct()
    empty = start.where("false").select("seed", "note_id", F.lit(0).alias("distance"), F.col("note_id").alias("from_id"), F.lit("").alias("via"))
    if depth < 1:
        return empty
    steps = neighbours(stored if depth == 1 else stored_once(stored.select("source", "target", "predicate")))
    order = F.struct("from_id", via_rank(F.col("via")).alias("r"), F.coalesce("predicate", F.lit("")).alias("p"), "via")
    levels: list[DataFrame] = []
    seen = frontier = start
    for d in range(1, depth + 1):
        notes = frontier.select("note_id").distinct()
        few = notes.limit(_FEW + 1).count() <= _FEW
        near = steps.join(F.broadcast(notes), "note_id", "left_semi") if few else steps
        reached = frontier.select("seed", F.col("note_id").alias("from_id")).join(near, F.col("from_id") == F.col("note_id")).drop("note_id")
        first = reached.groupBy("seed", "target").agg(F.min(order).alias("o"))  # before the anti-join: one row for each note reached
        fresh = first.join(seen.select("seed", F.col("note_id").alias("target")), ["seed", "target"], "left_anti")
        found = fresh.select("seed", F.col("target").alias("note_id"), F.lit(d).alias("distance"), F.col("o.from_id").alias("from_id"), F.col("o.via").alias("via"))
        if d < depth:
            found = stored_once(found)
            if found.isEmpty():
                break
        levels.append(found)
        frontier = found
        seen = seen.unionByName(found.select("seed", "note_id"))
    out = levels[0] if levels else empty
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def related(stored: DataFrame, seed: Column | str, depth: int = 1) -> DataFrame:
    """related_to_each() of one seed, without its name."""
    start = stored.sparkSession.range(1).select(F.lit(seed).alias("seed"))
    return related_to_each(stored, start, depth).drop("seed")


def orphan_notes(notes: DataFrame, stored: DataFrame) -> DataFrame:
    """Notes at neither end of any edge. Both ends become one column, so that the OR is one hash anti-join."""
    ends = stored.select(F.explode(F.array("source", "target")).alias("note_id"))
    return notes.join(ends, "note_id", "left_anti")


def duplicate_ids(notes: DataFrame) -> DataFrame:
    """A row for each note whose id another note has, with how many share it and the first of them by path."""
    groups = notes.groupBy("note_id").agg(F.count("*").alias("sharing"), F.min("path").alias("first_path")).where("sharing > 1")
    return notes.select("note_id", "path").join(groups, "note_id")


def identity_collisions(keys: DataFrame) -> DataFrame:
    """Normalised keys that more than one note claims; the empty key is no claim."""
    return keys.where("key <> ''").select("key", "note_id").distinct().groupBy("key").agg(F.count("*").alias("owners"), F.min("note_id").alias("first_owner")).where("owners > 1")


def without_colliders(notes: DataFrame, keys: DataFrame) -> DataFrame:
    """Notes that claim no key of another: of colliding notes none survives."""
    bad = keys.where("key <> ''").select("key", "note_id").distinct()
    owners = bad.groupBy("key").agg(F.count("*").alias("owners")).where("owners > 1")
    return notes.join(bad.join(owners, "key").select("note_id"), "note_id", "left_anti")


def classify_link(stored: DataFrame, asked: DataFrame, cell: Sequence[str] = ()) -> DataFrame:
    """added, updated, removed or noop for link requests ``(source, target, predicate, alias, remove)``.

    ``cell`` names columns of both that follow from source and target. Where both are dealt out
    by these already, into as many partitions, the requests are neither dealt out again nor sorted;
    a request is held against the stored links of its cell, which should be few.
    """
    same = (F.col("s.source") == F.col("a.source")) & (F.col("s.target") == F.col("a.target")) & F.col("s.predicate").eqNullSafe(F.col("a.predicate"))
    if cell:  # only the cell's columns are keys: what is equal beyond them is said as an order, which nulls have too in a struct
        pair = lambda t: F.struct(f"{t}.source", f"{t}.target", f"{t}.predicate")
        keys = reduce(and_, (F.col(f"s.{c}") == F.col(f"a.{c}") for c in cell))
        near = (F.col("s.source") <= F.col("a.source")) & (F.col("s.source") >= F.col("a.source"))
        same = keys & near & F.col("s.target").isNotNull() & (pair("s") <= pair("a")) & (pair("s") >= pair("a"))
    there = F.col("s.source").isNotNull()
    change = (
        F.when(F.col("a.remove"), F.when(there, "removed").otherwise("noop"))
        .when(~there, F.when(F.col("a.predicate").isNull(), "added").otherwise("related"))
        .when(F.col("s.alias").eqNullSafe(F.col("a.alias")), "noop")
        .otherwise("updated")
    )
    known = stored.hint("shuffle_hash") if cell else stored
    return asked.alias("a").join(known.alias("s"), same, "left").select("a.source", "a.target", "a.predicate", change.alias("change"))


def skipped_levels(sections: DataFrame) -> DataFrame:
    """Headings more than one level below the one before them."""
    before = F.lag("level").over(Window.partitionBy("note_id").orderBy("ord"))
    return sections.withColumn("previous", before).where("level > previous + 1")
