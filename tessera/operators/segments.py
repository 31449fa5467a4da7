"""A stored index that is kept up by increments.

Chunks and postings of each pass are immutable segments, sorted by term; a generation that is
no longer active gets a tombstone instead of being looked for in them. A reader takes the
postings of its terms from all segments and leaves out those with a tombstone, so answers are
those of an index made anew. Merging writes several segments as one without what is dead.
All tables of a pass become visible together, by one commit of a ``Store``. A stored posting
names its chunk by two numbers, and its length stands with the empty term; served() gives both
back.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import index, maintenance, retrieval
from tessera.operators.durable import run_once
from tessera.operators.publication import Snapshot, Store

NOTES = "note_id string, path string, content_hash string, generation_id string"
_KEYS = ("note_id", "chunk_id", "section_path", "generation_id")
#: What a chunk is called in postings: the version that made it and a number within that.
_NUMBER = ["segment", "chunk_no"]
#: Up to so many tombstones, or chunks that have one, are broadcast.
_FEW = 1 << 17


def live(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows of generations that have no tombstone."""
    return rows.join(tombstones.select("generation_id"), "generation_id", "left_anti")


def postings_of(chunks: DataFrame, analyzed: bool = True) -> DataFrame:
    """Postings of ``chunks(note_id, chunk_id, section_path, generation_id, text)``."""
    return (index.analyzed_postings if analyzed else index.plain_postings)(chunks, _KEYS)


def served(store: Store, at: Snapshot | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, postings) of the active generations as of a version."""
    at = at or store.snapshot()
    chunks, stored = live(store.read("chunks", at), store.read("tombstones", at)), store.read("postings", at)
    lengths = stored.where("term = ''").select(*_NUMBER, "length")
    postings = stored.drop("length").join(chunks.select(*_NUMBER, *_KEYS), _NUMBER).join(lengths, _NUMBER)
    return chunks.drop(*_NUMBER), postings.select("term", *_KEYS, "length", "tf")


def _without(rows: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that ``gone`` does not name, dealt out only where it names many."""
    few = gone.limit(_FEW + 1).count() <= _FEW
    return rows.join(F.broadcast(gone) if few else gone, list(key), "left_anti").select(*rows.columns)


def ranked(postings: DataFrame, terms: Sequence[str], k: int = 10) -> DataFrame:
    """The k best notes of live postings for one question; only its terms and the lengths are read."""
    stats = postings.where("term = ''").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    return retrieval.rank_chunks(retrieval.bm25(postings, stats, [t for t in terms if t]), k, False)


def changes_of(stored: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes of ``wanted(note_id, path, content_hash, ...)`` that are new, edited or moved; ids of notes that are gone)."""
    diff = maintenance.snapshot_diff(stored, wanted)
    return wanted.join(diff.where("change <> 'dropped'").select("note_id"), "note_id", "left_semi"), diff.where("change = 'dropped'").select("note_id")


def prepared(store: Store, base: Snapshot, touched: DataFrame, gone: DataFrame, make_chunks: Callable[[DataFrame], DataFrame], analyzed: bool = True) -> tuple[dict, DataFrame]:
    """(what to commit after ``base``, outcomes ``(note_id, kind, reattached, retired_chunks, chunk_count)``) of one pass.

    ``touched(note_id, path, content_hash, generation_id, ...)`` replace the stored rows of
    their notes, ``gone(note_id)`` leave. Only generations that no segment holds are chunked
    and embedded; one that an earlier version had loses its tombstone. A note with a chunk that
    could not be embedded (null ``embedding``) keeps what is stored of it.
    """
    spark, known = store.spark, "notes" in base.tables
    table = lambda name, schema: store.read(name, base) if known else spark.createDataFrame([], schema)
    stored, held = table("notes", NOTES), table("chunks", "note_id string, generation_id string")
    # Who is touched is found once; what is embedded is written once, so that nothing after it asks the embedder again.
    asked, gone = run_once(touched.select("note_id", "path", "content_hash", "generation_id")), run_once(gone.select("note_id"))
    present = held.select("generation_id").distinct()
    needed = asked.join(present, "generation_id", "left_anti").select("note_id", "generation_id")
    chunks = make_chunks(touched.join(needed, ["note_id", "generation_id"], "left_semi"))
    chunks = chunks.withColumns({"segment": F.lit(base.version + 1).cast("long"), "chunk_no": F.monotonically_increasing_id()})
    made = store.stage("chunks", chunks)
    attempt = spark.read.schema(chunks.schema).parquet(f"{store.root}/{made[0]}")
    failed = attempt.where("embedding is null" if "embedding" in attempt.columns else "false").select("note_id", "generation_id").distinct()
    wanted = asked.join(failed.select("generation_id"), "generation_id", "left_anti").select(*asked.columns)
    fresh = attempt
    if "embedding" in attempt.columns and not failed.isEmpty():
        made = store.stage("chunks", attempt.join(failed.select("generation_id"), "generation_id", "left_anti").select(*attempt.columns))
        fresh = spark.read.schema(chunks.schema).parquet(f"{store.root}/{made[0]}")

    changed = wanted.select("note_id").unionByName(gone.select("note_id")).distinct()
    old = stored.join(changed, "note_id", "left_semi").select("note_id", "generation_id")
    retired = old.join(wanted.select("generation_id"), "generation_id", "left_anti")
    dead = table("tombstones", "generation_id string").unionByName(retired.select("generation_id")).distinct().join(wanted.select("generation_id"), "generation_id", "left_anti")
    postings = index.postings_in_place(fresh, _NUMBER, analyzed).repartitionByRange("term", *_NUMBER).sortWithinPartitions("term", *_NUMBER)
    staged = {
        "replace": {"notes": [store.stage("notes", stored.join(changed, "note_id", "left_anti").unionByName(wanted))], "tombstones": [store.stage("tombstones", dead)]},
        "append": {"chunks": [made], "postings": [store.stage("postings", postings)]},
    }

    n_retired = held.join(retired.select("generation_id"), "generation_id", "left_semi").groupBy("note_id").agg(F.count("*").alias("retired_chunks"))
    n_made = fresh.groupBy("note_id").agg(F.count("*").alias("chunk_count"))
    was = old.select("note_id", F.col("generation_id").alias("was"))
    mine = wanted.join(was, "note_id", "left").join(n_made, "note_id", "left").join(present.withColumn("known", F.lit(True)), "generation_id", "left")
    again = F.col("known").isNotNull() & ~F.col("was").eqNullSafe(F.col("generation_id"))
    kind = F.when(F.col("was").eqNullSafe(F.col("generation_id")), "unchanged").when(again | F.col("chunk_count").isNotNull(), "indexed").otherwise("empty")
    out = mine.select("note_id", kind.alias("kind"), again.alias("reattached"), "chunk_count")
    out = out.unionByName(gone.select("note_id", F.lit("empty").alias("kind"), F.lit(False).alias("reattached"), F.lit(None).cast("long").alias("chunk_count")))
    out = out.unionByName(failed.select("note_id", F.lit("embedding-failed").alias("kind"), F.lit(False).alias("reattached"), F.lit(None).cast("long").alias("chunk_count")))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return staged, out.join(n_retired, "note_id", "left").select("note_id", "kind", "reattached", count("retired_chunks"), count("chunk_count"))


_OUTCOMES = "note_id string, kind string, reattached boolean, retired_chunks long, chunk_count long"


def index_changes(store: Store, delta: Callable[[DataFrame], tuple[DataFrame, DataFrame]], make_chunks: Callable[[DataFrame], DataFrame], analyzed: bool = True, facts: Mapping[str, str] | None = None, done: Callable[[Snapshot], bool] | None = None) -> tuple[Snapshot, DataFrame]:
    """(the version, the pass's outcomes) after ``delta(stored notes)`` gave what is touched and what is gone.

    The facts are part of the version, so a pass whose facts are there has happened; ``done``
    looks for them and then nothing is made. It is asked again with every attempt.
    """
    held: dict = {}

    def change(base: Snapshot) -> dict | None:
        held["outcomes"] = store.spark.createDataFrame([], _OUTCOMES)
        if done is not None and done(base):
            return None
        touched, gone = delta(store.read("notes", base) if "notes" in base.tables else store.spark.createDataFrame([], NOTES))
        if "notes" in base.tables and touched.select("note_id").unionByName(gone.select("note_id")).isEmpty():
            return {"facts": facts} if facts else None
        staged, held["outcomes"] = prepared(store, base, touched, gone, make_chunks, analyzed)
        return staged | {"facts": facts}

    return store.publish(change), held["outcomes"]


def index_pass(store: Store, wanted: DataFrame, make_chunks: Callable[[DataFrame], DataFrame], analyzed: bool = True, facts: Mapping[str, str] | None = None) -> tuple[Snapshot, DataFrame]:
    """One whole pass: what differs from the stored notes is indexed, activated and retired in one version; with its tally.

    Where nothing differs no version is made.
    """
    version, outcomes = index_changes(store, lambda stored: changes_of(stored, wanted), make_chunks, analyzed, facts)
    return version, maintenance.rebuild_tally(outcomes)


def merge(store: Store, most: int = 8, whole: bool = False) -> Snapshot:
    """Where there are over ``most`` segments, the smallest become one; ``whole`` merges all and drops the tombstones.

    The chunks and postings of a pass are merged together, so that a dead generation leaves both at once.
    """

    def change(base: Snapshot) -> dict | None:
        pairs = list(zip(base.tables["chunks"], base.tables["postings"], strict=True))
        if not whole and len(pairs) <= most or not pairs:
            return None
        chosen = pairs if whole else sorted(pairs, key=lambda p: (sum(map(store.size, p)), p))[: len(pairs) - most + 1]
        tombstones = store.read("tombstones", base)
        of = lambda name, i: store.read(name, Snapshot(base.version, {name: [p[i] for p in chosen]}, base.schemas))
        chunks, postings = of("chunks", 0), of("postings", 1)
        dead = chunks.select("generation_id", *_NUMBER).join(tombstones.select("generation_id"), "generation_id", "left_semi").select(*_NUMBER)
        postings = _without(postings, dead, _NUMBER).repartitionByRange("term", *_NUMBER).sortWithinPartitions("term", *_NUMBER)
        kept = {"chunks": _without(chunks, tombstones.select("generation_id"), ["generation_id"]), "postings": postings}
        out: dict = {"append": {name: [store.stage(name, rows)] for name, rows in kept.items()}, "drop": {name: [p[i] for p in chosen] for i, name in enumerate(kept)}}
        if whole:
            out["replace"] = {"tombstones": [store.stage("tombstones", tombstones.where("false"))]}
        return out

    return store.publish(change)
