"""The commands of a knowledge base as functions over its tables.

A ``Vault`` is the parsed notes and what is derived from them; every function is lazy and
returns DataFrames, but for the few answers that steer the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.embedding import embed, hash_vector
from tessera.functions.hashing import chunk_id, config_key, generation_id
from tessera.functions.identity import identity_key, normalize_identity_key
from tessera.functions.patch import patched
from tessera.functions.stemmer import analyze, analyzed_terms
from tessera.operators import batch, changes, evaluation, graph, index, maintenance, retrieval, segments, validation, workflow
from tessera.operators.durable import stored_once
from tessera.operators.publication import Snapshot, Store
from tessera.sources import normalize, revision
from tessera.sources import vault as v


@dataclass
class Vault:
    notes: DataFrame
    errors: DataFrame
    keys: DataFrame
    links: DataFrame
    edges: DataFrame


class Invalid(ValueError):
    """A batch that breaks a rule; the rows that do are in ``rows``."""

    def __init__(self, rule: str, rows: list) -> None:
        super().__init__(f"{rule}: {len(rows)} rows, the first {rows[:3]}")
        self.rule, self.rows = rule, rows


def open_vault(spark: SparkSession, root: str, **globs) -> Vault:
    return derive(v.parse_notes(v.scan(spark, root, **globs)))


def derive(parsed: DataFrame) -> Vault:
    notes, errors = v.snapshot(parsed)
    keys = v.identity_keys(notes)
    links = graph.resolve_links(v.note_links(notes), keys, normalize=identity_key)
    return Vault(notes, errors, keys, links, graph.edges(links))


def rebuild_projection(parsed: DataFrame, drop_colliders: bool = False) -> dict[str, DataFrame]:
    """All derived tables anew, or Invalid: any file error, identity collision or dangling link refuses the whole.

    With ``drop_colliders`` notes whose identity collides, and links that lead nowhere, are
    left out as gaps instead. Files are parsed once: every table is made of what is kept of them,
    all but their texts and sections.
    """
    parsed = stored_once(parsed.drop("raw", "sections"))
    vault = derive(parsed)
    if drop_colliders:
        notes = graph.without_colliders(vault.notes, vault.keys.select("key", "note_id"))
        vault = derive(stored_once(parsed.join(notes.select("path"), "path", "left_semi")))
    else:
        for rule, rows in (("file errors", vault.errors), ("identity collisions", graph.identity_collisions(vault.keys)), ("duplicate ids", graph.duplicate_ids(vault.notes)), ("dangling links", graph.dangling(vault.links))):
            if found := rows.take(20):
                raise Invalid(rule, found)
    columns = ("note_id", "path", "type", "schema_version", "title", "status", "created", "updated", "content_hash")
    return {
        "notes": vault.notes.select(*columns),
        "note_identity_keys": vault.keys,
        "note_links": vault.edges,
        "vault_schema_migrations": vault.notes.groupBy("schema_version").agg(F.count("*").alias("note_count")),
        "evidence": workflow.fold_evidence(vault.notes),
    }


#: Tables of operations, which notes can't give back; fixed values.
LEDGERS = {
    "agent_runs": "run history is operational state",
    "workflow_idempotency": "idempotency of callers is operational state",
}


def rebuild_from_revision(spark: SparkSession, repository: str, at: str, include: Sequence[str] = ("**/*.md",)) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the derived tables as of a revision, gaps ``(table, reason, detail)``).

    Files that can't be read, notes whose identity collides and links that lead nowhere are
    gaps and left out; the tables of operations always are.
    """
    parsed = v.parse_notes(revision.scan_revision(spark, repository, at, include))
    vault = derive(parsed)
    survivors = graph.without_colliders(vault.notes, vault.keys.select("key", "note_id"))
    survivors = survivors.join(graph.duplicate_ids(survivors).select("path"), "path", "left_anti")
    kept = parsed.join(survivors.select("path"), "path", "left_semi")
    gap = lambda df, table, reason, detail: df.select(F.lit(table).alias("table"), F.lit(reason).alias("reason"), detail.alias("detail"))
    gaps = gap(vault.errors, "notes", "unreadable", F.concat_ws(": ", "path", "kind"))
    gaps = gaps.unionByName(gap(vault.notes.join(survivors.select("path"), "path", "left_anti"), "notes", "identity-collision", F.concat_ws(": ", "path", "note_id")))
    gaps = gaps.unionByName(gap(graph.dangling(derive(kept).links), "note_links", "dangling", F.concat_ws(" -> ", "source", "target")))
    for table, reason in LEDGERS.items():
        gaps = gaps.unionByName(gap(spark.range(1), table, reason, F.lit(None).cast("string")))
    return rebuild_projection(kept, drop_colliders=True), gaps


def build_index(notes: DataFrame, embedder: Callable[[Sequence[str]], list[list[float]]] | None = None, model: str = "hash-embed", dimensions: int = 64, version: int = 1) -> DataFrame:
    """``search_chunks`` of notes: chunks with content-addressed ids and vectors."""
    chunks = v.chunk_notes(notes)
    g = generation_id(F.col("note_id"), F.col("content_hash"), F.lit(model), F.lit(dimensions), F.lit(version))
    chunks = chunks.withColumn("generation_id", g).withColumn("chunk_id", chunk_id(F.col("generation_id"), F.col("section_path"), F.col("ordinal")))
    f = embedder or (lambda texts: [hash_vector(t, dimensions) for t in texts])
    return chunks.withColumn("embedding", embed(F.col("text"), f))


def expected_generations(notes: DataFrame, model: str = "hash-embed", dimensions: int = 64, version: int = 1) -> DataFrame:
    parts = (F.lit(model), F.lit(dimensions), F.lit(version))
    return notes.select("note_id", "content_hash", generation_id(F.col("note_id"), F.col("content_hash"), *parts).alias("generation_id"), config_key(*parts).alias("config_key"))


def retrieve(vault: Vault, chunks: DataFrame, question: str, embedder: Callable[[Sequence[str]], list[list[float]]] | None = None, k: int = 10, kind: str | None = None, dimensions: int = 64, active: DataFrame | None = None, full_text: bool = True, postings: DataFrame | None = None) -> DataFrame:
    """Ranked notes ``(rank, note_id, score, channel, section_path, mode)`` for a question.

    A question that names one note by id, slug or alias gets that note and is not embedded;
    one that names several is an error. A type filters before ranking. Only chunks of ``active``
    generations are served, all if None; without full text, or where it fails, vectors answer alone.
    ``postings`` are those of a stored index, of which the question's terms are read; without
    them the chunks are indexed for this question alone, which suits a few notes.
    """
    retrieval.check_k(k)
    spark = chunks.sparkSession
    asked = spark.createDataFrame([(question, question, normalize_identity_key(question))], "query string, exact string, normalized string")
    hit = retrieval.identity_matches(asked, vault.keys).first()
    if hit and hit["ambiguous"]:
        raise LookupError(f"{question!r} names several notes")
    if hit:
        mode = "id" if hit["tier"] == 0 else "alias"
        return spark.createDataFrame([(1, hit["note_id"], 1.0, "identity", "", mode)], "rank int, note_id string, score double, channel string, section_path string, mode string")
    if kind is not None:
        chunks = chunks.join(vault.notes.where(F.col("type") == kind).select("note_id"), "note_id", "left_semi")
    vector = (embedder or (lambda texts: [hash_vector(t, dimensions) for t in texts]))([question])[0]

    def text_layer(served: DataFrame, k: int) -> DataFrame:
        terms = analyze(question, frozenset(retrieval.STOP_WORDS))
        if postings is None:
            return segments.ranked(index.analyzed_postings(served.select("note_id", "chunk_id", "section_path", "text")), terms, k)
        hits = postings.where(F.col("term").isin("", *terms))
        narrowed = kind is not None or active is not None
        return segments.ranked(hits.join(served.select("chunk_id"), "chunk_id", "left_semi") if narrowed else hits, terms, k)

    found = retrieval.search_layers(chunks, active, vector, text_layer if full_text else None, k)
    columns = ("note_id", "section_path", "rank")
    layers = found.vector.select(F.lit("vector").alias("layer"), *columns)
    if found.text is not None:
        layers = layers.unionByName(found.text.select(F.lit("fts").alias("layer"), *columns))
    folded = retrieval.fold(layers)
    fused = retrieval.fuse(folded).where(F.col("rank") <= k)
    mode = F.when(F.size(F.array_distinct(F.transform("contributions", lambda c: c["layer"]))) > 1, "hybrid").otherwise(F.col("contributions")[0]["layer"])
    return fused.join(retrieval.primary_channel(folded), "note_id").select("rank", "note_id", "score", "channel", "section_path", mode.alias("mode"))


def index_vault(store: Store, notes: DataFrame, embedder: Callable[[Sequence[str]], list[list[float]]] | None = None, facts: dict[str, str] | None = None, **config) -> tuple[Snapshot, DataFrame]:
    """(the version, its tally) of a pass that brings a stored index to ``notes``: only what differs is chunked and embedded.

    Chunks, postings, activation and retirement become visible in one version; where another
    writer was first the pass is made again on what it left.
    """
    wanted = notes.join(expected_generations(notes, **config).select("note_id", "generation_id"), "note_id")
    return segments.index_pass(store, wanted, lambda needed: build_index(needed.drop("generation_id"), embedder, **config), facts=facts)


def ask(store: Store, vault: Vault, question: str, **options) -> DataFrame:
    """retrieve() over a stored index as of its latest version."""
    chunks, postings = segments.served(store)
    return retrieve(vault, chunks, question, postings=postings, **options)


def ask_many(store: Store, questions: DataFrame, embedder: Callable[[Sequence[str]], list[list[float]]] | None = None, k: int = 10, dimensions: int = 64) -> DataFrame:
    """The fused ranking ``(query_id, note_id, rank, score, ...)`` of ``questions(query_id, text)`` over a stored index, in a few passes for all."""
    chunks, postings = segments.served(store)
    asked = questions.select("query_id", analyzed_terms(F.col("text"), tuple(retrieval.STOP_WORDS)).alias("terms"), embed(F.col("text"), embedder or (lambda texts: [hash_vector(t, dimensions) for t in texts])).alias("vector"))
    return batch.hybrid({"fts": batch.text_layer(postings, asked, k), "vector": batch.vector_layer(chunks, asked, k)}, k)


def evaluate(store: Store, questions: DataFrame, labels: DataFrame, k: int = 10, least_recall: float = 0.85, least_mrr: float = 0.7, **options) -> DataFrame:
    """Recall and MRR of both layers for ``questions(query_id, text)`` against ``labels(query_id, note_id)``, and whether they pass."""
    metrics = evaluation.recall_and_mrr(questions, ask_many(store, questions, k=k, **options), labels, k)
    return evaluation.passes(metrics, least_recall, least_mrr)


def sync(stored: DataFrame, vault: Vault, dry_run: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(changes, the next notes table or None): edited, new and moved notes replaced, dropped ones removed."""
    fresh = vault.notes.select("note_id", "path", "content_hash")
    diff = maintenance.snapshot_diff(stored, fresh)
    if dry_run or diff.isEmpty():
        return diff, None
    touched = fresh.join(diff.where("change <> 'dropped'").select("note_id"), "note_id", "left_semi")
    gone = diff.where("change = 'dropped'").select("note_id")
    return diff, maintenance.apply_notes(stored.select("note_id", "path", "content_hash").join(gone, "note_id", "left_anti"), touched)


def status(vault: Vault, notes: DataFrame, chunks: DataFrame, jobs: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row of counts, and ok if there is nothing to repair."""
    stale = maintenance.staleness(notes, expected_generations(vault.notes)).agg(F.count_if(F.col("state") == "stale").alias("stale_notes"), F.count_if(F.col("state") == "missing").alias("missing_notes"))
    parts = [
        vault.notes.agg(F.count("*").alias("notes")),
        vault.errors.agg(F.count("*").alias("errors")),
        stale,
        chunks.agg(F.count("*").alias("chunks")),
        workflow.matching(jobs, state="pending").agg(F.count("*").alias("pending_jobs")),
        workflow.needs_attention(evidence).agg(F.count("*").alias("open_evidence")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # each is one row
    return out.withColumn("ok", (F.col("errors") == 0) & (F.col("stale_notes") == 0))


def validate(vault: Vault) -> DataFrame:
    """Findings ``(subject, code, severity)`` of the vault."""
    found = [
        vault.errors.select(F.col("path").alias("subject"), F.col("kind").alias("code"), F.lit("error").alias("severity")),
        graph.duplicate_ids(vault.notes).select(F.col("path").alias("subject"), F.lit("duplicate-id").alias("code"), F.lit("error").alias("severity")),
        graph.identity_collisions(vault.keys).select(F.col("key").alias("subject"), F.lit("identity-collision").alias("code"), F.lit("error").alias("severity")),
        vault.links.where("target_id is null").select(F.concat_ws(" -> ", "source", "target").alias("subject"), F.when(F.col("ambiguous"), "ambiguous-link").otherwise("broken-link").alias("code"), F.lit("warning").alias("severity")),
    ]
    lines = vault.notes.select("note_id", F.posexplode(F.split("raw", "\n")).alias("ord", "line"))
    found.append(validation.accessibility(lines).select(F.concat_ws(":", "note_id", F.col("ord").cast("string")).alias("subject"), "code", F.lit("warning").alias("severity")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def resolve_seed(vault: Vault, seed: str) -> str:
    """The one note that a seed names by id, raw slug or alias; none or several is an error."""
    spark = vault.notes.sparkSession
    asked = spark.createDataFrame([(seed, seed, normalize_identity_key(seed))], "query string, exact string, normalized string")
    hit = retrieval.identity_matches(asked, vault.keys).first()
    if hit is None or hit["note_id"] is None:
        raise LookupError(f"{seed!r} names {'no note' if hit is None else 'several notes'}")
    return hit["note_id"]


def add_notes(vault: Vault, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the notes to write, refused ones ``(path, note_id, code)``) of ``files(path, content)`` that are new to the vault."""
    parsed = v.parse_notes(files)
    judged = changes.judged_additions(parsed, vault.notes, vault.keys.where("tier > 0"), identity_key)
    return parsed.join(judged.where("code is null").select("path"), "path", "left_semi"), judged.where("code is not null")


def ingest(spark: SparkSession, files: DataFrame, apply: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(what ``files(path, content, length)`` would give, the normalised texts to store or None): without ``apply`` a preview.

    Files over their format's limit are refused by their length, before they are read.
    """
    small, large = normalize.within_limits(files)
    texts = normalize.normalize(small)
    report = texts.select("path", "format", F.col("reject_code").alias("code"), "size_bytes").unionByName(
        large.select("path", F.lit(None).cast("string").alias("format"), F.lit("too-large").alias("code"), F.col("length").alias("size_bytes"))
    )
    return report, texts.where("reject_code is null") if apply else None


def list_sources(sources: DataFrame, limit: int = 50, offset: int = 0) -> tuple[DataFrame, dict]:
    """A page of the registered sources, newest first."""
    return workflow.page(sources, workflow.newest_first("added_at", "id"), limit, offset)


def show_source(sources: DataFrame, handle: str) -> dict:
    """The source of an id or else a locator, without the fields that it lacks."""
    asked = sources.sparkSession.createDataFrame([(handle,)], "handle string")
    row = changes.shown_sources(sources, asked).first()
    if not row["found"]:
        raise LookupError(f"{handle!r} names no source")
    return {k: x for k, x in row.asDict().items() if x is not None and k not in ("handle", "found")}


def settle_evidence(vault: Vault, evidence: DataFrame, asked: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(the report of reverified(), next texts ``(note_id, path, ok, code, next)``) of evidence to resolve or retry, ``asked(id, retry)``.

    All entries of a note are changed in one edit.
    """
    entries = vault.notes.select("note_id", F.explode("evidence.id").alias("id"))
    report = changes.reverified(evidence, entries, asked)
    fields = F.struct(F.lit("resolved").alias("status"), F.lit("re-anchored to the current note").alias("verdict"), F.lit(at).alias("lastCheckedAt"), F.when(F.col("retry"), F.col("attempts")).alias("attempts"))
    retried = asked.groupBy("id").agg(F.max("retry").alias("retry"))
    ops = report.where("outcome = 'resolved'").join(retried, "id").select("note_id", F.struct(F.lit("set-evidence-fields").alias("kind"), "id", fields.alias("fields")).alias("op"))
    patches = ops.groupBy("note_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list("op")).alias("ops"))).alias("patch"))
    edited = vault.notes.select("note_id", "path", "raw").join(patches, "note_id").withColumn("p", patched(F.col("raw"), F.col("patch")))
    return report, edited.select("note_id", "path", "p.ok", "p.code", "p.next")


def preview_plans(vault: Vault, plans: DataFrame, require_sources: bool = True) -> tuple[DataFrame, DataFrame]:
    """(findings ``(plan_id, code, severity)``, plans with ``outcome`` and the text that each would write, ``next``); nothing is written.

    ``plans(plan_id, op, target, note_type, alias, object, sources, evidence_states, grounded_hash, patch)``;
    a plan is ready if it has no error, its note is there and still the one that it was made
    from, and its JSON ``patch``, if any, applies.
    """
    claimed = vault.keys.where("tier > 0").select("key", "note_id")
    findings = changes.plan_findings(plans, require_sources).unionByName(changes.target_findings(plans, vault.notes, claimed, identity_key))
    grounded = changes.applicable(plans.withColumnRenamed("target", "note_id"), changes.plan_verdicts(plans, findings), vault.notes)
    ready = grounded.where("outcome = 'ready' and patch is not null").join(vault.notes.select("note_id", "path", "raw"), "note_id")
    edits = ready.select("plan_id", "path", patched(F.col("raw"), F.col("patch")).alias("p"))
    out = grounded.select("plan_id", "note_id", "outcome").join(edits, "plan_id", "left")
    outcome = F.when(F.col("p.ok") == F.lit(False), F.col("p.code")).otherwise(F.col("outcome"))
    return findings, out.select("plan_id", "note_id", outcome.alias("outcome"), "path", F.col("p.next").alias("next"))


def enrich(vault: Vault, chunks: DataFrame, note_id: str, generate: Callable[[DataFrame], DataFrame], k: int = 10) -> tuple[DataFrame, DataFrame]:
    """preview_plans() of what ``generate`` plans for a note from the ranked notes on it; without any there is no plan."""
    context = retrieve(vault, chunks, f"enrich note {note_id}", k=k)
    if context.isEmpty():
        raise LookupError(f"nothing was found to enrich {note_id!r} from")
    return preview_plans(vault, generate(context))


def related(vault: Vault, seed: str, depth: int = 1, limit: int = 50, offset: int = 0) -> tuple[DataFrame, dict]:
    found = graph.related(vault.edges, resolve_seed(vault, seed), depth)
    return workflow.page(found, ["distance", "note_id"], limit, offset)


def issues_in_order(issues: DataFrame) -> DataFrame:
    """By note and issue in the order of the Unicode collation, as readers expect it."""
    return issues.orderBy(F.collate("note_id", "UNICODE"), F.collate("issue", "UNICODE"))


@dataclass(frozen=True)
class Migration:
    """A step of the tables' schema; ``up`` gives the tables' next version."""

    id: str
    checksum: str
    up: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def migrate(tables: dict[str, DataFrame], applied: DataFrame, migrations: Sequence[Migration]) -> tuple[dict[str, DataFrame], list[tuple[str, str, str]]]:
    """(the tables' next version, ``(id, checksum, applied or skipped)`` in order of id).

    ``applied(id, checksum)`` is what ran before. A step runs once: the same id with another
    checksum, or an id given twice, refuses the whole. A gap is filled in its place. The caller
    publishes the tables and the report together.
    """
    ids = [m.id for m in migrations]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise Invalid("duplicate migrations", twice)
    known = {r["id"]: r["checksum"] for r in applied.where(F.col("id").isin(ids)).select("id", "checksum").distinct().collect()}
    if changed := sorted(m.id for m in migrations if known.get(m.id, m.checksum) != m.checksum):
        raise Invalid("migrations changed after they ran", changed)
    report = []
    for m in sorted(migrations, key=lambda m: m.id):
        if m.id not in known:
            tables = m.up(dict(tables))
        report.append((m.id, m.checksum, "skipped" if m.id in known else "applied"))
    return tables, report
