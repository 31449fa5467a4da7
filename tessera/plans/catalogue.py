"""Queries over the driver's tables, one or more for each operator, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import embedding, hashing, identity, stemmer, text
from tessera.operators import batch, cells, changes, evaluation, graph, index, maintenance, retrieval, segments, validation, workflow
from tessera.operators.durable import shared_folder
from tessera.operators.publication import Store
from tessera.plans import adapters, commands
from tessera.plans.adapters import read
from tessera.sources import vault
from tessera.streaming import lifecycle

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

#: The lexical query of the ranked reads.
TERMS = ("worthless", "clown", "idiot", "there")
_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- retrieval ---------------------------------------------------------------------------

_QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_DISTANCE = f"list_sum(list_transform(list_zip(embedding, {_QUERY_VECTOR}), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"


def _vectors(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    first = e.where("vec_id = 0").select("embedding").first()
    return e, (list(first[0]) if first else [])


@query(f"SELECT vec_id, row_number() OVER (ORDER BY d, vec_id)::BIGINT AS rank FROM (SELECT vec_id, {_DISTANCE} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10")
def vector_topk(spark, sf_dir) -> DataFrame:
    e, q = _vectors(spark, sf_dir)
    chunks = e.select(F.col("vec_id").alias("note_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieval.vector_layer(chunks, q, 10).where("rank <= 10").select(F.col("note_id").alias("vec_id"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH r AS (SELECT label, vec_id, row_number() OVER (ORDER BY d, vec_id) AS rank, d FROM (SELECT label, vec_id, {_DISTANCE} AS d FROM embeddings)),
    n AS (SELECT label, min(rank) AS best FROM r GROUP BY label ORDER BY best LIMIT 5),
    b AS (SELECT max(d) AS edge FROM r JOIN n ON r.rank = n.best)
    SELECT r.label, r.vec_id, r.rank::BIGINT AS all_rank FROM r JOIN n USING (label), b WHERE r.d <= b.edge"""
)
def vector_topk_distinct_notes(spark, sf_dir) -> DataFrame:
    e, q = _vectors(spark, sf_dir)
    chunks = e.select(F.col("label").alias("note_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    kept = retrieval.vector_layer(chunks, q, 5)
    # Every chunk up to the k-th note's best belongs to one of the k notes, so ranks among these are ranks among all.
    return kept.select(F.col("note_id").alias("label"), F.col("chunk_id").alias("vec_id"), F.col("rank").cast("long").alias("all_rank"))


def _scored_documents(spark, sf_dir) -> DataFrame:
    """Scores of the documents that hold a query term, from the stored index."""
    return index.scored(spark, adapters.index_folder(spark, sf_dir, "plain"), TERMS)


_FTS = f"""t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND w NOT IN ({_STOP})) AS terms FROM documents),
    s AS (SELECT count(*) AS n, avg(len(terms)) AS mean_length FROM t),
    p AS (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM t),
    f AS (SELECT doc_id, length, term, count(*) AS tf FROM p WHERE term IN {TERMS} GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    score AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length))), 9) AS relevance FROM f JOIN df USING (term), s GROUP BY doc_id),
    fts AS (SELECT doc_id, row_number() OVER (ORDER BY relevance DESC, doc_id) AS rank FROM score ORDER BY relevance DESC, doc_id LIMIT 10)"""


@query(f"WITH {_FTS} SELECT doc_id, rank::BIGINT AS rank FROM fts")
def fts_topk_plain(spark, sf_dir) -> DataFrame:
    ranked = retrieval.rank_chunks(_scored_documents(spark, sf_dir), 10, False)
    return ranked.select(F.col("note_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


#: Words of the documents' language that the analyzer gives the stems of TERMS; "there" is a function word.
_FORMS = "(worthless(ly|ness)?|clown(s|ed|ing)?|idiot(s|ic|ically)?)"


@query(
    f"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(strip_accents(lower(coalesce(text, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND w NOT IN ({_STOP})) AS terms FROM documents),
    s AS (SELECT count(*) AS n, avg(len(terms)) AS mean_length FROM t),
    p AS (SELECT doc_id, len(terms) AS length, regexp_extract(unnest(terms), '^{_FORMS}$', 1) AS word FROM t),
    f AS (SELECT doc_id, length, regexp_extract(word, '^(worthless|clown|idiot)', 1) AS term, count(*) AS tf FROM p WHERE word <> '' GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    score AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length))), 9) AS relevance FROM f JOIN df USING (term), s GROUP BY doc_id)
    SELECT doc_id, row_number() OVER (ORDER BY relevance DESC, doc_id)::BIGINT AS rank FROM score ORDER BY relevance DESC, doc_id LIMIT 10"""
)
def fts_topk_analyzed(spark, sf_dir) -> DataFrame:
    """Documents and query both folded, without function words and stemmed."""
    terms = stemmer.analyze(" ".join(TERMS), frozenset(retrieval.STOP_WORDS))
    ranked = retrieval.rank_chunks(index.scored(spark, adapters.index_folder(spark, sf_dir, "analyzed"), terms), 10, False)
    return ranked.where("rank <= 10").select(F.col("note_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


def _layers(spark, sf_dir) -> DataFrame:
    fts = retrieval.rank_chunks(_scored_documents(spark, sf_dir), 10, False).select(F.lit("fts").alias("layer"), "note_id", "section_path", "rank")
    e, q = _vectors(spark, sf_dir)
    chunks = e.select(F.col("vec_id").alias("note_id"), F.col("vec_id").alias("chunk_id"), F.lit("v").alias("section_path"), "embedding")
    vector = retrieval.vector_layer(chunks, q, 10).select(F.lit("vector").alias("layer"), "note_id", "section_path", "rank")
    return fts.unionByName(vector)


_LAYERS = f"""{_FTS}, vec AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY d, vec_id) AS rank FROM (SELECT vec_id, {_DISTANCE} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10),
    layers AS (SELECT 'fts' AS layer, doc_id, '' AS section_path, rank FROM fts UNION ALL SELECT 'vector', doc_id, 'v', rank FROM vec)"""


@query(f"WITH {_LAYERS} SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, row_number() OVER (ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 12) DESC, doc_id)::BIGINT AS rank FROM layers GROUP BY doc_id")
def hybrid_rrf(spark, sf_dir) -> DataFrame:
    fused = retrieval.fuse(retrieval.fold(_layers(spark, sf_dir)))
    return fused.select(F.col("note_id").alias("doc_id"), F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_LAYERS} SELECT doc_id, arg_min(layer, rank * 2 + (layer = 'vector')::INT) AS channel FROM layers GROUP BY doc_id")
def primary_channel(spark, sf_dir) -> DataFrame:
    return retrieval.primary_channel(retrieval.fold(_layers(spark, sf_dir))).withColumnRenamed("note_id", "doc_id")


@query(f"WITH {_LAYERS} SELECT doc_id, section_path, min(rank)::BIGINT AS best_rank, row_number() OVER (PARTITION BY doc_id ORDER BY min(rank), section_path)::BIGINT AS place FROM layers GROUP BY doc_id, section_path")
def sections_best_rank(spark, sf_dir) -> DataFrame:
    s = retrieval.best_sections(_layers(spark, sf_dir))
    return s.select(F.col("note_id").alias("doc_id"), "section_path", F.col("best_rank").cast("long").alias("best_rank"), F.col("place").cast("long").alias("place"))


@query(
    f"""WITH {_FTS}, l AS (SELECT d.doc_id, fts.rank, unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS ord FROM documents d JOIN fts USING (doc_id)),
    r AS (SELECT doc_id, ord, rank, ceil(length(line) / 4.0)::BIGINT AS tokens, sum(ceil(length(line) / 4.0)) OVER (ORDER BY rank, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM l)
    SELECT doc_id, ord::BIGINT AS ord, tokens, running FROM r WHERE running <= 6000"""
)
def pack_budget(spark, sf_dir) -> DataFrame:
    ranked = retrieval.rank_chunks(_scored_documents(spark, sf_dir), 10, False).select(F.col("note_id").alias("doc_id"), F.col("rank").alias("item_rank"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(ranked), "doc_id")  # ten rows
    sections = docs.select("doc_id", "item_rank", F.posexplode(F.split("text", "\n")).alias("section_rank", "text"))
    packed = retrieval.pack_context(sections)
    return packed.select("doc_id", (F.col("section_rank") + 1).cast("long").alias("ord"), "tokens", "running")


@query(
    """WITH ids AS (SELECT 'doc-' || doc_id AS note_id, doc_id FROM documents),
    q AS (SELECT 'doc-' || doc_id AS query FROM documents WHERE doc_id % 100 = 0 UNION SELECT DISTINCT upper(source) || '.' || doc_id FROM documents WHERE doc_id % 100 = 0 UNION SELECT DISTINCT lang || '-' || (doc_id % 100) FROM documents),
    k AS (SELECT 0 AS tier, 'doc-' || doc_id AS key, 'doc-' || doc_id AS note_id FROM documents UNION ALL SELECT 1, source || ' ' || doc_id, 'doc-' || doc_id FROM documents UNION ALL SELECT 2, lang || ' ' || (doc_id % 100), 'doc-' || doc_id FROM documents),
    a AS (SELECT query, 0 AS tier, query AS key FROM q UNION ALL SELECT query, t, trim(regexp_replace(lower(query), '[[:punct:]\\s]+', ' ', 'g')) FROM q, (VALUES (1), (2)) v(t)),
    h AS (SELECT query, tier, count(DISTINCT note_id) AS owners, min(note_id) AS note_id FROM a JOIN k USING (tier, key) GROUP BY query, tier)
    SELECT query, min(tier)::BIGINT AS tier, CASE WHEN arg_min(owners, tier) = 1 THEN arg_min(note_id, tier) END AS note_id, arg_min(owners, tier) > 1 AS ambiguous FROM h GROUP BY query"""
)
def retrieval_identity_tiers(spark, sf_dir) -> DataFrame:
    n = adapters.notes(spark, sf_dir)
    slug = F.concat_ws(" ", "type", F.col("doc_id").cast("string"))
    asked = (
        n.where("doc_id % 100 = 0").select(F.col("note_id").alias("query"))
        .union(n.where("doc_id % 100 = 0").select(F.concat(F.upper("type"), F.lit("."), "doc_id")))
        .union(n.select("alias"))
        .distinct()
    )
    asked = asked.select("query", F.col("query").alias("exact"), identity.identity_key_ascii(F.col("query")).alias("normalized"))
    keys = (
        n.select(F.lit(0).alias("tier"), F.col("note_id").alias("key"), "note_id")
        .union(n.select(F.lit(1), identity.identity_key_ascii(slug), "note_id"))
        .union(n.select(F.lit(2), identity.identity_key_ascii(F.col("alias")), "note_id"))
    )
    found = retrieval.identity_matches(asked, keys)
    return found.select("query", F.col("tier").cast("long").alias("tier"), "note_id", "ambiguous")


# --- many questions at once ------------------------------------------------------------------

_BATCH = f"""t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND w NOT IN ({_STOP})) AS terms FROM documents),
    s AS (SELECT count(*) AS n, avg(len(terms)) AS mean_length FROM t),
    bt AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND w NOT IN ({_STOP}))) AS term FROM benchmark),
    p AS (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM t),
    f AS (SELECT doc_id, length, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM bt) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    score AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length))), 9) AS relevance FROM bt JOIN f USING (term) JOIN df USING (term), s GROUP BY item_id, doc_id),
    fts AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, doc_id) AS rank FROM score QUALIFY rank <= 10),
    vec AS (SELECT item_id, e.vec_id AS doc_id, row_number() OVER (PARTITION BY item_id ORDER BY list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), e.vec_id) AS rank
        FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings e QUALIFY rank <= 10),
    layers AS (SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS part FROM fts UNION ALL SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM vec),
    sums AS (SELECT item_id, doc_id, sum(part) AS score FROM layers GROUP BY item_id, doc_id),
    fused AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM sums QUALIFY rank <= 10)"""


def _questions(spark, sf_dir) -> DataFrame:
    """Every item of benchmark as a question: its terms, and the vector of its number."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", retrieval.plain_terms(F.coalesce("text", F.lit(""))).alias("terms"))
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return b.join(vectors, "query_id", "left")


def _batch_fts(spark, sf_dir) -> DataFrame:
    return batch.text_layer(spark.read.parquet(adapters.index_folder(spark, sf_dir, "plain")), _questions(spark, sf_dir))


def _batch_vectors(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("note_id"), F.col("vec_id").alias("chunk_id"), F.lit("v").alias("section_path"), "embedding")
    return batch.vector_layer(e, _questions(spark, sf_dir))


def _asked(df, *columns) -> DataFrame:
    return df.select(F.col("query_id").alias("item_id"), F.col("note_id").alias("doc_id"), *columns, F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BATCH} SELECT item_id, doc_id, rank::BIGINT AS rank FROM fts")
def batch_fts_topk(spark, sf_dir) -> DataFrame:
    return _asked(_batch_fts(spark, sf_dir))


@query(f"WITH {_BATCH} SELECT item_id, doc_id, rank::BIGINT AS rank FROM vec")
def batch_vector_topk(spark, sf_dir) -> DataFrame:
    return _asked(_batch_vectors(spark, sf_dir))


@query(f"WITH {_BATCH} SELECT item_id, doc_id, round(score, 9) AS score, rank::BIGINT AS rank FROM fused")
def batch_hybrid_rrf(spark, sf_dir) -> DataFrame:
    fused = batch.hybrid({"fts": _batch_fts(spark, sf_dir), "vector": _batch_vectors(spark, sf_dir)})
    return _asked(fused, F.round("score", 9).alias("score"))


@query(
    f"""WITH {_BATCH},
    bw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM benchmark),
    dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
    br AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS run FROM bw WHERE len(w) >= 8),
    dr AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS run FROM dw WHERE len(w) >= 8),
    x AS (SELECT DISTINCT item_id, doc_id FROM br JOIN dr USING (run)),
    w AS (SELECT item_id, count(*) AS labels FROM x GROUP BY item_id),
    h AS (SELECT item_id, count(*) AS hits, min(rank) AS first FROM fused JOIN x USING (item_id, doc_id) GROUP BY item_id)
    SELECT count(*)::BIGINT AS queries, round(avg(coalesce(hits / labels, 0)), 9) AS recall, round(avg(coalesce(1 / first, 0)), 9) AS mrr FROM benchmark LEFT JOIN w USING (item_id) LEFT JOIN h USING (item_id)"""
)
def eval_recall_mrr(spark, sf_dir) -> DataFrame:
    """Both layers fused, for every item of benchmark, against the documents that quote it."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), "text")
    retrieved = batch.hybrid({"fts": _batch_fts(spark, sf_dir), "vector": _batch_vectors(spark, sf_dir)})
    return evaluation.recall_and_mrr(items, retrieved, evaluation.quoted(items, docs))


@query(
    """WITH c AS (SELECT conv_id, turn, coalesce(text, '') || ' [[doc-' || (conv_id * 7 + turn) || ']] [[ doc-' || conv_id || ' ]] [[nope]]' AS answer FROM conversations),
    m AS (SELECT conv_id, turn, unnest(regexp_extract_all(answer, '\\[\\[\\s*([^\\[\\]]+?)\\s*\\]\\]', 1)) AS note_id FROM c)
    SELECT DISTINCT m.conv_id, m.turn, m.note_id FROM m JOIN (SELECT 'doc-' || doc_id AS note_id FROM documents) d USING (note_id)"""
)
def citations_resolved(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    answer = F.concat(F.coalesce("text", F.lit("")), F.lit(" [[doc-"), (F.col("conv_id") * 7 + F.col("turn")).cast("string"), F.lit("]] [[ doc-"), F.col("conv_id").cast("string"), F.lit(" ]] [[nope]]"))
    cited = c.select("conv_id", "turn", F.explode(F.regexp_extract_all(answer, F.lit(r"\[\[\s*([^\[\]]+?)\s*\]\]"), F.lit(1))).alias("note_id")).distinct()
    return cited.join(adapters.notes(spark, sf_dir).select("note_id"), "note_id", "left_semi").select("conv_id", "turn", "note_id")


_CELLS: dict[str, str] = {}


@query(f"SELECT vec_id, row_number() OVER (ORDER BY d, vec_id)::BIGINT AS rank FROM (SELECT vec_id, {_DISTANCE} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10")
def vector_topk_by_cells(spark, sf_dir) -> DataFrame:
    """The same nearest vectors, from the cells that can hold them."""
    e, q = _vectors(spark, sf_dir)
    chunks = e.select(F.col("vec_id").alias("note_id"), F.col("vec_id").alias("chunk_id"), F.lit("v").alias("section_path"), "embedding")
    folder = f"{shared_folder(spark)}/cells-{uuid4().hex}"
    cells.write_cells(chunks, folder)
    found = cells.nearest(spark, folder, q, 10).ranked
    return found.where("rank <= 10").select(F.col("note_id").alias("vec_id"), F.col("rank").cast("long").alias("rank"))


@query(
    """WITH f AS (SELECT doc_id, source, text FROM documents), n AS (SELECT e.vec_id, e.embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.source = (SELECT min(source) FROM documents)),
    """
    + f"d AS (SELECT vec_id, {_DISTANCE} AS d FROM n) SELECT vec_id, row_number() OVER (ORDER BY d, vec_id)::BIGINT AS rank FROM d ORDER BY d, vec_id LIMIT 10"
)
def vector_topk_of_a_type(spark, sf_dir) -> DataFrame:
    """The nearest of one type of notes: the type filters before the layer is ranked."""
    e, q = _vectors(spark, sf_dir)
    d = read(spark, sf_dir, "documents")
    kind = d.agg(F.min("source")).first()[0]
    typed = d.where(F.col("source") == kind).select(F.col("doc_id").alias("vec_id"))
    chunks = e.join(typed, "vec_id", "left_semi").select(F.col("vec_id").alias("note_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieval.vector_layer(chunks, q, 10).where("rank <= 10").select(F.col("note_id").alias("vec_id"), F.col("rank").cast("long").alias("rank"))


def _edited(spark, sf_dir):
    """documents as a first and a second state: some edited, some gone, some new."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    after = d.where("doc_id % 17 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("clown "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    chunk = lambda df: df.select(F.col("doc_id").alias("note_id"), F.col("doc_id").alias("chunk_id"), F.lit("").alias("section_path"), F.concat_ws("-", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("generation_id"), "text")
    return chunk(d.where("doc_id % 13 <> 0")), chunk(after)


@query(
    "WITH "
    + _FTS.replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'clown ' ELSE '' END || coalesce(text, '') AS text FROM documents WHERE doc_id % 17 <> 0))", 1)
    + " SELECT doc_id, rank::BIGINT AS rank FROM fts"
)
def fts_topk_after_edits(spark, sf_dir) -> DataFrame:
    """The ranking of edited documents from two segments and tombstones: nothing that stayed is indexed again."""
    before, after = _edited(spark, sf_dir)
    dead = before.join(after.select("generation_id"), "generation_id", "left_anti")
    fresh = after.join(before.select("generation_id"), "generation_id", "left_anti").select(*before.columns)
    postings = segments.live(segments.postings_of(before, False).unionByName(segments.postings_of(fresh, False)), dead)
    ranked = segments.ranked(postings.where(F.col("term").isin("", *TERMS)), TERMS)
    return ranked.where("rank <= 10").select(F.col("note_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


@query()
def stored_index_topk(spark, sf_dir) -> DataFrame:
    """The same through a store: two passes, a merge and the answer of the last version, all in a new folder."""
    store = Store(spark, f"{shared_folder(spark)}/index-{uuid4().hex}")
    for state in _edited(spark, sf_dir):
        named = state.select(F.col("note_id").cast("string").alias("note_id"), F.col("chunk_id").cast("string").alias("chunk_id"), "section_path", "generation_id", "text")
        wanted = named.select("note_id", F.concat("note_id", F.lit(".md")).alias("path"), F.col("generation_id").alias("content_hash"), "generation_id", "text", "section_path", "chunk_id")
        segments.index_pass(store, wanted, lambda needed: needed.select("note_id", "chunk_id", "section_path", "generation_id", "text"), analyzed=False)
    segments.merge(store, most=1)
    _, postings = segments.served(store)
    ranked = segments.ranked(postings.where(F.col("term").isin("", *TERMS)), TERMS)
    return ranked.where("rank <= 10").select(F.col("note_id").cast("long").alias("doc_id"), F.round("relevance", 9).alias("relevance"))


@query()
def job_lifecycle(spark, sf_dir) -> DataFrame:
    """events as the log of jobs, four events a job, followed as a stream into a new folder: each job's last state."""
    folder = f"{shared_folder(spark)}/jobs-{uuid4().hex}"
    kinds = F.element_at(F.array(*map(F.lit, ("queued", "claimed", "ended", "cancel"))), (F.col("event_id") % 4 + 1).cast("int"))
    told = F.element_at(F.array(*map(F.lit, ("ok", "failed", "failed"))), (F.col("event_id") % 3 + 1).cast("int"))
    log = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table may be one file
    log = log.select(
        F.floor(F.col("event_id") / 4).alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), kinds.alias("kind"), F.lit(1).cast("long").alias("attempt"), told.alias("outcome"),
        F.when(F.col("event_id") % 5 < 3, "transient").otherwise("permanent").alias("error_class"), (F.col("event_id") % 2 + 1).cast("long").alias("max_attempts"),
    )
    lifecycle.follow_jobs(spark, log, folder).awaitTermination()
    changes = spark.read.parquet(f"{folder}/changes").where("kind <> 'due'")
    return workflow.latest_by(changes, "job_id", ("seq",), "seq", "state", "attempts", "next_run_at")


# --- identity and hashing ------------------------------------------------------------------


@query("SELECT lower(c_mktsegment) AS key, count(DISTINCT c_custkey)::BIGINT AS owners, min(c_custkey) AS first_owner FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) > 1")
def ambiguous_identity(spark, sf_dir) -> DataFrame:
    keys = read(spark, sf_dir, "customer").select(identity.identity_key_ascii(F.col("c_mktsegment")).alias("key"), F.col("c_custkey").alias("note_id"))
    return graph.identity_collisions(keys)


@query("WITH h AS (SELECT sha256(coalesce(text, '')) AS h, doc_id FROM documents), g AS (SELECT h, count(*) AS sharing, min(doc_id) AS first_doc FROM h GROUP BY h HAVING count(*) > 1) SELECT doc_id, sharing::BIGINT AS sharing, first_doc FROM h JOIN g USING (h)")
def duplicate_ids(spark, sf_dir) -> DataFrame:
    n = adapters.notes(spark, sf_dir).select(F.col("content_hash").alias("note_id"), F.col("doc_id").alias("path"))
    return graph.duplicate_ids(n).select(F.col("path").alias("doc_id"), "sharing", F.col("first_path").alias("first_doc"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[[:punct:]\\s]+', ' ', 'g')) AS key FROM part")
def identity_key_ascii(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", identity.identity_key_ascii(F.col("p_name")).alias("key"))


@query()
def identity_key_full(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", identity.identity_key(F.coalesce("text", F.lit(""))).alias("key"))


_CONTENT = "'sha256:' || sha256(coalesce(text, ''))"
_GENERATION = f"""sha256('{{"chunkerVersion":1,"contentHash":"' || {_CONTENT} || '","embeddingDimensions":64,"embeddingModel":"hash-embed","noteId":"doc-' || doc_id || '"}}')"""


@query(f"SELECT doc_id, {_CONTENT} AS content_hash FROM documents")
def content_hash(spark, sf_dir) -> DataFrame:
    return adapters.notes(spark, sf_dir).select("doc_id", "content_hash")


@query(f"SELECT doc_id, {_GENERATION} AS generation_id FROM documents")
def generation_id(spark, sf_dir) -> DataFrame:
    return adapters.document_generations(adapters.notes(spark, sf_dir)).select("doc_id", "generation_id")


@query(f"""SELECT doc_id, ord::BIGINT AS ord, sha256('{{"generationId":"' || g || '","ordinal":' || ord || ',"sectionPath":"line-' || ord || '"}}') AS chunk_id FROM (SELECT doc_id, {_GENERATION} AS g, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents)""")
def chunk_id(spark, sf_dir) -> DataFrame:
    g = adapters.document_generations(adapters.notes(spark, sf_dir)).select("doc_id", "generation_id", F.explode(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1)).alias("ord"))
    path = F.concat(F.lit("line-"), F.col("ord").cast("string"))
    return g.select("doc_id", F.col("ord").cast("long").alias("ord"), hashing.chunk_id(F.col("generation_id"), path, F.col("ord")).alias("chunk_id"))


@query("SELECT event_id, floor(('0x' || substr(sha256(event_id || ':' || (event_id % 9 + 1)), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 * least(300000.0::DOUBLE, 1000.0::DOUBLE * pow(2.0::DOUBLE, event_id % 9)))::BIGINT AS delay FROM events")
def backoff_delay(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", hashing.backoff_delay(F.col("event_id"), F.col("event_id") % 9 + 1).alias("delay"))


@query("SELECT doc_id, sha256(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]+$', '')), chr(10)), '^\\n+|\\n+$', '', 'g')) AS section_hash FROM documents")
def section_hash(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", hashing.section_content_hash(F.col("text")).alias("section_hash"))


@query("SELECT doc_id, ceil((length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]'))) / 4.0)::BIGINT AS tokens FROM documents")
def estimate_tokens(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT url, regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://') AS is_url, 'src_' || substr(sha256(url), 1, 16) AS id FROM (SELECT DISTINCT url FROM pages WHERE page_id % 10 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 10 = 0))")
def source_registry(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    stored = p.where("page_id % 10 = 0").select(F.col("url").alias("locator"))
    fresh = p.where("page_id % 10 <> 0").select(F.col("url").alias("locator"), F.lit("").alias("title"), F.col("page_id").alias("added_at"))
    new = workflow.register_sources(stored, fresh)
    return new.select(F.col("locator").alias("url"), (F.col("kind") == "url").alias("is_url"), "id")


# --- maintenance ---------------------------------------------------------------------------

_V1 = f"v1 AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, {_CONTENT} AS h FROM documents WHERE doc_id % 13 <> 0)"
_V2 = f"v2 AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'moved/' ELSE source || '/' END || doc_id || '.md' AS path, CASE WHEN doc_id % 5 = 0 THEN 'edited' ELSE '' END || {_CONTENT} AS h FROM documents WHERE doc_id % 17 <> 0)"
_DIFF = f"WITH {_V1}, {_V2}, d AS (SELECT 'doc-' || coalesce(v1.doc_id, v2.doc_id) AS note_id, CASE WHEN v1.doc_id IS NULL THEN 'new' WHEN v2.doc_id IS NULL THEN 'dropped' WHEN v1.h <> v2.h THEN 'changed' WHEN v1.path <> v2.path THEN 'moved' END AS change FROM v1 FULL JOIN v2 ON v1.doc_id = v2.doc_id)"


def _versions(spark, sf_dir):
    n = adapters.notes(spark, sf_dir).select("note_id", "path", "content_hash", "doc_id")
    v2 = n.where("doc_id % 17 <> 0").select(
        "note_id",
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("moved/"), "doc_id", F.lit(".md"))).otherwise(F.col("path")).alias("path"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("edited"), "content_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
    )
    return n.where("doc_id % 13 <> 0").drop("doc_id"), v2


@query(_DIFF + " SELECT note_id, change FROM d WHERE change IS NOT NULL")
def sync_diff(spark, sf_dir) -> DataFrame:
    return maintenance.snapshot_diff(*_versions(spark, sf_dir))


@query(_DIFF + " SELECT (count(*) FILTER (change = 'changed'))::BIGINT AS changed, (count(*) FILTER (change = 'new'))::BIGINT AS new, (count(*) FILTER (change = 'dropped'))::BIGINT AS dropped, (count(*) FILTER (change = 'moved'))::BIGINT AS moved, count(change) = 0 AS noop FROM d")
def sync_counts(spark, sf_dir) -> DataFrame:
    return maintenance.diff_counts(sync_diff(spark, sf_dir))


_ACTIVE = f"""n AS (SELECT doc_id, 'doc-' || doc_id AS note_id, {_CONTENT} AS want_hash, {_GENERATION} AS want, CASE WHEN doc_id % 5 = 0 THEN 'old-' ELSE '' END || {_CONTENT} AS content_hash,
    CASE WHEN doc_id % 11 <> 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'old-' WHEN doc_id % 7 = 0 THEN 'cfg-' ELSE '' END || {_GENERATION} END AS active_generation_id,
    CASE WHEN doc_id % 11 <> 0 THEN doc_id % 3 END AS active_generation FROM documents)"""


@query(f"WITH {_ACTIVE} SELECT note_id, (want_hash = content_hash AND 1 >= coalesce(active_generation, 0)) AS activated, CASE WHEN want_hash = content_hash AND 1 >= coalesce(active_generation, 0) THEN want ELSE active_generation_id END AS active_generation_id FROM n")
def activate_cas(spark, sf_dir) -> DataFrame:
    n = adapters.notes(spark, sf_dir)
    proposals = adapters.document_generations(n).select("note_id", "generation_id", "content_hash", F.lit(1).cast("long").alias("revision"))
    return maintenance.activate(adapters.active_notes(n), proposals).select("note_id", "activated", "active_generation_id")


@query(
    f"""WITH {_ACTIVE} SELECT note_id, CASE WHEN active_generation_id IS NULL THEN 'missing' WHEN active_generation_id = want THEN 'indexed' ELSE 'stale' END AS state,
    CASE WHEN active_generation_id IS NULL OR active_generation_id = want THEN '' ELSE concat_ws(',', CASE WHEN content_hash <> want_hash THEN 'content' END, CASE WHEN doc_id % 7 = 0 THEN 'config' END) END AS triggers FROM n"""
)
def staleness(spark, sf_dir) -> DataFrame:
    n = adapters.notes(spark, sf_dir)
    return maintenance.staleness(adapters.active_notes(n), adapters.document_generations(n))


def _chunks(n):
    """Chunks of every generation whose document is not a multiple of nine, and of some old ones."""
    g = adapters.document_generations(n).where("doc_id % 9 <> 0")
    current = g.select("generation_id", F.concat("generation_id", F.lit("/0")).alias("chunk_id"))
    old = adapters.active_notes(n).where("active_generation_id like 'old-%' and doc_id % 2 = 0").select(F.col("active_generation_id").alias("generation_id"), F.concat("active_generation_id", F.lit("/0")).alias("chunk_id"))
    return current.unionByName(old)


_CHUNKS = f"{_ACTIVE}, c AS (SELECT want AS generation_id FROM n WHERE doc_id % 9 <> 0 UNION ALL SELECT active_generation_id FROM n WHERE active_generation_id LIKE 'old-%' AND doc_id % 2 = 0)"


@query(f"WITH {_CHUNKS} SELECT generation_id, generation_id || '/0' AS chunk_id FROM c WHERE generation_id NOT IN (SELECT active_generation_id FROM n WHERE active_generation_id IS NOT NULL)")
def orphan_chunks(spark, sf_dir) -> DataFrame:
    n = adapters.notes(spark, sf_dir)
    return maintenance.orphan_chunks(_chunks(n), adapters.active_notes(n))


@query(
    f"""WITH {_CHUNKS}, g AS (SELECT DISTINCT generation_id FROM c), a AS (SELECT note_id, active_generation_id AS generation_id, want FROM n WHERE active_generation_id IS NOT NULL)
    SELECT 'missing-chunks' AS kind, note_id AS subject FROM a WHERE generation_id NOT IN (SELECT generation_id FROM g)
    UNION ALL SELECT 'stale-active', note_id FROM a WHERE generation_id <> want
    UNION ALL SELECT 'orphaned-generation', generation_id FROM g WHERE generation_id NOT IN (SELECT generation_id FROM a)"""
)
def index_verify(spark, sf_dir) -> DataFrame:
    n = adapters.notes(spark, sf_dir)
    return maintenance.divergences(adapters.active_notes(n), _chunks(n), adapters.document_generations(n))


@query(
    f"""WITH {_CHUNKS}, g AS (SELECT generation_id, count(*) AS present FROM c GROUP BY 1)
    SELECT note_id, CASE WHEN doc_id % 19 = 0 THEN 'tombstone' WHEN doc_id % 23 = 0 THEN 'empty' WHEN g.present IS NOT NULL AND doc_id % 4 <> 0 AND active_generation_id IS NOT DISTINCT FROM want THEN 'unchanged' WHEN g.present IS NOT NULL AND doc_id % 4 <> 0 THEN 'reattach' ELSE 'embed' END AS action
    FROM n LEFT JOIN g ON g.generation_id = n.want"""
)
def index_plan(spark, sf_dir) -> DataFrame:
    """Every fourth note expects a second chunk that is not stored, though another one is."""
    n = adapters.notes(spark, sf_dir)
    chunk = lambda i: F.concat("generation_id", F.lit(f"/{i}"))
    g = adapters.document_generations(n)
    ids = F.when(F.col("doc_id") % 23 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 4 == 0, F.array(chunk(0), chunk(1))).otherwise(F.array(chunk(0)))
    expected = g.select("note_id", "generation_id", F.explode(ids).alias("chunk_id"))
    chunks = _chunks(n).unionByName(g.where("doc_id % 4 = 0").select("generation_id", chunk("x").alias("chunk_id")))
    held = adapters.active_notes(n).withColumn("status", F.when(F.col("doc_id") % 19 == 0, "archived").otherwise("active"))
    return maintenance.index_plan(held, chunks, expected).select("note_id", "action")


@query(f"WITH {_ACTIVE} SELECT note_id FROM n WHERE active_generation < 2 OR active_generation_id IS NULL")
def needs_index(spark, sf_dir) -> DataFrame:
    return maintenance.needs_index(adapters.active_notes(adapters.notes(spark, sf_dir)), 2).select("note_id")


@query("SELECT user_id, event_id, sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS revision FROM (SELECT user_id, event_id, ts, coalesce((event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT, 1) AS step FROM events)")
def adopt_config_epochs(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("config_key"))
    return maintenance.config_epochs(e).select(F.col("owner").alias("user_id"), F.col("seq").alias("event_id"), F.col("revision").cast("long").alias("revision"))


@query("SELECT lang AS schema_version, count(*)::BIGINT AS note_count FROM documents GROUP BY lang")
def schema_version_histogram(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("schema_version")).agg(F.count("*").alias("note_count"))


# --- graph ---------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = p_partkey) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey)")
def orphan_notes(spark, sf_dir) -> DataFrame:
    notes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("note_id"))
    ends = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_custkey").alias("target")).union(read(spark, sf_dir, "supplier").select("s_suppkey", "s_suppkey"))
    return graph.orphan_notes(notes, ends).select(F.col("note_id").alias("p_partkey"))


@query(
    """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    d1 AS (SELECT b AS note_id, a AS from_id FROM s WHERE a = 's1'),
    d2 AS (SELECT s.b AS note_id, min(s.a) AS from_id FROM d1 JOIN s ON s.a = d1.note_id WHERE s.b <> 's1' AND s.b NOT IN (SELECT note_id FROM d1) GROUP BY s.b)
    SELECT note_id, 1::BIGINT AS distance, from_id FROM d1 UNION ALL SELECT note_id, 2, from_id FROM d2"""
)
def graph_related_depth2(spark, sf_dir) -> DataFrame:
    found = graph.related(adapters.part_edges(spark, sf_dir), "s1", 2)
    return found.select("note_id", F.col("distance").cast("long").alias("distance"), "from_id")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), s AS (SELECT a, b, 2 AS via FROM e UNION ALL SELECT b, a, 3 FROM e),
    seeds AS (SELECT 's' || min(s_suppkey) AS seed FROM supplier GROUP BY s_nationkey),
    r(seed, note_id, distance) AS (SELECT seed, seed, 0 FROM seeds UNION SELECT seed, s.b, distance + 1 FROM r JOIN s ON s.a = r.note_id WHERE distance < 4),
    d AS (SELECT seed, note_id, min(distance) AS distance FROM r GROUP BY seed, note_id)
    SELECT d.seed, d.note_id, d.distance::BIGINT AS distance, min(s.a) AS from_id, CASE WHEN min(s.via) = 2 THEN 'link' ELSE 'backlink' END AS via
    FROM d JOIN s ON s.b = d.note_id JOIN d p ON p.seed = d.seed AND p.note_id = s.a AND p.distance = d.distance - 1 WHERE d.distance > 0 GROUP BY d.seed, d.note_id, d.distance"""
)
def graph_related_seeds_depth4(spark, sf_dir) -> DataFrame:
    """Four steps from the first supplier of each nation."""
    seeds = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("s"), F.min("s_suppkey")).alias("seed"))
    found = graph.related_to_each(adapters.part_edges(spark, sf_dir), seeds, 4)
    return found.select("seed", "note_id", F.col("distance").cast("long").alias("distance"), "from_id", "via")


@query("WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem) SELECT a AS note_id, b AS target, 'link' AS via FROM e UNION ALL SELECT b, a, 'backlink' FROM e")
def links_backlinks(spark, sf_dir) -> DataFrame:
    return graph.neighbours(adapters.part_edges(spark, sf_dir)).select("note_id", "target", "via")


@query(
    """WITH l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'doc-' || (doc_id + 1) WHEN doc_id % 3 = 1 THEN lang || '-' || (doc_id % 100) || '#top' ELSE 'doc-x' || doc_id END AS target FROM documents),
    k AS (SELECT 'doc-' || doc_id AS key, 0 AS tier, 'doc-' || doc_id AS note_id FROM documents UNION ALL SELECT lang || '-' || (doc_id % 100), 2, 'doc-' || doc_id FROM documents),
    o AS (SELECT key, tier, count(DISTINCT note_id) AS owners, min(note_id) AS owner FROM k GROUP BY key, tier), f AS (SELECT key, arg_min(owners, tier) AS owners, arg_min(owner, tier) AS owner FROM o GROUP BY key)
    SELECT doc_id, CASE WHEN owners = 1 THEN owner END AS target_id, coalesce(owners > 1, false) AS ambiguous FROM l LEFT JOIN f ON f.key = regexp_replace(l.target, '#.*$', '')"""
)
def link_resolution(spark, sf_dir) -> DataFrame:
    n = adapters.notes(spark, sf_dir)
    target = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("doc-"), F.col("doc_id") + 1)).when(F.col("doc_id") % 3 == 1, F.concat("alias", F.lit("#top"))).otherwise(F.concat(F.lit("doc-x"), "doc_id"))
    keys = n.select(F.lit(0).alias("tier"), F.col("note_id").alias("key"), "note_id").union(n.select(F.lit(2), "alias", "note_id"))
    return graph.resolve_links(n.select("doc_id", target.alias("target")), keys).select("doc_id", "target_id", "ambiguous")


# --- queue, runs, evidence -------------------------------------------------------------------

_JOBS = "j AS (SELECT event_id AS job_id, event_type AS workflow, (['pending', 'running', 'succeeded', 'failed', 'cancelled', 'pending'])[event_id % 6 + 1] AS state, event_id % 4 AS attempts, 3 AS max_attempts, CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) END AS next_run_at, epoch_us(ts) AS created_at, user_id FROM events)"


@query(f"WITH {_JOBS} SELECT job_id, row_number() OVER (ORDER BY next_run_at ASC NULLS FIRST, job_id)::BIGINT AS place FROM j WHERE state = 'pending' AND attempts < max_attempts AND job_id % 10 <> 0 AND (next_run_at IS NULL OR next_run_at <= (SELECT max(created_at) FROM j)) ORDER BY next_run_at ASC NULLS FIRST, job_id LIMIT 20")
def jobs_claim_order(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    j = adapters.jobs(spark, sf_dir)
    now = j.agg(F.max("created_at")).first()[0]
    first = workflow.claim(j, F.lit(now), 20, j.where("job_id % 10 = 0"))
    return first.select("job_id", F.row_number().over(Window.orderBy(F.col("next_run_at").asc_nulls_first(), "job_id")).cast("long").alias("place"))


@query(f"WITH {_JOBS}, a AS (SELECT event_id // 3 AS job_id, arg_max(event_type || '-error', event_id % 3) AS last_error FROM events WHERE event_id % 5 > 1 GROUP BY 1) SELECT job_id, state, last_error FROM j LEFT JOIN a USING (job_id)")
def jobs_list_last_error(spark, sf_dir) -> DataFrame:
    return workflow.with_last_error(adapters.jobs(spark, sf_dir), adapters.attempts(spark, sf_dir)).select("job_id", "state", "last_error")


@query(f"WITH {_JOBS} SELECT count(*)::BIGINT AS jobs, (count(*) FILTER (state = 'succeeded'))::BIGINT AS succeeded, (count(*) FILTER (state = 'failed'))::BIGINT AS failed, (count(*) FILTER (state = 'cancelled'))::BIGINT AS cancelled, (count(*) FILTER (state = 'pending'))::BIGINT AS pending, 4::BIGINT AS exit_code FROM j")
def jobs_rollup(spark, sf_dir) -> DataFrame:
    return workflow.rollup(adapters.jobs(spark, sf_dir).withColumn("exit_code", F.col("job_id") % 8))


@query(f"WITH {_JOBS} SELECT job_id, CASE WHEN job_id % 5 = 0 THEN 'cancelled' WHEN attempts >= max_attempts THEN 'failed' ELSE 'pending' END AS state FROM j WHERE state = 'running'")
def jobs_recover(spark, sf_dir) -> DataFrame:
    j = adapters.jobs(spark, sf_dir)
    return workflow.recover(j, j.where("job_id % 5 = 0")).select("job_id", "state")


@query(
    f"""WITH {_JOBS} SELECT job_id, CASE WHEN state <> 'running' OR attempts <> job_id % 3 THEN state WHEN job_id % 2 = 0 THEN 'succeeded' WHEN workflow = 'click' THEN 'cancelled' WHEN workflow = 'view' THEN 'failed' WHEN attempts < max_attempts THEN 'pending' ELSE 'failed' END AS state FROM j"""
)
def jobs_settle(spark, sf_dir) -> DataFrame:
    j = adapters.jobs(spark, sf_dir)
    kind = F.when(F.col("workflow") == "click", "cancelled").when(F.col("workflow") == "view", "permanent").otherwise("transient")
    outcomes = j.select("job_id", (F.col("job_id") % 3).alias("attempt"), F.when(F.col("job_id") % 2 == 0, "ok").otherwise("error").alias("outcome"), kind.alias("error_class"))
    return workflow.settle(j, outcomes, F.lit(0)).select("job_id", "state")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'changed' WHEN 'P' THEN 'attempt-failed' ELSE 'in-progress' END AS kind, r.l_linenumber AS commit_id FROM orders LEFT JOIN lineitem r ON r.l_orderkey = o_orderkey AND r.l_returnflag = 'R'")
def note_history(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "integrated").when(F.col("o_orderstatus") == "P", "failed").otherwise("planning")
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("note_id"), F.col("o_orderdate").alias("started_at"), status.alias("status"))
    git = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.lit("integrate").alias("op_type"), F.when(F.col("l_returnflag") == "R", "done").alias("status"), F.col("l_linenumber").alias("commit_id"))
    return workflow.note_history(runs, git).select(F.col("run_id").alias("o_orderkey"), "kind", "commit_id")


@query("SELECT l_orderkey, max(l_linenumber)::BIGINT AS last_line, arg_max(l_partkey, l_linenumber * 10000000 + l_partkey) AS last_part FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def latest_per_run(spark, sf_dir) -> DataFrame:
    x = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("created_at"), F.col("l_partkey").alias("plan_id"))
    joined = x.join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("plan_id")), "plan_id")
    latest = workflow.latest_by(joined, "run", ("created_at",), "created_at", "plan_id")
    return latest.select(F.col("run").alias("l_orderkey"), F.col("created_at").cast("long").alias("last_line"), F.col("plan_id").alias("last_part"))


@query("SELECT user_id, (count(*) FILTER (event_type = 'click'))::BIGINT AS click, (count(*) FILTER (event_type = 'purchase'))::BIGINT AS purchase, (count(*) FILTER (event_type = 'view'))::BIGINT AS view FROM events GROUP BY user_id")
def run_report_pivot(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("op_type"))
    return workflow.run_report(e, ("click", "purchase", "view")).withColumnRenamed("run_id", "user_id")


@query("""WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS a FROM documents), b AS (SELECT doc_id, a || sha256(unhex(a)) AS h FROM h)
    SELECT doc_id, array_to_string(list_transform(range(64), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::INT), ',') AS bytes FROM b""")
def hash_embed_bytes(spark, sf_dir) -> DataFrame:
    """The vectors of the default embedder, as the bytes that they are made of."""
    d = read(spark, sf_dir, "documents").select("doc_id", embedding.hash_embed(F.coalesce("text", F.lit(""))).alias("v"))
    return d.select("doc_id", F.array_join(F.transform("v", lambda x: F.round(x * 127.5 + 127.5).cast("int").cast("string")), ",").alias("bytes"))


_EVIDENCE = "e AS (SELECT doc_id, CASE WHEN quality = 1 AND doc_id % 3 = 0 THEN 'resolved' WHEN quality = 1 THEN 'pending' END AS status FROM labels)"


def _evidence(spark, sf_dir) -> DataFrame:
    status = F.when((F.col("quality") == 1) & (F.col("doc_id") % 3 == 0), "resolved").when(F.col("quality") == 1, "pending")
    return read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id") * 2).alias("note_id"), status.alias("status"))


@query(f"WITH {_EVIDENCE} SELECT doc_id, status FROM e WHERE status IS DISTINCT FROM 'resolved'")
def evidence_attention(spark, sf_dir) -> DataFrame:
    return workflow.needs_attention(_evidence(spark, sf_dir)).select("doc_id", "status")


@query(
    f"""WITH {_EVIDENCE}, n AS (SELECT doc_id, len(string_split(text, chr(10))) AS lines, {_CONTENT} AS h FROM documents)
    SELECT e.doc_id, CASE WHEN n.doc_id IS NULL THEN 'note-missing' WHEN e.doc_id % 6 >= lines THEN 'section-missing' WHEN (e.doc_id % 4 = 0) THEN 'stale' ELSE coalesce(status, 'pending') END AS effective FROM e LEFT JOIN n ON n.doc_id = e.doc_id * 2"""
)
def evidence_effective_state(spark, sf_dir) -> DataFrame:
    n = adapters.notes(spark, sf_dir)
    notes = n.select("note_id", "content_hash", F.transform(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1), lambda i: i.cast("string")).alias("section_paths"))
    e = _evidence(spark, sf_dir).withColumn("section_path", (F.col("doc_id") % 6).cast("string"))
    stamped = e.join(n.select("note_id", F.col("content_hash").alias("h")), "note_id", "left").withColumn("source_note_hash", F.when(F.col("doc_id") % 4 == 0, "other").otherwise(F.col("h"))).drop("h")
    return workflow.effective_evidence(stamped, notes).select("doc_id", "effective")


@query(f"WITH {_JOBS} SELECT job_id FROM j LEFT JOIN (SELECT o_orderkey, o_orderstatus FROM orders) o ON o.o_orderkey = j.job_id WHERE state = 'running' AND (o_orderkey IS NULL OR o_orderstatus = 'F')")
def idempotency_reconcile(spark, sf_dir) -> DataFrame:
    slots = adapters.jobs(spark, sf_dir).select("job_id", F.col("job_id").alias("run_id"), F.when(F.col("state") == "running", "in-progress").otherwise("done").alias("state"))
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "integrated").otherwise("planning").alias("status"))
    return workflow.stale_slots(slots, runs).select("job_id")


@query("SELECT doc_id, source FROM documents ORDER BY source DESC, doc_id LIMIT 50 OFFSET 100")
def page_documents(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    return workflow.page(d, [F.desc("source"), "doc_id"], 50, 100)[0]


# --- constraints ---------------------------------------------------------------------------


@query("SELECT o_orderkey, coalesce(n, 0)::BIGINT AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(n, 0) <> 1")
def one_slug_per_note(spark, sf_dir) -> DataFrame:
    notes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note_id"))
    keys = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.when(F.col("l_linestatus") == "O", "slug").otherwise("alias").alias("kind"))
    return validation.keys_per_note(notes, keys).select(F.col("note_id").alias("o_orderkey"), F.col("n").cast("long").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def fk_violations(spark, sf_dir) -> DataFrame:
    parents = read(spark, sf_dir, "customer").where("c_custkey % 7 <> 0")
    return validation.unknown_references(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", parents, "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def enum_violations(spark, sf_dir) -> DataFrame:
    return validation.not_in(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ("1-URGENT", "2-HIGH", "3-MEDIUM"))


@query("SELECT l_suppkey, l_partkey, count(*)::BIGINT AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_edges(spark, sf_dir) -> DataFrame:
    return validation.not_unique(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


# --- text ----------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT conv_id, turn, 'see [[doc-' || conv_id || '|the ' || turn || ']] and [[ b' || turn || ' ]] ' || coalesce(text, '') AS body FROM conversations)
    SELECT conv_id, turn, unnest(list_transform(regexp_extract_all(body, '\\[\\[([^\\]\\[\\n|]+)(?:\\|([^\\]\\[\\n]+))?\\]\\]', 1), lambda x: trim(x))) AS target FROM t"""
)
def wiki_links(spark, sf_dir) -> DataFrame:
    body = F.concat(F.lit("see [[doc-"), F.col("conv_id").cast("string"), F.lit("|the "), F.col("turn").cast("string"), F.lit("]] and [[ b"), F.col("turn").cast("string"), F.lit(" ]] "), F.coalesce("text", F.lit("")))
    found = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.wiki_links(body)).alias("l"))
    return found.select("conv_id", "turn", "l.target")


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents),
    h AS (SELECT 'doc-' || doc_id AS note_id, ord::BIGINT AS ord, CASE WHEN doc_id % 7 = 0 AND ord % 3 = 0 THEN repeat('#', (ord % 6 + 1)::INT) || ' ' || line || ' ##' ELSE line END AS line FROM l)
    SELECT note_id, ord, length(regexp_extract(line, '^ {0,3}(#{1,6})([ \\t]|$)', 1))::BIGINT AS level, trim(regexp_replace(regexp_replace(line, '^ {0,3}#{1,6}', ''), '[ \\t]+#+[ \\t]*$', '')) AS heading FROM h WHERE regexp_matches(line, '^ {0,3}#{1,6}([ \\t]|$)')"""
)
def heading_scan(spark, sf_dir) -> DataFrame:
    x = adapters.lines(spark, sf_dir).withColumn("level", text.heading_level(F.col("line"))).where("level is not null")
    return x.select("note_id", "ord", F.col("level").cast("long").alias("level"), text.heading_text(F.col("line")).alias("heading"))


@query(
    """WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents WHERE doc_id % 7 = 0), h AS (SELECT doc_id, ord, ord % 6 + 1 AS level FROM l WHERE ord % 3 = 0)
    SELECT 'doc-' || doc_id AS note_id, ord::BIGINT AS ord, level::BIGINT AS level FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM h) WHERE level > before + 1"""
)
def skipped_heading_levels(spark, sf_dir) -> DataFrame:
    heads = adapters.lines(spark, sf_dir).where("note_id is not null").withColumn("level", text.heading_level(F.col("line"))).where("level is not null")
    return graph.skipped_levels(heads).select("note_id", "ord", F.col("level").cast("long").alias("level"))


@query()
def section_paths(spark, sf_dir) -> DataFrame:
    """Headings with unique paths and breadcrumbs, by one pass over each note."""
    from tessera.functions.markdown import sections

    notes = adapters.bodies(spark, sf_dir)

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(n, s["ord"], s["level"], s["path"], s["body_start"], s["body_end"]) for n, x in zip(b["note_id"], b["body"]) for s in sections(x)], columns=["note_id", "ord", "level", "path", "body_start", "body_end"])

    return notes.mapInPandas(run, "note_id string, ord int, level int, path string, body_start int, body_end int")


@query()
def html_text(spark, sf_dir) -> DataFrame:
    from tessera.sources.normalize import normalize

    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content"))
    return normalize(pages).select("path", "reject_code", "text", F.size("gaps").alias("gaps"))


@query()
def fts_analyzed(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return stemmer.analyzed_postings(d, F.col("text"), tuple(retrieval.STOP_WORDS))


@query()
def hash_embed(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", embedding.hash_embed(F.coalesce("text", F.lit(""))).alias("embedding"))


@query("SELECT item_id, true AS ok, NULL::VARCHAR AS code, '---' || chr(10) || 'id: b' || item_id || chr(10) || 'aliases: [\"x\"]' || chr(10) || '---' || chr(10) || '# Item' || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Seen' || chr(10) || chr(10) || 'yes' || chr(10) AS next FROM benchmark")
def patched_notes(spark, sf_dir) -> DataFrame:
    """A section appended to each benchmark item as a note, on condition that it is there."""
    from tessera.functions.patch import patched

    raw = F.concat(F.lit("---\nid: b"), F.col("item_id").cast("string"), F.lit("\n---\n# Item\n\n"), F.col("text"), F.lit("\n"))
    patch = F.lit('{"preconditions":[{"kind":"section-present","path":"Item"}],"ops":[{"kind":"append-to-section","path":"Item/Seen","content":"yes","createIfAbsent":true},{"kind":"add-alias","alias":"x"}]}')
    return read(spark, sf_dir, "benchmark").select("item_id", patched(raw, patch).alias("p")).select("item_id", "p.ok", "p.code", "p.next")


@query(
    """WITH c AS (SELECT conv_id, turn, (conv_id * 7 + turn) % 6 AS kind FROM conversations)
    SELECT conv_id, turn, 1::BIGINT AS ord, 'accessibility:' || (['vague-link-label', 'missing-alt-text', 'skipped-heading-level', 'list-jump', 'multiple-top-headings'])[kind::INT] AS code FROM c WHERE kind > 0"""
)
def accessibility_findings(spark, sf_dir) -> DataFrame:
    """Notes of two lines each, of which one in six has nothing to find."""
    second = F.element_at(F.array(*map(F.lit, ("see [the report](x.md) ![a plot](y.png)", "see [ Click here ](x)", "![ ](x.png)", "### deep", "      - far in", "# again"))), (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(6)) + 1).cast("int"))
    first = F.when(F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(6)) == 4, "- top").otherwise("# One")
    c = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("note_id"), F.posexplode(F.array(first, second)).alias("ord", "line"))
    found = validation.accessibility(c)
    return found.select("note_id.conv_id", "note_id.turn", F.col("ord").cast("long").alias("ord"), "code")


_SHOWN = "regexp_replace(regexp_replace(chr(27) || '[31m' || coalesce(c.text, '') || chr(27) || '[0m' || chr(7), chr(27) || '\\[[0-9;]*m', '', 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F\\x{80}-\\x{9F}\\x{061C}\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]', '', 'g')"


@query(f"SELECT c.conv_id, c.turn, length({_SHOWN})::BIGINT AS shown, md5({_SHOWN}) AS digest FROM conversations c")
def sanitized_text(spark, sf_dir) -> DataFrame:
    raw = F.concat(F.lit("\x1b[31m"), F.coalesce("text", F.lit("")), F.lit("\x1b[0m\x07"))
    shown = text.sanitize_terminal(raw)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(shown).cast("long").alias("shown"), F.md5(shown).alias("digest"))


# --- more of maintenance and workflow --------------------------------------------------------


@query("SELECT event_id::VARCHAR AS chunk_id, min(user_id) AS generation_id FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def merge_chunks(spark, sf_dir) -> DataFrame:
    """An idempotent write: rows that come twice or are stored already are appended once or not at all."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("chunk_id"), F.col("user_id").alias("generation_id"), "event_id")
    return maintenance.merge_chunks(e.where("event_id % 3 = 0"), e.union(e).drop("event_id"))


@query(f"WITH {_CHUNKS} SELECT generation_id, generation_id || '/0' AS chunk_id FROM c WHERE generation_id IN (SELECT active_generation_id FROM n)")
def retired_index(spark, sf_dir) -> DataFrame:
    n = adapters.notes(spark, sf_dir)
    return maintenance.retire(_chunks(n), adapters.active_notes(n)).select("generation_id", "chunk_id")


@query(f"WITH {_V1}, {_V2} SELECT 'doc-' || doc_id AS note_id, path, h AS content_hash FROM v2 UNION ALL SELECT 'doc-' || doc_id, path, h FROM v1 WHERE doc_id NOT IN (SELECT doc_id FROM v2)")
def applied_notes(spark, sf_dir) -> DataFrame:
    """The next version of a notes table: what is in the new snapshot replaces, the rest stays."""
    return maintenance.apply_notes(*_versions(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'archived' ELSE 'active' END AS status, sha256(coalesce(text, '')) AS content_hash FROM documents")
def archived_notes(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.lit("active").alias("status"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return maintenance.archive_missing(d, d.where("note_id % 6 = 0")).withColumnRenamed("note_id", "doc_id")


@query(
    """WITH k AS (SELECT DISTINCT lower(c_mktsegment) || ' ' || (c_custkey % 500) AS key, c_custkey FROM customer), o AS (SELECT key FROM k GROUP BY key HAVING count(*) > 1)
    SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM k JOIN o USING (key))"""
)
def without_colliders(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("note_id"), F.concat_ws(" ", F.lower("c_mktsegment"), (F.col("c_custkey") % 500).cast("string")).alias("key"))
    return graph.without_colliders(c.select("note_id"), c).select(F.col("note_id").alias("c_custkey"))


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'created' WHEN 'N' THEN 'planning' ELSE 'planned' END AS status FROM lineitem),
    p AS (SELECT *, lag(status) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, status) AS previous FROM s)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM p WHERE previous IS NOT NULL AND NOT (previous = 'created' AND status = 'planning' OR previous = 'planning' AND status = 'planned')"""
)
def invalid_transitions(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "created").when(F.col("l_returnflag") == "N", "planning").otherwise("planned")
    x = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", status).alias("seq"), status.alias("status"))
    return workflow.invalid_transitions(x).select(F.col("run_id").alias("l_orderkey"), F.col("seq.l_linenumber").cast("long").alias("l_linenumber"), "seq.l_partkey")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F') <> (o_orderkey % 4 <> 0)")
def failure_without_checkpoint(spark, sf_dir) -> DataFrame:
    runs = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("created").alias("status"), F.when(F.col("o_orderkey") % 4 != 0, "apply").alias("failed_checkpoint"))
    return validation.failure_without_checkpoint(runs).select("o_orderkey")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'started' WHEN user_id % 2 <> event_id % 2 THEN 'conflict' WHEN event_id % 3 = 0 THEN 'replay' ELSE 'in-progress' END AS verdict FROM events")
def claimed_slots(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    slots = e.where("event_id % 5 <> 0").select(F.lit("sync").alias("command"), F.col("event_id").alias("idempotency_key"), (F.col("event_id") % 2).alias("request_hash"), F.when(F.col("event_id") % 3 == 0, "done").otherwise("in-progress").alias("state"))
    asked = e.select(F.lit("sync").alias("command"), F.col("event_id").alias("idempotency_key"), (F.col("user_id") % 2).alias("request_hash"))
    return workflow.claim_slot(asked, slots).select(F.col("idempotency_key").alias("event_id"), "verdict")


@query("SELECT o_orderkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'O' AND o_orderstatus IN ('F', 'P')")
def orphan_worktrees(spark, sf_dir) -> DataFrame:
    git = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_partkey", F.lit("worktree").alias("op_type"), F.when(F.col("l_linestatus") == "O", "open").otherwise("closed").alias("status"))
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "cancelled").otherwise("planning").alias("status"))
    return workflow.orphan_worktrees(git, runs).select(F.col("run_id").alias("o_orderkey"), "l_partkey")


@query(
    f"""WITH {_EVIDENCE} SELECT 'doc-' || doc_id AS note_id, 'orphan' AS issue FROM documents WHERE doc_id % 4 > 1
    UNION SELECT 'doc-' || doc_id * 2, 'evidence-' || coalesce(status, 'unknown') FROM e WHERE status IS DISTINCT FROM 'resolved'"""
)
def maintenance_issues(spark, sf_dir) -> DataFrame:
    n = adapters.notes(spark, sf_dir)
    edges = n.where("doc_id % 4 = 0").select(F.col("note_id").alias("source"), F.concat(F.lit("doc-"), F.col("doc_id") + 1).alias("target"))
    return workflow.maintenance_issues(n.select("note_id"), edges, _evidence(spark, sf_dir))


@query("SELECT doc_id, coalesce(source, '') AS note_type, CASE WHEN doc_id % 2 = 0 THEN 'internal' ELSE 'restricted' END AS sensitivity, CASE WHEN doc_id % 2 = 0 THEN 'verified' ELSE 'unverified' END AS trust FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM documents)")
def ranked_metadata(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.col("source").alias("type"), F.lit("internal").alias("sensitivity"))
    return retrieval.with_metadata(d.select("note_id"), d.where("note_id % 2 = 0")).withColumnRenamed("note_id", "doc_id")


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)
    SELECT doc_id, len(list_filter(x, lambda y: NOT regexp_matches(y, '^[\\s\\x{0B}\\x{85}\\x{A0}]*$')))::BIGINT AS before, len(list_filter(x, lambda y: NOT regexp_matches(y, '^[\\s\\x{0B}\\x{85}\\x{A0}]*$')))::BIGINT + 1 AS after FROM l"""
)
def edit_summary(spark, sf_dir) -> DataFrame:
    s = text.diff_summary(F.col("text"), F.concat("text", F.lit("\n \nmore\n")))
    return read(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.col("s.before").cast("long").alias("before"), F.col("s.after").cast("long").alias("after"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'cancelled' WHEN 'view' THEN 'permanent' ELSE 'transient' END AS class FROM events")
def error_classes(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "abort").when(F.col("event_type") == "view", "auth").otherwise(F.concat(F.lit("locked:"), "event_type"))
    return read(spark, sf_dir, "events").select("event_id", text.error_class(kind).alias("class"))


@query("SELECT doc_id, source || CASE doc_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '/../' WHEN 2 THEN '/.git/' ELSE '//' END || doc_id || '.md' AS path, doc_id % 4 = 0 AND source IS NOT NULL AS valid FROM documents")
def destination_paths(spark, sf_dir) -> DataFrame:
    between = F.element_at(F.array(*map(F.lit, ("/", "/../", "/.git/", "//"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat("source", between, F.col("doc_id").cast("string"), F.lit(".md"))
    return read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), text.valid_destination(path).alias("valid"))


# --- operators over single values, orders and fences ---------------------------------------------


@query(f"WITH {_JOBS} SELECT job_id, state, row_number() OVER (ORDER BY created_at DESC, job_id DESC)::BIGINT AS place FROM j WHERE workflow = 'click' QUALIFY place > 20 AND place <= 70")
def jobs_page(spark, sf_dir) -> DataFrame:
    """The second page of one workflow's jobs, newest first."""
    from pyspark.sql import Window

    jobs = workflow.matching(adapters.jobs(spark, sf_dir), workflow="click", state=None)
    order = workflow.job_order()
    rows, _ = workflow.page(jobs, order, 50, 20)
    return rows.select("job_id", "state", (F.row_number().over(Window.orderBy(*order)) + 20).cast("long").alias("place"))


@query(f"WITH {_CHUNKS} SELECT generation_id, generation_id || '/0' AS chunk_id FROM c WHERE generation_id IN (SELECT active_generation_id FROM n WHERE active_generation_id IS NOT NULL)")
def fenced_chunks(spark, sf_dir) -> DataFrame:
    n = adapters.active_notes(adapters.notes(spark, sf_dir)).where("active_generation_id is not null")
    active = n.select(F.col("active_generation_id").alias("generation_id"))
    return retrieval.fence(_chunks(adapters.notes(spark, sf_dir)), active).select("generation_id", "chunk_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN '%00' ELSE replace(replace(p_name || '%/' || p_brand, '%', '%25'), '/', '%2F') END AS segment FROM part")
def encoded_segments(spark, sf_dir) -> DataFrame:
    heading = F.when(F.col("p_partkey") % 50 == 0, "").otherwise(F.concat("p_name", F.lit("%/"), "p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", text.encode_segment(heading).alias("segment"))


@query(
    """SELECT conv_id, turn, sha256(array_to_string(list_filter([CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'Title › ' || role END, CASE WHEN turn % 2 = 0 THEN '' ELSE 'id: ' || conv_id END, coalesce(text, '')], lambda x: x <> ''), chr(10) || chr(10))) AS chunk FROM conversations"""
)
def composed_chunks(spark, sf_dir) -> DataFrame:
    crumb = F.when(F.col("conv_id") % 3 == 0, "").otherwise(text.compose_breadcrumb(F.array(F.lit(" Title "), F.lit(" "), "role")))
    block = F.when(F.col("turn") % 2 != 0, F.concat(F.lit("id: "), F.col("conv_id").cast("string")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(text.compose_chunk_text(crumb, block, F.col("text")), 256).alias("chunk"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id || '.notes' ELSE 'README' END AS slug FROM documents")
def file_slugs(spark, sf_dir) -> DataFrame:
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a/b.md/"), F.col("doc_id").cast("string"), F.lit(".notes.MD"))).otherwise("x\\\\README.md")
    return read(spark, sf_dir, "documents").select("doc_id", identity.file_slug(path).alias("slug"))


@query(
    """WITH h AS (SELECT page_id, sha256(url) AS d FROM pages)
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'content' WHEN 1 THEN 'rendition' END AS kind, CASE WHEN page_id % 3 < 2 THEN d END AS digest, CASE WHEN page_id % 3 = 1 THEN 2 END AS extractor_version FROM h"""
)
def source_handles(spark, sf_dir) -> DataFrame:
    head = F.concat(F.lit("sha256:"), F.sha2("url", 256), F.lit(":text/html"))
    handle = F.when(F.col("page_id") % 3 == 0, head).when(F.col("page_id") % 3 == 1, F.concat(head, F.lit(":2:7"))).otherwise(F.concat(head, F.lit(":2")))
    return read(spark, sf_dir, "pages").select("page_id", identity.source_handle(handle).alias("h")).select("page_id", "h.kind", "h.digest", "h.extractor_version")


@query(
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN url END AS text, CASE page_id % 3 WHEN 1 THEN 'decorative' WHEN 2 THEN 'image-no-alt' END AS gap, CASE WHEN page_id % 2 = 0 THEN 'public' ELSE 'internal' END AS sensitivity, CASE WHEN page_id % 5 = 0 THEN 'project' ELSE 'loose' END AS type FROM pages"""
)
def gate_values(spark, sf_dir) -> DataFrame:
    """Alternative texts and their gaps, mapped sensitivities and types."""
    p = read(spark, sf_dir, "pages")
    alt = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, "")
    kind = F.when(F.col("page_id") % 5 == 0, "project").when(F.col("page_id") % 5 == 1, "memo")
    declared = F.when(F.col("page_id") % 2 == 0, "public").otherwise("restricted")
    return p.select("page_id", text.media_alt(alt).alias("m"), text.map_sensitivity(declared).alias("sensitivity"), text.resolve_type(kind).alias("type")).select("page_id", "m.text", "m.gap", "sensitivity", "type")


@query("SELECT doc_id, coalesce(source, '') || '/' || doc_id || '.md' AS path FROM documents WHERE regexp_matches(coalesce(source, '') || '/' || doc_id || '.md', '^([^/]+/)*[^/]*1[^/]\\.md$')")
def globbed_paths(spark, sf_dir) -> DataFrame:
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return read(spark, sf_dir, "documents").select("doc_id", path.alias("path")).where(F.col("path").rlike(text.glob_pattern("**/*1?.md")))


# --- what passes over the index and the queue come to ---------------------------------------------

_OUTCOMES = """o AS (SELECT doc_id, (['indexed', 'unchanged', 'empty', 'superseded', 'embedding-failed', 'write-incomplete'])[doc_id % 6 + 1] AS kind,
    doc_id % 4 = 0 AS reattached, doc_id % 5 AS retired_chunks, doc_id % 7 AS chunk_count FROM documents)"""


def _outcomes(spark, sf_dir) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("indexed", "unchanged", "empty", "superseded", "embedding-failed", "write-incomplete"))), (F.col("doc_id") % 6 + 1).cast("int"))
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("note_id"), kind.alias("kind"), (F.col("doc_id") % 4 == 0).alias("reattached"), (F.col("doc_id") % 5).alias("retired_chunks"), (F.col("doc_id") % 7).alias("chunk_count"))


@query(
    f"""WITH {_OUTCOMES} SELECT doc_id, CASE WHEN kind = 'empty' THEN 'retired-orphan' WHEN reattached THEN 're-activated' ELSE 're-embedded' END AS action
    FROM o WHERE kind = 'indexed' OR kind = 'empty' AND retired_chunks > 0"""
)
def index_repairs(spark, sf_dir) -> DataFrame:
    return maintenance.repaired(_outcomes(spark, sf_dir)).withColumnRenamed("note_id", "doc_id")


@query(
    f"""WITH {_OUTCOMES} SELECT (count(*) FILTER (kind IN ('indexed', 'unchanged')))::BIGINT AS notes_indexed, coalesce(sum(chunk_count) FILTER (kind = 'indexed'), 0)::BIGINT AS chunks_written,
    (count(*) FILTER (kind = 'indexed' AND retired_chunks > 0))::BIGINT AS generations_retired, (count(*) FILTER (kind IN ('embedding-failed', 'write-incomplete')))::BIGINT AS unresolved, 'partial' AS outcome FROM o"""
)
def index_rebuild_tally(spark, sf_dir) -> DataFrame:
    return maintenance.rebuild_tally(_outcomes(spark, sf_dir))


@query(
    f"""WITH {_OUTCOMES}, r AS (SELECT CASE WHEN doc_id % 9 = 0 OR kind LIKE '%-failed' OR kind = 'write-incomplete' OR kind = 'empty' AND retired_chunks > 0 THEN 'removed' WHEN kind = 'indexed' THEN 'reembedded' ELSE 'unchanged' END AS result FROM o)
    SELECT count(*)::BIGINT AS scanned, (count(*) FILTER (result = 'reembedded'))::BIGINT AS reembedded, (count(*) FILTER (result = 'unchanged'))::BIGINT AS unchanged, (count(*) FILTER (result = 'removed'))::BIGINT AS removed FROM r"""
)
def index_reconcile_tally(spark, sf_dir) -> DataFrame:
    """Of all notes asked for, every ninth and those that could not be indexed are taken to have left the vault."""
    o = _outcomes(spark, sf_dir)
    there = o.where((F.col("note_id") % 9 != 0) & ~F.col("kind").isin(*maintenance.FAILED))
    return maintenance.reconcile_tally(maintenance.reconciled(o.select("note_id"), there))


@query("SELECT event_id, user_id FROM events WHERE user_id % 3 = 0 OR event_id % 4 = user_id % 4")
def superseded_retired(spark, sf_dir) -> DataFrame:
    """Chunks of four generations a user; those of every third user have none active and stay."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("user_id").alias("note_id"), (F.col("event_id") % 4).alias("generation_id"))
    active = e.where("note_id % 3 <> 0").select("note_id", (F.col("note_id") % 4).alias("generation_id")).distinct()
    return maintenance.retire_superseded(e, active).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def removed_notes(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("note_id"))
    gone = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("note_id"))
    return maintenance.remove_notes(e, gone).withColumnRenamed("note_id", "user_id")


@query(
    f"""WITH {_JOBS}, due AS (SELECT * FROM j WHERE state = 'pending' AND attempts < max_attempts AND (next_run_at IS NULL OR next_run_at <= (SELECT max(created_at) FROM j))),
    i AS (SELECT job_id, workflow, CASE WHEN workflow = 'click' AND job_id % 4 = 0 THEN 'succeeded' WHEN workflow = 'view' THEN 'failed' WHEN attempts + 1 < max_attempts THEN 'retry-scheduled' ELSE 'failed' END AS outcome FROM due)
    SELECT job_id, outcome, CASE WHEN outcome <> 'failed' THEN 0 WHEN workflow = 'click' THEN 2 WHEN workflow = 'view' THEN 1 ELSE 4 END AS exit_code FROM i"""
)
def jobs_drained(spark, sf_dir) -> DataFrame:
    """One drain: clicks succeed or find a lock, views are refused, other workflows have no handler."""
    jobs = adapters.jobs(spark, sf_dir)
    now = jobs.agg(F.max("created_at")).first()[0]
    ok = F.col("job_id") % 4 == 0
    clicks = lambda d: d.select("job_id", F.when(ok, "ok").otherwise("failed").alias("outcome"), F.when(~ok, "transient").alias("error_class"), F.when(~ok, "locked:vault").alias("error_code"))
    views = lambda d: d.select("job_id", F.lit("failed").alias("outcome"), F.lit("permanent").alias("error_class"), F.lit("validation").alias("error_code"))
    _, items = workflow.run_all(jobs, {"click": clicks, "view": views}, F.lit(now))
    return items.select("job_id", "outcome", "exit_code")


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'reserved-operation' ELSE 'operation-forbidden' END AS code FROM events WHERE event_id % 5 IN (1, 2, 4)"""
)
def refused_operations(spark, sf_dir) -> DataFrame:
    op = F.element_at(F.array(*map(F.lit, ("CreateNote", "CreateTask", "DropVault", "AddAlias"))), F.least(F.col("event_id") % 5 + 1, F.lit(4)).cast("int"))
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 4, op).alias("op"))
    return workflow.refused_operations(e).select("event_id", "code")


# --- changes before they are written ---------------------------------------------------------------


@query(
    """WITH f AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '/' ELSE '' END || 'new/' || (CASE WHEN doc_id % 11 = 0 THEN doc_id - doc_id % 2 ELSE doc_id END) || '.md' AS path, CASE WHEN doc_id % 13 = 0 THEN 'source-' ELSE 'n' END || doc_id AS note_id,
        lang || ' ' || (doc_id % 100) AS alias, CASE WHEN doc_id % 5 = 0 THEN 'invalid-frontmatter' END AS bad FROM documents WHERE doc_id % 3 = 0),
    n AS (SELECT 'n' || doc_id AS note_id, 'new/' || (doc_id + 3) || '.md' AS path, lang || ' ' || (doc_id % 50) AS key FROM documents WHERE doc_id % 6 = 0),
    c AS (SELECT path, lower(alias) AS key FROM f WHERE bad IS NULL UNION SELECT path, trim(regexp_replace(lower(note_id), '[[:punct:]\\s]+', ' ', 'g')) FROM f WHERE bad IS NULL),
    k AS (SELECT lower(key) AS key FROM n UNION SELECT key FROM c GROUP BY key HAVING count(*) > 1)
    SELECT doc_id, CASE WHEN path LIKE '/%' THEN 'invalid-destination' WHEN bad IS NOT NULL THEN bad WHEN note_id LIKE 'source-%' THEN 'reserved-identity' WHEN note_id IN (SELECT note_id FROM n) THEN 'duplicate-id'
        WHEN path IN (SELECT path FROM n) OR path IN (SELECT path FROM f GROUP BY path HAVING count(*) > 1) THEN 'duplicate-path' WHEN path IN (SELECT path FROM c JOIN k USING (key)) THEN 'duplicate-identity' END AS code FROM f"""
)
def judged_additions(spark, sf_dir) -> DataFrame:
    """Every third document as a new note beside those of every sixth; ids, paths and aliases collide by rules of the id."""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    number = F.when(i % 11 == 0, i - i % 2).otherwise(i).cast("string")
    fresh = d.where("doc_id % 3 = 0").select(
        F.concat(F.when(i % 7 == 0, "/").otherwise(""), F.lit("new/"), number, F.lit(".md")).alias("path"),
        F.concat(F.when(i % 13 == 0, "source-").otherwise("n"), i.cast("string")).alias("note_id"),
        F.lit("concept").alias("type"),
        F.array(F.concat_ws(" ", "lang", (i % 100).cast("string"))).alias("aliases"),
        F.when(i % 5 == 0, "invalid-frontmatter").alias("error_kind"),
    )
    held = d.where("doc_id % 6 = 0")
    notes = held.select(F.concat(F.lit("n"), i.cast("string")).alias("note_id"), F.concat(F.lit("new/"), (i + 3).cast("string"), F.lit(".md")).alias("path"))
    keys = held.select(F.concat_ws(" ", "lang", (i % 50).cast("string")).alias("key"))
    judged = changes.judged_additions(fresh, notes, keys, identity.identity_key_ascii)
    return judged.select(F.regexp_extract("note_id", "[0-9]+$", 0).cast("long").alias("doc_id"), "code")


@query(
    """SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'not-found' WHEN event_id % 3 = 0 THEN 'target-missing' ELSE 'resolved' END AS outcome,
    CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'needs-review' ELSE 'resolved' END AS status,
    CASE WHEN event_id % 4 <> 0 THEN event_id % 5 + (event_id % 3 <> 0 AND event_id % 2 = 0)::BIGINT END AS attempts FROM events"""
)
def reverified_evidence(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("note_id"), (F.col("event_id") % 5).alias("attempts"))
    asked = e.select("id", (F.col("id") % 2 == 0).alias("retry"))
    return changes.reverified(e.where("id % 4 <> 0"), e.where("id % 3 <> 0").select("note_id", "id"), asked.union(asked)).select("id", "outcome", "status", "attempts")


_PLAN_OPS = ("CreateNote", "AppendSection", "SetLink", "CreateTask", "Unknown", "AddAlias", "CreateRelationship")
_PLANS = f"""p AS (SELECT event_id AS plan_id, ({list(_PLAN_OPS)})[event_id % 7 + 1] AS op, user_id AS target, event_id % 50 AS object, 'k' || (event_id % 40) AS alias, event_id % 3 = 0 AS bare, event_id % 5 = 0 AS untyped, event_id % 4 = 0 AS doubtful FROM events),
    f AS (SELECT plan_id, 'reserved-operation' AS code, 'error' AS severity FROM p WHERE op = 'CreateTask' UNION ALL SELECT plan_id, 'schema-invalid', 'error' FROM p WHERE op = 'Unknown'
    UNION ALL SELECT plan_id, 'path-policy-violation', 'error' FROM p WHERE op = 'CreateNote' AND untyped UNION ALL SELECT plan_id, 'missing-provenance', 'error' FROM p WHERE op IN ('CreateNote', 'AppendSection') AND bare
    UNION ALL SELECT plan_id, 'evidence-not-valid', 'gate' FROM p WHERE doubtful)"""
_HELD = "h AS (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey % 3 <> 0), k AS (SELECT c_custkey, 'k' || (c_custkey % 60) AS key FROM customer WHERE c_custkey % 3 <> 0)"


def _plans(spark, sf_dir) -> DataFrame:
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        i.alias("plan_id"),
        F.element_at(F.array(*map(F.lit, _PLAN_OPS)), (i % 7 + 1).cast("int")).alias("op"),
        F.col("user_id").cast("string").alias("target"),
        (i % 50).cast("string").alias("object"),
        F.concat(F.lit("K"), (i % 40).cast("string")).alias("alias"),
        F.when(i % 5 == 0, " ").otherwise("concept").alias("note_type"),
        F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("src"))).alias("sources"),
        F.when(i % 4 == 0, F.array(F.lit("valid"), F.lit("stale"))).otherwise(F.array(F.lit("valid"))).alias("evidence_states"),
    )


@query(f"WITH {_PLANS} SELECT plan_id, code, severity FROM f")
def plan_findings(spark, sf_dir) -> DataFrame:
    return changes.plan_findings(_plans(spark, sf_dir))


@query(
    f"""WITH {_PLANS}, {_HELD} SELECT DISTINCT plan_id, 'identity-collision' AS code FROM p LEFT JOIN k ON k.key = p.alias WHERE op = 'AddAlias' AND k.c_custkey <> target OR op = 'CreateNote' AND target IN (SELECT c_custkey FROM h)
    UNION ALL SELECT plan_id, 'dangling-note' FROM p WHERE op IN ('AppendSection', 'SetLink', 'AddAlias', 'CreateRelationship') AND (target NOT IN (SELECT c_custkey FROM h) OR op = 'CreateRelationship' AND object NOT IN (SELECT c_custkey FROM h))"""
)
def plan_target_findings(spark, sf_dir) -> DataFrame:
    held = read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    notes = held.select(F.col("c_custkey").cast("string").alias("note_id"))
    keys = held.select(F.concat(F.lit("k"), (F.col("c_custkey") % 60).cast("string")).alias("key"), F.col("c_custkey").cast("string").alias("note_id"))
    return changes.target_findings(_plans(spark, sf_dir), notes, keys, identity.identity_key_ascii).select("plan_id", "code")


@query(
    f"""WITH {_PLANS}, {_HELD}, v AS (SELECT plan_id, NOT coalesce(bool_or(severity = 'error'), false) AS ok, NOT coalesce(bool_or(severity IS NOT NULL), false) AS unattended FROM p LEFT JOIN f USING (plan_id) GROUP BY plan_id)
    SELECT plan_id, ok, unattended, CASE WHEN NOT ok THEN 'refused' WHEN target NOT IN (SELECT c_custkey FROM h) THEN 'target-missing' WHEN plan_id % 6 = 0 THEN 'stale' ELSE 'ready' END AS outcome FROM p JOIN v USING (plan_id)"""
)
def grounded_plans(spark, sf_dir) -> DataFrame:
    """Plans by whether they may be applied to the notes that they were made from; every sixth was made from an older text."""
    p = _plans(spark, sf_dir)
    notes = read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("note_id"), F.lit("h").alias("content_hash"))
    verdicts = changes.plan_verdicts(p, changes.plan_findings(p))
    grounded = p.select("plan_id", F.col("target").alias("note_id"), F.when(F.col("plan_id") % 6 == 0, "g").otherwise("h").alias("grounded_hash"))
    return changes.applicable(grounded, verdicts, notes).join(verdicts, "plan_id").select("plan_id", "ok", "unattended", "outcome")


_SOURCES = "s AS (SELECT 'src_' || substr(sha256(url), 1, 16) AS id, CASE WHEN regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN 'url' ELSE 'file' END AS kind, url AS locator, min(page_id) AS added_at FROM pages GROUP BY url)"


def _sources(spark, sf_dir) -> DataFrame:
    fresh = read(spark, sf_dir, "pages").select(F.col("url").alias("locator"), F.lit(None).cast("string").alias("title"), F.col("page_id").alias("added_at"))
    return workflow.register_sources(fresh.where("false"), fresh)


@query(f"WITH {_SOURCES} SELECT id, kind, locator, added_at, row_number() OVER (ORDER BY added_at DESC, id)::BIGINT AS place FROM s ORDER BY added_at DESC, id LIMIT 30 OFFSET 10")
def sources_page(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    order = workflow.newest_first("added_at", "id")
    rows, _ = workflow.page(_sources(spark, sf_dir), order, 30, 10)
    return rows.select("id", "kind", "locator", "added_at", (F.row_number().over(Window.orderBy(*order)) + 10).cast("long").alias("place"))


@query(
    f"""WITH {_SOURCES}, h AS (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'src_' || substr(sha256(url), 1, 16) ELSE 'none-' || page_id END AS handle FROM pages)
    SELECT handle, s.id IS NOT NULL AS found, s.id, kind, locator, added_at FROM h LEFT JOIN s ON handle IN (s.id, s.locator)"""
)
def shown_sources(spark, sf_dir) -> DataFrame:
    named = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("src_"), F.substring(F.sha2("url", 256), 1, 16))).otherwise(F.concat(F.lit("none-"), F.col("page_id").cast("string")))
    return changes.shown_sources(_sources(spark, sf_dir), read(spark, sf_dir, "pages").select(named.alias("handle"))).select("handle", "found", "id", "kind", "locator", "added_at")


_EVIDENCE = "e AS (SELECT doc_id AS id, 'doc-' || (doc_id % 97) AS note_id, nullif(doc_id * 7 % 11, 3) AS created_at FROM labels)"


def _evidence_rows(spark, sf_dir) -> DataFrame:
    created = F.nullif(F.col("doc_id") * 7 % 11, F.lit(3).cast("long"))
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id") % 97).alias("note_id"), created.alias("created_at"))


def _placed(df, order, limit, offset) -> DataFrame:
    """A page of rows with their places in the whole order."""
    from pyspark.sql import Window

    rows, _ = workflow.page(df, order, limit, offset)
    return rows.withColumn("place", (F.row_number().over(Window.orderBy(*order)) + offset).cast("long"))


@query(f"WITH {_EVIDENCE} SELECT id, note_id, created_at, row_number() OVER (ORDER BY note_id, created_at NULLS FIRST, id)::BIGINT AS place FROM e QUALIFY place > 25 AND place <= 425")
def evidence_in_order(spark, sf_dir) -> DataFrame:
    """A page of evidence as projections list it."""
    return _placed(_evidence_rows(spark, sf_dir), workflow.evidence_order(), 400, 25)


@query(f"WITH {_EVIDENCE} SELECT id, note_id, created_at, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id)::BIGINT AS place FROM e QUALIFY place <= 500")
def evidence_review_page(spark, sf_dir) -> DataFrame:
    """The first page of evidence as it is reviewed, newest first."""
    return _placed(_evidence_rows(spark, sf_dir), workflow.newest_first("created_at", "id"), 500, 0)


# --- notes made of documents, and what is read from them ---------------------------------------------

#: A note file of each document: every ninth without frontmatter, every seventh of another version.
_RAW = "CASE WHEN doc_id % 9 = 0 THEN '' ELSE '---' || chr(10) || 'id: doc-' || doc_id || chr(10) || 'type: ' || source || chr(10) || 'schema_version: ' || CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END || chr(10) || 'title: Note ' || doc_id || chr(10) || 'created: 2026-01-01' || chr(10) || 'updated: 2026-02-03' || chr(10) || 'aliases: [' || lang || '-' || doc_id || ']' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN 'evidence: [{id: e' || doc_id || ', status: failed, attempts: 2}]' || chr(10) ELSE '' END || '---' || chr(10) END || text || chr(10) || '[[doc-' || (doc_id + 1) || '|next]] [[nowhere]]'"
_NOTE_FILES = f"f AS (SELECT doc_id, source, lang, text, {_RAW} AS raw, CASE WHEN doc_id % 9 = 0 THEN 'missing-frontmatter' WHEN doc_id % 7 = 0 THEN 'unsupported-schema-version' END AS error FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, 'xx') AS lang, coalesce(source, 'none') AS source FROM documents) WHERE NOT starts_with(text, '---'))"


def _note_files(spark, sf_dir) -> DataFrame:
    """documents as files of a vault; one whose text begins like frontmatter is left to itself."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("xx")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source")).where("not startswith(text, '---')")
    i = F.col("doc_id").cast("string")
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("\n"))
    head = F.concat(
        line("---"), line("id: doc-", i), line("type: ", F.col("source")), line("schema_version: ", F.when(F.col("doc_id") % 7 == 0, "2").otherwise("1")), line("title: Note ", i), line("created: 2026-01-01"), line("updated: 2026-02-03"),
        line("aliases: [", F.col("lang"), "-", i, "]"), F.when(F.col("doc_id") % 4 == 0, line("evidence: [{id: e", i, ", status: failed, attempts: 2}]")).otherwise(""), line("---"),
    )
    raw = F.concat(F.when(F.col("doc_id") % 9 == 0, "").otherwise(head), "text", F.lit("\n[[doc-"), (F.col("doc_id") + 1).cast("string"), F.lit("|next]] [[nowhere]]"))
    return d.select(F.concat("source", F.lit("/"), i, F.lit(".md")).alias("path"), raw.cast("binary").alias("content"), F.length(raw.cast("binary")).cast("long").alias("length"))


def _parsed(spark, sf_dir) -> DataFrame:
    return vault.parse_notes(_note_files(spark, sf_dir))


@query(
    f"""WITH {_NOTE_FILES} SELECT source || '/' || doc_id || '.md' AS path, error AS error_kind, CASE WHEN error IS NULL THEN 'doc-' || doc_id END AS note_id, CASE WHEN error IS NULL THEN source END AS type, CASE WHEN error IS NULL THEN 'Note ' || doc_id END AS title,
    CASE WHEN error IS NULL THEN lang || '-' || doc_id END AS aliases, CASE WHEN error IS NULL THEN '2026-02-03' END AS updated, CASE WHEN error IS NULL THEN 'sha256:' || sha256(raw) END AS content_hash, sha256(raw) AS raw_sha256 FROM f"""
)
def parsed_notes(spark, sf_dir) -> DataFrame:
    """Every file as a note or as an error."""
    p = _parsed(spark, sf_dir)
    return p.select("path", "error_kind", "note_id", "type", "title", F.when(F.col("error_kind").isNull(), F.array_join("aliases", ",")).alias("aliases"), "updated", "content_hash", F.sha2("raw", 256).alias("raw_sha256"))


@query(f"WITH {_NOTE_FILES} SELECT coalesce(error, 'note') AS kind, count(*)::BIGINT AS files, count(DISTINCT source)::BIGINT AS types, sum(strlen(raw))::BIGINT AS bytes FROM f GROUP BY 1")
def vault_tally(spark, sf_dir) -> DataFrame:
    """Notes and errors of a vault, by kind."""
    sizes = _note_files(spark, sf_dir).select("path", "length")
    kinds = _parsed(spark, sf_dir).select("path", F.coalesce("error_kind", F.lit("note")).alias("kind"))
    return kinds.join(sizes, "path").groupBy("kind").agg(F.count("*").alias("files"), F.countDistinct(F.substring_index("path", "/", 1)).alias("types"), F.sum("length").alias("bytes"))


@query(f"WITH {_NOTE_FILES} SELECT 'e' || doc_id AS id, 'doc-' || doc_id AS note_id, 'sha256:' || sha256(raw) AS source_note_hash, 'failed' AS status, 2::BIGINT AS attempts FROM f WHERE error IS NULL AND doc_id % 4 = 0")
def folded_evidence(spark, sf_dir) -> DataFrame:
    """Evidence in the frontmatter of notes, with the hash of the note that it was read from."""
    e = workflow.fold_evidence(vault.snapshot(_parsed(spark, sf_dir))[0])
    return e.select("id", "note_id", "source_note_hash", "status", F.col("attempts").cast("long").alias("attempts"))


@query(
    f"""WITH {_NOTE_FILES}, n AS (SELECT doc_id, 'doc-' || doc_id AS note_id FROM f WHERE error IS NULL),
    l AS (SELECT n.note_id AS source, 'doc-' || (n.doc_id + 1) AS target FROM n JOIN n t ON t.doc_id = n.doc_id + 1)
    SELECT 'notes' AS "table", note_id AS k FROM n UNION ALL SELECT 'note_links', source || '>' || target FROM l UNION ALL SELECT 'note_identity_keys', 'doc-' || doc_id FROM n UNION ALL SELECT 'vault_schema_migrations', '1' FROM (SELECT count(*) AS c FROM n) WHERE c > 0"""
)
def rebuilt_projection(spark, sf_dir) -> DataFrame:
    """The tables of a whole rebuild that leaves out what it can't read and links that lead nowhere."""
    tables = commands.rebuild_projection(_parsed(spark, sf_dir), drop_colliders=True)
    one = lambda name, key: tables[name].select(F.lit(name).alias("table"), key.alias("k"))
    links = tables["note_links"].where(F.col("target").startswith("doc-"))
    ids = tables["note_identity_keys"].where("tier = 0").select(F.lit("note_identity_keys").alias("table"), F.col("key").alias("k"))
    out = one("notes", F.col("note_id")).unionByName(links.select(F.lit("note_links").alias("table"), F.concat_ws(">", "source", "target").alias("k")))
    return out.unionByName(ids).unionByName(one("vault_schema_migrations", F.col("schema_version").cast("string")))


@query(
    f"WITH {_NOTE_FILES} SELECT source || '/' || doc_id || '.md' AS note_id, 1::BIGINT AS findings FROM f WHERE error IS NOT NULL"
)
def vault_findings(spark, sf_dir) -> DataFrame:
    """How often validation names each file that is no note."""
    found = commands.validate(commands.derive(_parsed(spark, sf_dir)))
    return found.where("code in ('missing-frontmatter', 'unsupported-schema-version', 'duplicate-id')").groupBy(F.col("subject").alias("note_id")).agg(F.count("*").alias("findings"))


@query(
    f"""WITH {_NOTE_FILES}, n AS (SELECT 'doc-' || doc_id AS note_id, source || '/' || doc_id || '.md' AS path, 'sha256:' || sha256(raw) AS content_hash FROM f WHERE error IS NULL) SELECT note_id, path, content_hash FROM n"""
)
def synced_notes(spark, sf_dir) -> DataFrame:
    """The notes table after a sync from an older state: some were edited, some moved, some are new or gone."""
    v = commands.derive(_parsed(spark, sf_dir))
    d = read(spark, sf_dir, "documents")
    old = v.notes.select("note_id", "path", "content_hash").join(d.select(F.concat(F.lit("doc-"), "doc_id").alias("note_id"), "doc_id"), "note_id")
    old = old.where("doc_id % 5 <> 1").select("note_id", F.when(F.col("doc_id") % 5 == 2, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 5 == 3, "sha256:old").otherwise(F.col("content_hash")).alias("content_hash"))
    gone = d.where("doc_id % 7 = 0").select(F.concat(F.lit("gone-"), "doc_id").alias("note_id"), F.lit("x.md").alias("path"), F.lit("sha256:x").alias("content_hash"))
    return commands.sync(old.unionByName(gone), v)[1]


@query(
    """WITH c AS (SELECT click_id, props, CASE WHEN json_valid(props) THEN props END AS p FROM clicks),
    t AS (SELECT click_id, CASE WHEN p IS NOT NULL THEN '{' || concat_ws(',', '"device":' || json_extract(p, '$.device')::VARCHAR,
        CASE WHEN json_extract(p, '$.items') IS NOT NULL THEN '"items":[' || array_to_string(list_transform(json_extract(p, '$.items[*]'), lambda x: '{"qty":' || json_extract(x, '$.qty')::VARCHAR || ',"sku":' || json_extract(x, '$.sku')::VARCHAR || '}'), ',') || ']' END,
        '"k":' || json_extract(p, '$.k')::VARCHAR, '"tags":' || json_extract(p, '$.tags')::VARCHAR) || '}' END AS canonical FROM c)
    SELECT click_id, canonical IS NOT NULL AS has_form, sha256(canonical) AS payload_sha256 FROM t"""
)
def payload_hashes(spark, sf_dir) -> DataFrame:
    """Digests of the canonical form of every click's payload; a broken one has none."""
    form = hashing.canonical(F.col("props"))
    return read(spark, sf_dir, "clicks").select("click_id", form.isNotNull().alias("has_form"), hashing.payload_hash(form).alias("payload_sha256"))


@query("SELECT DISTINCT lang, source, sha256('{\"chunkerVersion\":1,\"embeddingDimensions\":64,\"embeddingModel\":\"' || lang || '/' || source || '\"}') AS config_key FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def config_keys(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("lang is not null and source is not null").select("lang", "source").distinct()
    return d.select("lang", "source", hashing.config_key(F.concat_ws("/", "lang", "source"), F.lit(64), F.lit(1)).alias("config_key"))


@query("SELECT doc_id, sha256(regexp_replace(' ' || chr(9) || chr(160) || text || chr(10), '^[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$', '', 'g')) AS value_hash FROM documents")
def frontmatter_value_hashes(spark, sf_dir) -> DataFrame:
    value = F.concat(F.lit(" \t\u00a0"), "text", F.lit("\n"))
    return read(spark, sf_dir, "documents").select("doc_id", hashing.frontmatter_value_hash(value).alias("value_hash"))


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(chr(10) || '  ' || chr(10) || text || chr(10) || ' ' || chr(10), '^([ \\t\\x0B\\f\\r\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]*\\n)+', ''), '(\\n[ \\t\\x0B\\f\\r\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]*)+$|^\\s+$', '')) AS body_sha256 FROM documents")
def normalized_bodies(spark, sf_dir) -> DataFrame:
    from tessera.functions.text import normalize_body

    body = F.concat(F.lit("\n  \n"), "text", F.lit("\n \n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(normalize_body(body), 256).alias("body_sha256"))


#: Some number of stored links that a task holds, the blocks that sources are dealt in, and the most sources that are broadcast.
_LINKS_A_TASK, _BLOCKS, _BROADCAST = 1 << 18, 16, 1 << 20


@query(
    """WITH e AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS target, CASE WHEN l_partkey % 3 = 0 THEN 'supplies' END AS predicate FROM lineitem),
    a AS (SELECT ps.s AS source, ps.p AS target, CASE WHEN ps.p % 2 = 0 THEN 'supplies' END AS predicate, CASE WHEN ps.p % 5 = 0 THEN 'other' END AS alias, ps.p % 7 = 0 AS remove FROM (SELECT s_suppkey AS s, p_partkey AS p FROM part JOIN supplier ON s_suppkey % 25 = p_partkey % 25) ps)
    SELECT a.source, a.target, a.predicate, CASE WHEN a.remove THEN CASE WHEN e.source IS NOT NULL THEN 'removed' ELSE 'noop' END WHEN e.source IS NULL THEN CASE WHEN a.predicate IS NULL THEN 'added' ELSE 'related' END
        WHEN a.alias IS NULL THEN 'noop' ELSE 'updated' END AS change FROM a LEFT JOIN e ON e.source = a.source AND e.target = a.target AND e.predicate IS NOT DISTINCT FROM a.predicate"""
)
def link_requests(spark, sf_dir) -> DataFrame:
    """What each request to link a part and a supplier would change."""
    p, s, x = (read(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    # Requests are made where the stored links of their targets are: there are many more of them than of what they are made of.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), x.count() // _LINKS_A_TASK + 1)
    block = lambda key: F.pmod(F.xxhash64(key), F.lit(_BLOCKS)).cast("int").alias("block")
    stored = x.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).distinct()
    stored = stored.select("source", "target", F.when(F.col("target") % 3 == 0, "supplies").alias("predicate"), F.lit(None).cast("string").alias("alias"), block(F.col("source"))).repartition(n, "target", "block")
    parts = p.select(F.col("p_partkey").alias("target"), F.explode(F.sequence(F.lit(0), F.lit(_BLOCKS - 1))).alias("block")).repartition(n, "target", "block")
    suppliers = s.select(F.col("s_suppkey").alias("source"), block(F.col("s_suppkey")).alias("of"))
    suppliers = F.broadcast(suppliers) if s.count() <= _BROADCAST else suppliers
    asked = parts.join(suppliers, (F.col("source") % 25 == F.col("target") % 25) & (F.col("of") == F.col("block"))).select(
        "source", "target", F.when(F.col("target") % 2 == 0, "supplies").alias("predicate"), F.when(F.col("target") % 5 == 0, "other").alias("alias"), (F.col("target") % 7 == 0).alias("remove"), "block"
    )
    return graph.classify_link(stored, asked, ("target", "block"))


@query(f"WITH {_JOBS}, q AS (SELECT workflow, job_id % 50 AS k FROM j WHERE job_id % 4 = 0), f AS (SELECT workflow, job_id % 70 AS k, min(job_id) AS job_id FROM j WHERE job_id % 4 <> 0 GROUP BY ALL) SELECT workflow, k::VARCHAR AS idempotency_key, job_id FROM f WHERE (workflow, k) NOT IN (SELECT workflow, k FROM q)")
def enqueued_jobs(spark, sf_dir) -> DataFrame:
    """Jobs to append to a queue that has some of their keys already."""
    j = adapters.jobs(spark, sf_dir)
    queued = j.where("job_id % 4 = 0").select("workflow", (F.col("job_id") % 50).cast("string").alias("idempotency_key"))
    fresh = j.where("job_id % 4 <> 0").select("workflow", (F.col("job_id") % 70).cast("string").alias("idempotency_key"), "job_id")
    return workflow.enqueue(queued, fresh)


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_chunks(spark, sf_dir) -> DataFrame:
    expected = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return maintenance.missing_chunks(expected, read(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")))


@query(
    f"""WITH {_LAYERS}, r AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM layers GROUP BY doc_id) SELECT 'r-1' AS retrieval_id, row_number() OVER (ORDER BY round(s, 12) DESC, doc_id)::BIGINT AS rank, doc_id AS note_id, round(s, 9) AS score FROM r"""
)
def retrieval_provenance(spark, sf_dir) -> DataFrame:
    """The record of one retrieval: each note that it gave, in order."""
    fused = retrieval.fuse(retrieval.fold(_layers(spark, sf_dir)))
    return retrieval.provenance(fused, "r-1").select("retrieval_id", F.col("rank").cast("long").alias("rank"), "note_id", F.round("score", 9).alias("score"))


@query(
    f"""WITH {_FTS}, b AS (SELECT rank, '[[' || doc_id || ']]' || chr(10) || coalesce(text, '') AS t FROM fts JOIN documents USING (doc_id))
    SELECT sha256('Answer from the context alone and cite notes as [[id]].' || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: who?') AS prompt_sha256 FROM b"""
)
def answer_prompts(spark, sf_dir) -> DataFrame:
    """The prompt over the whole texts of the best notes."""
    ranked = retrieval.rank_chunks(_scored_documents(spark, sf_dir), 10, False).where("rank <= 10").select(F.col("note_id").alias("doc_id"), F.col("rank").alias("item_rank"))
    context = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ranked), "doc_id")  # ten rows
    prompt = retrieval.answer_prompt("who?", context.select(F.col("doc_id").cast("string").alias("note_id"), "item_rank", F.lit(1).alias("section_rank"), "text"))
    return prompt.select(F.sha2("prompt", 256).alias("prompt_sha256"))


#: Bodies with headings around the text of each document, from which marks of headings and fences are taken.
_PLAIN = "nfc_normalize(translate(coalesce(text, ''), '#`~' || chr(13), ''))"
_TRIMMED = "regexp_replace(regexp_replace({}, '^([ \\t\\x0B\\f\\r\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]*\\n)+', ''), '(\\n[ \\t\\x0B\\f\\r\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]*)+$|^\\s+$', '')"
_TAIL = "\n\n## Sub 50%/x\nwords\n### Deep\n## Sub 50%/x\n\nmore\n\n# Part A\n```\n# no heading\n```\n"


def _outlined(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.translate(F.coalesce("text", F.lit("")), "#`~\r", "").alias("t"))
    i = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("---\nid: doc-"), i, F.lit("\ntype: t\nschema_version: 1\ntitle: Note "), i, F.lit("\ncreated: 2026-01-01\nupdated: 2026-01-01\naliases: [Alias "), i, F.lit("]\n---\n"), "t", F.lit("\n# Part A ##\n\n"), "t", F.lit(_TAIL))
    return vault.parse_notes(d.select(F.concat(i, F.lit(".md")).alias("path"), raw.cast("binary").alias("content")))


@query(
    """SELECT 'doc-' || doc_id AS note_id, s.ord::BIGINT AS ord, s.level::BIGINT AS level, s.heading, s.path FROM documents, (VALUES (0, 1, 'Part A', 'Part A'), (1, 2, 'Sub 50%/x', 'Part A/Sub 50%25%2Fx'), (2, 3, 'Deep', 'Part A/Sub 50%25%2Fx/Deep'), (3, 2, 'Sub 50%/x', 'Part A/Sub 50%25%2Fx-2'), (4, 1, 'Part A', 'Part A-2')) s(ord, level, heading, path)"""
)
def note_sections(spark, sf_dir) -> DataFrame:
    """The sections of every note: paths of equal siblings told apart, nothing found inside a fence."""
    s = _outlined(spark, sf_dir).select("note_id", F.explode("sections").alias("s"))
    return s.select("note_id", F.col("s.ord").cast("long").alias("ord"), F.col("s.level").cast("long").alias("level"), "s.heading", "s.path")


@query(
    f"""WITH t AS (SELECT doc_id, {_TRIMMED.format(_PLAIN)} AS body FROM documents),
    c AS (SELECT doc_id, '' AS path, '' AS crumb, body FROM t UNION ALL SELECT doc_id, 'Part A', 'Part A', body FROM t
        UNION ALL SELECT doc_id, 'Part A/Sub 50%25%2Fx', 'Part A › Sub 50%/x', 'words' FROM t UNION ALL SELECT doc_id, 'Part A/Sub 50%25%2Fx-2', 'Part A › Sub 50%/x', 'more' FROM t
        UNION ALL SELECT doc_id, 'Part A-2', 'Part A', '```' || chr(10) || '# no heading' || chr(10) || '```' FROM t)
    SELECT 'doc-' || doc_id AS note_id, path AS section_path, sha256(CASE WHEN crumb = '' THEN '' ELSE crumb || chr(10) || chr(10) END || 'Note ' || doc_id || chr(10) || 'Alias ' || doc_id || chr(10) || chr(10) || body) AS text_sha256 FROM c WHERE body <> ''"""
)
def note_chunks(spark, sf_dir) -> DataFrame:
    """The chunks of every note: heading path, names and own prose; sections without prose have none."""
    return vault.chunk_notes(_outlined(spark, sf_dir)).select("note_id", "section_path", F.sha2("text", 256).alias("text_sha256"))


@query(
    """WITH f AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id || '.txt' AS path,
    CASE WHEN doc_id % 5 = 4 THEN 'unsupported-encoding' WHEN t = '' THEN 'no-extractable-text' END AS reject_code, CASE WHEN doc_id % 5 <> 4 AND t <> '' THEN 'sha256:' || sha256(t) END AS text_hash FROM f"""
)
def decoded_files(spark, sf_dir) -> DataFrame:
    """Texts of files in UTF-8 with and without a mark, in both orders of UTF-16, and with a byte that is neither."""
    from tessera.sources import normalize

    t, n = F.coalesce("text", F.lit("")), F.col("doc_id") % 5
    mark = lambda h: F.unhex(F.lit(h))
    content = (
        F.when(n == 0, F.encode(t, "UTF-8")).when(n == 1, F.concat(mark("EFBBBF"), F.encode(t, "UTF-8"))).when(n == 2, F.concat(mark("FFFE"), F.encode(t, "UTF-16LE"))).when(n == 3, F.concat(mark("FEFF"), F.encode(t, "UTF-16BE"))).otherwise(F.concat(F.encode(t, "UTF-8"), mark("FF")))
    )
    files = read(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("path"), content.alias("content"))
    return normalize.normalize(files).select("path", "reject_code", "text_hash")


@query(
    """WITH f AS (SELECT doc_id || (['.md', '.txt', '.pdf', '.html', '.TXT'])[doc_id % 5 + 1] AS path, strlen(coalesce(text, '')) * 4000 AS length, ([5, 5, 50, 10, 5])[doc_id % 5 + 1] * 1048576 AS most FROM documents)
    SELECT path, length::BIGINT AS length, length <= most AS readable FROM f"""
)
def readable_files(spark, sf_dir) -> DataFrame:
    """Which files of a listing are read at all, by their formats' limits."""
    from tessera.sources import normalize

    ext = F.element_at(F.array(*map(F.lit, (".md", ".txt", ".pdf", ".html", ".TXT"))), (F.col("doc_id") % 5 + 1).cast("int"))
    files = read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), ext).alias("path"), (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * 4000).alias("length"))
    small, large = normalize.within_limits(files)
    return small.select("path", "length", F.lit(True).alias("readable")).unionByName(large.select("path", "length", F.lit(False).alias("readable")))


@query(
    f"""WITH docs AS (SELECT 'doc-' || doc_id AS id, text, embedding FROM documents JOIN embeddings ON vec_id = doc_id),
    t AS (SELECT id, list_filter(string_split_regex(strip_accents(lower(coalesce(text, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND w NOT IN ({_STOP})) AS terms FROM docs),
    s AS (SELECT count(*) AS n, avg(len(terms)) AS mean_length FROM t),
    p AS (SELECT id, len(terms) AS length, regexp_extract(unnest(terms), '^{_FORMS}$', 1) AS word FROM t),
    f AS (SELECT id, length, regexp_extract(word, '^(worthless|clown|idiot)', 1) AS term, count(*) AS tf FROM p WHERE word <> '' GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    score AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length))), 9) AS relevance FROM f JOIN df USING (term), s GROUP BY id),
    fts AS (SELECT id, row_number() OVER (ORDER BY relevance DESC, id) AS rank FROM score ORDER BY relevance DESC, id LIMIT 10),
    vec AS (SELECT id, row_number() OVER (ORDER BY d, id) AS rank FROM (SELECT id, {_DISTANCE} AS d FROM docs) ORDER BY d, id LIMIT 10),
    l AS (SELECT 'fts' AS layer, id, 1.0::DOUBLE / (60 + rank) AS part FROM fts UNION ALL SELECT 'vector', id, 1.0::DOUBLE / (60 + rank) FROM vec),
    u AS (SELECT id, sum(part) AS score, count(*) AS n, arg_max(layer, part * 2 + CASE WHEN layer = 'fts' THEN 1e-9 ELSE 0 END) AS channel, min(layer) AS only_layer FROM l GROUP BY id)
    SELECT id AS note_id, row_number() OVER (ORDER BY round(score, 12) DESC, id)::BIGINT AS rank, round(score, 9) AS score, channel, CASE WHEN n > 1 THEN 'hybrid' ELSE only_layer END AS mode FROM u QUALIFY rank <= 10"""
)
def retrieved_notes(spark, sf_dir) -> DataFrame:
    """A question through the command: no note has its name, so both layers rank, fuse and say who found what."""
    e, q = _vectors(spark, sf_dir)
    n = adapters.notes(spark, sf_dir)
    keys = n.select(F.lit(0).alias("tier"), F.col("note_id").alias("key"), "note_id")
    held = commands.Vault(n, n.where("false"), keys, n.where("false"), n.where("false"))
    chunks = n.join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select("note_id", F.col("note_id").alias("chunk_id"), F.lit("").alias("section_path"), "text", "embedding")
    found = commands.retrieve(held, chunks, " ".join(TERMS), embedder=lambda texts: [q])
    return found.select("note_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), "channel", "mode")


@query(
    f"""WITH {_NOTE_FILES}, {_JOBS} SELECT (SELECT count(*) FROM f WHERE error IS NULL)::BIGINT AS notes, (SELECT count(*) FROM f WHERE error IS NOT NULL)::BIGINT AS errors,
    (SELECT count(*) FROM f WHERE error IS NULL AND doc_id % 11 <> 0 AND doc_id % 5 = 0)::BIGINT AS stale_notes, (SELECT count(*) FROM f WHERE error IS NULL AND doc_id % 11 = 0)::BIGINT AS missing_notes,
    (SELECT count(*) FROM embeddings)::BIGINT AS chunks, (SELECT count(*) FROM j WHERE state = 'pending')::BIGINT AS pending_jobs, (SELECT count(*) FROM labels WHERE quality IS DISTINCT FROM 1)::BIGINT AS open_evidence, false AS ok"""
)
def vault_status(spark, sf_dir) -> DataFrame:
    """One row of what there is and what needs work."""
    v = commands.derive(_parsed(spark, sf_dir))
    n = F.substring_index("note_id", "-", -1).cast("long")
    active = F.when(n % 11 != 0, F.when(n % 5 == 0, "old").otherwise(F.col("generation_id")))
    notes = commands.expected_generations(v.notes).withColumn("active_generation_id", active)
    evidence = read(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "resolved").otherwise("failed").alias("status"))
    return commands.status(v, notes, read(spark, sf_dir, "embeddings"), adapters.jobs(spark, sf_dir), evidence)


#: The pads of an HMAC with the key "salt": it, filled with zeros to 64 bytes, against 0x36 and 0x5c.
_PADS = ["".join(f"{b ^ x:02x}" for b in b"salt".ljust(64, b"\0")) for x in (0x36, 0x5C)]


@query(f"SELECT doc_id, 'n_' || substr(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode('doc-' || doc_id)))), 1, 16) AS opaque FROM documents")
def opaque_ids(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("note_id"))
    return d.select("doc_id", identity.opaque_id(F.col("note_id"), "salt").alias("opaque"))


@query("SELECT 'current' AS flag, count(*)::BIGINT AS rows FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 1")
def current_configs(spark, sf_dir) -> DataFrame:
    """Of configurations of which one may be current, those that are."""
    from tessera.operators import validation

    configs = read(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "P").alias("is_current"))
    return validation.several_current(configs).select("flag", "rows")


def _pdf_of(line) -> tuple:
    """(objects, table of their places, end) of a PDF of one page that shows a line of ASCII letters and digits."""
    content = F.concat(F.lit("BT /F1 12 Tf ("), line, F.lit(") Tj ET"))
    objects = [
        F.lit("1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"),
        F.lit("2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n"),
        F.lit("3 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>\nendobj\n"),
        F.concat(F.lit("4 0 obj\n<< /Length "), F.length(content).cast("string"), F.lit(" >>\nstream\n"), content, F.lit("\nendstream\nendobj\n")),
        F.lit("5 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>\nendobj\n"),
    ]
    at, places = F.lit(9), []
    for o in objects:
        places.append(F.concat(F.lpad(at.cast("string"), 10, "0"), F.lit(" 00000 n \n")))
        at = at + F.length(o)
    return objects, places, at


@query(
    """WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS line FROM documents)
    SELECT doc_id || '.pdf' AS path, CASE WHEN doc_id % 6 = 5 THEN 'encrypted-source' WHEN line = '' THEN 'no-extractable-text' END AS reject_code, CASE WHEN doc_id % 6 <> 5 AND line <> '' THEN 'sha256:' || sha256(line) END AS text_hash FROM f"""
)
def pdf_texts(spark, sf_dir) -> DataFrame:
    """The letters and digits of every document as a PDF and back; every sixth is encrypted."""
    from tessera.sources import normalize

    line = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))
    objects, places, end = _pdf_of(F.col("line"))
    locked = F.when(F.col("doc_id") % 6 == 5, " /Encrypt 9 0 R").otherwise("")
    tail = F.concat(F.lit("xref\n0 6\n0000000000 65535 f \n"), *places, F.lit("trailer\n<< /Size 6 /Root 1 0 R"), locked, F.lit(" >>\nstartxref\n"), end.cast("string"), F.lit("\n%%EOF\n"))
    files = read(spark, sf_dir, "documents").select("doc_id", line.alias("line")).select(F.concat("doc_id", F.lit(".pdf")).alias("path"), F.concat(F.lit("%PDF-1.4\n"), *objects, tail).cast("binary").alias("content"))
    return normalize.normalize(files).select("path", "reject_code", "text_hash")


@query("SELECT l_orderkey AS run_id, max(l_linenumber)::BIGINT AS created_at, arg_max(l_partkey, l_linenumber * 10000000 + l_partkey)::BIGINT AS patch_id FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def latest_plan_patches(spark, sf_dir) -> DataFrame:
    """Each run's newest patch of those whose plan is known: lines as patches, those of known parts as plans."""
    x = read(spark, sf_dir, "lineitem")
    plan = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey")
    patches = x.select(F.col("l_partkey").alias("patch_id"), plan.alias("plan_id"), F.col("l_linenumber").alias("created_at"))
    plans = x.join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey").select(plan.alias("plan_id"), F.col("l_orderkey").alias("run_id")).distinct()
    return workflow.latest_plans(patches, plans).select("run_id", F.col("created_at").cast("long").alias("created_at"), F.col("patch_id").cast("long").alias("patch_id"))


@query(
    """SELECT conv_id, turn, CASE WHEN conv_id = conv_id * 7 + turn THEN 'doc-' || conv_id ELSE 'doc-' || (conv_id * 7 + turn) || ',doc-' || conv_id END AS cited FROM conversations WHERE text IS NULL OR NOT contains(text, '[[')
    UNION ALL SELECT conv_id, turn, '' FROM conversations WHERE contains(text, '[[')"""
)
def answer_citations(spark, sf_dir) -> DataFrame:
    """What each answer cites of what was retrieved, once each, in order."""
    c, n = read(spark, sf_dir, "conversations"), F.col("conv_id") * 7 + F.col("turn")
    one, two = F.concat(F.lit("doc-"), n.cast("string")), F.concat(F.lit("doc-"), F.col("conv_id").cast("string"))
    answer = F.concat(F.coalesce("text", F.lit("")), F.lit(" [["), one, F.lit("]] [[ "), two, F.lit(" ]] [[nope]] [["), one, F.lit("]]"))
    cited = F.array_join(text.citations(answer, F.array(F.lit("other"), two, one)), ",")
    return c.select("conv_id", "turn", F.when(F.coalesce("text", F.lit("")).contains("[["), "").otherwise(cited).alias("cited"))


_CLEAN = "regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B-\\x1F\\x7F\\x{80}-\\x{9F}\\x{061C}\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]', '', 'g')"


@query(f"SELECT conv_id, turn, md5({_CLEAN}) AS digest FROM conversations")
def sanitized_controls(spark, sf_dir) -> DataFrame:
    """Texts between commands to a terminal: titles, links, colours in one byte and two, resets and overrides of direction."""
    raw = F.concat(F.lit("\x1b]0;title\x07\x9b31m"), F.coalesce("text", F.lit("")), F.lit("\x1bM\x85\u202e\x1b]8;;http://x\x1b\\\x9d52;c;eA==\x9c\x1b(B\x1b[?25l\u2066"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.sanitize_terminal(raw)).alias("digest"))


_SPACES = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


@query(
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '{_SPACES}', ' ', 'g'))), lambda x: x <> '') AS lines FROM documents)
    SELECT doc_id || '.html' AS path, 'sha256:' || sha256(array_to_string(list_concat(['Doc ' || doc_id], list_concat(lines, ['a < b & c', 'pic ' || doc_id])), chr(10))) AS text_hash, 'image-no-alt@dom:/html[1]/body[1]/div[1]/img[2]' AS gaps FROM l"""
)
def html_renditions(spark, sf_dir) -> DataFrame:
    """The lines of every document as paragraphs of a page with scripts, references, unclosed elements and images, and back."""
    from tessera.sources import normalize

    i = F.col("doc_id").cast("string")
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("é"), F.lit("&#xE9;"))
    body = F.concat(F.lit("<p>"), F.replace(safe, F.lit("\n"), F.lit("<p><span>")))
    page = F.concat(
        F.lit("<!DOCTYPE html><html><head><meta charset=utf-8><script>var a = '<p>no</p>';</script><style>p {}</style></head><body><h1>Doc "), i, F.lit("</h1>\n<!-- <p>no --><template><p>no</template>"), body,
        F.lit("<table><tr><td>a &lt; b &amp;   c</table><div><img alt='pic "), i, F.lit("'><img src=\"a>b\"></div></body></html>"),
    )
    files = read(spark, sf_dir, "documents").select(F.concat(i, F.lit(".html")).alias("path"), page.cast("binary").alias("content"))
    out = normalize.normalize(files)
    return out.select("path", "text_hash", F.array_join(F.transform("gaps", lambda g: F.concat_ws("@", g["kind"], g["locator"])), ",").alias("gaps"))


_TYPED = "e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b, CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_returnflag = 'A' THEN 'kept' END AS predicate FROM lineitem)"


def _typed_edges(spark, sf_dir) -> DataFrame:
    x = read(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_returnflag") == "A", "kept")
    return x.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), kind.alias("predicate")).distinct()


@query(f"WITH {_TYPED} SELECT a AS note_id, b AS target, CASE WHEN predicate IS NULL THEN 'link' ELSE 'typed' END AS via, predicate FROM e UNION ALL SELECT b, a, 'backlink', predicate FROM e")
def typed_links(spark, sf_dir) -> DataFrame:
    """Both directions of plain and typed edges."""
    return graph.neighbours(_typed_edges(spark, sf_dir))


@query(
    f"""WITH {_TYPED}, seeds AS (SELECT 's' || min(s_suppkey) AS seed FROM supplier GROUP BY s_nationkey),
    s AS (SELECT a, b, CASE WHEN predicate IS NULL THEN 2 ELSE 1 END AS r FROM e UNION ALL SELECT b, a, 3 FROM e),
    d1 AS (SELECT seed, b AS note_id, a AS from_id, min(r) AS r FROM seeds JOIN s ON s.a = seed GROUP BY ALL),
    n2 AS (SELECT seed, s.b AS note_id, min(struct_pack(f := s.a, r := s.r)) AS o FROM d1 JOIN s ON s.a = d1.note_id WHERE s.b <> seed GROUP BY ALL),
    d2 AS (SELECT seed, note_id, o.f AS from_id, o.r AS r FROM n2 WHERE (seed, note_id) NOT IN (SELECT seed, note_id FROM d1))
    SELECT seed, note_id, distance::BIGINT AS distance, from_id, (['typed', 'link', 'backlink'])[r] AS via FROM (SELECT 1 AS distance, * FROM d1 UNION ALL SELECT 2, * FROM d2)"""
)
def graph_related_typed(spark, sf_dir) -> DataFrame:
    """Two steps along typed edges before plain ones, from the first supplier of each nation."""
    seeds = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("s"), F.min("s_suppkey")).alias("seed"))
    found = graph.related_to_each(_typed_edges(spark, sf_dir), seeds, 2)
    return found.select("seed", "note_id", F.col("distance").cast("long").alias("distance"), "from_id", "via")
