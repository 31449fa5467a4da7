"""A vault of Markdown notes as tables: scan, frontmatter, parsed notes, chunks."""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.markdown import chunks as cut_chunks
from tessera.functions.markdown import sections, split_frontmatter, strip_code
from tessera.functions.text import WIKI_LINK, glob_pattern

SENSITIVITIES = ("public", "internal", "confidential", "restricted")
SUPPORTED_VERSION = 1

NOTE = """path string, error_kind string, error_message string, note_id string, type string, schema_version int, title string, status string,
created string, updated string, aliases array<string>, sources array<string>, sensitivity string,
related array<struct<target:string,predicate:string,alias:string>>, links array<struct<target:string,alias:string,raw:string>>,
sections array<struct<ord:int,level:int,heading:string,path:string,breadcrumb:array<string>,heading_start:int,body_start:int,own_end:int,body_end:int>>,
evidence array<struct<id:string,status:string,attempts:int,sectionPath:string>>, content_hash string, raw string"""

_NOTE_COLUMNS = [x.split()[0] for x in re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "", NOTE).split(",")]


def scan(spark: SparkSession, root: str, include: Sequence[str] = ("**/*.md",), exclude: Sequence[str] = ()) -> DataFrame:
    """``(path, content, length)`` of the files under a root whose relative path matches; dot files and folders are no part of a vault."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.substring_index("path", root.rstrip("/").split(":", 1)[-1] + "/", -1)
    files = files.withColumn("path", relative).where(~F.col("path").rlike(r"(^|/)\."))
    keep = F.lit(False)
    for glob in include:
        keep = keep | F.col("path").rlike(glob_pattern(glob))
    for glob in exclude:
        keep = keep & ~F.col("path").rlike(glob_pattern(glob))
    return files.where(keep).select("path", "content", "length")


def _date(value) -> str | None:
    if isinstance(value, datetime.datetime):
        return value.date().isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value if isinstance(value, str) and value else None


class Refused(ValueError):
    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind


#: Characters of blocks that both of PyYAML's parsers read alike (tests); no quotes, comments, anchors, tags or tabs.
_PLAIN_YAML = re.compile(r"[\w ./,:+=()\[\]{}\n-]*")


def _load_yaml(block: str):
    """yaml.safe_load(); a plain block is parsed by libyaml where that is there, and by Python where libyaml refuses it."""
    if hasattr(yaml, "CSafeLoader") and _PLAIN_YAML.fullmatch(block):
        try:
            return yaml.load(block, Loader=yaml.CSafeLoader)
        except yaml.YAMLError:
            pass
    return yaml.safe_load(block)


def parse_frontmatter(block: str | None) -> dict:
    """The checked fields of a frontmatter block; unknown ones are let through unread."""
    if block is None:
        raise Refused("missing-frontmatter", "no frontmatter block")
    try:
        doc = _load_yaml(block)
    except yaml.YAMLError as e:
        raise Refused("invalid-frontmatter", f"not YAML: {e}") from None
    if not isinstance(doc, dict):
        raise Refused("invalid-frontmatter", "not a mapping")
    out: dict = {}

    def need(ok: bool, name: str) -> None:
        if not ok:
            raise Refused("invalid-frontmatter", f"bad field {name}")

    for name in ("id", "type", "title"):
        need(isinstance(doc.get(name), str) and doc[name] != "", name)
        out[name] = doc[name]
    need(type(doc.get("schema_version")) is int, "schema_version")
    out["schema_version"] = doc["schema_version"]
    for name in ("created", "updated"):
        out[name] = _date(doc.get(name))
        need(out[name] is not None, name)
    out["status"] = doc.get("status", "active")
    need(isinstance(out["status"], str) and out["status"] != "", "status")
    for name in ("aliases", "sources", "data_categories"):
        out[name] = doc.get(name, [])
        need(isinstance(out[name], list) and all(isinstance(x, str) for x in out[name]), name)
    out["sensitivity"] = doc.get("declaredSensitivity", "internal")
    need(out["sensitivity"] in SENSITIVITIES, "declaredSensitivity")
    out["related"] = doc.get("related", [])
    need(isinstance(out["related"], list), "related")
    for r in out["related"]:
        need(isinstance(r, dict) and {"target", "predicate"} <= set(r) <= {"target", "predicate", "alias"} and all(isinstance(v, str) and v for v in r.values()), "related")
    out["evidence"] = [e for e in doc.get("evidence") or [] if isinstance(e, dict)]
    if out["schema_version"] != SUPPORTED_VERSION:
        raise Refused("unsupported-schema-version", f"schema_version {out['schema_version']}")
    return out


def parse_note(path: str, content: bytes) -> dict:
    """One row of NOTE: a note, or why there is none."""
    row = dict.fromkeys(_NOTE_COLUMNS)
    row["path"] = path
    try:
        raw = bytes(content).decode("utf-8")
    except UnicodeDecodeError as e:
        return row | {"error_kind": "read-error", "error_message": str(e)}
    block, body = split_frontmatter(raw)
    try:
        f = parse_frontmatter(block)
    except Refused as e:
        return row | {"error_kind": e.kind, "error_message": str(e), "raw": raw}
    links = [{"target": m[1].strip(), "alias": (m[2] or "").strip() or None, "raw": m[0]} for m in re.finditer(WIKI_LINK, strip_code(body))]
    evidence = [{"id": e.get("id"), "status": e.get("status"), "attempts": e.get("attempts"), "sectionPath": e.get("sectionPath")} for e in f["evidence"]]
    related = [{"target": r["target"], "predicate": r["predicate"], "alias": r.get("alias")} for r in f["related"]]
    fields = {k: f[k] for k in ("type", "schema_version", "title", "status", "created", "updated", "aliases", "sources", "sensitivity")}
    return row | fields | {"note_id": f["id"], "related": related, "links": links, "sections": sections(body), "evidence": evidence, "content_hash": "sha256:" + hashlib.sha256(raw.encode()).hexdigest(), "raw": raw}


def parse_notes(files: DataFrame) -> DataFrame:
    """NOTE rows of ``files(path, content)``; a file that is no note is a row with an error, never a failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([parse_note(p, c) for p, c in zip(b["path"], b["content"])])

    return files.select("path", "content").mapInPandas(run, NOTE)


def snapshot(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, errors) of parsed files."""
    return parsed.where("error_kind is null"), parsed.where("error_kind is not null").select("path", F.col("error_kind").alias("kind"), F.col("error_message").alias("message"))


def chunk_notes(notes: DataFrame) -> DataFrame:
    """``(note_id, section_path, ordinal, text, content_hash)`` of each section of each note that has prose."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, p, o, t, h) for n, h, raw, title, aliases in zip(b["note_id"], b["content_hash"], b["raw"], b["title"], b["aliases"]) for p, o, t in cut_chunks(raw, title, list(aliases if aliases is not None else []))]
            yield pd.DataFrame(rows, columns=["note_id", "section_path", "ordinal", "text", "content_hash"])

    return notes.select("note_id", "content_hash", "raw", "title", "aliases").mapInPandas(run, "note_id string, section_path string, ordinal int, text string, content_hash string")


def identity_keys(notes: DataFrame) -> DataFrame:
    """``(tier, key, note_id)``: exact ids, normalised slugs and normalised aliases."""
    from tessera.functions.identity import file_slug, identity_key

    ids = notes.select(F.lit(0).alias("tier"), F.col("note_id").alias("key"), "note_id")
    slugs = notes.select(F.lit(1).alias("tier"), identity_key(file_slug(F.col("path"))).alias("key"), "note_id")
    aliases = notes.select("note_id", F.explode("aliases").alias("a")).select(F.lit(2).alias("tier"), identity_key(F.col("a")).alias("key"), "note_id")
    return ids.unionByName(slugs).unionByName(aliases).where("key <> ''")


def note_links(notes: DataFrame) -> DataFrame:
    """Every body link and typed relationship: ``(source, target, predicate, alias, ord)``."""
    plain = notes.select(F.col("note_id").alias("source"), F.posexplode("links").alias("ord", "l")).select("source", "l.target", F.lit(None).cast("string").alias("predicate"), "l.alias", "ord")
    typed = notes.select(F.col("note_id").alias("source"), F.posexplode("related").alias("ord", "r")).select("source", "r.target", "r.predicate", "r.alias", "ord")
    return plain.unionByName(typed)


def read_eval_set(spark: SparkSession, queries: str, labels: str) -> tuple[DataFrame, DataFrame]:
    """``(query_id, text)`` and ``(query_id, note_id)`` of two JSON files; another version is an error."""
    q = spark.read.schema("version int, queries array<struct<id:string,text:string>>").json(queries, multiLine=True)
    x = spark.read.schema("version int, labels map<string,array<string>>").json(labels, multiLine=True)
    fail = lambda df: df.withColumn("version", F.when(F.col("version") == 1, 1).otherwise(F.raise_error(F.lit("version must be 1")).cast("int")))
    q = fail(q).where("version = 1").select(F.explode("queries").alias("q")).select(F.col("q.id").alias("query_id"), "q.text")
    x = fail(x).where("version = 1").select(F.explode("labels").alias("query_id", "ids")).select("query_id", F.explode("ids").alias("note_id"))
    return q, x


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are left out."""
    df.write.mode("overwrite").json(path)
