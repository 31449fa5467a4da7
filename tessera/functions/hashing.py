"""Content addresses: SHA-256 over canonical JSON, in the JVM wherever the shape is fixed."""

from __future__ import annotations

import json
import math
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_serialize(value) -> str:
    """JSON with keys in UTF-16 order, NFC strings and keys, no white space; what JSON can't hold is an error."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, str):
        return json.dumps(unicodedata.normalize("NFC", value), ensure_ascii=False)
    if isinstance(value, int):
        if abs(value) > 2**53:
            raise ValueError("integers beyond 2^53 have no canonical form")
        return str(value)
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("numbers must be finite")
        return str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_serialize, value)) + "]"
    if isinstance(value, dict):
        keys = {}
        for k, v in value.items():
            name = unicodedata.normalize("NFC", k)
            if name in keys:
                raise ValueError(f"two keys are {name!r} once normalised")
            keys[name] = v
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_serialize(keys[k])}" for k in sorted(keys, key=lambda k: k.encode("utf-16-be"))) + "}"
    raise TypeError(f"{type(value).__name__} has no canonical form")


@F.pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """The canonical form of JSON texts."""
    return s.map(lambda x: canonical_serialize(json.loads(x)), na_action="ignore")


#: Texts whose canonical form the JVM writes itself: no exponents, no long numbers, no tiny fractions, nothing that NFC could change.
_BEYOND = r"[0-9][eE]|[0-9.]{16,}|0\.000000|[\u0300-\x{10FFFF}]|\\u"


def _once(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key is given twice")
    return out


def _or_null(text: str) -> str | None:
    try:
        return canonical_serialize(json.loads(text, object_pairs_hook=_once))
    except (ValueError, RecursionError):
        return None


def canonical(text: Column) -> Column:
    """The canonical form of any JSON text, null for what has none: broken JSON, a key given twice, numbers out of range.

    A variant keeps an object's keys in the order of their UTF-16 units, so writing it out again
    is the canonical form, at any depth and without leaving the JVM. Only texts with numbers or
    characters that the two write differently go to Python.
    """

    @F.pandas_udf(StringType())
    def elsewhere(s: pd.Series) -> pd.Series:
        return s.map(_or_null, na_action="ignore")

    odd = text.rlike(_BEYOND)
    return F.coalesce(elsewhere(F.when(odd, text)), F.to_json(F.try_parse_json(F.when(~odd, text))))


def canonical_value(value: Column) -> Column:
    """The canonical form of a struct, array or map column, nested as it may be."""
    return canonical(F.to_json(F.to_variant_object(value)))


def digest_of(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON of an object of these fields, which must be NFC."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


def content_hash(raw: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(raw, 256))


def config_key(model: Column, dimensions: Column, version: Column) -> Column:
    return digest_of(chunkerVersion=version, embeddingDimensions=dimensions, embeddingModel=model)


def generation_id(note_id: Column, content: Column, model: Column, dimensions: Column, version: Column) -> Column:
    return digest_of(chunkerVersion=version, contentHash=content, embeddingDimensions=dimensions, embeddingModel=model, noteId=note_id)


def chunk_id(generation: Column, path: Column, ordinal: Column) -> Column:
    return digest_of(generationId=generation, ordinal=ordinal, sectionPath=path)


def section_content_hash(text: Column) -> Column:
    """Digest of a section without trailing blanks of lines and without blank lines at its ends."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return F.sha2(F.regexp_replace(F.array_join(lines, "\n"), r"\A\n+|\n+\z", ""), 256)


def frontmatter_value_hash(value: Column) -> Column:
    return F.sha2(F.regexp_replace(value, r"(?U)\A\s+|\s+\z", ""), 256)


def payload_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def backoff_delay(job_id: Column, attempt: Column, base: float = 1000.0, factor: float = 2.0, most: float = 300_000.0) -> Column:
    """Milliseconds to wait: a share, fixed by job and attempt, of a limit that doubles with each attempt."""
    share = F.conv(F.substring(F.sha2(F.concat_ws(":", job_id.cast("string"), attempt.cast("string")), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)
    limit = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(factor), attempt - 1))
    return F.floor(share * limit).cast("long")
