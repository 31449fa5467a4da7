"""Identity keys, slugs, handles and opaque ids."""

from __future__ import annotations

import hashlib
import hmac
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters whose full case folding is more than one character.
_EXPANDED = {ord(c): f for c in map(chr, range(sys.maxunicode + 1)) if len(f := c.casefold()) > 1}
_OTHER = re.compile(r"[\W_]+", re.UNICODE)


def _is_mark(c: str) -> bool:
    return unicodedata.category(c)[0] in "PS"


def normalize_identity_key(s: str | None) -> str | None:
    """NFC, full case folding, punctuation and symbols to spaces, white space runs to one space, trimmed."""
    if s is None:
        return None
    folded = unicodedata.normalize("NFC", s).translate(_EXPANDED).lower().replace("ς", "σ")
    plain = folded if folded.isalnum() else "".join(" " if _is_mark(c) else c for c in folded)
    return unicodedata.normalize("NFC", " ".join(plain.split()))


@F.pandas_udf(StringType())
def identity_key_full(s: pd.Series) -> pd.Series:
    return s.map(normalize_identity_key, na_action="ignore")


def identity_key_ascii(c: Column) -> Column:
    """The same key for ASCII text, without leaving the JVM."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\p{Punct}\s]+", " "))


def identity_key(c: Column) -> Column:
    """Native for ASCII text; only other text goes to Python."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), identity_key_ascii(c)).otherwise(identity_key_full(F.when(~c.rlike(r"^[\x00-\x7F]*$"), c)))


def file_slug(path: Column) -> Column:
    """The file's name without its .md, in whatever case."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?i)\.md$", "")


_HANDLE = r"^sha256:([0-9a-f]{64}):([^:]+)(?::(\d+):(\d+))?$"


def source_handle(c: Column) -> Column:
    """A handle's parts; three segments name content, five a rendition, anything else is null."""
    part = lambda i: F.regexp_extract(c, _HANDLE, i)
    kind = F.when(part(3) == "", "content").otherwise("rendition")
    number = lambda i: F.when(part(i) != "", part(i).cast("int"))
    return F.when(c.rlike(_HANDLE), F.struct(kind.alias("kind"), part(1).alias("digest"), part(2).alias("media"), number(3).alias("extractor_version"), number(4).alias("normalizer_version")))


def opaque_id(c: Column, salt: str, prefix: str = "n_") -> Column:
    """A salted 16-digit HMAC of an id, which keeps no trace of it."""
    key = salt.encode()

    @F.pandas_udf(StringType())
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda x: prefix + hmac.new(key, x.encode(), hashlib.sha256).hexdigest()[:16], na_action="ignore")

    return digest(c)


def source_id(locator: Column) -> Column:
    return F.concat(F.lit("src_"), F.substring(F.sha2(locator, 256), 1, 16))


_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(millis: int, entropy: bytes) -> str:
    """A run id: 48 bits of time and 80 of chance in Crockford's base 32."""
    value = (millis << 80) | int.from_bytes(entropy[:10], "big")
    return "".join(_CROCKFORD[(value >> 5 * i) & 31] for i in range(25, -1, -1))
