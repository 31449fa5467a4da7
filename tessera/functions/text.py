"""Text functions that need no parse tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What \s and trim() mean where white space is Unicode's.
SPACE = r"(?U)\s"


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: code points, and one more for each beyond the basic plane."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def estimate_tokens(c: Column) -> Column:
    return F.ceil(utf16_length(c) / 4).cast("long")


def compose_chunk_text(breadcrumb: Column, identity: Column, body: Column) -> Column:
    """The heading path, the identity block and the body, blank parts dropped, by blank lines."""
    return F.array_join(F.filter(F.array(breadcrumb, identity, body), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n")


def compose_breadcrumb(headings: Column) -> Column:
    return F.array_join(F.filter(F.transform(headings, lambda h: F.regexp_replace(h, r"(?U)^\s+|\s+$", "")), lambda h: h != ""), " › ")


def normalize_body(c: Column) -> Column:
    """Without blank lines at either end; inner blank lines and indentation stay."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\A(?:[^\S\n]*\n)+", ""), r"(?U)(?:\n[^\S\n]*)+\z|\A\s*\z", "")


def encode_segment(heading: Column) -> Column:
    """A heading as one segment of a section path."""
    return F.when(heading == "", F.lit("%00")).otherwise(F.replace(F.replace(heading, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")))


#: An ATX heading: indentation, level, text.
ATX = r"^( {0,3})(#{1,6})(?=[ \t]|$)"


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, else null."""
    return F.when(line.rlike(ATX), F.length(F.regexp_extract(line, ATX, 2)))


def heading_text(line: Column) -> Column:
    rest = F.regexp_replace(line, r"^ {0,3}#{1,6}", "")
    return F.regexp_replace(F.regexp_replace(rest, r"[ \t]+#+[ \t]*$", ""), r"(?U)^\s+|\s+$", "")


WIKI_LINK = r"\[\[([^\]\[\n|]+)(?:\|([^\]\[\n]+))?\]\]"


def wiki_links(text: Column) -> Column:
    """Links ``(target, alias, raw)`` of text from which code has been taken."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    zipped = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(WIKI_LINK), F.lit(i)).alias(n) for n, i in (("target", 1), ("alias", 2), ("raw", 0))))
    return F.transform(zipped, lambda x: F.struct(trim(x["target"]).alias("target"), F.nullif(trim(x["alias"]), F.lit("")).alias("alias"), x["raw"].alias("raw")))


def citations(answer: Column, retrieved: Column) -> Column:
    """Ids cited as [[id]] that were retrieved, once each, in order."""
    return F.array_distinct(F.array_intersect(F.regexp_extract_all(answer, F.lit(r"\[\[\s*([^\[\]]+?)\s*\]\]"), F.lit(1)), retrieved))


def error_class(kind: Column) -> Column:
    """transient, permanent or cancelled; what is unknown may pass."""
    return (
        F.when(kind.isin("abort", "aborted", "cancelled"), "cancelled")
        .when(kind.isin("validation", "auth", "authentication", "invalid-request", "bad-request", "permission"), "permanent")
        .otherwise("transient")
    )


def sanitize_terminal(c: Column) -> Column:
    """Text that can't steer a terminal: control sequences and bidirectional overrides go, tab and newline stay."""
    for pattern in (
        r"(?:\x1B\]|\x9D)[^\x07\x1B\x9C]*(?:\x07|\x1B\\|\x9C)?",  # operating system commands
        r"(?:\x1B\[|\x9B)[0-?]*[ -/]*[@-~]?",  # control sequences
        r"\x1B[ -/]*[0-~]?",  # other escapes
        r"[\x80-\x9F]",
        r"[\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]",
        r"[\x00-\x08\x0B-\x1F\x7F]",
    ):
        c = F.regexp_replace(c, pattern, "")
    return c


def map_sensitivity(declared: Column) -> Column:
    return F.when(declared == "public", "public").otherwise("internal")


def resolve_type(kind: Column, strict: tuple[str, ...] = ("concept", "person", "project", "source", "claim")) -> Column:
    return F.when(kind.isin(*strict), kind).otherwise("loose")


def media_alt(alt: Column) -> Column:
    """An image's alternative text, or the gap that it leaves."""
    gap = F.when(alt.isNull(), "image-no-alt").when(alt == "", "decorative")
    return F.struct(F.when(gap.isNull(), alt).alias("text"), gap.alias("gap"))


def valid_destination(path: Column) -> Column:
    """A relative Markdown path inside the vault, outside ``sources/`` and ``.git``."""
    parts = F.split(path, "/")
    bad = path.startswith("/") | path.contains("\\") | path.rlike("^[A-Za-z]:") | F.exists(parts, lambda p: p.isin("..", "", ".", ".git")) | (F.element_at(parts, 1) == "sources")
    return F.coalesce(~bad & F.lower(path).endswith(".md"), F.lit(False))


def diff_summary(before: Column, after: Column) -> Column:
    """Numbers of lines that are not blank, before and after."""
    lines = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: ~x.rlike(r"(?U)^\s*$")))
    return F.struct(lines(before).alias("before"), lines(after).alias("after"), (lines(after) - lines(before)).alias("change"))


def glob_pattern(glob: str) -> str:
    """An anchored regular expression for a path pattern of *, ?, ** and **/."""
    import re

    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])))
            i += 1
    return "^" + "".join(out) + "$"
