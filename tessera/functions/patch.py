"""Edits of one note's text: preconditions first, then operations in turn, all or nothing."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.markdown import Fences, sections, strip_inline_code


class PatchFailed(ValueError):
    def __init__(self, code: str, detail: str) -> None:
        super().__init__(detail)
        self.code = code


def frontmatter_span(text: str) -> tuple[int, int, int] | None:
    """(start of the fields, end of the fields, start of the body), or none."""
    m = re.match(r"---[ \t]*\n", text)
    end = re.compile(r"^---[ \t]*(?:\n|\Z)", re.M).search(text, m.end()) if m else None
    return (m.end(), end.start(), end.end()) if m and end else None


def _body_start(text: str) -> int:
    span = frontmatter_span(text)
    return span[2] if span else 0


def section(text: str, path: str) -> tuple[int, int]:
    """Span of a section's content with its subsections, in the whole text."""
    at = _body_start(text)
    for s in sections(text[at:]):
        if s["path"] == path:
            return at + s["body_start"], at + s["body_end"]
    raise PatchFailed("section-not-found", path)


def section_hash(content: str) -> str:
    lines = "\n".join(x.rstrip() for x in content.split("\n"))
    return hashlib.sha256(re.sub(r"\A\n+|\n+\Z", "", lines).encode()).hexdigest()


def field(text: str, name: str) -> str | None:
    """The text of a top-level frontmatter field, continuation lines included."""
    span = frontmatter_span(text)
    m = re.search(rf"^{re.escape(name)}:(.*(?:\n[ \t-].*)*)$", text[span[0] : span[1]], re.M) if span else None
    return m[1].strip() if m else None


def aliases(text: str) -> list[str]:
    span = frontmatter_span(text)
    doc = yaml.safe_load(text[span[0] : span[1]]) if span else None
    found = doc.get("aliases") if isinstance(doc, dict) else None
    return [str(x) for x in found] if isinstance(found, list) else []


def _scalar(value) -> str:
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (str, list, dict)) else json.dumps(value)


def set_field(text: str, name: str, value) -> str:
    span = frontmatter_span(text)
    if span is None:
        raise PatchFailed("frontmatter-missing", name)
    block = text[span[0] : span[1]]
    line = f"{name}: {_scalar(value)}"
    changed, n = re.subn(rf"^{re.escape(name)}:.*(?:\n[ \t-].*)*$", lambda m: line, block, count=1, flags=re.M)
    return text[: span[0]] + (changed if n else block + line + "\n") + text[span[1] :]


def replace_section(text: str, path: str, body: str) -> str:
    s, e = section(text, path)
    body = body.replace("\r\n", "\n")
    return text[:s] + body + ("\n" if e < len(text) and not body.endswith("\n") else "") + text[e:]


def append_to_section(text: str, path: str, content: str, create: bool = False) -> str:
    content = content.replace("\r\n", "\n").rstrip("\n")
    try:
        at = section(text, path)[1]
    except PatchFailed:
        if not create:
            raise
        parent, _, name = path.rpartition("/")
        heading = "" if name == "%00" else name.replace("%2F", "/").replace("%25", "%")
        level = 1
        at = len(text)
        if parent:
            at = section(text, parent)[1]
            body = text[_body_start(text) :]
            level = min(6, 1 + next(s["level"] for s in sections(body) if s["path"] == parent))
        content = f"{'#' * level} {heading}\n\n{content}"
    before, after = text[:at].rstrip("\n"), text[at:].lstrip("\n")
    return (before + "\n\n" if before else "") + content + ("\n\n" + after if after else "\n")


def add_alias(text: str, alias: str) -> str:
    have = aliases(text)
    return text if alias in have else set_field(text, "aliases", [*have, alias])


def set_evidence(text: str, entry_id: str, fields: dict) -> str:
    """Fields of one entry of the frontmatter's ``evidence``, changed in place; all other characters stay."""
    span = frontmatter_span(text)
    block = text[span[0] : span[1]] if span else ""
    try:
        root = yaml.compose(block)
    except yaml.YAMLError as e:
        raise PatchFailed("invalid-frontmatter", str(e)) from None
    fields_of_note = root.value if isinstance(root, yaml.MappingNode) else []
    entries = [e for k, v in fields_of_note if k.value == "evidence" and isinstance(v, yaml.SequenceNode) for e in v.value if isinstance(e, yaml.MappingNode)]
    entry = next((e for e in entries if any(k.value == "id" and v.value == entry_id for k, v in e.value)), None)
    if entry is None:
        raise PatchFailed("evidence-not-found", entry_id)
    held = {k.value: v for k, v in entry.value}
    end = len(block[: entry.value[-1][1].end_mark.index].rstrip())
    between = ", " if entry.flow_style else "\n" + " " * entry.value[0][0].start_mark.column
    edits = []
    for name, value in fields.items():
        if name in held:
            s, e = held[name].start_mark.index, held[name].end_mark.index
            edits.append((s, e, _scalar(value) if e > s else " " + _scalar(value)))
    edits += [(end, end, f"{between}{name}: {_scalar(value)}") for name, value in fields.items() if name not in held]
    for s, e, new in sorted(edits, key=lambda x: x[0])[::-1]:
        block = block[:s] + new + block[e:]
    return text[: span[0]] + block + text[span[1] :]


def check(text: str, pre: dict) -> None:
    """Raise if a precondition does not hold."""
    kind = pre["kind"]
    if kind in ("section-present", "section-content-hash"):
        s, e = section(text, pre["path"])
        if kind == "section-content-hash" and section_hash(text[s:e]) != pre["expectedContentHash"]:
            raise PatchFailed("content-hash-mismatch", pre["path"])
    elif kind == "alias-absent":
        if pre["alias"] in aliases(text):
            raise PatchFailed("alias-exists", pre["alias"])
    else:
        value = field(text, pre["field"])
        if kind == "frontmatter-field-absent":
            if value is not None:
                raise PatchFailed("field-exists", pre["field"])
        elif value is None:
            raise PatchFailed("field-not-found", pre["field"])
        elif kind == "frontmatter-value-hash" and hashlib.sha256(value.strip().encode()).hexdigest() != pre["expectedValueHash"]:
            raise PatchFailed("value-hash-mismatch", pre["field"])


def apply_patch(raw: str, preconditions: list[dict], ops: list[dict]) -> str:
    text = raw.replace("\r\n", "\n")
    for pre in preconditions:
        check(text, pre)
    for op in ops:
        kind = op["kind"]
        if kind == "replace-section-body":
            text = replace_section(text, op["path"], op["newBody"])
        elif kind == "append-to-section":
            text = append_to_section(text, op["path"], op["content"], op.get("createIfAbsent", False))
        elif kind == "set-frontmatter-field":
            if op.get("mode") == "create" and field(text, op["field"]) is not None:
                raise PatchFailed("field-exists", op["field"])
            text = set_field(text, op["field"], op["value"])
        elif kind == "add-alias":
            text = add_alias(text, op["alias"])
        elif kind == "set-evidence-fields":
            text = set_evidence(text, op["id"], op["fields"])
        else:
            raise PatchFailed("unknown-operation", kind)
    return text


def add_link(text: str, target: str, alias: str | None = None) -> str:
    """A list item for the link under ``Links``, which is made where it is missing; a link that is there gets the alias."""
    link = f"[[{target}|{alias}]]" if alias else f"[[{target}]]"
    changed, n = _edit_links(text, target, lambda m: link)
    return changed if n else append_to_section(text, "Links", f"- {link}", create=True)


def remove_link(text: str, target: str) -> str:
    """Without the link's list items, and elsewhere with its label as plain text."""
    kept = [x for x in text.split("\n") if not re.fullmatch(rf"\s*[-*+] \[\[\s*{re.escape(target)}\s*(?:\|[^\]]*)?\]\]\s*", x)]
    return _edit_links("\n".join(kept), target, lambda m: (m[1] or target).strip("| "))[0]


def _edit_links(text: str, target: str, f) -> tuple[str, int]:
    """Replace links to a target outside code."""
    pattern = re.compile(rf"\[\[\s*{re.escape(target)}\s*(\|[^\]\[\n]+)?\]\]")
    at = _body_start(text)
    fences, out, n = Fences(), [], 0
    for line in text[at:].split("\n"):
        if not fences.code(line) and pattern.search(strip_inline_code(line)):
            line, k = pattern.subn(f, line)
            n += k
        out.append(line)
    return text[:at] + "\n".join(out), n


def patched(raw: Column, patch: Column) -> Column:
    """``(ok, code, next)`` of a JSON patch ``{preconditions, ops}`` on each text."""

    @F.pandas_udf("ok boolean, code string, next string")
    def run(raw: pd.Series, patch: pd.Series) -> pd.DataFrame:
        rows = []
        for text, p in zip(raw, patch):
            try:
                p = json.loads(p)
                rows.append((True, None, apply_patch(text, p.get("preconditions", []), p["ops"])))
            except PatchFailed as e:
                rows.append((False, e.code, None))
        return pd.DataFrame(rows, columns=["ok", "code", "next"])

    return run(raw, patch)
