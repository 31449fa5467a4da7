"""Markdown structure: fences, sections, chunks. Order-dependent, so one pass over each note in Python."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_HEADING = re.compile(r"^( {0,3})(#{1,6})(?=[ \t]|$)(.*)$", re.S)
_CLOSING = re.compile(r"[ \t]+#+[ \t]*$")
_TICKS = re.compile(r"`+")


class Fences:
    """Says of each line in turn whether it is code: a fence, or between two."""

    def __init__(self) -> None:
        self.open: tuple[str, int] | None = None

    def code(self, line: str) -> bool:
        m = _FENCE.match(line)
        if self.open:
            if m and m[1][0] == self.open[0] and len(m[1]) >= self.open[1] and not m[2].strip():
                self.open = None
            return True
        if m and not (m[1][0] == "`" and "`" in m[2]):
            self.open = (m[1][0], len(m[1]))
            return True
        return False


def strip_inline_code(line: str) -> str:
    """Without spans between equal runs of backticks; a run that no equal one closes is text."""
    if "`" not in line:
        return line
    runs = list(_TICKS.finditer(line))
    out, at, i = [], 0, 0
    while i < len(runs):
        size = len(runs[i][0])
        end = next((j for j in range(i + 1, len(runs)) if len(runs[j][0]) == size), None)
        if end is None:
            i += 1
        else:
            out.append(line[at : runs[i].start()])
            at, i = runs[end].end(), end + 1
    return "".join(out) + line[at:]


def strip_code(body: str) -> str:
    fences = Fences()
    return "\n".join("" if fences.code(x) else strip_inline_code(x) for x in body.split("\n"))


def split_frontmatter(raw: str) -> tuple[str | None, str]:
    """(YAML, body); no YAML unless the first line is a fence that a later line closes."""
    text = raw.replace("\r\n", "\n")
    m = re.match(r"---[ \t]*\n(.*?)(?:^|\n)---[ \t]*(?:\n|\Z)", text, re.S)
    return (m[1], text[m.end() :]) if m else (None, text)


def encode_segment(heading: str) -> str:
    return heading.replace("%", "%25").replace("/", "%2F") if heading else "%00"


def sections(body: str) -> list[dict]:
    """Headings in order with their unique paths, breadcrumbs and spans.

    ``body_end`` closes a section with its subsections, ``own_end`` before the next heading
    of any level.
    """
    fences, at, found = Fences(), 0, []
    for line in body.split("\n"):
        start, at = at, at + len(line) + 1
        if fences.code(line):
            continue
        if m := _HEADING.match(line):
            found.append({"level": len(m[2]), "heading": _CLOSING.sub("", m[3]).strip(), "heading_start": start, "body_start": min(at, len(body))})
    open_: list[tuple[int, str, set, list]] = [(0, "", set(), [])]
    for x in found:
        while len(open_) > 1 and open_[-1][0] >= x["level"]:
            open_.pop()
        _, path, taken, trail = open_[-1]
        base = name = encode_segment(x["heading"])
        n = 2
        while name in taken:
            name, n = f"{base}-{n}", n + 1
        taken.add(name)
        x["path"] = f"{path}/{name}" if path else name
        x["breadcrumb"] = [*trail, x["heading"]]
        open_.append((x["level"], x["path"], set(), x["breadcrumb"]))
    for i, x in enumerate(found):
        x["ord"] = i
        x["own_end"] = found[i + 1]["heading_start"] if i + 1 < len(found) else len(body)
        x["body_end"] = next((y["heading_start"] for y in found[i + 1 :] if y["level"] <= x["level"]), len(body))
    return found


def normalize_body(body: str) -> str:
    lines = unicodedata.normalize("NFC", body).split("\n")
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()
    return "\n".join(lines)


def chunks(raw: str, title: str, aliases: list[str]) -> Iterator[tuple[str, int, str]]:
    """(section path, ordinal, text) of each section with prose of its own, the part before the first heading first."""
    body = split_frontmatter(raw)[1]
    found = sections(body)
    names = dict.fromkeys(x for a in [title, *aliases] if (x := unicodedata.normalize("NFC", a or "").strip()))
    identity = "\n".join(names)
    parts = [("", [], body[: found[0]["heading_start"] if found else len(body)])]
    parts += [(x["path"], x["breadcrumb"], body[x["body_start"] : x["own_end"]]) for x in found]
    for path, trail, text in parts:
        if text := normalize_body(text):
            crumb = " › ".join(x for h in trail if (x := unicodedata.normalize("NFC", h).strip()))
            yield path, 0, "\n\n".join(x for x in (crumb, identity, text) if x)
