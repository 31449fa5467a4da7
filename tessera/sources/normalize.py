"""Source files to canonical text: format gate, decoding, HTML and PDF text, typed rejections."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.pdf import PdfRejected, pdf_text

#: Formats by extension, and the most bytes of each.
EXTENSIONS = {".md": "markdown", ".markdown": "markdown", ".txt": "text", ".pdf": "pdf", ".html": "html", ".htm": "html"}
MAX_BYTES = {"markdown": 5 << 20, "text": 5 << 20, "pdf": 50 << 20, "html": 10 << 20}
LOCATORS = {"markdown": "heading-path", "text": "char-offset", "pdf": "page", "html": "dom-anchor"}
CHARSETS = {"utf-8": "utf-8", "utf8": "utf-8", "us-ascii": "utf-8", "ascii": "utf-8", "iso-8859-1": "latin-1", "latin1": "latin-1", "l1": "latin-1", "windows-1252": "cp1252", "cp1252": "cp1252", "x-cp1252": "cp1252"}
REJECTIONS = ("unsupported-encoding", "encrypted-source", "no-extractable-text", "signature-mismatch", "too-large", "partial-extraction")

_BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th thead tr ul".split())
_DROPPED = frozenset("script style template noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD = frozenset("base link meta title style script template noscript".split())
#: Which open elements a start tag ends, and where the search for them stops.
_ENDS = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_CLOSES_P = _BREAKS - {"br", "td", "th", "tr", "tbody", "thead"}


class Rejected(ValueError):
    def __init__(self, code: str, detail: str) -> None:
        super().__init__(detail)
        self.code = code


def decode_text(data: bytes) -> str:
    """Strict UTF-8, or UTF-16 where a byte order mark says so."""
    try:
        if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return data[2:].decode("utf-16-le" if data[0] == 0xFF else "utf-16-be")
        return (data[3:] if data.startswith(b"\xef\xbb\xbf") else data).decode("utf-8")
    except UnicodeDecodeError as e:
        raise Rejected("unsupported-encoding", str(e)) from None


def signature_matches(form: str, data: bytes) -> bool:
    """Does the content look like the format that the name claims?"""
    if form == "pdf":
        return data.startswith(b"%PDF-")
    body = data[3:] if data.startswith(b"\xef\xbb\xbf") else data
    if form == "html":
        return body[:512].decode("utf-8", "replace").lstrip().lower().startswith(("<!doctype html", "<html"))
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        wide = data[2:]
        if len(wide) % 2:
            return False
        text = wide[:8192].decode("utf-16-le" if data[0] == 0xFF else "utf-16-be", "replace")
        return "\0" not in text and text.count("\ufffd") * 10 < max(1, len(text))
    return b"\0" not in body[:8192]


#: Elements that an end tag, or the start of a block, does not look beyond; fixed values of the HTML standard.
_SCOPE = frozenset("applet caption html table td th marquee object template".split())
_BUTTON_SCOPE = _SCOPE | {"button"}
_TABLE_SCOPE = frozenset(("html", "table", "template"))
_TABLE_PARTS = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())


class _Charset(HTMLParser):
    """The first charset that a meta element outside raw text declares."""

    found: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "meta" and self.found is None:
            a = {k: v or "" for k, v in attrs}
            if "charset" in a:
                self.found = a["charset"].strip().lower()
            elif a.get("http-equiv", "").lower() == "content-type" and (m := re.search(r"charset\s*=\s*[\"']?([^\s\"';]+)", a.get("content", ""), re.I)):
                self.found = m[1].lower()


def decode_html(data: bytes) -> str:
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise Rejected("unsupported-encoding", "UTF-16 is no HTML encoding here")
    if data.startswith(b"\xef\xbb\xbf"):
        data, label = data[3:], "utf-8"
    else:
        scan = _Charset(convert_charrefs=True)
        scan.feed(data[:4096].decode("latin-1"))
        label = CHARSETS.get(scan.found) if scan.found is not None else "utf-8"
        if label is None:
            raise Rejected("unsupported-encoding", f"charset {scan.found}")
    try:
        return data.decode(label)
    except UnicodeDecodeError as e:
        raise Rejected("unsupported-encoding", str(e)) from None


class _HtmlText(HTMLParser):
    """Document text with a newline at block boundaries, and a gap for each image without one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.gaps: list[tuple[str, str]] = []
        self.open: list[str] = []
        self.counts: list[dict[str, int]] = [{}]
        self.paths: list[str] = [""]
        self.dropped = 0
        self.pending = ""

    def _push(self, tag: str) -> None:
        n = self.counts[-1][tag] = self.counts[-1].get(tag, 0) + 1
        self.open.append(tag)
        self.paths.append(f"{self.paths[-1]}/{tag}[{n}]")
        self.counts.append({})
        if tag in _DROPPED:
            self.dropped += 1
        elif tag in _BREAKS:
            self._break()

    def _pop(self) -> None:
        tag = self.open.pop()
        self.paths.pop()
        self.counts.pop()
        if tag in _DROPPED:
            self.dropped -= 1
        elif tag in _BREAKS:
            self._break()

    def _break(self) -> None:
        if self.out and not self.dropped:
            self.pending = "\n"

    def _emit(self, text: str) -> None:
        self.out += [self.pending, text] if self.out else [text]
        self.pending = ""

    def _body(self, tag: str) -> None:
        """Imply the document, and the body for what is not of the head."""
        if tag == "html":
            return
        if not self.open:
            self._push("html")
        if tag in ("head", "body") or len(self.open) > 1:
            if tag not in _HEAD and self.open[-1:] == ["head"] and tag not in ("head",):
                self._pop()
                if tag != "body":
                    self._push("body")
            return
        self._push("head" if tag in _HEAD else "body")

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body", "head") and tag in self.open:
            return
        self._body(tag)
        if tag in _CLOSES_P:
            self._end(self._within("p", _BUTTON_SCOPE))
        if tag in _ENDS:
            ends, stops = (x.split() for x in _ENDS[tag])
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k] in stops:
                    break
                if self.open[k] in ends:
                    while len(self.open) > k:
                        self._pop()
                    break
        if tag == "img" and not self.dropped:
            n = self.counts[-1]["img"] = self.counts[-1].get("img", 0) + 1
            a = dict(attrs)
            if a.get("alt"):
                self._emit(a["alt"])
            else:
                self.gaps.append(("image-decorative" if "alt" in a else "image-no-alt", f"dom:{self.paths[-1]}/img[{n}]"))
            return
        if tag in _VOID:
            self._push(tag)
            self._pop()
            return
        self._push(tag)

    def _within(self, tag: str, stops: frozenset[str]) -> int | None:
        """Where the nearest open element of that name is, if none of the stops lies above it."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] == tag:
                return k
            if self.open[k] in stops:
                return None
        return None

    def _end(self, k: int | None) -> None:
        while k is not None and len(self.open) > k:
            self._pop()

    def handle_endtag(self, tag):
        if tag in ("html", "body"):  # what follows still belongs to the body
            return
        if tag in ("p", "br") and self._within("p", _BUTTON_SCOPE) is None:
            self._body("p")  # such an end tag stands for an empty element
            self._push(tag)
            self._pop()
            return
        k = self._within(tag, _TABLE_SCOPE if tag in _TABLE_PARTS else _BUTTON_SCOPE if tag == "p" else _SCOPE)
        if k is not None and tag in _FORMATTING and any(x in _BREAKS for x in self.open[k + 1 :]):
            del self.open[k], self.paths[k + 1], self.counts[k + 1]  # a block inside stays open
            return
        self._end(k)

    def handle_data(self, data):
        if self.dropped or not data:
            return
        if data.strip():
            self._body("#text")
        text = " ".join(data.split())
        if (not text or data[0].isspace()) and self.out and not self.pending:
            self.pending = " "
        if text:
            self._emit(text)
            if data[-1].isspace():
                self.pending = " "


def html_text(data: bytes) -> tuple[str, list[tuple[str, str]]]:
    parser = _HtmlText()
    parser.feed(decode_html(data))
    parser.close()
    text = "".join(parser.out)
    if not text and not parser.gaps:
        raise Rejected("no-extractable-text", "no document text")
    return text, parser.gaps


def normalize_bytes(path: str, data: bytes) -> dict:
    """One rendition or one rejection of a file."""
    extension = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    form = EXTENSIONS.get(extension)
    row = {"path": path, "format": form, "reject_code": None, "detail": None, "text": None, "gaps": [], "content_id": "sha256:" + hashlib.sha256(data).hexdigest(), "text_hash": None, "size_bytes": len(data), "locator_scheme": LOCATORS.get(form or "")}
    if form is None:
        return row | {"reject_code": "usage-error", "detail": f"no format for {extension or path}"}
    try:
        if len(data) > MAX_BYTES[form]:
            raise Rejected("too-large", f"over {MAX_BYTES[form]} bytes")
        if not signature_matches(form, data):
            raise Rejected("signature-mismatch", f"content is not {form}")
        gaps: list = []
        if form == "html":
            text, gaps = html_text(data)
        elif form == "pdf":
            text = pdf_text(data)
        else:
            text = decode_text(data)
            if not text:
                raise Rejected("no-extractable-text", "empty document")
    except (Rejected, PdfRejected) as e:
        return row | {"reject_code": e.code, "detail": str(e)}
    return row | {"text": text, "gaps": [{"kind": k, "locator": x, "note": None} for k, x in gaps], "text_hash": "sha256:" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()}


RENDITION = "path string, format string, reject_code string, detail string, text string, gaps array<struct<kind:string,locator:string,note:string>>, content_id string, text_hash string, size_bytes long, locator_scheme string"


def within_limits(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to read, files too large): judged by the listing's length, before any content is read."""
    ext = F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1)))
    limit = F.lit(max(MAX_BYTES.values()))
    for e, form in EXTENSIONS.items():
        limit = F.when(ext == e, F.lit(MAX_BYTES[form])).otherwise(limit)
    return files.where(F.col("length") <= limit), files.where(F.col("length") > limit).select("path", "length")


def normalize(files: DataFrame) -> DataFrame:
    """RENDITION rows of ``files(path, content)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([normalize_bytes(p, bytes(c)) for p, c in zip(b["path"], b["content"])])

    return files.select("path", "content").mapInPandas(run, RENDITION)
