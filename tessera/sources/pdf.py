"""Text of simple PDF files. What can't be read in full is refused, never half returned.

The trailer that the file's end points at, with those it was appended to, names the catalogue
and tells encryption. Fonts must map their bytes plainly: WinAnsi, or ASCII under any other
base encoding; composite fonts, maps of their own and remapped codes are refused.
"""

from __future__ import annotations

import re
import zlib


class PdfRejected(ValueError):
    def __init__(self, code: str, detail: str) -> None:
        super().__init__(detail)
        self.code = code


def _partial(detail: str) -> PdfRejected:
    return PdfRejected("partial-extraction", detail)


_STRING = rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()]|\([^()]*\))*\))*\)|<[0-9A-Fa-f\s]*>"
_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj\b", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(_STRING + rb"|%[^\r\n]*|<<|>>|\[|\]|/[^\s/<>\[\]()]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[0-9]*", re.S)
_ENTRY = re.compile(_STRING + rb"|%[^\r\n]*|<<|>>|\[|\]|/[^\s/<>\[\]()%]*|[^\s/<>\[\]()%]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def escape(m: re.Match) -> bytes:
        x = m[1]
        if x[:1].isdigit():
            return bytes([int(x, 8) & 255])
        return b"" if x in (b"\n", b"\r\n", b"\r") else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", escape, token[1:-1], flags=re.S)


def _entries(body: bytes) -> dict[bytes, bytes]:
    """The entries of the dictionary that ``body`` begins with, those of inner ones left out; none if it begins otherwise."""
    out: dict[bytes, bytes] = {}
    depth, key, start, end = 0, None, None, 0
    for m in _ENTRY.finditer(body):
        token = m[0]
        if token[:1] == b"%":
            continue
        if depth == 0 and token != b"<<":
            break
        closes = token in (b">>", b"]")
        if depth == 1 and key is not None and start is not None and (token[:1] == b"/" or token == b">>"):
            out.setdefault(key, body[start:end])
            key = start = None
        if depth == 1 and key is None and token[:1] == b"/":
            key = token[1:]
        elif depth >= 1 and start is None and not closes:
            start = m.start()
        depth += (token in (b"<<", b"[")) - closes
        end = m.end()
        if depth == 0:
            break
    return out


class _File:
    def __init__(self, data: bytes) -> None:
        self.data = data
        self.objects: dict[int, bytes] = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if _entries(body).get(b"Type") == b"/ObjStm":
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        content, head = self.stream(body), _entries(body)
        try:
            count, first = int(head[b"N"]), int(head[b"First"])
            numbers = list(map(int, content[:first].split()[: 2 * count]))
            places = [*numbers[1::2], len(content) - first]
            for i in range(count):
                self.objects.setdefault(numbers[2 * i], content[first + places[i] : first + places[i + 1]])
        except (KeyError, ValueError, IndexError):
            raise _partial("a stream of objects is broken") from None

    def resolve(self, value: bytes | None) -> bytes | None:
        """What a value refers to, or the value itself; None if that is not there."""
        if value is not None and (r := _REFERENCE.match(value)):
            return self.objects.get(int(r[1]))
        return value

    def declared(self, entries: dict[bytes, bytes], key: bytes) -> bytes:
        """An entry's value, empty if there is none; one that refers to nothing is refused."""
        if key not in entries:
            return b""
        value = self.resolve(entries[key])
        if value is None:
            raise _partial(f"{key.decode('latin-1')} refers to nothing")
        return value

    def stream(self, body: bytes) -> bytes:
        head = _entries(body)
        m = re.search(rb"\bstream\r?\n", body)
        if not m:
            raise _partial("a stream is missing")
        data = body[m.end() :]
        length = (self.resolve(head.get(b"Length")) or b"").strip()
        if length.isdigit() and data[int(length) :].lstrip(b"\r\n").startswith(b"endstream"):
            data = data[: int(length)]
        elif b"endstream" in data:
            data = data[: data.rindex(b"endstream")]
        else:
            raise _partial("a stream has no end")
        for name in re.findall(rb"/(\w+)", self.declared(head, b"Filter")):
            if name not in (b"FlateDecode", b"Fl") or b"/Predictor" in self.declared(head, b"DecodeParms"):
                raise _partial(f"filter {name.decode()}")
            inflate = zlib.decompressobj()
            try:
                data = inflate.decompress(data)
            except zlib.error as e:
                raise _partial(str(e)) from None
            if not inflate.eof:
                raise _partial("a stream is cut short")
        return data

    def trailer(self) -> dict[bytes, bytes]:
        """The active trailer: that of the last cross-reference section, then what older ones add; else the last in the text."""
        merged: dict[bytes, bytes] = {}
        starts = re.findall(rb"\bstartxref\s+(\d+)", self.data)
        at, seen = int(starts[-1]) if starts else None, set()
        while at is not None and at not in seen:
            seen.add(at)
            section = self._section(at)
            for k, v in section.items():
                merged.setdefault(k, v)
            previous = section.get(b"Prev", b"").strip()
            at = int(previous) if previous.isdigit() else None
        if merged:
            return merged
        last = self.data.rfind(b"trailer")
        return _entries(self.data[last + 7 :]) if last >= 0 else {}

    def _section(self, at: int) -> dict[bytes, bytes]:
        if re.compile(rb"\s*xref\b").match(self.data, at):
            found = self.data.find(b"trailer", at)
            return _entries(self.data[found + 7 :]) if found >= 0 else {}
        if m := re.compile(rb"\s*\d+\s+\d+\s+obj\b").match(self.data, at):
            head = _entries(self.data[m.end() :])
            return head if head.get(b"Type") == b"/XRef" else {}
        return {}


def _number(token: bytes) -> float:
    try:
        return float(token)
    except ValueError:
        raise _partial("an operand is no number") from None


def _fonts(file: _File, resources: bytes) -> dict[bytes, str]:
    """The codec of each font's bytes; a font whose bytes are not plainly characters is refused."""
    out = {}
    declared = _entries(file.declared(_entries(resources), b"Font"))
    for name in declared:
        font = _entries(file.declared(declared, name))
        encoding = file.declared(font, b"Encoding").strip()
        base = _entries(encoding)
        if font.get(b"Subtype") == b"/Type0" or b"ToUnicode" in font or b"Differences" in base:
            raise _partial(f"font {name.decode('latin-1')} maps its codes itself")
        out[name] = "cp1252" if b"/WinAnsiEncoding" in (encoding, base.get(b"BaseEncoding")) else "ascii"
    return out


def _page_text(file: _File, page: bytes, resources: bytes) -> str:
    fonts = _fonts(file, resources)
    contents = _entries(page).get(b"Contents")
    if contents is None:
        return ""
    if _REFERENCE.match(contents) and (file.resolve(contents) or b"").lstrip()[:1] == b"[":
        contents = file.resolve(contents)
    parts = []
    for r in _REFERENCE.finditer(contents):
        if int(r[1]) not in file.objects:
            raise _partial("page content is missing")
        parts.append(file.stream(file.objects[int(r[1])]))
    out: list[str] = []
    stack: list[bytes] = []
    codec = "ascii"
    for token in _TOKEN.findall(b"\n".join(parts)):
        first = token[:1]
        if first == b"%":
            continue
        if first in b"(<>[]/+-.0123456789":
            stack.append(token)
            continue
        if token == b"Tf":
            name = next((x[1:] for x in stack if x[:1] == b"/"), b"")
            codec = fonts.get(name, "ascii")
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                out.append("\n")
            for x in stack:
                if x[:1] in b"(<" and x != b"<<":
                    try:
                        out.append(_string(x).decode(codec))
                    except UnicodeDecodeError:
                        raise _partial("a byte without a character in its font") from None
                elif token == b"TJ" and x[:1] in b"-" and _number(x) < -200:
                    out.append(" ")
        elif token in (b"T*", b"ET") or token in (b"Td", b"TD") and len(stack) >= 2 and _number(stack[-1]) != 0:
            out.append("\n")
        elif token in (b"Td", b"TD"):
            out.append(" ")
        stack.clear()
    return "\n".join(x for line in "".join(out).split("\n") if (x := " ".join(line.split())))


def pdf_text(data: bytes) -> str:
    """Text of all pages in order, a form feed between two."""
    file = _File(data)
    trailer = file.trailer()
    if b"Encrypt" in trailer:
        raise PdfRejected("encrypted-source", "the file is encrypted")
    root = file.resolve(trailer.get(b"Root"))
    if root is None:
        raise _partial("no catalogue")
    pages: list[str] = []
    seen: set[bytes] = set()

    def walk(node: bytes, inherited: bytes) -> None:
        if node in seen:
            raise _partial("the page tree has a loop")
        seen.add(node)
        body = file.resolve(node)
        if body is None:
            raise _partial("a page is missing")
        entries = _entries(body)
        resources = file.declared(entries, b"Resources") or inherited
        if entries.get(b"Type") == b"/Page":
            pages.append(_page_text(file, body, resources))
        elif b"Kids" in entries:
            for r in _REFERENCE.finditer(file.declared(entries, b"Kids")):
                walk(r[0], resources)
        else:
            raise _partial("neither a page nor a list of pages")

    walk(_entries(root).get(b"Pages", b"0 0 R"), b"")
    text = "\f".join(pages)
    if not text.strip("\f\n "):
        raise PdfRejected("no-extractable-text", "no text layer")
    return text
