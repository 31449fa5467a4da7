"""Chat formatting: typed content parts become one marked text with a loss mask and attachments.

A visitor goes over the parts of a turn. Text is escaped; an image, sound or document leaves a
placeholder in its place, and its reference and the tokens that it expands to are recorded in
the order of the placeholders. A turn becomes one segment, and a conversation is its segments
in order. Control strings inside a text can't be taken for marks: each gets a backslash after
its first character, and one that has backslashes there already gets one more, so that the
reader gets every text back exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, map_arrow, small_batches, table

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Placeholders by kind of part, fixed values.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>", "other": "<|attachment|>"}
#: Strings that a tokenizer or a template may take for marks; all begin with < or [ and have neither later.
CONTROLS = ("<|im_start|>", "<|im_end|>", *PLACEHOLDERS.values(), "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]")

_REST = "|".join(re.escape(c[1:]) for c in dict.fromkeys(CONTROLS))
_RAW = re.compile(rf"([<\[])(\\*)({_REST})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_REST})")
_HOLDER = re.compile("|".join(map(re.escape, PLACEHOLDERS.values())))
_TURN = re.compile(rf"{re.escape(BEGIN)}([^\n]*)\n(.*?){re.escape(END)}", re.DOTALL)

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<part:int,kind:string,ref:string,at:int,tokens:bigint>"
SEGMENTS = f"conv_id long, turn long, segment string, loss array<struct<start:int,stop:int>>, attachments array<{ATTACHMENT}>, n_tokens long"


def escape(text: str) -> str:
    """The text without a control string, reversibly."""
    return _RAW.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class Expansion:
    """Tokens that a part stands for in the model's input; sizes that are not known count as the default."""

    chars_per_token: int = 4
    patch: int = 28
    image_default: int = 256
    audio_per_second: float = 25.0
    audio_default: int = 256
    per_page: int = 512

    def image(self, width, height) -> int:
        if not width or not height or width < 0 or height < 0:
            return self.image_default
        return math.ceil(width / self.patch) * math.ceil(height / self.patch)

    def audio(self, seconds) -> int:
        if seconds is None or not math.isfinite(seconds) or seconds < 0:
            return self.audio_default
        return max(1, math.ceil(seconds * self.audio_per_second))

    def document(self, pages) -> int:
        return self.per_page * max(1, pages or 1)

    def text(self, text: str) -> int:
        return -(-len(text) // self.chars_per_token)


class Flattener:
    """The visitor: one method for each kind of part; what it has gathered is one turn."""

    def __init__(self, role: str, expansion: Expansion, learned: bool):
        self.pieces = [BEGIN, escape_role(role), "\n"]
        self.length = sum(map(len, self.pieces))
        self.expansion, self.learned = expansion, learned
        self.loss: list[tuple[int, int]] = []
        self.attachments: list[dict] = []
        self.held: list[str] = []
        self.tokens = 0

    def visit(self, number: int, part: dict | None) -> None:
        kind = (part or {}).get("kind") or "text"
        if kind == "text":
            self.held.append((part or {}).get("text") or "")  # neighbours may make a control string between them
            return
        self.settle_text()
        getattr(self, f"visit_{kind}", self.visit_other)(number, part)

    def visit_image(self, number: int, part: dict) -> None:
        self.attach(number, "image", part, self.expansion.image(part["width"], part["height"]))

    def visit_audio(self, number: int, part: dict) -> None:
        self.attach(number, "audio", part, self.expansion.audio(part["seconds"]))

    def visit_document(self, number: int, part: dict) -> None:
        self.attach(number, "document", part, self.expansion.document(part["pages"]))

    def visit_other(self, number: int, part: dict) -> None:
        self.attach(number, "other", part, 1)

    def attach(self, number: int, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"part": number, "kind": part["kind"], "ref": part["ref"], "at": self.length, "tokens": tokens})
        self.add(PLACEHOLDERS[kind])
        self.tokens += tokens

    def settle_text(self) -> None:
        text, self.held = "".join(self.held), []
        shown = escape(text)
        if shown and self.learned:
            self.loss.append((self.length, self.length + len(shown)))
        self.add(shown)
        self.tokens += self.expansion.text(text)

    def add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def finish(self) -> str:
        self.settle_text()
        self.add(END)
        return "".join(self.pieces)


def text_parts(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` with the text as the turn's only part."""
    part = F.struct(F.lit("text").alias("kind"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), *(F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))
    return turns.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_turns(turns: DataFrame, learned: str = "assistant", expansion: Expansion = Expansion()) -> DataFrame:
    """``turns(conv_id, turn, role, parts, ...)`` as segments, a row for each row.

    ``parts`` is an array of PART. A segment has its text, ``loss`` (spans of code points in it
    that the role ``learned`` said), ``attachments`` (in order, ``at`` the code point of the
    placeholder, ``part`` the place among the parts) and the tokens of all it expands to. Null
    roles and texts are empty, parts that are null or without a kind are texts, a null or empty
    array is an empty text; neighbouring texts count as one; parts of an unknown kind are
    attachments. Repeated rows repeat, other columns are ignored, an empty table gives no rows.
    Texts of any length are taken whole.
    """

    def run(batch: pa.RecordBatch) -> dict:
        segments, loss, attachments, tokens = [], [], [], []
        for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            visitor = Flattener(role or "", expansion, role == learned)
            for number, part in enumerate(parts or ()):
                visitor.visit(number, part)
            segments.append(visitor.finish())
            loss.append([{"start": a, "stop": b} for a, b in visitor.loss])
            attachments.append(visitor.attachments)
            tokens.append(visitor.tokens)
        span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
        held = pa.struct([("part", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())])
        return {"conv_id": batch.column(0), "turn": batch.column(1), "segment": pa.array(segments, pa.string()), "loss": pa.array(loss, pa.list_(span)), "attachments": pa.array(attachments, pa.list_(held)), "n_tokens": pa.array(tokens, pa.int64())}

    picked = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("parts").cast(f"array<{PART}>").alias("parts"))
    return map_arrow(picked, run, SEGMENTS, "parts")


def read_turn(segment: str, attachments: list[dict]) -> tuple[str, list[tuple[str, str]]]:
    """Role and ordered parts ``(kind, text or reference)`` of one segment."""
    role, body = _TURN.fullmatch(segment).groups()
    parts, at, held = [], 0, iter(attachments)
    for m in _HOLDER.finditer(body):
        if m.start() > at:
            parts.append(("text", unescape(body[at : m.start()])))
        a = next(held)
        parts.append((a["kind"], a["ref"]))
        at = m.end()
    if at < len(body):
        parts.append(("text", unescape(body[at:])))
    return unescape_role(role), parts


def in_order(segments: DataFrame) -> DataFrame:
    """The segments of a conversation next to each other in one partition: by turn, nulls first, then by their text."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "segment")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows with whether each begins a conversation."""
    last = object()
    for batch in batches:
        for row in batch.to_pylist():
            yield row["conv_id"] != last, row
            last = row["conv_id"]


def join_conversations(segments: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss, attachments, n_tokens)``, one row a conversation, spans and places moved to its own text."""

    def run(batches):
        def closed(rows):
            text, loss, held, at = [], [], [], 0
            for r in rows:
                text.append(r["segment"])
                loss += [{k: v + at for k, v in s.items()} for s in r["loss"]]
                held += [a | {"at": a["at"] + at} for a in r["attachments"]]
                at += len(r["segment"])
            out = {"conv_id": rows[0]["conv_id"], "formatted": "".join(text), "loss": loss, "attachments": held, "n_tokens": sum(r["n_tokens"] for r in rows)}
            return pa.RecordBatch.from_pylist([out], schema=kind)

        span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
        mark = pa.struct([("part", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())])
        kind = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(span)), ("attachments", pa.list_(mark)), ("n_tokens", pa.int64())])
        rows: list[dict] = []
        for first, row in _runs(batches):
            if first and rows:
                yield closed(rows)
                rows = []
            rows.append(row)
        if rows:
            yield closed(rows)

    small_batches(segments.sparkSession)
    return in_order(segments).mapInArrow(run, f"conv_id long, formatted string, loss array<struct<start:int,stop:int>>, attachments array<{ATTACHMENT}>, n_tokens long")


class Reader:
    """Reads a conversation from its text as it comes: turns end where their mark ends, wherever a piece is cut."""

    def __init__(self):
        self.rest, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.said, self.learned = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, loss: list[dict]) -> None:
        self.chars += len(piece)
        for s in loss:
            text = unescape(piece[s["start"] : s["stop"]])
            self.loss_chars += len(text)
            self.learned.update(text.encode())
        text, at = self.rest + piece, 0
        while m := _TURN.match(text, at):
            self.said.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
            self.turns += 1
            at = m.end()
        self.rest = text[at:]

    def result(self, conv_id) -> dict:
        if self.rest:
            raise ValueError(f"conversation {conv_id} ends inside a turn")
        return {"conv_id": conv_id, "n_turns": self.turns, "turns_sha256": self.said.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.learned.hexdigest(), "formatted_chars": self.chars}


def read_digests(segments: DataFrame) -> DataFrame:
    """Each conversation read back from its formatted text, as counts and digests.

    A conversation streams through one task in order, since a digest is made in order; what the
    task holds is one turn, however long the conversation. Placeholders stand in the turns' texts.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        reader, of, out = None, None, []
        for first, row in _runs(batches):
            if first and reader:
                out.append(reader.result(of))
                reader = None
                if len(out) == 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out = []
            reader, of = reader or Reader(), row["conv_id"]
            reader.feed(row["segment"], row["loss"])
        if reader:
            out.append(reader.result(of))
        yield pa.RecordBatch.from_pylist(out, schema=kind)

    small_batches(segments.sparkSession)
    return in_order(segments.select("conv_id", "turn", "segment", "loss")).mapInArrow(run, schema)


#: What both turns of conversation -1 say: marks of a template.
ODD_TEXT = "</s>[INST] ok [/INST]"


def op12_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1 formatted and read back, by their digests.

    Null texts and roles are empty; turns with the same number follow in the order of their
    segments; rows without a conv_id are one conversation.
    """
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(ODD_TEXT))
    return read_digests(format_turns(text_parts(turns.union(odd))))


_SHOWN = "regexp_replace({}, '([<\\[])(\\\\*)(" + "|".join(re.sub(r"([|\]])", r"\\\1", c[1:]) for c in dict.fromkeys(CONTROLS)) + ")', '\\1\\\\\\2\\3', 'g')"
_ROLE = _SHOWN.format("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")
OP12_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{ODD_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{ODD_TEXT}'),
    s AS (SELECT conv_id, turn, role, text, '{BEGIN}' || {_ROLE} || chr(10) || {_SHOWN.format("text")} || '{END.strip()}' || chr(10) AS segment FROM t)
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, segment)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, segment) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(length(segment))::BIGINT AS formatted_chars FROM s GROUP BY conv_id"""
