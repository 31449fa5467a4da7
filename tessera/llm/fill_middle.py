"""Fill-in-middle transformation by succinct rank and select over character boundaries.

The UTF-8 bytes of a batch of texts are one string of bits, 1 where a character begins. Packed
into 64-bit words with a directory of ones before each block, it answers rank (characters before
a byte) by one look into the directory and a popcount, and select (byte of the k-th character)
by a search in the directory and in one block. So a text of any length is cut at characters
without decoding it, and all texts of a batch are cut at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, map_arrow, table

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, those cut at all, and of 100 cut ones, those with the suffix first.
CUT, SUFFIX_FIRST = 90, 20


class Boundaries:
    """Rank and select over the bytes ``data``; a word has 64 bits, a block 8 words.

    ``before[b]`` is the number of characters that begin before block b: 8 bytes for 512 bits,
    an eighth beside the bits themselves.
    """

    BLOCK = 8

    def __init__(self, data: np.ndarray):
        begins = (data & 0xC0) != 0x80
        packed = np.packbits(begins, bitorder="little")
        words = -(-len(packed) // 8)
        blocks = -(-words // self.BLOCK)
        self.bits = np.zeros(blocks * self.BLOCK * 8, np.uint8)
        self.bits[: len(packed)] = packed
        self.words = self.bits.view("<u8")
        counts = np.bitwise_count(self.words).reshape(blocks, self.BLOCK).astype(np.int64)
        self.within = np.zeros((blocks + 1, self.BLOCK), np.int64)  # ones before each word of its block
        np.cumsum(counts[:, :-1], axis=1, out=self.within[:blocks, 1:])
        self.before = np.zeros(blocks + 1, np.int64)
        np.cumsum(counts.sum(axis=1), out=self.before[1:])
        self.size = len(data)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Characters that begin before each byte position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        block = word // self.BLOCK
        inside = np.append(self.words, np.uint64(0))[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + self.within[block, word % self.BLOCK] + np.bitwise_count(inside).astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte position of the k-th character, counted from 0; the end for k = all of them."""
        out = np.full(len(k), self.size, np.int64)
        there = k < self.before[-1]
        k = k[there]
        block = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[block]
        word = (self.within[block] <= left[:, None]).sum(axis=1) - 1
        left = left - self.within[block, word]
        byte = (block * self.BLOCK + word) * 8
        ones = np.unpackbits(self.bits[byte[:, None] + np.arange(8)], axis=1, bitorder="little").cumsum(axis=1, dtype=np.int16)
        out[there] = byte * 8 + (ones <= left[:, None]).sum(axis=1)
        return out


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def draws(doc_id: Column, seed: str = "1") -> list[Column]:
    """Four whole numbers below 2^32 by the id: the leading digits of a hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = "1", cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs(doc_id, text, ...)`` as ``(doc_id, n, form, prefix_chars, middle_chars, output)``, a row for each row.

    n counts the code points of the whole text. Two draws by doc_id cut it into prefix, middle
    and suffix, any of which may be empty; two more choose the form: plain, psm (prefix, suffix,
    middle) or spm (suffix, prefix, middle). Empty and null texts and those that hold a mark are
    plain: ``output`` is then the text, the lengths are null. Equal ids have equal draws, also
    the null id (it counts as an empty one); repeated rows repeat; other columns are ignored; an
    empty table gives no rows. A long text stands alone in its batch, with memory of a few
    times its size.
    """
    names = [free_name(f"draw_{k}", docs) for k in range(4)]
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(d.alias(n) for d, n in zip(draws(F.col("doc_id"), seed), names, strict=True)))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batch: pa.RecordBatch) -> dict:
        data, offsets = _buffer(batch.column(1))
        h1, h2, h3, h4 = (batch.column(k).to_numpy() for k in range(2, 6))
        index = Boundaries(data)
        ranks = index.rank(offsets)
        n = np.diff(ranks)
        first, second = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
        held = index.select(np.concatenate([ranks[:-1] + first, ranks[:-1] + second]))
        a, b = np.minimum(held[: len(n)], offsets[1:]), np.minimum(held[len(n) :], offsets[1:])
        raw = data.tobytes()
        form, out = [], []
        for k in range(len(n)):
            start, end = offsets[k], offsets[k + 1]
            text = raw[start:end]
            if not text or h3[k] % 100 >= cut or any(m in text for m in marks):
                form.append("plain")
                out.append(text)
                continue
            prefix, middle, suffix = raw[start : a[k]], raw[a[k] : b[k]], raw[b[k] : end]
            late = h4[k] % 100 < suffix_first
            form.append("spm" if late else "psm")
            parts = (marks[1], suffix, marks[0], prefix) if late else (marks[0], prefix, marks[1], suffix)
            out.append(b"".join((*parts, marks[2], middle)))
        plain = np.array([f == "plain" for f in form], bool)
        return {
            "doc_id": batch.column(0),
            "n": pa.array(n, pa.int64()),
            "form": pa.array(form, pa.string()),
            "prefix_chars": pa.array(first, pa.int64(), mask=plain),
            "middle_chars": pa.array(second - first, pa.int64(), mask=plain),
            "output": pa.array(out, pa.binary()).cast(pa.string()),
        }

    return map_arrow(picked, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from it and its form alone.

    The text holds no mark, and no mark can begin inside another or in a cut end of a text, so
    the first place of each mark is its own.
    """
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    outer = F.split(body, F.when(form == "spm", PREFIX).otherwise(SUFFIX), 2)
    inner = F.split(outer[1], MIDDLE, 2)
    prefix, suffix = F.when(form == "spm", inner[0]).otherwise(outer[0]), F.when(form == "spm", outer[0]).otherwise(inner[0])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, inner[1], suffix))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every document cut for infilling, by its digests; the restored text comes from the output alone.

    Null texts are empty and plain; a null id draws as the empty one; repeated rows repeat.
    """
    made = fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = """WITH h AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    d AS (SELECT doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
             WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    c AS (SELECT doc_id, text, n, form, least(x, y) AS a, greatest(x, y) AS b FROM d)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substring(text, 1, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
            ELSE '<S>' || substring(text, b + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, b - a) END) AS output_sha256,
        sha256(text) AS restored_sha256 FROM c"""
