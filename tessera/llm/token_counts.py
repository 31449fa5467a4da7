"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie over bytes. Each node has a failure link to the node of what is
left when the longest pieces have been cut off its string, and the number of these pieces.
A word is then read once, byte by byte: where the trie has no edge, the node's count is
added and the failure link followed (Song et al., "Fast WordPiece Tokenization"). No
piece is ever built. Every single byte is a piece, so that every word can be cut.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, raw_bytes, table

#: A byte-level vocabulary file, a piece in base64 and a rank in each line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose lengths one task remembers at once.
REMEMBERED = 200_000


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Edges by ``node << 8 | byte``; for each node a failure link and the pieces it pops."""

    def __init__(self, vocabulary: Iterable[bytes]) -> None:
        self.edges: dict[int, int] = {}
        whole = [False]
        children: list[list[tuple[int, int]]] = [[]]
        for piece in sorted({*vocabulary, *(bytes([b]) for b in range(256))} - {b""}):
            node = 0
            for b in piece:
                step = self.edges.get(node << 8 | b)
                if step is None:
                    step = self.edges[node << 8 | b] = len(whole)
                    children[node].append((b, step))
                    whole.append(False)
                    children.append([])
                node = step
            whole[node] = True
        self.fail, self.popped = [0] * len(whole), [0] * len(whole)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for b, child in children[node]:
                if whole[child]:
                    self.popped[child] = 1  # the whole string is one piece, and nothing is left
                else:
                    at, pops = self.fail[node], self.popped[node]
                    while (step := self.edges.get(at << 8 | b)) is None:
                        pops += self.popped[at]
                        at = self.fail[at]
                    self.fail[child], self.popped[child] = step, pops
                queue.append(child)

    def length(self, word: bytes) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        node = pieces = 0
        for b in word:
            step = edges.get(node << 8 | b)
            while step is None:
                pieces += popped[node]
                node = fail[node]
                step = edges.get(node << 8 | b)
            node = step
        while node:
            pieces += popped[node]
            node = fail[node]
        return pieces


def count_tokens(docs: DataFrame, vocabulary: Iterable[bytes], prefix: bytes = b" ") -> DataFrame:
    """``(doc_id, n_words, n_tokens, n_bytes)`` of every row of ``docs(doc_id, text)``.

    Words are runs without ASCII white space; each is cut with ``prefix`` before it, as the
    vocabulary writes word beginnings. n_bytes counts the text's UTF-8. Null and empty texts
    have no tokens. Repeated rows repeat, a null doc_id stays null, other columns are
    ignored, an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary))  # as large as the vocabulary

    memory: dict[bytes, int] = {}

    def run(batch: pa.RecordBatch) -> dict:
        length = sent.value.length
        words, tokens, size = [], [], []
        for text in raw_bytes(batch.column(1)):
            found = text.split()
            if len(memory) > REMEMBERED:
                memory.clear()
            for w in set(found).difference(memory):
                memory[w] = length(prefix + w)
            words.append(len(found))
            tokens.append(sum(map(memory.__getitem__, found)))
            size.append(len(text))
        return {"doc_id": batch.column(0), "n_words": pa.array(words, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "n_bytes": pa.array(size, pa.int64())}

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(docs, run, "doc_id long, n_words long, n_tokens long, n_bytes long")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), read_vocabulary())
