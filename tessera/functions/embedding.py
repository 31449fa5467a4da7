"""Embedders. The default makes a fixed vector of a text's digest, so that equal texts are nearest."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_vector(text: str, dimensions: int) -> list[float]:
    seed, data = hashlib.sha256(text.encode()).digest(), b""
    while len(data) < dimensions:
        data += seed
        seed = hashlib.sha256(seed).digest()
    return ((np.frombuffer(data[:dimensions], np.uint8) - 127.5) / 127.5).tolist()


def hash_embed(text: Column, dimensions: int = 64) -> Column:
    return embed(text, lambda texts: [hash_vector(t, dimensions) for t in texts])


def embedded(text: Column, embedder: Callable[[Sequence[str]], list[list[float]]], batch: int = 256) -> Column:
    """``struct<vector, code>`` of any function of a list of texts; a null text has neither.

    A batch that fails is tried text by text, so that one bad text costs no other its vector; a
    text that fails alone, or gets no list of finite numbers, has the code ``embedding-failed:``
    and the name of the error.
    """

    def one(texts: list[str]) -> list[list[float]]:
        out = [[float(x) for x in v] for v in embedder(texts)]
        if len(out) != len(texts) or not all(v and np.isfinite(v).all() for v in out):
            raise ValueError("an embedder must give a vector of finite numbers for each text")
        return out

    @F.pandas_udf("vector array<float>, code string")
    def run(s: pd.Series) -> pd.DataFrame:
        vectors, codes = [None] * len(s), [None] * len(s)
        there = [i for i, t in enumerate(s) if t is not None]
        todo = [there[k : k + batch] for k in range(0, len(there), batch)]
        while todo:
            part = todo.pop()
            try:
                for i, v in zip(part, one([s.iloc[i] for i in part]), strict=True):
                    vectors[i] = v
            except Exception as e:  # noqa: BLE001  whatever a model raises, its rows say so
                if len(part) > 1:
                    todo += [[i] for i in part]
                else:
                    codes[part[0]] = f"embedding-failed:{type(e).__name__}"
        return pd.DataFrame({"vector": vectors, "code": codes})

    return run(text)


def embed(text: Column, embedder: Callable[[Sequence[str]], list[list[float]]], batch: int = 256) -> Column:
    """The vectors of embedded(); null where there is none. Keep embedded() where the reason counts."""
    return embedded(text, embedder, batch)["vector"]
