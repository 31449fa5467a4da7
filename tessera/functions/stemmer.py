"""The English (Porter2) stemmer and the full-text analyzer built on it.

Stems are found once for each distinct word of a batch and remembered; nothing is shuffled by word.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
#: Words with stems of their own, fixed values of the published algorithm.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Suffixes of steps 2, 3 and 4, fixed values of the published algorithm.
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _region(word: str, start: int = 0) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w) < 3:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = w.removeprefix("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWELS) else c for i, c in enumerate(w))
    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(w)
    r2 = _region(w, r1)

    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and any(c in _VOWELS for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"

    end = _longest(w, _STEP2)
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)]
        if end == "ogi":
            w = before + "og" if before.endswith("l") else w
        elif end == "li":
            w = before if before and before[-1] in _LI else w
        else:
            w = before + _STEP2[end]
    end = _longest(w, _STEP3)
    if end and len(w) - len(end) >= r1 and (end != "ative" or len(w) - len(end) >= r2):
        w = w[: -len(end)] + _STEP3[end]
    end = _longest(w, _STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def fold_ascii(word: str) -> str:
    """Without accents, where what is left is ASCII."""
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


_TOKEN = re.compile(r"[^\W_]+")


def analyze(text: str | None, stop: frozenset[str] | set[str] = frozenset()) -> list[str]:
    """Simple tokens, folded, without stop words, stemmed."""
    return [stem(w) for t in _TOKEN.findall(text or "") if (w := fold_ascii(t.lower())) and w not in stop]


def analyzed_terms(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """The terms of each text, null for null: for questions, which are few; analyzed_postings() is for chunks."""
    words = frozenset(stop)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else analyze(t, words))

    return run(text)


#: Words whose stems a worker remembers at most; then it begins anew.
REMEMBERED = 1 << 18


def stem_terms(words: Column, stop: tuple[str, ...] = ()) -> Column:
    """Arrays of words folded and stemmed, without those that fold to a stop word or to nothing.

    Each batch stems its distinct words once and each worker remembers them, so nothing is
    shuffled by word, however frequent one is. A null array is empty.
    """
    left_out, memory = frozenset(stop), {}

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        if len(memory) > REMEMBERED:
            memory.clear()
        distinct = coded.dictionary.to_pylist()
        for w in distinct:
            if w is not None and w not in memory:
                folded = fold_ascii(w)
                memory[w] = stem(folded) if folded and folded not in left_out else None
        terms = pa.array([memory.get(w) for w in distinct], pa.string()).take(coded.indices)
        kept = np.concatenate([[0], np.cumsum(terms.is_valid().to_numpy(zero_copy_only=False))])
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
        return pa.ListArray.from_arrays(pa.array(kept[ends], pa.int32()), terms.drop_null())

    return run(words)


def analyzed_postings(chunks: DataFrame, text: Column, stop: tuple[str, ...]) -> DataFrame:
    """``(chunk_id, term, tf)`` of chunks; stop words go before anything leaves the JVM."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*stop))
    return chunks.select("chunk_id", F.explode(stem_terms(words, stop)).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
