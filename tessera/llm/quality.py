"""Quality rules and line labelling.

Fixed rules reject what is too short or too repetitive. For the rest a linear-chain
conditional random field labels each line as content or boilerplate from a few binary
features of the line; Viterbi decoding gives the best labelling of the whole document,
and the share of words on content lines decides whether it stays. The field is trained
here, on a bounded sample of labelled documents, by gradient ascent on its conditional
likelihood. Labels are known of documents only, so the labels of lines are hidden: a stated
share of a document's lines must be expected to have its label, and the field learns by
what it expects of the lines with that constraint and without (posterior regularisation,
Ganchev et al.). Weights start from, and are drawn towards, a stated prior, which stands
alone where nothing is labelled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, raw_bytes, table

_SYMBOLS = b"#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
#: Fixed phrases of page furniture, in lower case.
_FURNITURE = (b"http://", b"https://", b"www.", b"cookie", b"subscribe", b"click here", b"sign in", b"log in", b"all rights reserved", b"copyright", b"privacy policy", b"terms of use", b"terms of service", b"javascript")

#: Line features, in bit order, and each one's prior log-odds for boilerplate; the last two are bias and staying in a state.
FEATURES = ("symbols >= 5 %", "symbols >= 1 %", "all upper case", "words repeat", "line repeats", "<= 3 words", ">= 12 words", "sentence end", "bars", "digits >= 20 %", "furniture", "!!")
PRIOR = np.array([2.0, 0.5, 1.5, 2.0, 1.0, 0.3, -0.5, -0.5, 1.0, 0.5, 1.0, 1.0, -1.5, 1.0])


def line_code(line: bytes, repeats: bool, furniture: list[bytes]) -> tuple[int, int]:
    """Bits of FEATURES for a line, and its number of words."""
    words = line.split()
    n, size = len(words), len(line) or 1
    symbols = len(line) - len(line.translate(None, _SYMBOLS))
    code = 0
    if symbols:
        code = (symbols * 20 >= size) | (symbols * 100 >= size) << 1 | (b"|" in line) << 8
    if n >= 3 and line.decode("utf-8", "replace").isupper():
        code |= 4
    if n >= 6 and len(set(words)) * 2 < n:
        code |= 8
    code |= repeats << 4 | (n <= 3) << 5 | (n >= 12) << 6
    if n:
        code |= (words[-1][-1:] in b".!?") << 7
    if (len(line) - len(line.translate(None, b"0123456789"))) * 5 >= size:
        code |= 1 << 9
    if furniture and any(x in line.lower() for x in furniture):
        code |= 1 << 10
    if b"!!" in line:
        code |= 1 << 11
    return code, n


def line_codes(text: bytes) -> tuple[list[int], list[int]]:
    """Feature codes and word counts of the lines that have a word."""
    codes, sizes, seen = [], [], set()
    low = text.lower()
    furniture = [x for x in _FURNITURE if x in low]
    for line in text.split(b"\n"):
        if line.strip():
            code, n = line_code(line, line in seen, furniture)
            seen.add(line)
            codes.append(code)
            sizes.append(n)
    return codes, sizes


def emission_table(weights: np.ndarray) -> list[float]:
    """Log-odds for boilerplate of every feature code."""
    k = len(FEATURES)
    bits = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
    return (bits @ weights[:k] + weights[k]).tolist()


def viterbi(codes: list[int], odds: list[float], stay: float) -> list[int]:
    """The best labels, 1 for boilerplate; ties go to content. ``stay`` is the gain of keeping a label."""
    back = []
    lead = 0.0  # score of the best path that ends in boilerplate, less that of content
    for i, c in enumerate(codes):
        if i:
            back.append((lead + stay > 0, lead > stay))
            lead = max(lead + stay, 0.0) - max(lead, stay)
        lead += odds[c]
    out = [int(lead > 0)]
    for to_bad, to_good in reversed(back):
        out.append(int(to_bad if out[-1] else to_good))
    return out[::-1] if codes else []


def expectations(unary: np.ndarray, stay: float, live: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Chance of boilerplate of each line, and of each two neighbours having one label, by forward and backward log-odds.

    A column is a sequence, the longest first; ``live`` has the number that reach each row.
    """
    ahead, behind = np.zeros_like(unary), np.zeros_like(unary)
    bad, kept = np.zeros_like(unary), np.zeros_like(unary)
    pass_on = lambda d: np.logaddexp(d + stay, 0) - np.logaddexp(d, stay)
    for j in range(1, len(live)):
        n = live[j]
        ahead[j, :n] = pass_on(ahead[j - 1, :n] + unary[j - 1, :n])
    for j in range(len(live) - 2, -1, -1):
        n = live[j + 1]
        behind[j, :n] = pass_on(behind[j + 1, :n] + unary[j + 1, :n])
        left, right = ahead[j, :n] + unary[j, :n], unary[j + 1, :n] + behind[j + 1, :n]
        same = np.logaddexp(left + right, 0) + stay - np.logaddexp(left, right)
        kept[j, :n] = 1 / (1 + np.exp(-np.clip(same, -40, 40)))
    for j, n in enumerate(live):
        bad[j, :n] = 1 / (1 + np.exp(-np.clip(ahead[j, :n] + unary[j, :n] + behind[j, :n], -40, 40)))
    return bad, kept


def train(sequences: list[list[int]], labels: list[int], agree: float = 0.6, rounds: int = 100, pull: float = 1.0, cut: int = 64) -> np.ndarray:
    """Weights of the field (features, bias, stay) from feature codes and a label for each sequence, 1 for boilerplate.

    Which lines have their sequence's label is hidden; of each sequence the share ``agree`` of
    the lines must be expected to. Where it falls short, all lines of the sequence are
    urged towards the label, the more the longer that lasts. The slope is what the field
    expects of each feature so urged less what it expects by itself.
    """
    pieces = [(s[i : i + cut], y) for s, y in zip(sequences, labels) for i in range(0, len(s), cut)]
    weights = PRIOR.copy()
    if not pieces:
        return weights
    pieces.sort(key=lambda p: -len(p[0]))
    k, n, t = len(FEATURES), len(pieces), len(pieces[0][0])
    codes = np.zeros((t, n), np.int64)
    for i, (s, _) in enumerate(pieces):
        codes[: len(s), i] = s
    live = [sum(len(s) > j for s, _ in pieces) for j in range(t)]
    is_bad = np.array([bool(v) for _, v in pieces])
    sizes = np.array([len(s) for s, _ in pieces])
    urged = np.zeros(n)
    bits = np.concatenate([((np.arange(1 << k)[:, None] >> np.arange(k)) & 1), np.ones((1 << k, 1))], axis=1)
    lines = sum(live)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        unary = (bits @ weights[:-1])[codes]
        known_bad, known_kept = expectations(unary + np.where(is_bad, urged, -urged), weights[-1], live)
        share = known_bad.sum(0) / sizes
        urged = np.clip(urged + 2 * (agree - np.where(is_bad, share, 1 - share)), 0, 8)
        bad, kept = expectations(unary, weights[-1], live)
        by_code = np.bincount(codes.ravel(), (known_bad - bad).ravel(), minlength=1 << k)
        slope = np.append(by_code @ bits, (known_kept - kept).sum()) / lines - pull * (weights - PRIOR) / max(lines, 1000)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights = weights + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights[-1] = max(weights[-1], 0.0)
    return weights


def repeated_words(words: list[bytes], span: int = 8) -> int:
    """Words inside windows of ``span`` words that the text has twice or more."""
    n = len(words)
    if n <= span:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    size = 1
    while size < span:  # span is a power of two
        h = h[:-size] * np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64)) + h[size:]
        size *= 2
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    found = np.isin(h, twice)
    edge = np.zeros(n + 1, np.int64)
    edge[: len(found)] += found
    edge[span : span + len(found)] -= found
    return int((np.cumsum(edge)[:n] > 0).sum())


def judge(text: bytes, odds: list[float], stay: float, least_share: float = 0.5) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share) of a text."""
    words = text.split()
    n = len(words)
    shown = text.decode("utf-8")
    chars = len(shown) - sum(map(shown.count, _SPACES))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    codes, sizes = line_codes(text)
    doubles = sum(c >> 4 & 1 for c in codes)
    again = repeated_words(words)
    failed = n < 20 or 100 * again > 30 * n
    content = sum(s for s, bad in zip(sizes, viterbi(codes, odds, stay)) if not bad)
    share = content / n if n else 0.0
    return n, chars, symbols, doubles, again, failed, not failed and share >= least_share, share


def labelled_lines(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[list[int]], list[int]]:
    """Feature codes and quality labels of at most ``sample`` labelled documents, drawn by a hash of the id."""
    drawn = (
        labels.where("quality is not null and doc_id is not null")
        .select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__quality"))
        .orderBy(F.xxhash64("__id"), "__id", "__quality")
        .limit(sample)
    )

    def run(batch: pa.RecordBatch) -> dict:
        codes = [line_codes(x)[0] for x in raw_bytes(batch.column(2))]
        return {"id": batch.column(0), "quality": batch.column(1), "codes": pa.array(codes, pa.list_(pa.int32()))}

    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("__id")).select("__id", "__quality", F.col("text").cast("string").alias("text"))
    rows = sorted(map(tuple, map_arrow(joined, run, "id long, quality int, codes array<int>").collect()))[:sample]
    return [list(r[2]) for r in rows], [int(r[1] == 0) for r in rows]


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = 3000, least_share: float = 0.5) -> DataFrame:
    """Rule counts and verdict of every row of ``docs(doc_id, text)``.

    At most ``sample`` labelled documents, with all their lines, train the field; all rows
    are judged, over their whole texts. Null counts as an empty text, which fails. Repeated rows
    get equal verdicts, a null doc_id stays null, other columns are ignored, an empty table
    gives an empty result, and empty labels leave the prior weights.
    """
    weights = train(*labelled_lines(docs, labels, sample))
    odds, stay = emission_table(weights), float(weights[-1])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")

    def run(batch: pa.RecordBatch) -> dict:
        rows = [judge(x, odds, stay, least_share) for x in raw_bytes(batch.column(1))]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        return {"doc_id": batch.column(0)} | {n: pa.array([r[k] for r in rows], kinds[k]) for k, n in enumerate(names)}

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(docs, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 3000, least_share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules and the field keep, with all their columns and no shuffle."""
    weights = train(*labelled_lines(docs, labels, sample))
    odds, stay = emission_table(weights), float(weights[-1])
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([bool(judge(x, odds, stay, least_share)[6]) for x in raw_bytes(batch.column(at))], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """score_quality() of the whole documents table, trained on a sample of its labels."""
    return score_quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
