"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed words. The score is linear in the terms and, through a
short vector for each, in all their pairs (Rendle, "Factorization Machines"), so that two
terms can be toxic together that are harmless alone. It is trained by gradient descent on
a bounded sample of labelled documents outside the held-out fold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, raw_bytes, table

_LETTERS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
#: Hashes of words that one task remembers at once.
REMEMBERED = 200_000


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learnt from; a null id is in it."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def terms(text: bytes) -> set[bytes]:
    return set(text.lower().translate(_LETTERS).split())


def term_hashes(term: bytes) -> tuple[int, ...]:
    """Of the term, and of its first four and five bytes, which its inflected forms share."""
    return (xxhash.xxh64_intdigest(term, 9), *(xxhash.xxh64_intdigest(term[:k], k) for k in (4, 5) if len(term) >= k))


def hashes(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's terms, in rising order."""
    return np.array(sorted({h for t in terms(text) for h in term_hashes(t)}), np.uint64)


@dataclass
class Machine:
    """Weights of the known terms, whose hashes are ``keys`` in rising order."""

    keys: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, known: np.ndarray) -> float:
        """Probability of label 1 of a document with these places of known terms."""
        v = self.factors[known]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        z = self.bias + float(self.linear[known].sum()) + pairs
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))


def telling(documents: list[np.ndarray], labels: np.ndarray, least: int, chi: float) -> np.ndarray:
    """Hashes, in rising order, of the terms whose presence goes with the label: chi-squared of ``chi`` or more."""
    if not documents:
        return np.empty(0, np.uint64)
    whole = np.concatenate(documents)
    keys, place = np.unique(whole, return_inverse=True)
    label = np.repeat(labels, np.fromiter(map(len, documents), np.int64, len(documents)))
    have, bad = np.bincount(place, minlength=len(keys)), np.bincount(place, label, minlength=len(keys))
    n, all_bad = len(documents), labels.sum()
    off = n * bad - have * all_bad
    value = off**2 / np.maximum(have * (n - have) * all_bad * (n - all_bad), 1e-9) * n
    return keys[(have >= least) & (value >= chi)]


def telling_pairs(documents: list[np.ndarray], labels: np.ndarray, cell: int, chi: float, block: int = 1024) -> np.ndarray:
    """Hashes, in rising order, of the terms that tell together: of some pair the label's share with both, with one, the other and none departs from a sum.

    The departure's square over its variance must be ``chi`` or more, and each of the four
    cases hold ``cell`` documents. Terms that alone tell nothing are found so. Only terms that
    chance puts with one as frequent in ``cell`` documents can be judged; all of these are.
    """
    n = len(documents)
    if not n:
        return np.empty(0, np.uint64)
    keys, have = np.unique(np.concatenate(documents), return_counts=True)
    keys = keys[(have >= np.sqrt(cell * n)) & (have <= n - cell)]
    share = float(labels.mean())
    if not len(keys) or share in (0.0, 1.0):
        return np.empty(0, np.uint64)
    present = np.zeros((n, len(keys)), np.float32)
    for i, d in enumerate(documents):
        at = np.minimum(np.searchsorted(keys, d), len(keys) - 1)
        present[i, at[keys[at] == d]] = 1
    bad = labels.astype(np.float32)[:, None]
    have, have_bad = present.sum(0), (present * bad).sum(0)
    found = np.zeros(len(keys), bool)
    for s in range(0, len(keys), block):
        part = present[:, s : s + block]
        both, both_bad = part.T @ present, (part * bad).T @ present
        mine, mine_bad = have[s : s + block, None], have_bad[s : s + block, None]
        counts = np.stack([both, mine - both, have - both, n - mine - have + both])
        bads = np.stack([both_bad, mine_bad - both_bad, have_bad - both_bad, bad.sum() - mine_bad - have_bad + both_bad])
        rate = bads / np.maximum(counts, 1)
        off = rate[0] - rate[1] - rate[2] + rate[3]
        value = off**2 / (share * (1 - share) * (1 / np.maximum(counts, 1)).sum(0))
        tells = (value >= chi) & (counts.min(0) >= cell)
        found[s : s + block] |= tells.any(1)
        found |= tells.any(0)
    return keys[found]


def fit(documents: list[np.ndarray], labels: np.ndarray, factors: int = 4, epochs: int = 40, rate: float = 0.03, decay: tuple[float, float] = (3e-4, 3e-3), least: int = 5, chi: float = 15.0, cell: int = 10, pair_chi: float = 40.0, floor: float = 3e-3, batch: int = 256, seed: int = 5) -> Machine:
    """Train on arrays of distinct term hashes, of which those that tell, alone or in a pair, are known.

    ``decay`` pulls the linear weights and the factors to zero; factors move a fifth as fast.
    Steps shrink for terms whose slopes stay below ``floor``, the rare ones.
    """
    draw = np.random.default_rng(seed)
    keys = np.union1d(telling(documents, labels, least, chi), telling_pairs(documents, labels, cell, pair_chi))
    n, share = len(keys), float(np.mean(labels)) if len(labels) else 0.0
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3))) if len(labels) else -3.0
    params = np.concatenate([np.zeros((n, 1)), draw.normal(0, 0.01, (n, factors))], axis=1)
    if not n or share in (0.0, 1.0):
        return Machine(keys, bias, params[:, 0], params[:, 1:])
    known = []
    for d in documents:
        at = np.searchsorted(keys, d)
        at[at == n] = 0
        known.append(at[keys[at] == d])
    first, second = np.zeros_like(params), np.zeros_like(params)
    pull = np.array([decay[0]] + [decay[1]] * factors)
    rates = rate * np.array([1.0] + [0.2] * factors)
    move = 0
    for _ in range(epochs):
        order = draw.permutation(len(known))
        for s in range(0, len(order), batch):
            rows = [known[i] for i in order[s : s + batch]]
            y = labels[order[s : s + batch]]
            at = np.concatenate(rows)
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            doc = np.repeat(np.arange(len(rows)), sizes)
            p = params[at]
            sums = np.stack([np.bincount(doc, p[:, k], minlength=len(rows)) for k in range(factors + 1)], axis=1)
            squares = np.bincount(doc, (p[:, 1:] ** 2).sum(1), minlength=len(rows))
            z = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)
            miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(rows)
            bias -= rate * 10 * float(miss.sum())
            slope = np.empty_like(p)
            slope[:, 0] = miss[doc]
            slope[:, 1:] = miss[doc][:, None] * (sums[doc, 1:] - p[:, 1:])
            total = np.stack([np.bincount(at, slope[:, k], minlength=n) for k in range(factors + 1)], axis=1)
            total += pull * params
            move += 1
            first = 0.9 * first + 0.1 * total
            second = 0.999 * second + 0.001 * total**2
            params -= rates * (first / (1 - 0.9**move)) / (np.sqrt(second / (1 - 0.999**move)) + floor)
    return Machine(keys, bias, params[:, 0], params[:, 1:])


def training_sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Term hashes and labels of at most ``sample`` documents outside the held-out fold, drawn by a hash of the id."""
    drawn = (
        labels.where("toxic is not null and doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__toxic"))
        .where(~held_out(F.col("__id")))
        .orderBy(F.xxhash64("__id"), "__id", "__toxic")
        .limit(sample)
    )

    def run(batch: pa.RecordBatch) -> dict:
        blobs = [hashes(x).tobytes() for x in raw_bytes(batch.column(2))]
        return {"id": batch.column(0), "toxic": batch.column(1), "terms": pa.array(blobs, pa.binary())}

    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("__id")).select("__id", "__toxic", F.col("text").cast("string").alias("text"))
    rows = sorted(map(tuple, map_arrow(joined, run, "id long, toxic int, terms binary").collect()))[:sample]
    return [np.frombuffer(r[2], np.uint64) for r in rows], np.array([float(r[1] == 1) for r in rows])


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs(doc_id, text)``, over the whole text.

    At most ``sample`` labelled documents, with all their terms, train the machine. Null and empty texts score as a document without terms. Repeated rows score
    alike, a null doc_id stays null and counts as held out, other columns are ignored, an
    empty table gives no rows; without labels every score is the one of no knowledge, low.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(*training_sample(docs, labels, sample)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known: dict[int, int] = {}
    places: dict[bytes, list[int]] = {}  # of a term's hashes among the known ones

    def run(batch: pa.RecordBatch) -> dict:
        machine = sent.value
        if not known:
            known.update(zip(machine.keys.tolist(), range(len(machine.keys))))
        scores = []
        for text in raw_bytes(batch.column(1)):
            found = terms(text)
            if len(places) > REMEMBERED:
                places.clear()
            for t in found.difference(places):
                places[t] = [known[h] for h in term_hashes(t) if h in known]
            scores.append(machine.score(np.array(sorted({p for t in found for p in places[t]}), np.int64)))
        return {"doc_id": batch.column(0), "score": pa.array(scores, pa.float64())}

    scored = map_arrow(docs, run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """score_toxicity() of the whole documents table, trained on a sample of its labels."""
    return score_toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
