"""Toxicity by nearest labelled examples: exact cosine of weighted TF-IDF over a block-max inverted index.

Terms are lower-case words. Every term that occurs in LEAST_TEXTS labelled texts or more is indexed, and every term,
indexed or not, counts in the norms of examples and queries. A term weighs (1 + log tf) * idf * relevance, where
relevance is a floor that all terms have plus the term's correlation with the label so far as it exceeds chance; with
the floor alone, which is plain TF-IDF, nearest texts are of like vocabulary rather than of like tone (figures in the
README).

Examples are rows in blocks; an inverted list keeps, besides its rows and weights, each block's largest weight. A
search adds these up to a bound for every block, opens the most promising blocks, and then all those whose bound
reaches the k-th best cosine so far, which makes the k nearest exact. Neighbours vote with weight
1 / (distance + 0.05); an isotonic map fitted on votes that leave the example itself out turns votes into
probabilities, and neighbours' ids and cosines are kept as evidence.

The fit reads at most about EXAMPLES labelled rows and indexes at most TERMS terms, the most frequent (documented
bounds); scoring reads every whole text.

Defined results: a null or empty text, and any text without an indexed term, scores the rate of toxic examples among
those without an indexed term; repeated rows score alike; equal cosines prefer the example that comes first in the
index; of repeated labelled rows of one id all are examples, and a vote that leaves one out leaves out all; no labels
at all give a score of 0; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Bounds of the fit: labelled examples, indexed terms, examples used to calibrate.
EXAMPLES, TERMS, CALIBRATION = 2_500, 1 << 18, 2_000
NEIGHBOURS, BLOCK, LEAST_TEXTS = 15, 128, 2
#: Relevance that every term has, and the standard errors of a correlation that count as chance.
FLOOR, CHANCE = 0.01, 4.0
#: Blocks opened before the first threshold; texts whose result a worker remembers.
FIRST, SEEN = 2, 20_000

_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> Counter:
    """Counts of the text's words."""
    return Counter(_WORD.findall((text or "").lower()))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    upto = np.cumsum(size)
    return np.repeat(start - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


class BlockMaxIndex:
    """Examples by term, cut into blocks of BLOCK examples with the largest weight per term and block.

    weights has the factor of every indexed term, other that of any other term; an example is (id, label, and what
    counts() returns for it).
    """

    def __init__(self, weights: dict[str, float], other: float, examples: list[tuple[int, int, np.ndarray, np.ndarray, float]]):
        self.terms = sorted(weights)
        self.number = {t: i for i, t in enumerate(self.terms)}
        self.weight = np.array([weights[t] for t in self.terms])
        self.other = other
        vectors = []
        for doc_id, y, term, n, rest in examples:
            if len(term):
                at, w = self.scaled(term, n, rest)
                heavy = np.lexsort((at, -w))[:3]
                vectors.append((tuple(at[heavy].tolist()), doc_id, y, at, w))
        vectors.sort(key=lambda x: x[:3])  # like vectors share blocks, which sharpens the bounds
        count = len(vectors)
        self.ids = np.array([x[1] for x in vectors], np.int64)
        self.y = np.array([x[2] for x in vectors], np.float64)
        self.rate = float(self.y.mean()) if count else 0.0
        self.blocks = -(-count // BLOCK)
        size = np.array([len(x[3]) for x in vectors], np.int64)
        term = np.concatenate([x[3] for x in vectors]) if count else np.empty(0, np.int64)
        row = np.repeat(np.arange(count), size)
        order = np.lexsort((row, term))
        self.row = row[order]
        self.value = (np.concatenate([x[4] for x in vectors]) if count else np.empty(0))[order]
        term = term[order]
        new = np.append(True, (term[1:] != term[:-1]) | (self.row[1:] // BLOCK != self.row[:-1] // BLOCK))[: len(term)]
        first = np.flatnonzero(new)
        # one entry per term and block: its block, largest weight, and range of postings; and each term's range of entries
        self.block = self.row[first] // BLOCK
        self.most = np.maximum.reduceat(self.value, first) if len(first) else np.empty(0)
        self.first, self.size = first, np.diff(np.append(first, len(term)))
        self.entry = np.searchsorted(term[first], np.arange(len(self.terms) + 1))
        self.posting = np.searchsorted(term, np.arange(len(self.terms) + 1))
        # lists of a quarter of all examples or more are kept as whole rows besides
        often = np.flatnonzero(np.diff(self.posting) * 4 >= max(count, 1))
        self.dense = np.full(len(self.terms), -1)
        self.dense[often] = np.arange(len(often))
        self.whole = np.zeros((len(often), count))
        for at, t in enumerate(often.tolist()):
            part = slice(self.posting[t], self.posting[t + 1])
            self.whole[at, self.row[part]] = self.value[part]

    def counts(self, found: dict[str, int]) -> tuple[np.ndarray, np.ndarray, float]:
        """Numbers and counts of the indexed terms, and the square sum of the other terms' weights."""
        term = np.fromiter(map(self.number.get, found, repeat(-1)), np.int64, len(found))
        n = np.fromiter(found.values(), np.int64, len(found))
        known = term >= 0
        rest = self.other**2 * float(((1 + np.log(n[~known])) ** 2).sum())
        return term[known], n[known], rest

    def scaled(self, term: np.ndarray, n: np.ndarray, rest: float) -> tuple[np.ndarray, np.ndarray]:
        """Indexed terms in order and their weights, normalised over all terms."""
        w = (1 + np.log(n)) * self.weight[term]
        w /= math.sqrt(float(w @ w) + rest)
        order = np.argsort(term)
        return term[order], w[order]

    def vector(self, found: dict[str, int]) -> tuple[np.ndarray, np.ndarray] | None:
        """A query's vector; None without any indexed term."""
        term, n, rest = self.counts(found)
        return self.scaled(term, n, rest) if len(term) else None

    def nearest(self, vector, k: int = NEIGHBOURS, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k best examples with a term of the query, best first, ties to the smaller row; exact.

        Examples of the id `without` are left out.
        """
        term, w = vector
        size = self.entry[term + 1] - self.entry[term]
        entry, weight = _ranges(self.entry[term], size), np.repeat(w, size)
        block = self.block[entry]
        bound = np.bincount(block, weights=weight * self.most[entry], minlength=self.blocks) * (1 + 1e-12)
        opened = np.zeros(self.blocks, bool)
        opened[np.argsort(-bound, kind="stable")[:FIRST]] = True
        opened &= bound > 0
        rows, sims = self._open(entry, weight, opened[block], k, without)
        more = ~opened & (bound > 0)
        if len(rows) >= k:
            more &= bound >= sims[k - 1]
        if more.any():
            if 2 * more.sum() > self.blocks:  # most of each list: whole slices are read faster than their parts
                return self._all(term, w, k, without)
            next_ = self._open(entry, weight, more[block], k, without)
            rows, sims = np.append(rows, next_[0]), np.append(sims, next_[1])
            best = np.lexsort((rows, -sims))[:k]
            rows, sims = rows[best], sims[best]
        return rows, sims

    def _open(self, entry, weight, chosen, k: int, without: int | None) -> tuple[np.ndarray, np.ndarray]:
        entry, weight = entry[chosen], weight[chosen]
        size = self.size[entry]
        at = _ranges(self.first[entry], size)
        return self._best(np.bincount(self.row[at], weights=np.repeat(weight, size) * self.value[at], minlength=1), k, without)

    def _all(self, term, w, k: int, without: int | None) -> tuple[np.ndarray, np.ndarray]:
        dense = self.dense[term]
        score = w[dense >= 0] @ self.whole[dense[dense >= 0]]
        term, w = term[dense < 0], w[dense < 0]
        low, high = self.posting[term], self.posting[term + 1]
        if len(term):
            parts = list(map(slice, low.tolist(), high.tolist()))
            row, value = np.concatenate([self.row[x] for x in parts]), np.concatenate([self.value[x] for x in parts])
            score += np.bincount(row, weights=np.repeat(w, high - low) * value, minlength=len(score))
        return self._best(score, k, without)

    def _best(self, score: np.ndarray, k: int, without: int | None) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(score)
        if without is not None:
            rows = rows[self.ids[rows] != without]
        sims = score[rows]
        if len(rows) > 4 * k:  # those under the k-th best are not sorted
            keep = sims >= np.partition(sims, len(sims) - k)[len(sims) - k]
            rows, sims = rows[keep], sims[keep]
        best = np.lexsort((rows, -sims))[:k]
        return rows[best], sims[best]


class ToxicityModel:
    """The index with its vote and calibration."""

    def __init__(self, index: BlockMaxIndex, silent: float):
        self.index, self.silent = index, silent
        self.steps = (np.array([0.0]), np.array([0.0]))
        self.seen: dict = {}

    def vote(self, rows, sims) -> float:
        """Share of the weight of toxic neighbours; where fewer than k share a term, the others are any examples, at distance 1."""
        w = 1 / (np.maximum(0, 1 - sims) + 0.05)
        others = (NEIGHBOURS - len(rows)) / 1.05
        return float(((w * self.index.y[rows]).sum() + others * self.index.rate) / (w.sum() + others))

    def calibrate(self, examples) -> None:
        """Isotonic steps of the label on votes that leave the example itself out."""
        pairs = []
        for doc_id, y, term, n, rest in examples[:CALIBRATION]:
            if len(term):
                rows, sims = self.index.nearest(self.index.scaled(term, n, rest), without=doc_id)
                if len(rows):
                    pairs.append((self.vote(rows, sims), y))
        by_vote: dict[float, list[int]] = {}  # sum of labels, count
        for vote, y in pairs:
            seen = by_vote.setdefault(round(vote, 9), [0, 0])
            seen[0] += y
            seen[1] += 1
        steps: list[list[float]] = []  # smallest vote, sum of labels, count; pooled while they fall
        for vote, (y, n) in sorted(by_vote.items()):
            steps.append([vote, y, n])
            while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
                _, s, n = steps.pop()
                steps[-1][1] += s
                steps[-1][2] += n
        if steps:
            self.steps = np.array([s[0] for s in steps]), np.array([(s[1] + 0.05) / (s[2] + 0.1) for s in steps])

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        """Probability, and the neighbours' ids and cosines."""
        key = hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
        found = self.seen.get(key)
        if found is None:
            if len(self.seen) >= SEEN:
                self.seen.clear()
            found = self.seen[key] = self._score(text)
        return found

    def _score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        vector = self.index.vector(terms_of(text))
        rows, sims = self.index.nearest(vector) if vector else ((), ())
        if not len(rows):
            return self.silent, [], []
        at = max(0, int(np.searchsorted(self.steps[0], round(self.vote(rows, sims), 9), side="right")) - 1)
        return float(self.steps[1][at]), self.index.ids[rows].tolist(), np.minimum(sims, 1.0).tolist()


def relevance(n, toxic, texts: int, toxic_texts: int) -> np.ndarray:
    """FLOOR plus the size of each term's correlation with the label beyond chance, from texts with the term."""
    n, toxic = np.asarray(n, np.float64), np.asarray(toxic, np.float64)
    spread = n * (texts - n) * toxic_texts * (texts - toxic_texts)
    phi = np.abs(toxic * texts - n * toxic_texts) / np.sqrt(np.where(spread > 0, spread, np.inf))
    return FLOOR + np.maximum(0.0, phi - CHANCE / math.sqrt(max(texts, 1)))


def fit(documents: DataFrame, labels: DataFrame, keep: Column, examples: int = EXAMPLES) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows that pass keep."""
    spark = documents.sparkSession
    common.prepare(spark)
    sample = common.labelled_sample(labels, "toxic", keep, examples)
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = common.stored(rows.select("doc_id", "text", "y"), "toxicity-examples")

    def counted(batches):
        n, toxic, total, total_toxic = Counter(), Counter(), 0, 0
        for batch in batches:
            for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist()):
                found = terms_of(text).keys()
                n.update(found)
                total += 1
                if y:
                    toxic.update(found)
                    total_toxic += 1
        n[""], toxic[""] = total, total_toxic
        yield pa.RecordBatch.from_pydict({"term": list(n), "n": list(n.values()), "toxic": [toxic[t] for t in n]})

    counts = common.text_map(rows, counted, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counts = common.stored(counts.where((F.col("n") >= LEAST_TEXTS) | (F.col("term") == "")), "toxicity-terms")
    total = counts.where("term = ''").collect()
    n, n_toxic = (total[0]["n"], total[0]["toxic"]) if total else (0, 0)
    chosen = counts.where("term <> ''").orderBy(F.desc("n"), "term").limit(TERMS).toArrow() if 0 < n_toxic < n else None
    if chosen is None:
        weights = {}
    else:
        of = np.asarray(chosen["n"])
        weight = (np.log((1 + n) / (1 + of)) + 1) * relevance(of, np.asarray(chosen["toxic"]), n, n_toxic)
        weights = dict(zip(chosen["term"].to_pylist(), weight.tolist()))
    other = (math.log(1 + n) + 1) * FLOOR
    index = BlockMaxIndex(weights, other, [])
    held = spark.sparkContext.broadcast(index)

    def vectors(batches):
        for batch in batches:
            found = [held.value.counts(terms_of(t)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["y"],
                    pa.array([f[0] for f in found], pa.list_(pa.int64())),
                    pa.array([f[1] for f in found], pa.list_(pa.int64())),
                    pa.array([f[2] for f in found], pa.float64()),
                ],
                ["doc_id", "y", "terms", "counts", "rest"],
            )

    got = common.text_map(rows, vectors, "doc_id long, y int, terms array<long>, counts array<long>, rest double").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], sorted(zip(r["terms"], r["counts"]))))
    found = [(r["doc_id"], r["y"], np.array(r["terms"], np.int64), np.array(r["counts"], np.int64), r["rest"]) for r in got]
    silent = [x[1] for x in found if not len(x[2])]
    model = ToxicityModel(BlockMaxIndex(weights, other, found), (sum(silent) + 0.01) / (len(silent) + 1) if found else 0.0)
    rng = np.random.default_rng(7)
    model.calibrate([found[i] for i in rng.permutation(len(found))])
    return model


def score_toxicity(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence_ids, evidence_cosines of every document.

    Labels of documents whose crc32(doc_id) modulo folds is `held` are never read; a null doc_id is not held out.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(fit(documents, labels, common.fold("doc_id", folds) != held))
    rows = documents.select("doc_id", F.coalesce(common.fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "text")

    def scored(batches):
        for batch in batches:
            found = [model.value.score(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["held_out"],
                    pa.array([f[0] for f in found], pa.float64()),
                    pa.array([int(f[0] >= 0.5) for f in found], pa.int32()),
                    pa.array([f[1] for f in found], pa.list_(pa.int64())),
                    pa.array([f[2] for f in found], pa.list_(pa.float64())),
                ],
                ["doc_id", "held_out", "score", "predicted", "evidence_ids", "evidence_cosines"],
            )

    return common.text_map(rows, scored, "doc_id long, held_out boolean, score double, predicted int, evidence_ids array<long>, evidence_cosines array<double>")


def keep_clean(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, most: float = 0.5) -> DataFrame:
    """The rows of documents, all columns, whose score is under `most`; nothing is shuffled."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, common.fold("doc_id", folds) != held))

    def kept(batches):
        for batch in batches:
            yield batch.filter(pa.array([model.value.score(t)[0] < most for t in batch["text"].to_pylist()], pa.bool_()))

    return common.text_map(documents, kept, documents.schema)
