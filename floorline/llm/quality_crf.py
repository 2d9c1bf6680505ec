"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. A line's emission reads statistics of the line and of its two neighbours; a 2 x 2
matrix weighs transitions. Labels exist per document only, so the field is trained by what they imply: all
lines of a good document are good, some line of a bad one is bad (log-likelihood of these two events, whose
gradients come from forward-backward). A document's badness is the length-weighted mean of its lines'
marginals; a logistic map fitted on the training documents turns it into the score.

The fit reads about EXAMPLES labelled documents of at most LINES lines (documented bounds); scoring reads every
line of every text.

Defined results: a null or empty text is one empty line; line weights are UTF-8 bytes plus one; repeated rows
score alike; without labels of both kinds every score is the share of good labels (1 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

EXAMPLES, LINES = 6000, 200
#: Bytes of text whose line statistics are taken together.
CHUNK = 1 << 20
ROUNDS, STEP, SHRINK = 150, 0.15, 1e-3

_KIND = np.zeros(256, np.uint8)  # 1 space, 2 symbol, 3 bar, 4 upper, 5 digit, 6 shout, 7 other mark
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[list(b"#*$%&<>@^~{}[]\\=_+")] = 2
_KIND[ord("|")] = 3
_KIND[65:91] = 4
_KIND[48:58] = 5
_KIND[list(b"!?")] = 6
_KIND[list(b".,;:'\"()-/`")] = 7
#: Statistics of a line and the factor that brings each to about 0..1 (fixed values).
SCALE = np.array([4.0, 8.0, 2.0, 4.0, 6.0, 3.0, 1.0, 1.0, 1.0, 1.0])
WIDTH = len(SCALE)
_rng = np.random.default_rng(5)
_BYTE = _rng.integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 62, 4096, dtype=np.uint64) | np.uint64(1)


def line_statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics per line, weight per line, first line of each text and the total)."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _KIND[buffer]
    ends = np.flatnonzero(buffer == 10)
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    text_start = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, text_start)
    n = len(starts)
    stats = np.zeros((n, WIDTH))
    length = np.maximum(1, size)
    for k in range(2, 8):
        stats[:, k - 2] = np.add.reduceat((kind == k).astype(np.int32), starts) / length
    stats[:, 8] = 1.0  # without words
    solid = kind != 1
    begin = np.flatnonzero(solid & np.append(True, ~solid[:-1]))
    if len(begin):
        place = np.zeros(len(buffer), np.int64)
        place[begin[0] :] = np.arange(begin[0], len(buffer)) - np.repeat(begin, np.diff(np.append(begin, len(buffer))))
        codes = np.where(solid, _BYTE[buffer] * _PLACE[place & 4095], np.uint64(0))
        word = np.add.reduceat(codes, begin)
        line = np.searchsorted(starts, begin, side="right") - 1
        words = np.bincount(line, minlength=n)
        same = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
        stats[:, 6] = np.bincount(line[1:][same], minlength=n) / np.maximum(1, words)
        order = np.lexsort((word, line))
        fresh = np.append(True, (word[order][1:] != word[order][:-1]) | (line[order][1:] != line[order][:-1]))
        distinct = np.bincount(line[order][fresh], minlength=n)
        stats[:, 7] = np.where(words >= 8, 1 - distinct / np.maximum(1, words) ** 0.9, 0).clip(0, 1)
        stats[:, 8] = (words == 0) * 1.0
    stats[:, 9] = size < 20
    return np.minimum(1.0, stats * SCALE), (size + 1).astype(np.float64), first


def emissions(stats: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own, previous and next statistics of each line, flags of a text's first and last line, and 1."""
    n = len(stats)
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    head[first[:-1]] = True
    tail[first[1:] - 1] = True
    before, after = np.roll(stats, 1, axis=0), np.roll(stats, -1, axis=0)
    before[head] = 0
    after[tail] = 0
    return np.hstack([stats, before, after, head[:, None], tail[:, None], np.ones((n, 1))])


class Chains:
    """Forward-backward over many chains at once, longest first, so that each step is one array operation."""

    def __init__(self, first: np.ndarray):
        self.first, self.size = first[:-1], np.diff(first)
        self.order = np.argsort(-self.size, kind="stable")
        self.top = int(self.size.max(initial=0))
        sizes = self.size[self.order]
        self.live = [self.first[self.order[: int(np.searchsorted(-sizes, -t, side="left"))]] + t for t in range(self.top)]
        self.last = self.first + self.size - 1
        self.chain = np.repeat(np.arange(len(self.size)), self.size)

    def run(self, bad: np.ndarray, move: np.ndarray):
        """Log marginal scores: (forward, backward, log Z per chain) for emission `bad` of state 1 and matrix `move`."""
        e = np.stack([np.zeros_like(bad), bad], axis=1)
        a, b = e.copy(), np.zeros_like(e)
        for rows in self.live[1:]:
            p = a[rows - 1]
            a[rows] += np.logaddexp(p[:, :1] + move[0], p[:, 1:] + move[1])
        for rows in self.live[:0:-1]:
            q = b[rows] + e[rows]
            b[rows - 1] = np.logaddexp(q[:, :1] + move[:, 0], q[:, 1:] + move[:, 1])
        z = np.logaddexp(a[self.last, 0], a[self.last, 1])
        return e, a, b, z

    def marginals(self, bad, move) -> np.ndarray:
        _, a, b, z = self.run(bad, move)
        return np.exp(np.minimum(0, a[:, 1] + b[:, 1] - z[self.chain]))


class Field:
    """Weights of the field and of the map from badness to score."""

    def __init__(self, weights=None, move=None, scale=0.0, shift=0.0):
        self.weights, self.move, self.scale, self.shift = weights, move, scale, shift

    def train(self, x: np.ndarray, first: np.ndarray, weight: np.ndarray, good: np.ndarray) -> None:
        chains = Chains(first)
        params = np.zeros(x.shape[1] + 4)
        m, v = np.zeros_like(params), np.zeros_like(params)
        share = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum())
        follows = np.ones(len(x), bool)
        follows[first[:-1]] = False
        rows = np.flatnonzero(follows)
        for t in range(1, ROUNDS + 1):
            w, move = params[:-4], params[-4:].reshape(2, 2)
            e, a, b, z = chains.run(x @ w, move)
            steps = chains.size - 1
            p = np.minimum(steps * move[0, 0] - z, -1e-9)  # log P(every line good)
            pull = share * np.where(good, 1.0, -np.exp(p - np.log(-np.expm1(p))))
            up = pull[chains.chain]
            grad = np.empty_like(params)
            grad[:-4] = -(up * np.exp(a[:, 1] + b[:, 1] - z[chains.chain])) @ x
            for i in range(2):
                for j in range(2):
                    joint = np.exp(a[rows - 1, i] + move[i, j] + e[rows, j] + b[rows, j] - z[chains.chain[rows]])
                    grad[-4 + 2 * i + j] = -(up[rows] * joint).sum() + ((pull * steps).sum() if i == j == 0 else 0)
            grad -= SHRINK * params
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            params = params + STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.weights, self.move = params[:-4], params[-4:].reshape(2, 2)
        x1, y = self.badness(x, first, weight), good.astype(float)
        beta = np.zeros(2)
        design = np.stack([x1, np.ones_like(x1)], axis=1)
        for _ in range(30):
            q = 1 / (1 + np.exp(-(design @ beta).clip(-30, 30)))
            hess = (design * (q * (1 - q))[:, None]).T @ design + 1e-2 * np.eye(2)
            beta = beta + np.linalg.solve(hess, design.T @ (y - q) - 1e-2 * beta).clip(-2, 2)
        self.scale, self.shift = beta

    def badness(self, x, first, weight) -> np.ndarray:
        """Log odds of the length-weighted mean marginal of a bad line."""
        chains = Chains(first)
        p = chains.marginals(x @ self.weights, self.move)
        mean = np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        return np.log((mean + 1e-3) / (1 - mean + 1e-3))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.shift)
        stats, weight, first = line_statistics(texts) if len(texts) > 1 or len(texts[0]) <= CHUNK else _in_pieces(texts[0])
        x = emissions(stats, first)
        return 1 / (1 + np.exp(-(self.scale * self.badness(x, first, weight) + self.shift).clip(-30, 30)))


def _in_pieces(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_statistics of one long text, of about CHUNK bytes of whole lines at a time."""
    found, at = [], 0
    while at <= len(text):
        end = text.find(b"\n", at + CHUNK)
        end = len(text) if end < 0 else end
        found.append(line_statistics([text[at:end]])[:2])
        at = end + 1
    stats, weight = (np.concatenate(c) for c in zip(*found))
    return stats, weight, np.array([0, len(stats)])


def chunks(texts: list[bytes | None]):
    """Texts in runs of about CHUNK bytes, longer texts alone; null as empty."""
    part, size = [], 0
    for t in texts:
        t = t or b""
        if part and size + len(t) > CHUNK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def fit(documents: DataFrame, labels: DataFrame, keep: Column, examples: int = EXAMPLES) -> Field:
    """Train on a bounded sample of the labelled rows that pass keep."""
    common.prepare(documents.sparkSession)
    sample = common.labelled_sample(labels, "quality", keep, examples)
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id")

    def work(batches):
        for batch in batches:
            out = []
            for doc_id, text, y in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["y"].to_pylist()):
                if text.count(b"\n") < LINES:
                    stats, weight, _ = line_statistics([text])
                    out.append((doc_id, y, stats.astype(np.float32).tobytes(), weight.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array([o[0] for o in out], pa.int64()), "y": pa.array([o[1] for o in out], pa.int32()), "stats": pa.array([o[2] for o in out], pa.binary()), "weight": pa.array([o[3] for o in out], pa.binary())}
            )

    got = sorted(common.text_map(rows, work, "doc_id long, y int, stats binary, weight binary").collect())
    good = np.array([r["y"] == 1 for r in got], bool)
    field = Field(shift=float(good.mean()) if len(good) else 1.0)
    if good.any() and not good.all():
        stats = [np.frombuffer(r["stats"], np.float32).reshape(-1, WIDTH) for r in got]
        first = np.cumsum([0] + [len(s) for s in stats])
        x = emissions(np.vstack(stats).astype(np.float64), first)
        field.train(x, first, np.concatenate([np.frombuffer(r["weight"], np.float32) for r in got]).astype(np.float64), good)
    return field


def score_quality(documents: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Labels of documents whose crc32(doc_id) modulo folds is `held` are never read; a null doc_id is not held out.
    """
    spark = documents.sparkSession
    field = spark.sparkContext.broadcast(fit(documents, labels, common.fold("doc_id", folds) != held))
    rows = documents.select("doc_id", F.coalesce(common.fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), F.col("text").cast("binary").alias("text"))

    def work(batches):
        for batch in batches:
            parts = [field.value.scores(c) for c in chunks(batch["text"].to_pylist())]
            score = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(score, pa.float64()), pa.array((score >= least).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return common.text_map(rows, work, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, least: float = 0.7) -> DataFrame:
    """The rows of documents, all columns, whose score is at least `least`; nothing is shuffled."""
    field = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, common.fold("doc_id", folds) != held))

    def work(batches):
        for batch in batches:
            texts = batch["text"].cast(pa.binary()).to_pylist()
            parts = [field.value.scores(c) for c in chunks(texts)]
            yield batch.filter(pa.array(np.concatenate(parts) >= least if parts else [], pa.bool_()))

    return common.text_map(documents, work, documents.schema)
