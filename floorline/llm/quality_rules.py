"""Quality rules with an isolation forest over rule statistics.

Rules count words, word characters, symbols, repeated lines and repeated three-word windows of every whole
text, and fail what is too short or mostly repetition. An isolation forest over ratios of these statistics
(trees of random splits; short average paths mark anomalies) rejects further documents; its threshold parts the
labelled good rows from the bad ones best, at the cost of at most MOST_GOOD of the good ones.

Every row of the table is in the forest: rows are dealt to the trees by hash, to one tree each, or to several where
the table has fewer than TREES * LEAST rows. Trees grow a level at a time from the number, least and greatest values of
the rows in each open node, so no rows are gathered. The threshold is counted over all labelled rows.

Defined results: a null text has no words, so it fails the base rules; repeated rows are judged alike; with
no good-labelled rows the forest rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from floorline.operators.ranking import running

from . import common

#: Trees, and the rows that each of them has at least; a tree is no higher than one of so many rows would be.
TREES, LEAST = 100, 256
MOST_GOOD = 0.01
#: Fixed values of the rules.
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share")
_STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>"


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The counts of COUNTS and the ratios of FEATURES of a UTF-8 text."""
    text = text or b""
    words = text.split()  # splits bytes at exactly \x20 and \x09-\x0D
    n = len(words)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(hist[0x80:0xC0].sum())
    chars = points - int(hist[0x20] + hist[0x09:0x0E].sum())
    symbols = int(hist[list(SYMBOLS.encode())].sum())
    seen: set[bytes] = set()
    lines = dups = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeats = 0
    if n > 3:
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        _, window, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        often = times[window] > 1
        if often.any():
            hit = np.zeros(n, bool)
            for k in range(3):
                hit[k : n - 2 + k] |= often
            repeats = int(hit.sum())
    upper, digits = int(hist[0x41:0x5B].sum()), int(hist[0x30:0x3A].sum())
    marks = int(hist[0x21:0x30].sum() + hist[0x3A:0x41].sum() + hist[0x5B:0x61].sum() + hist[0x7B:0x7F].sum())
    per = 1 / max(1, n)
    letters = 1 / max(1, chars)
    shrunk = min(len(number), n) / max(1.0, n**0.8)  # distinct words grow slower than words
    return [n, chars, symbols, dups, repeats], [
        chars * per, symbols * per, dups / max(1, lines), repeats * per, upper * letters, digits * letters, marks * letters, shrunk,
    ]


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, the counts and the features of every document."""

    def work(batches):
        for batch in batches:
            found = [statistics(t) for t in batch["text"].to_pylist()]
            arrays = [batch["doc_id"], *(pa.array([c[i] for c, _ in found], pa.int64()) for i in range(len(COUNTS))), pa.array([f for _, f in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *COUNTS, "features"])

    return common.text_map(documents.select("doc_id", F.col("text").cast("binary").alias("text")), work, _STATS)


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))


class Forest:
    """Isolation trees as arrays of feature, split, left child (right follows), and path length at leaves.

    While a forest grows, open nodes have no path length (NaN).
    """

    def __init__(self, rows: np.ndarray, trees: int, sample: int, seed: int = 11):
        """Trees that each have `sample` of some rows in memory."""
        rng = np.random.default_rng(seed)
        size = min(sample, len(rows))
        drawn = [rng.choice(len(rows), size, replace=False) for _ in range(trees)] if len(rows) > 1 else []
        tree = np.repeat(np.arange(len(drawn)), size)
        held = rows[np.concatenate(drawn)] if drawn else rows[:0]
        self._grow(lambda: self.extents(tree, held), len(drawn), max(2, size), sample, rng)

    @classmethod
    def over(cls, dealt: DataFrame, trees: int, size: float, least: int, seed: int = 11) -> Forest:
        """Trees over all rows (tree, features) of a table, about `size` in each."""
        forest = cls.__new__(cls)
        forest._grow(lambda: _extents(dealt, forest), trees, max(2, size), least, np.random.default_rng(seed))
        return forest

    @staticmethod
    def expected(n: float) -> float:
        """Mean path length of an unsuccessful search in a tree of n rows."""
        return 0.0 if n < 2 else 1.0 if n < 3 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, extents: Callable[[], tuple], trees: int, size: float, least: int, rng: np.random.Generator) -> None:
        """Split all open nodes by what extents gives of them, until none is open; trees without rows go."""
        self.sample = size
        limit = math.ceil(math.log2(min(size, max(2, least))))
        growing = [([-1], [0.0], [0], [math.nan]) for _ in range(trees)]
        for depth in range(limit + 1 if trees else 0):
            self.trees = [tuple(np.array(c) for c in tree) for tree in growing]
            for t, at, n, low, high in zip(*extents()):
                feature, split, left, path = growing[t]
                open_ = np.flatnonzero(high > low)
                if depth >= limit or not len(open_):
                    path[at] = depth + self.expected(n)
                    continue
                f = int(open_[rng.integers(len(open_))])
                s = float(rng.uniform(low[f], high[f]))
                feature[at], split[at], left[at], path[at] = f, float(low[f]) if s >= high[f] else s, len(feature), 0.0
                for c, value in zip(growing[t], (-1, 0.0, 0, math.nan)):
                    c += [value, value]
        self.trees = [tuple(np.array(c) for c in tree) for tree in growing if not np.isnan(tree[3]).any()]

    def extents(self, tree: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tree, node, number of rows, least and greatest values of the open nodes to which rows of trees come, in order."""
        first = np.cumsum([0, *[len(t[0]) for t in self.trees]])
        feature, split, left, path = (np.concatenate(c) for c in zip(*self.trees))
        left = left + np.repeat(first[:-1], np.diff(first))
        at = first[tree]
        live = np.flatnonzero(feature[at] >= 0)
        while len(live):
            node = at[live]
            at[live] = left[node] + (rows[live, feature[node]] > split[node])
            live = live[feature[at[live]] >= 0]
        order = np.argsort(at, kind="stable")
        order = order[np.isnan(path[at[order]])]
        node, start, n = np.unique(at[order], return_index=True, return_counts=True)
        low, high = (np.empty((0, rows.shape[1])),) * 2
        if len(node):
            low, high = np.minimum.reduceat(rows[order], start), np.maximum.reduceat(rows[order], start)
        t = np.searchsorted(first, node, side="right") - 1
        return t, node - first[t], n, low, high

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly in 0 to 1; 0.5 is ordinary."""
        if not self.trees or not len(rows):
            return np.full(len(rows), 0.5)
        total = np.zeros(len(rows))
        for feature, split, left, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            live = np.flatnonzero(feature[at] >= 0)
            while len(live):
                node = at[live]
                at[live] = left[node] + (rows[live, feature[node]] > split[node])
                live = live[feature[at[live]] >= 0]
            total += path[at]
        return np.exp2(-total / len(self.trees) / self.expected(self.sample))


def _extents(dealt: DataFrame, forest: Forest) -> tuple[np.ndarray, ...]:
    """Forest.extents of all rows of a table: each task gives those of its rows, which are then put together by node."""
    held = dealt.sparkSession.sparkContext.broadcast(forest.trees)
    edges = [f"{name}_{k}" for name in ("low", "high") for k in range(len(FEATURES))]

    def work(batches):
        mine, kept = Forest.__new__(Forest), []
        mine.trees = held.value

        def merged():
            t, at, n, low, high = (np.concatenate(c) for c in zip(*kept))
            order = np.lexsort((at, t))
            t, at, n, low, high = t[order], at[order], n[order], low[order], high[order]
            start = np.flatnonzero(np.append(True, (np.diff(t) != 0) | (np.diff(at) != 0)))
            return t[start], at[start], np.add.reduceat(n, start), np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)

        for batch in batches:
            x = np.array(batch["features"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
            found = mine.extents(batch["tree"].to_numpy(zero_copy_only=False), x)
            if len(found[0]):
                kept.append(found)
            if len(kept) > 32:
                kept = [merged()]
        if kept:
            t, at, n, low, high = merged()
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(at), pa.array(n), *map(pa.array, low.T.copy()), *map(pa.array, high.T.copy())], ["tree", "node", "n", *edges])

    parts = common.text_map(dealt, work, "tree long, node long, n long, " + ", ".join(f"{e} double" for e in edges))
    whole = parts.groupBy("tree", "node").agg(F.sum("n").alias("n"), *[(F.min if e.startswith("low") else F.max)(e).alias(e) for e in edges])
    rows = whole.toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
    held.unpersist()
    side = lambda names: np.stack([rows[e].to_numpy() for e in names], axis=1)
    return (*(rows[c].to_numpy() for c in ("tree", "node", "n")), side(edges[: len(FEATURES)]), side(edges[len(FEATURES) :]))


def grown(stats: DataFrame, trees: int = TREES, least: int = LEAST) -> Forest:
    """A forest over the features of all rows."""
    n = stats.count()
    if n < 2:
        return Forest(np.empty((0, len(FEATURES))), trees, least)
    copies = min(trees, math.ceil(trees * least / n))
    # the trees of a row: a start by one hash and a step by another, of those steps that come to every tree
    steps = [k for k in range(1, trees + 1) if math.gcd(k, trees) == 1]
    start, step = F.xxhash64("doc_id", "features"), F.xxhash64("features", "doc_id", F.lit(17))
    step = F.element_at(F.array(*map(F.lit, steps)), (F.pmod(step, F.lit(len(steps))) + 1).cast("int"))
    dealt = stats.select("features", start.alias("start"), step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("turn"))
    tree = F.pmod(F.pmod("start", F.lit(trees)) + F.col("turn") * F.col("step"), F.lit(trees)).cast("long")
    return Forest.over(common.stored(dealt.select(tree.alias("tree"), "features"), "dealt-rows"), trees, n * copies / trees, least)


def calibrated(anomalies: np.ndarray, good: np.ndarray) -> float:
    """The threshold that parts labelled rows best: the largest share of bad rows over it less that of good ones.

    No more than MOST_GOOD of the good rows lie over it; of equal thresholds the largest is taken, which rejects least.
    Without good rows nothing is rejected. threshold_of gives the same for a table.
    """
    fine, bad = np.sort(anomalies[good == 1]), np.sort(anomalies[good == 0])
    if not len(fine):
        return 1.0
    least = fine[len(fine) - 1 - int(MOST_GOOD * len(fine))]
    steps = np.unique(np.append(anomalies[anomalies >= least], [least, fine[-1]]))
    lost = 1 - np.searchsorted(fine, steps, side="right") / len(fine)
    caught = 1 - np.searchsorted(bad, steps, side="right") / max(1, len(bad)) if len(bad) else np.zeros(len(steps))
    gain = np.round(caught - lost, 12)
    return float(steps[np.flatnonzero(gain == gain.max())[-1]])


def threshold_of(known: DataFrame) -> float:
    """calibrated of all rows (anomaly, y) of a table, from running counts by value."""
    count = lambda label: F.sum(F.when(F.col("y") == label, 1).otherwise(0))
    values = common.stored(known.groupBy("anomaly").agg(count(1).alias("fine"), count(0).alias("bad")), "labelled-anomalies")
    fine, bad = values.agg(F.sum("fine"), F.sum("bad")).first()
    if not fine:
        return 1.0
    upto = lambda name: F.col(f"{name}_before") + F.col(name)
    whole = lambda c: c.cast("decimal(18,0)")
    # the share of good rows up to a value less that of bad ones, times the numbers of both
    gain = whole(upto("fine")) * whole(F.lit(bad)) - whole(upto("bad")) * whole(F.lit(fine))
    steps = running(values, "anomaly", ["fine", "bad"]).where(upto("fine") > fine - 1 - int(MOST_GOOD * fine))
    return float(steps.agg(F.max(F.struct(gain.alias("gain"), "anomaly")).alias("best")).first()["best"]["anomaly"])


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly, threshold and kept of every document."""
    stats = common.stored(measure(documents), "rule-statistics")
    held = documents.sparkSession.sparkContext.broadcast(grown(stats))

    def scored(batches):
        for batch in batches:
            x = np.array(batch["features"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
            arrays = [batch[c] for c in ("doc_id", *COUNTS)] + [pa.array(held.value.score(x), pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *COUNTS, "anomaly"])

    found = common.text_map(stats, scored, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", anomaly double")
    found, failed = common.stored(found, "anomalies"), base_failed()
    known = found.where(~failed).join(common.labelled(labels, "quality", F.lit(True)), "doc_id").select("anomaly", "y")
    threshold = threshold_of(known)
    return found.select("doc_id", *COUNTS, failed.alias("base_failed"), "anomaly", F.lit(threshold).alias("threshold"), (~failed & (F.col("anomaly") <= threshold)).alias("kept"))
