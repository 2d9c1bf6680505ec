"""Exact top-k inner products by multi-resolution segment statistics.

A vector cut into segments of w components keeps each segment's mean m and deviation d. By Cauchy-Schwarz
the squared distance of two vectors is at least the sum over segments of w * ((m - m')^2 + (d - d')^2), hence
their inner product at most the sum of w * (m * m' + d * d'). Levels go from few segments to many; pairs whose
bound falls under the query's k-th best so far are dropped, survivors get the exact integer product.

Queries are a stated set. Queries and candidates are dealt into blocks of bounded size, and every pair of blocks is
a cell that one task searches: it holds the two blocks and k rows a query, and passes on only those rows. Candidates
are dealt by their place in the input, not by their id, so an id that many rows repeat fills no block of its own.
Neither queries nor candidates go through the driver.

Defined results: vectors that are null or hold a null, NaN or infinite component, and rows without an id, take no
part; vectors of another dimension are not compared; a query's own id is no candidate; equal scores prefer the
smaller id; repeated candidate rows each take a rank, repeated query ids are asked once (with the smallest vector);
no queries, or an empty table, give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

#: Components in a block of queries and in one of candidates; candidates are dealt into CELLS blocks at least where they are many.
QUERIES_HOLD, CANDIDATES_HOLD, CELLS = 1 << 19, 1 << 22, 16
#: Candidate rows of a block that are compared at once, by pairs with the block's queries.
PAIRS = 1 << 18
LEVELS = (4, 16)
#: Above this share of surviving pairs a dense product is cheaper than picking pairs.
DENSE = 0.1


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and `v`, the components as floor(scale * x), of the vectors that can take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad))
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(w) * mean and sqrt(w) * deviation per segment; products of such rows bound inner products."""
    if not x.shape[1]:
        return np.zeros((len(x), 2))
    parts = np.array_split(x, min(segments, max(1, x.shape[1])), axis=1)
    cols = []
    for p in parts:
        w = np.sqrt(p.shape[1])
        cols += [w * p.mean(axis=1), w * p.std(axis=1)]
    return np.stack(cols, axis=1)


class Search:
    """A block of queries of one dimension with its k best candidates so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.levels = [statistics(x, s) for s in LEVELS]
        self.size = np.abs(x).sum(axis=1).max(initial=0)
        self.q = np.empty(0, np.int64)  # rows of the best so far, by query, score and id
        self.score, self.vec = np.empty(0, np.int64), np.empty(0, np.int64)
        self.least = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        exact = np.abs(x).max(initial=0) * self.size < 2.0**52
        own_x, other_x = (self.x, x) if exact else (self.x.astype(np.int64), x.astype(np.int64))
        pairs = len(self.ids) * len(ids)
        slack = 1e-6 * (1 + self.size * np.abs(x).max(initial=0))
        q = c = None  # surviving pairs; None while all are
        for own in self.levels if np.isfinite(self.least).any() else ():
            other = statistics(x, own.shape[1] // 2)
            if q is None or len(q) > DENSE * pairs:
                ok = own @ other.T + slack >= self.least[:, None]
                if q is not None:
                    keep = ok[q, c]
                    q, c = q[keep], c[keep]
                else:
                    q, c = np.nonzero(ok)
            else:
                keep = np.einsum("ij,ij->i", own[q], other[c]) + slack >= self.least[q]
                q, c = q[keep], c[keep]
        if q is not None and len(q) <= DENSE * pairs:
            if not len(q):
                return
            score = np.concatenate([np.einsum("ij,ij->i", own_x[q[i : i + 65536]], other_x[c[i : i + 65536]]) for i in range(0, len(q), 65536)])
            keep = (score >= self.least[q]) & (ids[c] != self.ids[q])
            self._merge(q[keep], score[keep].astype(np.int64), ids[c[keep]])
            return
        score = own_x @ other_x.T
        fits = (self.ids[:, None] != ids) & (score >= self.least[:, None])
        if len(ids) > self.k:  # what is under a query's k-th best here is not sorted
            low = score.min(initial=0) - 1
            score_here = np.where(fits, score, low)
            fits &= score >= np.partition(score_here, len(ids) - self.k, axis=1)[:, len(ids) - self.k, None]
        q, c = np.nonzero(fits)
        self._merge(q, score[q, c].astype(np.int64), ids[c])

    def _merge(self, q, score, vec) -> None:
        q, score, vec = np.append(self.q, q), np.append(self.score, score), np.append(self.vec, vec)
        order = np.lexsort((vec, -score, q))
        q, score, vec = q[order], score[order], vec[order]
        first = np.searchsorted(q, q, side="left")
        keep = np.arange(len(q)) - first < self.k
        self.q, self.score, self.vec = q[keep], score[keep], vec[keep]
        full = np.arange(len(q)) - first == self.k - 1
        self.least[q[full]] = score[full]


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each dimension that occurs."""
    offsets = np.asarray(column.offsets)
    flat, sizes = np.asarray(column.values), np.diff(offsets)
    out = []
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        out.append((rows, flat[offsets[rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0))))
    return out


def _search(k: int):
    def work(asked: pa.Table, against: pa.Table) -> pa.Table:
        """The k best candidates of one cell for each of its queries, by dimension."""
        ids, seen = np.asarray(asked["vec_id"].combine_chunks()), np.asarray(against["vec_id"].combine_chunks())
        candidates = {x.shape[1]: (at, x) for at, x in _matrix(against["v"].combine_chunks())}
        out = [(np.empty(0, np.int64),) * 3]
        for at, x in _matrix(asked["v"].combine_chunks()):
            if x.shape[1] in candidates:
                rows, y = candidates[x.shape[1]]
                search = Search(ids[at], x, k)
                few = max(16, PAIRS // len(x))
                for low in range(0, len(y), few):
                    search.add(seen[rows[low : low + few]], y[low : low + few])
                out.append((search.ids[search.q], search.vec, search.score))
        return pa.table([np.concatenate(c) for c in zip(*out)], ["query_id", "vec_id", "score"])

    return work


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, queries_hold: int = QUERIES_HOLD, candidates_hold: int = CANDIDATES_HOLD) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of every query."""
    common.prepare(vectors.sparkSession)
    rows = integer_vectors(vectors)
    n, asks, width = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v"))).first()
    width = max(1, width or 1)
    asked_blocks = -(-asks // max(1, queries_hold // width)) or 1
    blocks = max(-(-n // max(1, candidates_hold // width)), min(CELLS, -(-n // 1024)), 1)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(asked_blocks)).cast("int").alias("low"), every(blocks).alias("high"))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    against = rows.select("vec_id", "v", place.alias("high")).withColumn("low", every(asked_blocks))
    cells = asked.groupBy("low", "high").cogroup(against.groupBy("low", "high"))
    found = cells.applyInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB twin of the op8 query.
TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
