"""Best-fit packing of token pieces with certified bounds.

Texts become token pieces of at most CAPACITY; only longer texts are cut. Pieces are dealt into partitions of
about PIECES each, and every partition runs best-fit decreasing. Dual-feasible functions (thresholds that
round sizes near the capacity up and small ones down, and the stepwise functions u_k) give a lower bound on a
partition's bins. A partition whose bins meet the bound is certified: none of its pieces moves again. The
others have gaps: they keep their full bins and put the pieces of the open ones into an exchange, which is
dealt anew and packed by best-fit decreasing in the next round. The exchange ends when at most one partition
has a gap (it has nobody to exchange with), when a round saved no bin, or after ROUNDS rounds. Every row
carries the certificate of the packing that placed it: the bins and the bound of its partition.

Defined results: a null text counts as empty and still takes a sequence place for its closing id; repeated
rows are packed each; an empty table gives no rows. Which sequence a piece goes to depends on how the input is
split into files, the pieces themselves do not.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common
from .bpe import LETTERS, UNSAFE, byte_letters

CAPACITY, PIECES, ROUNDS = 4096, 32768, 4
#: Share of the capacity that an open bin may lack and still count as full.
SLACK = 0.0005
CLOSING = 1
#: Remembered words of a Python worker.
KEPT = 1_000_000
#: Splitting pattern of the word-end vocabulary for texts of safe characters, after lower-casing (fixed value).
_SPLIT = re.compile(rf"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\s0-9{LETTERS}]+")

_PIECE = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = _PIECE + ", part long, bin long, offset long, fill long, bins long, bound long"


#: Byte -> the character by which the vocabulary writes it.
_LETTERS = {b: c for c, b in byte_letters().items()}


class _Places(dict):
    """Word -> its number; a new word gets the next one and waits in `new`."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordTokens:
    """Ids of a word-end BPE tokenizer, by remembered words; texts of other characters go to the library whole.

    Texts of safe characters are split here as the library splits them. The ids of the words lie in one pool, from
    which a text's ids are gathered; new words go to the library's model as it writes bytes.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.places = _Places()
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    @staticmethod
    def pack(ids) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _learn(self) -> None:
        """Put the ids of the new words, which are numbered in turn, at the end of the pool."""
        new, self.places.new = self.places.new, []
        tokenize = self.library.model.tokenize
        found = [[t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS))] for w in new]
        n, first = len(new), len(self.places) - len(new)
        sizes = np.fromiter(map(len, found), np.int64, n)
        total = int(sizes.sum())
        while first + n > len(self.start):
            self.start, self.size = np.append(self.start, np.zeros_like(self.start)), np.append(self.size, np.zeros_like(self.size))
        while self.used + total > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.start[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + n] = sizes
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.used += total

    def _together(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of safe characters."""
        if len(self.places) > KEPT:
            self.forget()
        words = [_SPLIT.findall(t.lower()) for t in texts]
        counts = list(map(len, words))
        n = sum(counts)
        if not n:
            return [b""] * len(texts)
        places = np.fromiter(map(self.places.__getitem__, chain.from_iterable(words)), np.int64, n)
        if self.places.new:
            self._learn()
        sizes = self.size[places]
        upto = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.start[places] - upto + sizes, sizes) + np.arange(upto[-1])].tobytes()
        cuts = (4 * np.append(0, upto)[np.append(0, np.cumsum(counts))]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        texts = [t or "" for t in texts]
        safe = [not UNSAFE.search(t) and not any(mark in t for mark in self.added) for t in texts]
        found = iter(self._together([t for t, s in zip(texts, safe) if s]) if any(safe) else [])
        return [next(found) if s else self.pack(self.library.encode(t, add_special_tokens=False).ids) for t, s in zip(texts, safe)]


_tokens: dict[int, WordTokens] = {}


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 (and the ids as bytes) of every piece of every text."""
    spark = documents.sparkSession
    with open(path, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())

    def work(batches):
        key = hash(held.value)
        if key not in _tokens:
            _tokens[key] = WordTokens(held.value)
        closing = WordTokens.pack([CLOSING])
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            texts, ids = batch["text"].to_pylist(), batch["doc_id"].to_pylist()
            for low in range(0, len(texts), 200):
                for doc_id, data in zip(ids[low : low + 200], _tokens[key].encode(texts[low : low + 200])):
                    data += closing
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        out.append((uid, doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
                        uid += 1
            cols = list(zip(*out)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 7 if keep_ids else 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t, _ in zip(cols, types, names)], names)

    return common.text_map(documents.select("doc_id", "text"), work, _PIECE + (", ids binary" if keep_ids else ""))


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each size and the fill of each bin; among bins that fit, the fullest, then the latest opened."""
    order = np.argsort(-sizes, kind="stable")
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    open_ = 0  # bit r: some bin has room r
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = open_ >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
        else:
            b, r = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += size
        if r > size:
            room[r - size].append(b)
            open_ |= 1 << (r - size)
    return where, offset, np.array(fill, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Largest of the bounds that dual-feasible functions give on the number of bins."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    many, mass = np.cumsum(count), np.cumsum(count * x)
    for t in x[1 : capacity // 2 + 1][count[1 : capacity // 2 + 1] > 0].tolist():
        # sizes over capacity - t count as whole bins, sizes under t as nothing
        whole = int(many[-1] - many[capacity - t])
        middle = int(mass[capacity - t] - mass[t - 1])
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 21):
        exact = (k + 1) * x % capacity == 0
        scaled = np.where(exact, k * x, (k + 1) * x // capacity * capacity)  # u_k(x) * k * capacity
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def _pack_partitions(rows: DataFrame, parts: int, salt: int, capacity: int) -> DataFrame:
    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("uid", "ascending")])
        sizes = np.asarray(group["length"])
        where, offset, fill = best_fit_decreasing(sizes, capacity)
        bins, bound = np.full(len(sizes), len(fill)), np.full(len(sizes), lower_bound(sizes, capacity))
        for name, values in (("bin", where), ("offset", offset), ("fill", fill[where]), ("bins", bins), ("bound", bound)):
            group = group.append_column(name, pa.array(values, pa.int64()))
        return group

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(work, _PLACED)


def pack(found: DataFrame, capacity: int = CAPACITY, per_part: int = PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Rows of pieces() with sequence_id, offset, fill, and the certificate: round, part, its bins and their lower bound.

    A sequence's number joins round, partition and bin.
    """
    common.prepare(found.sparkSession)
    todo, done, before = found, None, None
    for step in range(rounds + 1):
        n = todo.count()
        if step and n == 0:
            break
        parts = max(1, -(-n // per_part))
        placed = common.stored(_pack_partitions(todo.select("uid", "doc_id", "piece", "start", "length", "ids_crc32"), parts, step, capacity), f"packing-{step}")
        certified, full = F.col("bins") == F.col("bound"), F.col("fill") >= int(capacity * (1 - SLACK))
        tally = placed.groupBy("part").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound"))
        bins, gaps = tally.agg(F.coalesce(F.sum("bins"), F.lit(0)), F.count_if(~certified)).first()
        last = step == rounds or gaps < 2 or (before is not None and bins >= before)
        stays = F.lit(True) if last else certified | full
        kept = placed.where(stays).withColumn("sequence_id", F.lit(step << 58) + F.col("part") * (1 << 24) + F.col("bin"))
        kept = kept.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill", F.lit(step).alias("round"), "part", "bins", "bound")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        todo = placed.where(~stays)
        before = todo.select("part", "bin").distinct().count()
    return done


def pack_documents(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places, from texts to sequences."""
    return pack(common.stored(pieces(documents, path, capacity), "pieces"), capacity)
