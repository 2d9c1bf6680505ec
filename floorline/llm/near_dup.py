"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its lower-case words without marks. Its five-word shingles are labelled with how often each
occurred before, so that labels are unique within a text. Each of SKETCHES hash functions keeps the two labelled
shingles of least hash in the order in which they stand; texts of high edit similarity agree in many of these. Every
sketch is a key, and equal keys bring texts together: where s is the share of shingles that two texts have in common,
they meet with probability 1 - (1 - s^2)^24, over 0.99 for s = 0.45, which is about one word in ten changed.

Copies are first folded into one text by digest. Then every text is compared with the hub of each of its keys, the
least text under that key, which links large families without pairing their members. The links give first classes;
what remains are keys whose texts are of different classes. Under these every two texts of different classes are
compared, keys of more than PIECE texts block by block, so no pair that could join two classes is left out; only
bounds that no pair of SIMILARITY breaks (lengths, and counts of words by hash, coarse ones first) spare an alignment.

The similarity of two texts is the number of words that an alignment matches over the words of the longer text; two
texts of SIMILARITY or more are linked. The alignment is anchored at the longest chain of common labelled shingles
that stand in the same order within the band around the diagonal which a path of that similarity never leaves; between
anchors the words are aligned by longest common subsequence. Classes are connected components of links, found by
hooking to smaller neighbours and pointer jumping; links within what has been joined go after each round.

Defined results: a null text, or a null id, is in a class of its own; equal texts share a class, empty ones too; a
text of one to four words is one shingle; texts without words are compared by digest alone; a class is named by its
smallest doc_id; a row of an id that has several texts is in the class of its own text; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES = 24
#: Texts of a block of a key whose texts are compared pair by pair; buckets of the counts of words, and of coarse ones.
PIECE, BUCKETS, COARSE = 500, 4096, 512
#: Pairs handled and counts compared at once.
PAIRS, COMPARED = 1 << 12, 1 << 21
#: Parts into which the texts of a class are dealt for a join.
SALTS = 16
#: Texts up to which their set (8 MB of numbers) is broadcast; larger ones are joined.
BROADCAST_TEXTS = 1_000_000
#: Words whose codes a worker remembers.
KEPT = 100_000
#: Shingles hashed by all functions at once; longer texts function by function.
TOGETHER = 4096

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(23)
_MULTIPLIERS = _rng.integers(1, 1 << 62, SKETCHES, dtype=np.uint64) | np.uint64(1)
_POWERS = _rng.integers(1, 1 << 62, SHINGLE, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(text: str, seen: dict[str, int]) -> np.ndarray:
    """32-bit codes of the text's words; seen remembers words."""
    import xxhash

    out = []
    for w in _WORD.findall(text.lower()):
        code = seen.get(w)
        if code is None:
            if len(seen) > KEPT:
                seen.clear()
            code = seen[w] = xxhash.xxh32_intdigest(w)
        out.append(code)
    return np.array(out, np.uint32)


def labelled_shingles(codes: np.ndarray) -> np.ndarray:
    """Hash of each shingle and the number of its earlier occurrences, in text order."""
    n = len(codes)
    if not n:
        return np.empty(0, np.uint64)
    if n < SHINGLE:
        codes = np.append(codes, np.zeros(SHINGLE - n, np.uint32))
        n = SHINGLE
    wide = codes.astype(np.uint64)
    h = np.zeros(n - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        h += (wide[k : n - SHINGLE + 1 + k] + np.uint64(1)) * _POWERS[k]
    h = _mixed(h)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    again = np.append(False, ranked[1:] == ranked[:-1])
    if again.any():
        at = np.arange(len(h))
        start = np.maximum.accumulate(np.where(again, 0, at))
        times = np.empty(len(h), np.uint64)
        times[order] = (at - start).astype(np.uint64)
        h = _mixed(h + times * _MIX) if times.any() else h
    return h


def sketch(shingles: np.ndarray) -> np.ndarray:
    """For every hash function the hash of its two least labelled shingles in text order, as 64 bits."""
    top = np.iinfo(np.uint64).max
    i, j = np.empty(SKETCHES, np.int64), np.empty(SKETCHES, np.int64)
    few = SKETCHES if len(shingles) <= TOGETHER else 1
    for k in range(0, SKETCHES, few):
        h = shingles * _MULTIPLIERS[k : k + few, None]
        h ^= h >> np.uint64(32)
        h *= _MIX
        i[k : k + few] = j[k : k + few] = h.argmin(axis=1)
        if len(shingles) > 1:
            h[np.arange(few), i[k : k + few]] = top
            j[k : k + few] = h.argmin(axis=1)
    first, second = shingles[np.minimum(i, j)], shingles[np.maximum(i, j)]
    return _mixed(_mixed(first * _MIX ^ second) + np.arange(SKETCHES, dtype=np.uint64) * _MIX)


def word_counts(codes: np.ndarray) -> np.ndarray:
    """How many words fall into each of BUCKETS, up to 255; words differ in at least as many places as these counts."""
    return np.minimum(np.bincount(codes & (BUCKETS - 1), minlength=BUCKETS), 255).astype(np.uint8)


def _chain(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest chain that rises in both, of places sorted by i."""
    if (j[1:] > j[:-1]).all():
        return i, j
    tails: list[int] = []
    at: list[int] = []
    before = np.full(len(j), -1, np.int64)
    for k, x in enumerate(j.tolist()):
        p = bisect.bisect_left(tails, x)
        if p == len(tails):
            tails.append(x)
            at.append(k)
        else:
            tails[p], at[p] = x, k
        if p:
            before[k] = at[p - 1]
    found, k = [], at[-1]
    while k >= 0:
        found.append(k)
        k = int(before[k])
    found = np.array(found[::-1])
    return i[found], j[found]


def common_words(a: list[int], b: list[int], width: int) -> int:
    """Longest common subsequence by bits, of matches at most width places off the diagonal."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    left = full
    narrow = (1 << (2 * width + 1)) - 1 if max(len(a), len(b)) > width else 0
    for j, w in enumerate(b):
        match = places.get(w)
        if match is not None:
            if narrow:
                match &= narrow << (j - width) if j >= width else narrow >> (width - j)
            used = left & match
            left = (left + used | left - used) & full
    return len(a) - left.bit_count()


def _anchors(x: np.ndarray, y: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Runs (place in a, place in b, words) that common labelled shingles match, in order and apart."""
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    inside = np.abs(i - j) <= width
    i, j = i[inside], j[inside]
    if not len(i):
        return []
    order = np.argsort(i)
    i, j = _chain(i[order], j[order])
    new = np.append(True, (np.diff(i - j) != 0) | (np.diff(i) > SHINGLE))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i)) - 1
    runs, end_a, end_b = [], 0, 0
    for p, q, n in zip(i[first].tolist(), j[first].tolist(), (i[last] - i[first] + SHINGLE).tolist()):
        over = max(0, end_a - p, end_b - q)
        if n > over:
            runs.append((p + over, q + over, n - over))
            end_a, end_b = p + n, q + n
    return runs


def alignment(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> float:
    """Matched words over those of the longer text; 0 as soon as it must fall under least.

    a and b are the codes of the words, x and y their labelled shingles.
    """
    n, m = len(a), len(b)
    need = least * max(n, m) - 1e-9
    if not n or not m or min(n, m) < need:
        return 0.0
    width = int(n + m - 2 * need) + 1  # a path with that many matches never leaves this band
    runs = _anchors(x, y, width) if min(n, m) >= SHINGLE else []
    matched, spare, gaps, end_a, end_b = 0, 0, [], 0, 0
    for p, q, k in [*runs, (n, m, 0)]:
        if p > end_a and q > end_b:
            gaps.append((end_a, p, end_b, q))
            spare += min(p - end_a, q - end_b)
        matched += k
        end_a, end_b = p + k, q + k
    for low, high, left, right in sorted(gaps, key=lambda g: (g[1] - g[0]) * (g[3] - g[2])):
        if matched + spare < need:
            return 0.0
        spare -= min(high - low, right - left)
        # the band of the whole text, seen from the gap's corner
        matched += common_words(a[low:high].tolist(), b[left:right].tolist(), width + abs(low - left))
    return matched / max(n, m) if matched >= need else 0.0


def text_digest(text: str = "text") -> Column:
    """16 bytes of a text's SHA-256; null for null."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _sketched(documents: DataFrame) -> DataFrame:
    """text (a number), doc_id, digest, codes (bytes), keys (array<long>; none without words) and n of every row.

    Numbers are given by row, so they hold once the rows are stored.
    """

    def work(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            codes = [word_codes(t, seen) for t in batch["text"].to_pylist()]
            cols = [
                batch["doc_id"],
                batch["digest"],
                pa.array([c.tobytes() for c in codes], pa.binary()),
                pa.array([sketch(labelled_shingles(c)).view(np.int64) if len(c) else [] for c in codes], pa.list_(pa.int64())),
                pa.array([len(c) for c in codes], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "digest", "codes", "keys", "n"])

    rows = common.text_map(documents, work, "doc_id long, digest binary, codes binary, keys array<long>, n long")
    return rows.withColumn("text", F.monotonically_increasing_id())


def _counted(texts: DataFrame) -> DataFrame:
    """text, n, keys and counts (bytes) of texts with their codes."""

    def work(batches):
        for batch in batches:
            counts = [word_counts(np.frombuffer(c, np.uint32)).tobytes() for c in batch["codes"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["text"], batch["n"], batch["keys"], pa.array(counts, pa.binary())], ["text", "n", "keys", "counts"])

    return common.text_map(texts, work, "text long, n long, keys array<long>, counts binary")


def _differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sum of absolute differences of each two rows of unsigned numbers."""
    return (np.maximum(p, q) - np.minimum(p, q)).sum(axis=-1, dtype=np.int64)


def _coarse(counts: np.ndarray) -> np.ndarray:
    """Counts in COARSE buckets, of which those of BUCKETS are parts."""
    return counts.reshape(len(counts), -1, COARSE).sum(axis=1, dtype=np.uint16)


def _may_link(n: np.ndarray, counts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether lengths and counts of words leave pairs of rows x and y the chance of a link."""
    longest = np.maximum(n[x], n[y])
    may = np.minimum(n[x], n[y]) >= SIMILARITY * longest - 1e-9
    at = np.flatnonzero(may)
    many = COMPARED // counts.shape[1]
    for part in np.split(at, range(many, len(at), many)):
        apart = _differences(counts[x[part]], counts[y[part]])
        may[part] = apart <= n[x[part]] + n[y[part]] - 2 * SIMILARITY * longest[part] + 1e-6
    return may


def hub_pairs(keyed: DataFrame) -> DataFrame:
    """Distinct pairs a < b of a text and the least text under one of its keys."""
    hubs = keyed.groupBy("key").agg(F.min("text").alias("a"), F.count("*").alias("members")).where("members > 1")
    return keyed.join(hubs, "key").where("text <> a").select("a", F.col("text").alias("b")).distinct()


def _crossing(rows: DataFrame) -> DataFrame:
    """a, b of the rows of one cell that are of different classes and may be linked; rows come sorted by key, low and high."""

    def pairs(held, at, many):
        """Row numbers of a cell's pairs, a block of rows against all at a time."""
        low, high = held["low"][at], held["high"][at]
        kind, block = held["class_id"][at : at + many], held["block"][at : at + many]
        for start in range(0, many, 256):
            stop = min(start + 256, many)
            fits = kind[start:stop, None] != kind
            # a cell of one block has each pair twice, a cell of two blocks the pairs of either block besides
            if low == high:
                fits &= np.arange(start, stop)[:, None] < np.arange(many)
            else:
                fits &= (block[start:stop, None] == low) & (block == high)
            x, y = np.nonzero(fits)
            x, y = x + at + start, y + at
            for counts in ("coarse", "counts"):
                may = _may_link(held["n"], held[counts], x, y)
                x, y = x[may], y[may]
            for part in range(0, len(x), PAIRS):
                p, q = x[part : part + PAIRS], y[part : part + PAIRS]
                # a pair of several keys counts under the first of them
                first = (held["keys"][p] == held["keys"][q]).argmax(axis=1)
                once = held["keys"][p, first] == held["key"][at]
                yield p[once], q[once]

    def emit(held, first, end):
        found = [(np.empty(0, np.int64),) * 2]
        for at, many in zip(first.tolist(), np.diff(np.append(first, end)).tolist()):
            if many > 1:
                found += pairs(held, at, many)
        x, y = (np.concatenate(c) for c in zip(*found))
        x, y = held["text"][x], held["text"][y]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def work(batches):
        kept = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            rows = pa.Table.from_batches(kept).combine_chunks()
            held = {c: rows[c].to_numpy() for c in ("key", "low", "high", "text", "class_id", "n", "block")}
            held["keys"] = rows["keys"].combine_chunks().flatten().to_numpy().reshape(-1, SKETCHES)
            held["counts"] = np.frombuffer(b"".join(rows["counts"].to_pylist()), np.uint8).reshape(-1, BUCKETS)
            held["coarse"] = _coarse(held["counts"])
            new = np.append(True, np.any([held[c][1:] != held[c][:-1] for c in ("key", "low", "high")], axis=0))
            first = np.flatnonzero(new)
            end = int(first[-1])  # the last cell may go on in the next batch
            if len(first) > 1:
                yield emit(held, first[:-1], end)
            kept = rows.slice(end).to_batches()
        if kept:
            yield emit(held if end == 0 else {c: v[end:] for c, v in held.items()}, np.array([0]), len(rows) - end)

    return rows.mapInArrow(work, "a long, b long")


def crossing_pairs(sketches: DataFrame, keyed: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs that share a key, may be linked, and are of different classes under label, each once.

    Every such pair is found: keys of more than PIECE texts are dealt into blocks, and each two blocks meet in a cell.
    """
    named = keyed.join(label, "text", "left").withColumn("class_id", F.coalesce("class_id", "text"))
    mixed = named.groupBy("key").agg(F.count("*").alias("members"), F.min("class_id").alias("least"), F.max("class_id").alias("most"))
    mixed = mixed.where("least <> most").select("key", F.ceil(F.col("members") / PIECE).alias("blocks"))
    member = common.stored(named.join(mixed, "key").select("text", "class_id", "key", F.pmod(F.xxhash64("text", "key"), "blocks").alias("block"), "blocks"), "mixed-keys")
    member = _counted(_restricted(sketches.select("text", "n", "codes", "keys"), member.select("text"))).join(member, "text")
    cells = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")
    common.prepare(sketches.sparkSession)
    return _crossing(cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high"))


def _restricted(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts that are among ids, sorted out before a shuffle where the set is small."""
    ids = ids.distinct()
    return texts.join(F.broadcast(ids), "text", "left_semi") if ids.count() <= BROADCAST_TEXTS else texts


def verified(pairs: DataFrame, sketches: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """a, b, similarity of the pairs whose banded alignment reaches least."""
    codes = _restricted(sketches.select("text", "codes"), pairs.select(F.col("a").alias("text")).union(pairs.select("b")))
    side = lambda at, name: codes.select(F.col("text").alias(at), F.col("codes").alias(name))
    joined = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y")

    def work(batches):
        for batch in batches:
            known: dict[bytes, tuple] = {}
            found = []
            for p, q in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
                if min(len(p), len(q)) < least * max(len(p), len(q)) - 1e-6:
                    found.append(0.0)
                    continue
                for c in (p, q):
                    if c not in known:
                        codes = np.frombuffer(c, np.uint32)
                        known[c] = codes, word_counts(codes), labelled_shingles(codes)
                (a, u, x), (b, v, y) = known[p], known[q]
                may = _differences(u, v) <= len(a) + len(b) - 2 * least * max(len(a), len(b)) + 1e-6
                found.append(alignment(a, b, x, y, least) if may else 0.0)
            out = pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(found, pa.float64())], ["a", "b", "similarity"])
            yield out.filter(pa.array([f > 0 for f in found], pa.bool_()))

    common.prepare(pairs.sparkSession)
    return joined.mapInArrow(work, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """text and class_id (the smallest) of every text that occurs in links of columns a and b.

    Every round hooks each text to its least neighbour and jumps to that one's; links then lie between the labels so
    given, and those of one label go. A label is of the same component, so links of labels join what links of texts
    do. Rounds are logarithmic in the longest path for usual graphs and end when no link is left.
    """
    ends = lambda one, other: (F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))
    edges = common.stored(links.select(*ends("a", "b")).where("a <> b").distinct(), "edges-0")
    label, step = None, 0
    while True:
        step += 1
        near = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("near"))
        near = near.select(F.col("a").alias("text"), F.least("a", "near").alias("class_id"))
        jump = near.select(F.col("text").alias("class_id"), F.col("class_id").alias("far"))
        # a least neighbour is a text of the graph, so the inner join keeps every row
        root = common.stored(near.join(jump, "class_id").select("text", F.col("far").alias("class_id")), f"roots-{step}")
        if label is None:
            label = root
        else:
            named = label.join(root.select(F.col("text").alias("class_id"), F.col("class_id").alias("root")), "class_id", "left")
            label = common.stored(named.select("text", F.coalesce("root", "class_id").alias("class_id")), f"labels-{step}")
        of = lambda at: root.select(F.col("text").alias(at), F.col("class_id").alias(f"{at}_root"))
        edges = edges.join(of("a"), "a").join(of("b"), "b").select(*ends("a_root", "b_root")).where("a <> b").distinct()
        edges = common.stored(edges, f"edges-{step}")
        if edges.isEmpty():
            return label


def _classes_of(sketches: DataFrame, keyed: DataFrame) -> DataFrame:
    """text, class_id of the texts of classes of several: links to hubs, then links between the classes these give."""
    links = common.stored(verified(common.stored(hub_pairs(keyed), "hub-pairs"), sketches), "hub-links")
    label = components(links)
    crossing = common.stored(verified(common.stored(crossing_pairs(sketches, keyed, label), "crossing-pairs"), sketches), "crossing-links")
    if crossing.isEmpty():
        return label
    of = lambda at: label.select(F.col("text").alias(at), F.col("class_id").alias(f"{at}_class"))
    between = crossing.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = between.select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b")).distinct()
    merged = components(between).select(F.col("text").alias("class_id"), F.col("class_id").alias("root"))
    # a text that was alone is a class by itself, so merged has a row for it that label lacks
    alone = merged.join(label.select("class_id").distinct(), "class_id", "left_anti").select(F.col("class_id").alias("text"), F.col("root").alias("class_id"))
    return label.join(merged, "class_id", "left").select("text", F.coalesce("root", "class_id").alias("class_id")).unionByName(alone)


def classified(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id and digest of every row with an id and a text; digest, class_id, keeper, n_copies of every text of these).

    keeper marks the text of the row that stands for the class: that of its smallest doc_id, of several such the least.
    """
    usable = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", text_digest().alias("digest"))
    rows = common.stored(_sketched(usable), "sketches")
    copies = common.stored(rows.groupBy("digest").agg(F.min("text").alias("text"), F.min("doc_id").alias("first"), F.count("*").alias("n_copies")), "copies")
    repeated = copies.where("n_copies > 1").select("digest", F.col("text").alias("one"))
    spare = rows.select("digest", "text").join(repeated, "digest").where("text <> one").select("text")
    spare = F.broadcast(spare) if spare.count() <= BROADCAST_TEXTS else spare
    keys = rows.select("text", "keys").join(spare, "text", "left_anti").select("text", F.explode("keys").alias("key"))
    several = keys.groupBy("key").count().where("count > 1").select("key")
    keyed = common.stored(keys.join(several, "key", "left_semi").select("text", "key"), "shared-keys")
    named = copies.join(_classes_of(rows, keyed), "text", "left").withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)))
    alone = named.where("class_id is null").select("digest", F.col("first").alias("class_id"), F.lit(True).alias("keeper"), "n_copies")
    # folded before the join and joined by class and salt, so a class of many texts is no group of one task
    named = named.where("class_id is not null").withColumnRenamed("class_id", "root")
    best = named.groupBy("root").agg(F.min(F.struct("first", "digest")).alias("best"))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = named.join(best, ["root", "salt"])
    found = found.select("digest", F.col("best.first").alias("class_id"), (F.col("best.digest") == F.col("digest")).alias("keeper"), "n_copies").unionByName(alone)
    return rows.select("doc_id", "digest"), common.stored(found, "classified")


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id and n_copies (rows with the same text) of every row."""
    rows, found = classified(documents)
    named = rows.join(found, "digest").select("doc_id", "class_id", "n_copies")
    alone = documents.where(F.col("text").isNull() | F.col("doc_id").isNull())
    return named.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies")))


def keep_first(documents: DataFrame) -> DataFrame:
    """One row of each class, all its columns: that of its smallest doc_id, one of several equal in id and text.

    Rows without a text or an id stay.
    """
    rows, found = classified(documents)
    digest, keeper, first = (common.fresh(documents, c) for c in ("digest", "keeper", "class_id"))
    # texts that go, and texts of several rows, of which those of the smallest id stay
    marks = found.where("not keeper or n_copies > 1")
    same = (F.col("doc_id") == F.col("class_id")) & F.col("keeper")
    again = rows.join(marks, "digest").where(same).groupBy("digest").count().where("count > 1")  # rows equal in id and text
    again = common.stored(again.select(F.col("digest").alias(digest)), "equal-rows")
    marks = marks.select(F.col("digest").alias(digest), F.col("keeper").alias(keeper), F.col("class_id").alias(first))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_TEXTS // 2 else df
    named = documents.withColumn(digest, F.when(F.col("doc_id").isNotNull(), text_digest()))
    kept = named.join(small(marks), digest, "left").where(F.col(keeper).isNull() | (F.col(keeper) & (F.col("doc_id") == F.col(first))))
    if again.isEmpty():
        return kept.select(documents.columns)
    again = small(again)
    once = kept.join(again, digest, "left_semi").dropDuplicates([digest])
    return kept.join(again, digest, "left_anti").select(documents.columns).unionByName(once.select(documents.columns))
