"""Byte-level BPE by a tokenization automaton.

The merges are compiled one after another into a deterministic automaton over tokens whose paths are exactly
the correct tokenizations. It starts as one state with an arc per byte. The gadget of a merge (a, b) -> c
splits the state that follows a: it loses its arc b, and every state from which a then b could be read gains
an arc c to where b led. Two facts keep the result small: the state after an arc depends on its label alone, so
states are numbered by tokens, and a split state differs from its origin by one cut arc. The compiled tables are,
per token, the gadget that made it and its two parts, and per gadget the cut arc; from them any entry of the
transition table (state, arc) -> whether the arc leaves the state follows by going back through the gadgets that
made state and arc. Entries are put into the table when they are first asked for, and a word is encoded by steps
through that table: its bytes are read through the trie of arc labels from every prefix, and exactly one chain of
arcs reaches each prefix. Decoding emits arc labels.

Defined results: a null text counts as empty and has no ids; strings of added tokens become their ids, as the
library does by default; an id without a label is an error; ids that cut characters decode with U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Texts of these characters alone are split by the pattern below; others by the library's own splitter.
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
UNSAFE = re.compile(f"[^\\t-\\r -~{LETTERS}]")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
#: Words of more bytes go through the automaton one by one; others together, in classes of length.
CLASSES = (8, 16, 32, 64)
#: Bits of a place in the transition table; an entry gives way to another of the same place.
TABLE_BITS = 21
#: Words kept with their encodings per Python worker.
KEPT = 400_000


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges of a byte-level BPE tokenizer file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.labels: list[bytes | None] = [None] * size
        for text, i in vocab.items():
            if all(c in letters for c in text):
                self.labels[i] = bytes(letters[c] for c in text)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.added.items():
            self.labels[i] = text.encode()
        self.first = np.full(size, -1, np.int64)  # parts that the gadget of a token joined
        self.second = np.full(size, -1, np.int64)
        self.born = np.full(size, -1, np.int64)  # number of that gadget; -1 for bytes
        cut = {}
        letter_ids = {i for t, i in vocab.items() if len(t) == 1}
        made = set(letter_ids)
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            cut.setdefault((a, b), rank)
            if c not in made:
                made.add(c)
                self.first[c], self.second[c], self.born[c] = a, b, rank
        self.size = size
        self.cut = {a * size + b: rank for (a, b), rank in cut.items()}
        self._table(list(self.cut), list(self.cut.values()))
        self.moves = np.full(1 << TABLE_BITS, -1, np.int64)  # 2 * (state, arc) + whether the arc is there
        self.known: dict[int, bool] = {}
        self.parts: tuple[list[int], list[int], list[int]] | None = None
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i in sorted(made):
            at = 0
            for byte in self.labels[i]:
                nxt = nodes.get((at, byte))
                if nxt is None:
                    nxt = nodes[(at, byte)] = len(ends)
                    ends.append(-1)
                at = nxt
            ends[at] = i
        # nodes with arcs out come first, so the table of steps has rows for them alone
        inner = sorted({a for a, _ in nodes})
        place = np.full(len(ends), -1, np.int64)
        place[inner] = np.arange(len(inner))
        place[place < 0] = np.arange(len(inner), len(ends))
        self.inner = len(inner)
        self.step = np.full((len(inner), 256), -1, np.int32)
        for (a, byte), b in nodes.items():
            self.step[place[a], byte] = place[b]
        self.ends = np.empty(len(ends), np.int64)
        self.ends[place] = ends
        self.arcs = {a << 8 | byte: b for (a, byte), b in nodes.items()}
        self.finals = ends

    def _table(self, keys: list[int], ranks: list[int], bits: int = 18) -> None:
        """Open-addressed table of cuts: pair -> number of the gadget."""
        self.shift = np.uint64(64 - bits)
        self.cut_key = np.full((1 << bits) + 64, -1, np.int64)
        self.cut_rank = np.zeros((1 << bits) + 64, np.int64)
        slots = self._slot(np.array(keys, np.int64)).tolist()
        for key, rank, slot in zip(keys, ranks, slots):
            while self.cut_key[slot] >= 0:
                slot += 1
            self.cut_key[slot], self.cut_rank[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def cut_at(self, keys: np.ndarray) -> np.ndarray:
        """Number of the gadget that cut each pair; a number beyond all for pairs that were never cut."""
        out = np.full(len(keys), np.iinfo(np.int64).max)
        slot = self._slot(keys)
        at = np.arange(len(keys))
        while len(at):
            found = self.cut_key[slot]
            hit = found == keys
            out[at[hit]] = self.cut_rank[slot[hit]]
            on = ~hit & (found >= 0)
            at, slot, keys = at[on], slot[on] + 1, keys[on]
        return out

    def has_arc(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether an arc y leaves the state after x, by pairs; x = -1 is the start, which has every arc."""
        key = x * self.size + y
        place = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        entry = self.moves[place]
        out = (entry & 1).astype(bool)
        new = np.flatnonzero((entry >> 1 != key) | (x < 0))
        if len(new):
            out[new] = self._derived(x[new], y[new])
            new = new[x[new] >= 0]
            self.moves[place[new]] = key[new] << 1 | out[new]
        return out

    def _derived(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Entries of the transition table, from the gadgets."""
        out = np.ones(len(x), bool)
        at = np.flatnonzero(x >= 0)
        x, y = x[at].copy(), y[at].copy()
        until = np.full(len(at), np.iinfo(np.int64).max)
        while len(at):
            gone = self.cut_at(x * self.size + y) < until
            out[at[gone]] = False
            bx, by = self.born[x], self.born[y]
            on = ~gone & ((bx >= 0) | (by >= 0))
            at, x, y, bx, by, until = at[on], x[on], y[on], bx[on], by[on], until[on]
            # the younger of state and arc goes back to its origin at its gadget; the gadget's own cut counts for arcs only
            until = np.where(by > bx, by + 1, bx)
            x, y = np.where(bx >= by, self.second[x], x), np.where(by >= bx, self.first[y], y)
        return out

    def _one_arc(self, x: int, y: int) -> bool:
        """The same entry for one state and arc."""
        if x < 0:
            return True
        key = x * self.size + y
        found = self.known.get(key)
        if found is None:
            first, second, born = self.parts
            until, found = 1 << 62, True
            while True:
                if self.cut.get(x * self.size + y, until) < until:
                    found = False
                    break
                bx, by = born[x], born[y]
                if bx < 0 and by < 0:
                    break
                until = by + 1 if by > bx else bx
                x, y = second[x] if bx >= by else x, first[y] if by >= bx else y
            if len(self.known) > KEPT:
                self.known.clear()
            self.known[key] = found
        return found

    def _one_word(self, word: bytes) -> list[int]:
        """Ids of one word of any length, byte by byte; the time grows with its length."""
        if self.parts is None:
            self.parts = self.first.tolist(), self.second.tolist(), self.born.tolist()
        n, arcs, finals, has = len(word), self.arcs, self.finals, self._one_arc
        last, back = [-1] * (n + 1), [-1] * (n + 1)
        for j in range(n):
            node, state = 0, last[j]
            for i in range(j, n):
                node = arcs.get(node << 8 | word[i])
                if node is None:
                    break
                token = finals[node]
                if token >= 0 and back[i + 1] < 0 and has(state, token):
                    last[i + 1], back[i + 1] = token, j
        ids, at = [], n
        while at > 0:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of every pre-split word."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.array([len(w) for w in words])
        low = 0
        for high in CLASSES:
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for some in np.array_split(rows, -(-len(rows) // 50_000)) if len(rows) else []:
                text = np.frombuffer(b"".join(words[i].ljust(high, b"\0") for i in some), np.uint8).reshape(-1, high).astype(np.int64)
                for i, ids in zip(some, self._run(text, sizes[some])):
                    out[i] = ids
        for i in np.flatnonzero(sizes > low):
            out[i] = self._one_word(words[i])
        return out

    def _run(self, text: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        """From every prefix in turn, arcs whose labels match; each prefix is reached by one arc."""
        n, width = text.shape
        last = np.full((n, width + 1), -1, np.int64)
        back = np.zeros((n, width + 1), np.int64)
        for j in range(width):
            rows = np.flatnonzero(sizes > j)
            node = np.zeros(len(rows), np.int64)
            for i in range(j, width):
                on = (sizes[rows] > i) & (node < self.inner)
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
                node = self.step[node, text[rows, i]]
                on = node >= 0
                rows, node = rows[on], node[on]
                token = self.ends[node]
                hit = np.flatnonzero(token >= 0)
                hit = hit[self.has_arc(last[rows[hit], j], token[hit])]
                last[rows[hit], i + 1] = token[hit]
                back[rows[hit], i + 1] = j
        ids, at = [], sizes.copy()
        owner = np.arange(n)
        while len(owner):
            ids.append((owner, last[owner, at]))
            at = back[owner, at]
            owner, at = owner[at > 0], at[at > 0]
        found: list[list[int]] = [[] for _ in range(n)]
        for owner, token in reversed(ids):
            for o, t in zip(owner.tolist(), token.tolist()):
                found[o].append(t)
        return found

    def emit(self, ids) -> bytes:
        """The labels of the arcs."""
        return b"".join(self.labels[i] for i in ids)


class Encoder:
    """An automaton with the splitter of its texts and a bounded memory of words."""

    def __init__(self, source: str):
        self.automaton, self.source = Automaton(source), source
        marks = sorted(self.automaton.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self.words: dict[str, tuple[str, list[int], bytes]] = {}
        self.library = None

    def __reduce__(self):
        return Encoder, (self.source,)

    def split(self, text: str) -> list[str]:
        """Words of a text in order; added tokens are words of their own."""
        if self.marks and (parts := self.marks.split(text))[1:]:
            return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.split(part) if part else [])]
        if not UNSAFE.search(text):
            return _SPLIT.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.source)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, words) -> None:
        """Put the encodings of these words in memory: ids as text, ids, and the bytes that decoding emits."""
        if len(self.words) > KEPT:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        plain = [w for w in new if w not in self.automaton.added]
        for w, ids in zip(plain, self.automaton.encode_words([w.encode("utf-8", "surrogatepass") for w in plain])):
            self.words[w] = (",".join(map(str, ids)), ids, self.automaton.emit(ids))
        for w in new:
            if w in self.automaton.added:
                i = self.automaton.added[w]
                self.words[w] = (str(i), [i], self.automaton.emit([i]))

    def batches(self, texts: list[str | None], size: int = 4 << 20):
        """The texts' words in runs of about `size` characters, with memory filled for each run."""
        run, chars = [], 0
        for t in texts:
            run.append(self.split(t) if t else [])
            chars += len(t or "")
            if chars >= size:
                self.learn(set().union(*run))
                yield run
                run, chars = [], 0
        if run:
            self.learn(set().union(*run))
            yield run


def _held(spark, path: str):
    """The tokenizer file's text, read on the driver and broadcast (files of vocabularies are bounded)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


_encoders: dict[int, Encoder] = {}


def encoder_of(source: str) -> Encoder:
    """One encoder per worker process and tokenizer."""
    key = hash(source)
    if key not in _encoders:
        _encoders[key] = Encoder(source)
    return _encoders[key]


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""
    held = _held(documents.sparkSession, path)

    def work(batches):
        encoder = encoder_of(held.value)
        for batch in batches:
            ids = [[i for w in words for i in encoder.words[w][1]] for run in encoder.batches(batch["text"].to_pylist()) for words in run]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return common.text_map(documents.select("doc_id", "text"), work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give an empty text."""
    held = _held(encoded.sparkSession, path)

    def work(batches):
        automaton = encoder_of(held.value).automaton
        for batch in batches:
            texts = [automaton.emit(ids or []).decode("utf-8", "replace") for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return common.text_map(encoded.select("doc_id", "ids"), work, "doc_id long, text string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode and decode of every text without moving its ids."""
    held = _held(documents.sparkSession, path)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def work(batches):
        encoder = encoder_of(held.value)
        for batch in batches:
            n, ids, decoded = [], [], []
            for run in encoder.batches(batch["text"].to_pylist()):
                for words in run:
                    found = [encoder.words[w] for w in words]
                    n.append(sum([len(f[1]) for f in found]))
                    ids.append(sha(",".join([f[0] for f in found]).encode()))
                    decoded.append(sha(b"".join([f[2] for f in found]).decode("utf-8", "replace").encode()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.text_map(documents.select("doc_id", "text"), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
