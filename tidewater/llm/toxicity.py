"""Toxicity scores from class-conditional Kneser-Ney models of variable order.

Two tables, counted over all training rows. `Model` has grams of ORDER characters folded to SYMBOLS
symbols: boundary, letters a-z, and groups of other letters; its highest order has counts of its
own for toxic and ordinary texts, and both back off to the same lower orders, which are continuation
counts of both classes together. The node table has the beginnings of the training words, exact to
the byte, up to the word with its end: each is counted for both classes in the context of all that
stands before it in the word, with an absolute discount, and backs off to `Model`. So whole words
and long stems have probabilities of their own, rare ones nearly equal ones in both classes, and
words that training lacks those of their longest known beginning and then of characters. What
occurs less than CUTOFF times in all training rows is left to backing off, as is usual for high
orders. Contexts do not reach over word boundaries.

Training words, counted in each task, are dealt by their first symbols and read in order, so that one
pass over them makes every node beside the one before: a stack as deep as a word is long. What is
dealt are different words, so a word that a third of all rows hold is one row a task. Runs of more
than LONGEST letters, as scripts without spaces have, are taken in pieces of so many, all of them, so
that time and memory grow with a text's length and not with its square.

A document is compared by length-normalised differences of log-likelihoods (toxic less ordinary):
the whole text's, a symbol; its most toxic word's; and by how much words exceed several levels, in
sum and a word. A logistic regression makes them a score. It is fitted on a bounded sample of
training rows, each compared by models that have not counted it: the rows are halved by a hash of
the id, and each half is compared by the other half's models.

The node table grows with the training rows' words. Up to AT_ONCE nodes, their number checked, it goes
to the tasks as two arrays, and a document is scored where it is read; beyond, it stays a keyed
table: the different words of the documents meet it by their beginnings, and the documents meet
their words' differences. Both ways give the same scores.

Defined results: null, empty and letterless texts have differences of 0 and the score of such
texts; with no training row, or with one class only, all scores are the share of that class
(0 without rows); an id with several labels counts as toxic if one is; null labels are ignored; equal texts have equal
scores; a very long text is read whole, in memory that grows with its different words; a null id stays
null; repeated rows are scored each; an empty table gives none; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.blocks import row_blocks, texts
from tidewater.llm.storage import bounded, few, stored

SYMBOLS, ORDER = 32, 4
#: a-z are 1 to 26; continuation bytes of other letters 27 to 30; all else is a boundary.
FOLD = bytes(c - 96 if 97 <= c <= 122 else 27 + (c & 3) if 128 <= c < 192 else 0 for c in range(256))
LEADS = bytes(range(192, 256))
#: Rows of labels up to which they are broadcast to the documents; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Rows up to which words' differences are broadcast to the documents.
BROADCAST_WORDS = 1_000_000
#: Nodes up to which their table (12 or 16 bytes each) goes to the tasks whole.
AT_ONCE = 4_000_000
#: Occurrences in training rows from which a beginning is a node.
CUTOFF = 3
#: Entries of a task's table of words, and words that are taken apart at once.
KEPT, WORDS_AT_ONCE = 500_000, 50_000
#: Symbols of the shortest beginning that is a node: up to it, `Model` has the same contexts.
SHORTEST = 3
#: Letters of a word beyond which it is taken in pieces, each a word of its own: text without spaces.
LONGEST = 48
_WORD = re.compile(rb"[a-z\x80-\xff]+")
#: Differences of a word from which its excess counts.
LEVELS = (1.0, 2.0, 4.0, 6.0)
FEATURES = 2 + 2 * len(LEVELS)


def symbols(raw: list[bytes], lowered: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols, each text between boundaries, and the number of its text at each. A letter of
    three bytes has two symbols, so beginnings, which are lower-cased, may end inside one."""
    folded = [b"\0%b\0" % (x if lowered else x.decode().lower().encode()).translate(FOLD, LEADS) for x in raw]
    owner = np.repeat(np.arange(len(raw)), [len(x) for x in folded])
    return np.frombuffer(b"".join(folded), np.uint8).astype(np.int32), owner


def grams(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of letters and word ends, and each one's gram with its context in the word."""
    code, seen = s.copy(), np.ones(len(s), bool)
    for k in range(1, ORDER):
        before = np.zeros_like(s)
        before[k:] = s[:-k]
        before *= seen
        code += before * SYMBOLS**k
        seen = before > 0
    at = np.flatnonzero((s > 0) | (code >= SYMBOLS))
    return at, code[at]


class Model:
    """diff: the difference of log-probabilities of every gram."""

    def __init__(self, toxic: np.ndarray, ordinary: np.ndarray):
        q = self._shared(toxic + ordinary)
        self.toxic, self.ordinary = (self._top(n, q).astype(np.float32) for n in (toxic, ordinary))
        self.diff = np.log(self.toxic) - np.log(self.ordinary)

    @staticmethod
    def _discount(n: np.ndarray) -> float:
        one, two = float((n == 1).sum()), float((n == 2).sum())
        return one / (one + 2 * two) if one and two else 0.5

    @classmethod
    def _shared(cls, pooled: np.ndarray) -> np.ndarray:
        """Probabilities of the last symbol of grams of ORDER - 1, from continuation counts."""
        counts, now = [], pooled
        for order in range(ORDER - 1, 0, -1):
            now = (now > 0).reshape(SYMBOLS, SYMBOLS**order).sum(0)
            counts.append(now)
        q = np.full(1, 1 / SYMBOLS)
        for n in reversed(counts):
            q = cls._smooth(n, q)
        return q

    @classmethod
    def _smooth(cls, n: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        d = cls._discount(n)
        rows = n.reshape(-1, SYMBOLS).astype(float)
        total, kinds = rows.sum(1, keepdims=True), (rows > 0).sum(1, keepdims=True)
        back = np.tile(shorter.reshape(-1, SYMBOLS) if len(shorter) > 1 else np.full((1, SYMBOLS), shorter[0]), (len(rows) // max(1, len(shorter) // SYMBOLS), 1))
        with np.errstate(invalid="ignore", divide="ignore"):
            p = np.maximum(rows - d, 0) / total + d * kinds / total * back
        return np.where(total > 0, p, back).reshape(-1)

    @classmethod
    def _top(cls, n: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return cls._smooth(n, shared)


@dataclass
class Fitted:
    """Character models for the texts of each half and for all others, and the node table: node (a
    hash) and gain0 to gain2, by number of the model: its difference, and by how much what its
    context gives symbols without a node exceeds the node before's. So the gains of a word's nodes,
    each the beginning of the next, sum to their differences and the last one's backing off."""

    models: list[Model]
    nodes: DataFrame


NAMES = [f"f{i}" for i in range(FEATURES)]
KINDS = ("t0", "o0", "t1", "o1")


def words(text: bytes) -> list[bytes]:
    """The text's words in order, longer ones than LONGEST letters in pieces."""
    found = _WORD.findall(text.decode().lower().encode())
    if max(map(len, found), default=0) <= LONGEST:
        return found
    out: list[bytes] = []
    for w in found:
        if len(w) <= LONGEST:
            out.append(w)
        else:
            letters = w.decode()
            out += [letters[i : i + LONGEST].encode() for i in range(0, len(letters), LONGEST)]
    return out


def beginnings(of: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every symbol of the words, their ends included: number of the word, place in it, gram of
    characters, and node: the hash of the word's bytes up to the symbol (0 below SHORTEST)."""
    s, owner = symbols(of)
    at, code = grams(s)
    word = owner[at]
    first = np.searchsorted(word, np.arange(len(of)))
    nodes: list[int] = []
    digest = xxhash.xxh64_intdigest
    for w in of:
        ends = symbol_ends(w)
        nodes += [0] * min(SHORTEST - 1, len(ends))
        nodes += [digest(w[:e]) for e in ends[SHORTEST - 1 :]]
        nodes.append(digest(w + b"\0") if len(ends) >= SHORTEST - 1 else 0)
    return word, np.arange(len(word)) - first[word], code, np.array(nodes, np.uint64).view(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, and toxic and ordinary occurrences in this task's texts, by half."""
    n = np.zeros((4, SYMBOLS**ORDER), np.int64)
    for batch in batches:
        for block in row_blocks(batch, "text"):
            s, owner = symbols(texts(block.column(0)))
            at, code = grams(s)
            kind = 2 * block.column(2).to_numpy() + (1 - block.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            n += np.bincount(kind[owner[at]] * n.shape[1] + code, minlength=n.size).reshape(n.shape)
    held = np.flatnonzero(n.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), *[pa.array(x[held]) for x in n]], ["gram", "t0", "o0", "t1", "o1"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients by Newton's method, the last is the constant; classes as frequent as they are."""
    z, w = np.concatenate([x, np.ones((len(x), 1))], 1), np.zeros(x.shape[1] + 1)
    penalty = ridge * len(x) * np.diag([1.0] * x.shape[1] + [0.0]) / 100
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def symbol_ends(word: bytes) -> Sequence[int]:
    """Bytes of the word up to each of its symbols."""
    return range(1, len(word) + 1) if word.isascii() else [i + 1 for i, c in enumerate(word) if c < 192]


def head(word: bytes) -> bytes:
    """The word's first SHORTEST symbols: words that share a node share them."""
    ends = symbol_ends(word[: 4 * SHORTEST])
    return word[: ends[min(SHORTEST, len(ends)) - 1]]


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, its head, and its occurrences in this task's texts by KINDS."""
    held: tuple[Counter, ...] = tuple(Counter() for _ in KINDS)

    def rows() -> pa.RecordBatch:
        every = list(set().union(*held))
        columns = [pa.array([c[w] for w in every], pa.int64()) for c in held]
        for c in held:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array([head(w) for w in every], pa.binary()), *columns], ["word", "head", *KINDS])

    for batch in batches:
        for block in row_blocks(batch, "text"):
            for raw, toxic, half in zip(texts(block.column(0)), block.column(1).to_pylist(), block.column(2).to_pylist()):
                held[2 * half + (not toxic)].update(words(raw))
            if sum(map(len, held)) > KEPT:
                yield rows()
    yield rows()


#: A node and its counts by KINDS; `up`, of the node before it: its counts, `kinds`, how many nodes
#: follow it that a class has, and `cut`, occurrences of what follows it and is no node; `on`: its own.
#: Classes are KINDS, then toxic and ordinary of both halves.
_SIDES = [*KINDS, "t", "o"]
_TRIE = [*KINDS, *[f"up_{k}" for k in KINDS], *[f"up_kinds_{k}" for k in _SIDES], *[f"up_cut_{k}" for k in KINDS], *[f"on_kinds_{k}" for k in _SIDES], *[f"on_cut_{k}" for k in KINDS]]


class _Trie:
    """Words in order, with counts, to nodes (see _TRIE), in memory of one word's beginnings."""

    def __init__(self, cutoff: int) -> None:
        self.cutoff = cutoff
        self.rows: list[tuple] = []
        self.open: list[list] = []  # of each beginning of the last word: end, counts, kinds, cut, nodes that follow
        self.word = b""

    def _fold(self, name: bytes, n: list[int], kinds: list[int], cut: list[int], up: list | None) -> None:
        """A beginning that no further word has: it goes to the one before, or is the first."""
        if sum(n) < self.cutoff:
            if up:
                up[3] = [x + y for x, y in zip(up[3], n)]
            return
        row = (name, *n)
        if not up:
            self.rows.append((*row, *[0] * 14, *kinds, *cut))
            return
        t, o = n[0] + n[2], n[1] + n[3]
        up[2] = [x + (y > 0) for x, y in zip(up[2], (*n, t, o))]
        up[4].append((row, kinds, cut))

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            end, n, kinds, cut, follow = self.open.pop()
            up = self.open[-1] if self.open else None
            if up:
                up[1] = [x + y for x, y in zip(up[1], n)]
            for row, own, own_cut in follow:
                self.rows.append((*row, *n, *kinds, *cut, *own, *own_cut))
            self._fold(self.word[:end], n, kinds, cut, up)

    def add(self, word: bytes, n: list[int], shared: int) -> None:
        """shared: bytes at the word's beginning that the next word has too."""
        ends = symbol_ends(word)
        if len(ends) < SHORTEST - 1:
            return
        # The beginnings that the last word had too are open; of those that only this one has, the
        # counts are its own, and so many that they are nodes or none is.
        at, often = SHORTEST - 1 + len(self.open), sum(n) >= self.cutoff
        self.word = word
        while at < len(ends) and (ends[at] <= shared or often):
            self.open.append([ends[at], [0] * 4, [0] * 6, [0] * 4, []])
            at += 1
        up = self.open[-1] if self.open else None
        if up:
            up[1] = [x + y for x, y in zip(up[1], n)]
        if at == len(ends):
            self._fold(word + b"\0", n, [0] * 6, [0] * 4, up)
        elif up:
            up[3] = [x + y for x, y in zip(up[3], n)]
        keep = 0
        while keep < len(self.open) and self.open[keep][0] <= shared:
            keep += 1
        self._close(keep)

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * (1 + len(_TRIE))
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["name", *_TRIE])


def _noded(cutoff: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (word, KINDS) in order of words to _TRIE."""
        trie, last, n = _Trie(cutoff), None, [0] * 4
        for batch in batches:
            for word, *now in zip(*[c.to_pylist() for c in batch.columns]):
                if word == last:
                    n = [x + y for x, y in zip(n, now)]
                    continue
                if last is not None:
                    shared = 0
                    for x, y in zip(last, word):
                        if x != y:
                            break
                        shared += 1
                    trie.add(last, n, shared)
                    if len(trie.rows) >= WORDS_AT_ONCE:
                        yield trie.taken()
                last, n = word, now
        if last is not None:
            trie.add(last, n, 0)
        yield trie.taken()

    return run


def _gains(shorter: list[tuple[np.ndarray, np.ndarray]], used: Sequence[tuple[int, int]], discounts: np.ndarray) -> Callable:
    """Rows (name, _TRIE) to node and gains; shorter: each model's probabilities of grams, toxic and
    ordinary; used: its classes, as places in _SIDES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_pylist()
            column = {c: batch.column(1 + i).to_numpy().astype(float) for i, c in enumerate(_TRIE)}
            for x in ("", "up_", "up_cut_", "on_cut_"):
                column |= {f"{x}{c}": column[f"{x}{c}0"] + column[f"{x}{c}1"] for c in "to"}
            ended = np.array([x.endswith(b"\0") for x in names])
            s, owner = symbols([x.removesuffix(b"\0") for x in names], lowered=True)
            at, code = grams(s)
            # The gram of the last symbol: a word's end, or the letter before it.
            last = np.searchsorted(owner[at], np.arange(len(names)), "right") - 1
            code = code[last - ~ended]
            out = []
            for by_class, sides in zip(shorter, used):
                gain = np.zeros(len(names))
                for sign, side, q in zip((1, -1), sides, by_class):
                    c, d, q = _SIDES[side], discounts[side], q[code].astype(float)
                    n, total = column[c], column[f"up_{c}"]
                    free, free_on = (d * column[f"{x}_kinds_{c}"] + column[f"{x}_cut_{c}"] for x in ("up", "on"))
                    p = np.where(total > 0, (np.maximum(n - d, 0) * (n > 0) + free * q) / np.maximum(total, 1), q)
                    before, on = (np.where((t > 0) & (f > 0), f / np.maximum(t, 1), 1) for t, f in ((total, free), (np.where(ended, 0, n), free_on)))
                    gain += sign * (np.log(p) - np.log(before) + np.log(on))
                out.append(pa.array(gain.astype(np.float32)))
            node = pa.array(np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([node, *out], ["node", "gain0", "gain1", "gain2"])

    return run


def _nodes(rows: DataFrame, models: list[Model], used: Sequence[tuple[int, int]], cutoff: int) -> DataFrame:
    """The node table of rows (text, toxic, half); used: each model's classes, as places in _SIDES."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spelled = rows.mapInArrow(_spelled, "word binary, head binary, " + ", ".join(f"{c} long" for c in KINDS))
    dealt = spelled.repartition(parts, "head").drop("head").sortWithinPartitions("word")
    counted = stored(few(dealt.mapInArrow(_noded(cutoff), "name binary, " + ", ".join(f"{c} long" for c in _TRIE))))
    sides = [F.col(c) for c in KINDS] + [F.col("t0") + F.col("t1"), F.col("o0") + F.col("o1")]
    after = counted.where(" + ".join(f"up_{k}" for k in KINDS) + " > 0")
    often = after.agg(*[F.count_if(x == k).alias(f"n{i}_{k}") for i, x in enumerate(sides) for k in (1, 2)]).first()
    discounts = np.array([often[f"n{i}_1"] / (often[f"n{i}_1"] + 2 * often[f"n{i}_2"]) if often[f"n{i}_1"] and often[f"n{i}_2"] else 0.5 for i in range(len(sides))])
    return stored(few(counted.mapInArrow(_gains([(m.toxic, m.ordinary) for m in models], used, discounts), "node long, gain0 float, gain1 float, gain2 float")))


def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: set[bytes] = set()
    for batch in batches:
        for block in row_blocks(batch, "text"):
            for raw in texts(block.column(0)):
                held.update(words(raw))
            if len(held) > KEPT:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary())], ["word"])
                held.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary())], ["word"])


def _begun(diffs: list[np.ndarray], which: Sequence[int]) -> Callable:
    """Rows (word) to its key, and its nodes with their differences by characters; the symbols
    before the first node are one row without a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, WORDS_AT_ONCE):
                part = batch.column(0).slice(i, WORDS_AT_ONCE).to_pylist()
                word, place, code, node = beginnings(part)
                key = np.array([xxhash.xxh64_intdigest(w) for w in part], np.uint64).view(np.int64)
                own = np.flatnonzero(place >= SHORTEST - 1)
                early = place < SHORTEST - 1
                columns = []
                for table in diffs:
                    diff = table[code].astype(float)
                    columns.append(pa.array(np.concatenate((np.bincount(word[early], diff[early], len(part)), diff[own])).astype(np.float32)))
                nodes = pa.array(np.concatenate((np.zeros(len(part), np.int64), node[own])), mask=np.arange(len(part) + len(own)) < len(part))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((key, key[word[own]]))), nodes, *columns], ["word", "node", *[f"char{m}" for m in which]])

    return run


def word_differences(rows: DataFrame, fitted: Fitted, which: Sequence[int]) -> DataFrame:
    """word (a hash) and word0, ...: the models' differences, of all words of rows (text)."""
    different = rows.select("text").mapInArrow(_different, "word binary").distinct()
    begun = different.mapInArrow(_begun([fitted.models[m].diff for m in which], which), "word long, node long, " + ", ".join(f"char{m} float" for m in which))
    nodes = fitted.nodes.select("node", *[f"gain{m}" for m in which])
    met = begun.join(nodes, "node", "left")
    return met.groupBy("word").agg(*[F.sum(F.coalesce(f"gain{m}", f"char{m}").cast("double")).alias(f"word{m}") for m in which]).select("word", *[F.col(f"word{m}").cast("float") for m in which])


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, key, which, text) to the text's different words, how often they occur and their
    symbols; a text without words has one row without a word."""
    for batch in batches:
        for block in row_blocks(batch, "text"):
            at, hashes, n, size = [], [], [], []
            keys: dict[bytes, tuple[int, int]] = {}
            for i, raw in enumerate(texts(block.column(3))):
                held = Counter(words(raw))
                for w in held:
                    if w not in keys:
                        keys[w] = (xxhash.xxh64_intdigest(w), len(w.translate(None, LEADS)) + 1)
                known = [keys[w] for w in held] or [(0, 0)]
                at += [i] * len(known)
                hashes += [k for k, _ in known]
                size += [k for _, k in known]
                n += held.values() or (0,)
            take = pa.array(at, pa.int32())
            columns = [pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(size, pa.int32())]
            yield pa.RecordBatch.from_arrays([*[block.column(k).take(take) for k in range(3)], *columns], ["row", "key", "which", "word", "n", "size"])


def _features(whole: np.ndarray, size: np.ndarray, top: np.ndarray, excess: list[np.ndarray], n: np.ndarray) -> list[np.ndarray]:
    """NAMES of texts with n words and `size` symbols."""
    columns = [whole / np.maximum(size, 1) * 10, np.clip(top, -10, 20) / 5]
    for e in excess:
        columns += [np.log1p(e), np.sqrt(e / np.maximum(n, 1))]
    return columns


def _here(diffs: list[np.ndarray], which: Sequence[int], nodes: np.ndarray, gains: list[np.ndarray]) -> Callable:
    """Rows (key, which, text) to key and NAMES, by the differences of grams and the node table as
    arrays, for each model of `which`; nodes ascend."""
    place = {m: i for i, m in enumerate(which)}

    def differences(of: list[bytes]) -> np.ndarray:
        word, _, code, node = beginnings(of)
        at = np.minimum(np.searchsorted(nodes, node), max(len(nodes) - 1, 0))
        known = (nodes[at] == node) & (node != 0) if len(nodes) else np.zeros(len(node), bool)
        out = np.empty((len(which), len(of)), np.float32)
        for i, table in enumerate(diffs):
            diff = table[code].astype(float)
            if known.any():
                diff[known] = gains[i][at[known]]
            out[i] = np.bincount(word, diff, len(of))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[bytes, int] = {}
        held, sizes = np.zeros((len(which), 0), np.float32), np.zeros(0, np.int64)
        for batch in batches:
            for block in row_blocks(batch, "text"):
                if len(index) > KEPT:
                    index, held, sizes = {}, held[:, :0], sizes[:0]
                rows, at, n, counts = block.num_rows, [], [], []
                for raw in texts(block.column(2)):
                    found = Counter(words(raw))
                    counts.append(len(found))
                    at += [index.setdefault(w, len(index)) for w in found]
                    n += found.values()
                fresh = list(islice(index, len(sizes), None))
                held = np.concatenate([held, *[differences(fresh[i : i + WORDS_AT_ONCE]) for i in range(0, len(fresh), WORDS_AT_ONCE)]], 1)
                sizes = np.concatenate((sizes, np.array([len(w.translate(None, LEADS)) + 1 for w in fresh], np.int64)))
                owner, n = np.repeat(np.arange(rows), counts), np.array(n, float)
                at, model = np.array(at, np.int64), np.array([place[m] for m in block.column(1).to_pylist()], np.int64)
                diff = held[model[owner], at].astype(float)
                total = lambda x: np.bincount(owner, x, rows)
                top = np.full(rows, -np.inf)
                np.maximum.at(top, owner, diff)
                top[np.isinf(top)] = 0
                excess = [total(np.maximum(diff - level, 0) * n) for level in LEVELS]
                columns = _features(total(diff * n), total(sizes[at] * n), top, excess, total(n))
                yield pa.RecordBatch.from_arrays([block.column(0), *[pa.array(c) for c in columns]], ["key", *NAMES])

    return run


def _compared(rows: DataFrame, fitted: Fitted, which: Sequence[int]) -> DataFrame:
    """key and FEATURES differences of each of the rows (key, text, which: its model)."""
    if fitted.nodes.count() <= AT_ONCE:
        known = fitted.nodes.select("node", *[f"gain{m}" for m in which]).toArrow()
        order = np.argsort(known.column(0).to_numpy())
        nodes, *gains = [c.to_numpy()[order] for c in known.columns]
        del known, order
        run = _here([fitted.models[m].diff for m in which], which, nodes, gains)
        return rows.select("key", F.col("which").cast("int").alias("which"), "text").mapInArrow(run, "key long, " + ", ".join(f"{n} double" for n in NAMES))
    table = stored(few(word_differences(rows, fitted, which)))
    table = F.broadcast(table) if table.count() <= BROADCAST_WORDS else table
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "key", F.col("which").cast("int").alias("which"), "text")
    met = numbered.mapInArrow(_worded, "row long, key long, which int, word long, n int, size int").join(table, "word", "left")
    diff = F.coalesce(*[F.when(F.col("which") == m, F.col(f"word{m}")) for m in which], F.lit(0.0)).cast("double")
    held = met.withColumn("diff", F.when(F.col("n") > 0, diff)).groupBy("row").agg(
        F.first("key").alias("key"),
        F.sum("n").alias("n"),
        F.sum(F.col("diff") * F.col("n")).alias("whole"),
        F.sum(F.col("size") * F.col("n")).alias("size"),
        F.max("diff").alias("top"),
        *[F.sum(F.greatest(F.col("diff") - level, F.lit(0.0)) * F.col("n")).alias(f"excess{i}") for i, level in enumerate(LEVELS)],
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    columns = [zero(F.col("whole") / F.nullif("size", F.lit(0))) * 10, zero(F.when(F.col("top").isNotNull(), F.greatest(F.least("top", F.lit(20.0)), F.lit(-10.0)))) / 5]
    for i in range(len(LEVELS)):
        columns += [F.log1p(zero(F.col(f"excess{i}"))), F.sqrt(zero(F.col(f"excess{i}")) / F.greatest("n", F.lit(1)))]
    return held.select("key", *[c.alias(n) for n, c in zip(NAMES, columns)])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, cutoff: int = CUTOFF) -> tuple[Fitted | None, np.ndarray | float]:
    """Model and coefficients (or a constant score) from labels (doc_id, toxic) of documents; all
    rows are counted, and at most `sample` rows, by a hash of the id, fit the calibration."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic") > 0).alias("toxic"))
    small = labels.count() <= BROADCAST_LABELS
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    rows = bounded(docs).select("doc_id", "text").join(F.broadcast(known) if small else known, "doc_id")
    counted = rows.select("text", "toxic", half.alias("half")).mapInArrow(_counts, "gram int, t0 long, o0 long, t1 long, o1 long")
    table = counted.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("t0", "o0", "t1", "o1")]).toPandas()
    # The table has SYMBOLS ** ORDER rows at most.
    n = np.zeros((4, SYMBOLS**ORDER), np.int64)
    for i, c in enumerate(("t0", "o0", "t1", "o1")):
        n[i, table["gram"]] = table[c]
    toxic, ordinary = n[0] + n[2], n[1] + n[3]
    if not toxic.any() or not ordinary.any():
        return None, float(toxic.any())
    model = Model(toxic, ordinary)
    # Each half is compared by the other one's models; a half without one of the classes has none.
    sums = 4, 5
    halves = [(Model(n[2 * i], n[2 * i + 1]), (2 * i, 2 * i + 1)) if n[2 * i].any() and n[2 * i + 1].any() else (model, sums) for i in (1, 0)]
    models, used = map(list, zip(*halves, (model, sums)))
    fitted = Fitted(models, _nodes(rows.select("text", "toxic", half.alias("half")), models, used, cutoff))
    ids = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    x = _compared(chosen.select(F.col("toxic").cast("long").alias("key"), "text", half.alias("which")), fitted, (0, 1)).toPandas()
    y = x["key"].to_numpy(float)
    if y.min(initial=1) == y.max(initial=0):
        return None, float(y.mean()) if len(y) else 0.0
    return fitted, _logistic(x[NAMES].to_numpy(), y)


def score(docs: DataFrame, model: Fitted | None, weights: np.ndarray | float, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, score and predicted, from the text alone."""
    if model is None:
        scored = docs.select(F.col("doc_id").cast("long"), F.lit(float(weights)).alias("score"))
    else:
        x = _compared(bounded(docs).select(F.col("doc_id").cast("long").alias("key"), "text", F.lit(2).alias("which")), model, (2,))
        w = [float(v) for v in weights]
        z = F.lit(w[-1]) + sum((F.col(n) * v for n, v in zip(NAMES, w)), F.lit(0.0))
        scored = x.select(F.col("key").alias("doc_id"), (1 / (1 + F.exp(-z))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
