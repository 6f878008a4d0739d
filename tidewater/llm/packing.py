"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

A document is its token ids and a closing 0; only longer ones are cut, into pieces of the capacity.
Pieces of equal length can stand for each other, so what is to be packed is the table of lengths and
their counts, which has `capacity` rows however large the corpus is, and a solution is a table of
bins: what a bin holds, as (length, count) pairs, and how many such bins there are.

The genetic algorithm works on those groups. Crossover injects a random part of the well-filled bins
of one parent whole into the other, takes bins of the other as often as their documents are still
there (which removes duplicates), and best-fits the documents that lost their bins into the room
that is left. Mutation empties bins with room and copies of some full ones. Islands are Spark tasks,
each with a population of its own; after every epoch the elite of an island moves to the next one, by
a shuffle of solutions. It ends when a solution meets the lower bound of Martello and Toth, which
proves that no packing is smaller, when an epoch betters nothing, or after EPOCHS.

Pieces then get their places without meeting in one task: they are numbered within their length in
SALTS parts, a part's first number is the sum of the parts before it, and number and length give
bin and offset by a binary search in the table of bins, which is bounded by the capacity.

Defined results: a null text is an empty one, and an empty text is the single id 0; repeated rows and
ids are packed each; documents of equal length and id are in the order of their checksum, so reruns
agree; a null id stays null; no row is dropped; extra columns are not read; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from tidewater.llm.blocks import row_blocks, texts
from tidewater.llm.storage import bounded, few, stored

CLOSING = 0
#: Words whose ids a task keeps; beyond it the table starts anew. Longer ones than LONG are not kept.
KEPT, LONG = 1_200_000, 64
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 6, 6, 6, 8
#: Kinds of bins a solution may have; a child with more is not taken into the population.
KINDS = 20_000
#: Pieces numbered in one part of a length, and the least number of parts.
PART, SALTS = 100_000, 128
#: Pre-tokens of one ASCII word in this kind of vocabulary, lower-cased (fixed value).
PRE_TOKEN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

Bin = tuple[tuple[int, int], ...]
Solution = dict[Bin, int]


class _Words(dict):
    """Token ids of words, as bytes. Words between white space are coded one by one by the library;
    an ASCII word of several pre-tokens is put together from theirs."""

    def __init__(self, path: str) -> None:
        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.special = [t.content.encode() for t in self.encoder.get_added_tokens_decoder().values()]
        vocabulary = self.encoder.get_vocab()
        suffix = getattr(self.encoder.model, "end_of_word_suffix", None)
        if not suffix:
            raise ValueError("a vocabulary with word ends is needed: others code white space too")
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def code(self, raw: list[bytes]) -> list[bytes]:
        coded = self.encoder.encode_batch_fast([w.decode() for w in raw], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in coded]

    def learn(self, words: set[bytes]) -> None:
        """Codes new words; pre-tokens of ASCII travel together, and word ends part them again."""
        fresh = [w for w in words if w not in self]
        parts = {w: PRE_TOKEN.findall(w) for w in fresh if w.isascii()}
        single = [p for p in {p for found in parts.values() for p in found} if p not in self]
        for i in range(0, len(single), 512):
            some = single[i : i + 512]
            (coded,) = self.code([b" ".join(some)])
            ends = np.flatnonzero(self.last[np.frombuffer(coded, "<u4")]) + 1
            if len(ends) == len(some):
                at = [0, *(4 * ends).tolist()]
                self.update(zip(some, (coded[a:b] for a, b in zip(at, at[1:]))))
            else:
                self.update(zip(some, self.code(some)))
        self.update((w, b"".join(map(self.__getitem__, found))) for w, found in parts.items() if len(found) > 1)
        others = [w for w in fresh if not w.isascii()]
        self.update(zip(others, self.code(others)))

    def ids(self, raw: list[bytes]) -> list[bytes]:
        """Each text's ids, little-endian. Texts with the string of a special token go whole."""
        cut = [None if any(s in t for s in self.special) else t.lower().split() for t in raw]
        if len(self) > KEPT:
            self.clear()
        words = set().union(*(c for c in cut if c))
        long = {w for w in words if len(w) > LONG}
        self.learn(words - long)
        out = []
        for text, found in zip(raw, cut):
            if found is None:
                out.append(self.code([text])[0])
            elif long and not long.isdisjoint(found):
                out.append(b"".join(self.code([w])[0] if w in long else self[w] for w in found))
            else:
                out.append(b"".join(map(self.__getitem__, found)))
        return out


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def _cut(path: str, capacity: int):  # noqa: ANN202
    closing = CLOSING.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            for block in row_blocks(batch, "text"):
                coded = [i + closing for i in words.ids(texts(block.column(1)))]
                n = np.array([-(-len(i) // (4 * capacity)) for i in coded], np.int64)
                owner = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                parts = [coded[o][4 * s : 4 * (s + capacity)] for o, s in zip(owner.tolist(), start.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column(0).take(pa.array(owner)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array([len(p) // 4 for p in parts], pa.int64()),
                        pa.array(parts, pa.binary()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return run


def pieces(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian, 32 bits each) of every document. path: a
    BPE .json with word ends that drops white space and lower-cases."""
    narrow = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_cut(path, capacity), "doc_id long, piece int, start long, length long, ids binary")


def lower_bound(counts: np.ndarray) -> int:
    """Martello and Toth's bound on the number of bins, from counts of lengths 0..capacity."""
    capacity = len(counts) - 1
    size = np.arange(capacity + 1)
    n, mass = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * size)))
    half = capacity // 2
    best = -(-int(mass[-1]) // capacity)
    for t in range(half + 1):
        large = n[-1] - n[capacity - t + 1]
        middle, held = n[capacity - t + 1] - n[half + 1], mass[capacity - t + 1] - mass[half + 1]
        small = mass[half + 1] - mass[t]
        best = max(best, int(large + middle + max(0, -(-(small - (middle * capacity - held)) // capacity))))
    return best


def room(content: Bin, capacity: int) -> int:
    return capacity - sum(length * k for length, k in content)


def cost(solution: Solution, capacity: int) -> tuple[int, float]:
    """Bins, and less the mean square fill: of two with as many bins, the one with fuller ones leads."""
    bins = sum(solution.values())
    return bins, -sum(m * (1 - room(b, capacity) / capacity) ** 2 for b, m in solution.items()) / max(1, bins)


def best_fit(solution: Solution, order: Iterator[tuple[int, int]], capacity: int) -> Solution:
    """Puts n pieces of each (length, n), in this order, where they leave the least room, opening
    bins where none has enough. Equal bins are handled at once."""
    by_room: dict[int, dict[Bin, int]] = {}
    for content, m in solution.items():
        by_room.setdefault(room(content, capacity), {})[content] = m
    rooms = np.zeros(capacity + 1, bool)
    rooms[list(by_room)] = True

    def put(content: Bin, left: int, m: int) -> None:
        held = by_room.setdefault(left, {})
        held[content] = held.get(content, 0) + m
        rooms[left] = True

    def joined(content: Bin, length: int, k: int) -> Bin:
        held = dict(content)
        held[length] = held.get(length, 0) + k
        return tuple(sorted(held.items(), reverse=True))

    for length, n in order:
        for left in (np.flatnonzero(rooms[length:]) + length).tolist() if n else ():
            there, k = by_room.pop(left), left // length
            rooms[left] = False
            for content, m in there.items():
                full = min(m, n // k)
                n -= full * k
                if full:
                    put(joined(content, length, k), left - k * length, full)
                if full < m and n:
                    put(joined(content, length, n), left - n * length, 1)
                    full, n = full + 1, 0
                if full < m:
                    put(content, left, m - full)
            if not n:
                break
        k = capacity // length
        if n >= k:
            put(((length, k),), capacity - k * length, n // k)
        if n % k:
            put(((length, n % k),), capacity - n % k * length, 1)
    return {content: m for held in by_room.values() for content, m in held.items()}


def _shuffled(counts: np.ndarray, rng: np.random.Generator, noise: float) -> list[tuple[int, int]]:
    """(length, count) from the longest on, disturbed: noise 0 is decreasing order, 1 nearly any."""
    sizes = np.flatnonzero(counts)
    key = sizes / len(counts) + noise * rng.random(len(sizes))
    return [(int(i), int(counts[i])) for i in sizes[np.argsort(-key, kind="stable")]]


def _take(left: np.ndarray, content: Bin, most: int) -> int:
    """How many such bins the documents that are left can fill; they are taken."""
    m = min([most, *(int(left[length]) // k for length, k in content)])
    for length, k in content:
        left[length] -= m * k
    return m


def crossover(a: Solution, b: Solution, counts: np.ndarray, rng: np.random.Generator) -> Solution:
    capacity, left, child = len(counts) - 1, counts.copy(), {}
    fullest = sorted(b, key=lambda c: room(c, capacity))
    injected = fullest[: max(1, int(len(fullest) * rng.uniform(0.2, 0.8)))]
    chosen = [c for c, u in zip(injected, rng.random(len(injected))) if u < 0.7] or injected[:1]
    for content, most in (*((c, b[c]) for c in chosen), *((c, a[c]) for c in sorted(a, key=lambda c: room(c, capacity)))):
        if m := _take(left, content, most):
            child[content] = child.get(content, 0) + m
    return best_fit(child, iter(_shuffled(left, rng, 0.05)), capacity)


def mutate(solution: Solution, counts: np.ndarray, rng: np.random.Generator) -> Solution:
    """Empties half of the kinds of bins with room and some copies of one in twenty full kinds, and
    best-fits what they held, in an order that is disturbed more or less."""
    capacity = len(counts) - 1
    left, kept = np.zeros_like(counts), dict(solution)
    for (content, m), u, v in zip(solution.items(), rng.random(len(solution)), rng.random(len(solution))):
        loose = room(content, capacity) > 0
        if u < (0.5 if loose else 0.05):
            out = m if loose else math.ceil(m**v)
            kept[content] -= out
            if not kept[content]:
                del kept[content]
            for length, k in content:
                left[length] += k * out
    return best_fit(kept, iter(_shuffled(left, rng, rng.choice((0, 0.01, 0.05, 0.2)))), capacity)


def _packed_up(solution: Solution) -> bytes:
    return np.array([x for content, m in solution.items() for x in (m, len(content), *(y for pair in content for y in pair))], "<i8").tobytes()


def unpacked(raw: bytes) -> Solution:
    flat, at, out = np.frombuffer(raw, "<i8").tolist(), 0, {}
    while at < len(flat):
        m, n = flat[at], flat[at + 1]
        out[tuple((flat[at + 2 + 2 * i], flat[at + 3 + 2 * i]) for i in range(n))] = m
        at += 2 + 2 * n
    return out


def _evolve(counts: np.ndarray, bound: int, epoch: int):  # noqa: ANN202
    capacity = len(counts) - 1

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        island = key[0].as_py()
        rng = np.random.default_rng([island, epoch])
        # In a fixed order, whatever order the rows came in.
        known = sorted({r for r in rows.column("solution").to_pylist() if r is not None})
        living = [unpacked(r) for r in known]
        while len(living) < POPULATION:
            living.append(best_fit({}, iter(_shuffled(counts, rng, len(living) / POPULATION)), capacity))
        living.sort(key=lambda s: cost(s, capacity))
        for _ in range(GENERATIONS):
            if sum(living[0].values()) <= bound:
                break
            for _ in range(POPULATION // 2):
                i, j = (int(min(rng.integers(len(living), size=2))) for _ in range(2))
                child = crossover(living[i], living[j], counts, rng) if i != j else mutate(living[i], counts, rng)
                if rng.random() < 0.3:
                    child = mutate(child, counts, rng)
                if len(child) <= KINDS:
                    living.append(child)
            best = {_packed_up(s): s for s in living}
            living = sorted(best.values(), key=lambda s: cost(s, capacity))[:POPULATION]
        costs = [cost(s, capacity) for s in living]
        return pa.table({
            "island": pa.array([island] * len(living), pa.int32()),
            "place": pa.array(range(len(living)), pa.int32()),
            "bins": pa.array([c[0] for c in costs], pa.int64()),
            "spread": pa.array([c[1] for c in costs], pa.float64()),
            "solution": pa.array([_packed_up(s) for s in living], pa.binary()),
        })

    return run


def evolved(pieces_: DataFrame, capacity: int) -> tuple[Solution, int]:
    """The best packing found for the lengths of the pieces, and the bound under which none can be.
    The driver reads counts of `capacity` lengths and one solution, whatever the number of pieces."""
    spark = pieces_.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces_.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    bound = lower_bound(counts)
    schema = "island int, place int, bins long, spread double, solution binary"
    living = spark.range(ISLANDS).selectExpr("int(id) AS island", "int(0) AS place", "0L AS bins", "0D AS spread", "binary(NULL) AS solution")
    best = None
    for epoch in range(EPOCHS):
        # The elite of an island also lives on the next one from here on.
        moved = living.where("place = 0").withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))
        both = living.unionByName(moved) if epoch else living
        # A stated number of partitions: small ones would else be joined, and islands wait for each other.
        dealt = both.repartition(ISLANDS, "island")
        living = stored(dealt.groupBy("island").applyInArrow(_evolve(counts, bound, epoch), schema))
        former, best = best, living.orderBy("bins", "spread", "island", "place").first()
        if best["bins"] <= bound or former and best["bins"] == former["bins"]:
            break
    return unpacked(bytes(best["solution"])), bound


def _places(solution: Solution) -> dict[str, np.ndarray]:
    """Ranges of numbers within a length: first number, pieces of it in a bin, first bin, offset."""
    rows, used, base = [], {}, 0
    for content, m in sorted(solution.items(), reverse=True):
        offset = 0
        for length, k in content:
            rows.append((length, used.get(length, 0), k, base, offset))
            used[length] = used.get(length, 0) + m * k
            offset += k * length
        base += m
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "base", "offset"), table.T))


def pack(pieces_: DataFrame, capacity: int = 2048) -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32: a stored table) with sequence_id and
    offset."""
    solution, _ = evolved(pieces_, capacity)
    at = _places(solution)
    # One sorted key for (length, number): lengths are ranges of a fixed width.
    wide = np.int64(1) << 48
    keys = at["length"] * wide + at["first"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            i = np.searchsorted(keys, length * wide + number, "right") - 1
            nth = number - at["first"][i]
            sequence, offset = at["base"][i] + nth // at["each"][i], at["offset"][i] + nth % at["each"][i] * length
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    salts = max(SALTS, pieces_.count() // PART)
    salted = pieces_.select(*names[:5], F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).alias("part"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = few(salted.groupBy("length", "part").agg(F.count("*").alias("n"))).select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("own", F.row_number().over(own)).join(parts, ["length", "part"])
    numbered = numbered.select(*names[:5], (F.col("before") + F.col("own") - 1).alias("number"))
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(packed: DataFrame, pieces_: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of every sequence: pieces meet their ids by document, piece and
    checksum. Of equal pieces each has a sequence of its own, so equal rows are numbered on both sides."""
    key = ["doc_id", "piece", "ids_crc32"]
    nth = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(order))
    coded = pieces_.select("doc_id", "piece", F.crc32("ids").alias("ids_crc32"), "ids").withColumn("_nth", nth("ids"))
    placed = packed.withColumn("_nth", nth(F.struct("sequence_id", "offset")))
    met = placed.alias("p").join(coded.alias("c"), F.expr(" AND ".join(f"p.{k} <=> c.{k}" for k in [*key, "_nth"])))
    rows = F.array_sort(F.collect_list(F.struct("p.offset", "c.ids")))
    whole = F.aggregate(rows, F.lit(b""), lambda out, r: F.concat(out, r["ids"]))
    return met.groupBy("p.sequence_id").agg(F.sum("p.length").alias("n_tokens"), whole.alias("ids"))


def digest(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, path, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stored(cut), capacity)
