"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles.

A document's shingles are its runs of `words` words, lower-cased (a shorter text is one shingle); a
shingle weighs its frequency in the text times its inverse document frequency, 1 + ln((1 + N) / (1 + df)),
where df is the exact number of documents that hold it. Shingles of over FREQUENT of the documents
go to all tasks: every task keeps a bounded summary of its own, the summaries' sums cannot miss one
however the texts are dealt, and what they propose, at most 3 / FREQUENT times the shingles of a mean
text, is then counted in all documents. The others are counted by a shuffle: documents are gathered
in runs of about RUN shingles, a run's different hashes are dealt by their leading bits into slices,
a slice counts each hash over all runs, and tells each run which of its hashes stand in several
documents, and in how many. Hashes and places travel sorted, as differences.

1. Signatures, run by run: SIDE * SIDE consistent weighted samples a text. A band is a line of the affine
   plane of order SIDE whose points are the samples: 20 bands of 4 samples that cross in such a way
   that two signatures share a band whenever 10 of 16 samples agree.
2. Texts that are equal are one node. Nodes that share a band key are candidates. A bucket's leader is
   its most popular node, the one whose keys have most nodes. In each of ROUNDS rounds, a node is
   compared with one leader of a bucket that still holds several components, that which leads most
   of the node's buckets and was not compared with it before: one row a node, not one a pair or a
   bucket. Links make components. What a bucket then has left are pairs of its nodes outside its
   largest component with nodes of other components: joined in small buckets, compared in blocks of
   CHUNK nodes on both sides in larger ones, which give links only. Pairs whose signatures agree too
   little for LEAST are not verified.
3. A verified link has weighted Jaccard similarity, over all shingles of both texts, of `least`.
4. Classes are the connected components of links, by label propagation with pointer jumping.

A bucket that holds a third of all texts is joined by key, where skewed parts are split; counts per
bucket are pre-aggregated. Nothing but the few very frequent shingles goes to the driver.

Defined results: a null text, and one without a word, is a class of its own; equal texts are of one
class; rows that repeat an id are told apart by their text; the class id is the least id in it; a
very long text is a block of its own, and takes about 30 bytes of a task's memory a byte; other
columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidewater.llm.blocks import flat, ranges, row_blocks, texts
from tidewater.llm.decontaminate import FOLD
from tidewater.llm.storage import bounded, checkpointed, few, stored, unused
from tidewater.sources.shared import temporary

WORDS, LEAST = 5, 0.8
SIDE = 4
SAMPLES = SIDE * SIDE
#: Share of the documents under which a shingle's df counts as that share: there is none.
SATURATION = 0.0
#: Share of the documents over which a shingle is counted by summaries and known to all tasks.
FREQUENT = 0.05
#: Entries of a task's summary of frequent shingles; it has more where texts are so long that twice
#: the shingles a text, over FREQUENT, are more: what is lost stays under half of FREQUENT.
SUMMARY = 1 << 16
#: Shingles of a run of documents; bytes of all text for each slice of hashes, and slices at least.
RUN, SLICE_BYTES, SLICES = 1 << 19, 16 << 20, 64
#: Agreeing samples from which a pair is verified after its bucket's leader: at similarity LEAST,
#: fewer of 16 agree in 0.02 % of pairs.
AGREE = 8
#: Rounds of comparisons with leaders.
ROUNDS = 3
#: Nodes of a bucket up to which its leftover pairs are joined, and of a larger one's block: of
#: signatures, and of whole vectors.
SMALL, CHUNK, VECTORS = 16, 1024, 256
#: Rows of ids up to which they are broadcast to the texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Labels of components up to which they are broadcast: few, as each round broadcasts new ones.
BROADCAST_LABELS = 20_000
BLOCK = 512 << 10
#: Columns of a node's shingles and what they weigh by.
VECTOR = ("hashes", "counts", "places", "df")

_rng = np.random.default_rng(20240612)
_BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE, _STEP = 0xD1342543DE82EF95, 0x9E3779B97F4A7C15
_ODD = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
_BITS = 16
# Tables of the sampling variables, looked up by bits of a hash of shingle and sample number.
_R = _rng.gamma(2, 1, 1 << _BITS)
_LN_C = np.log(_rng.gamma(2, 1, 1 << _BITS))
_BETA = _rng.random(1 << _BITS)
# What a shingle of weight 1 has, whose level is 0.
_LN_A = _LN_C - _R * (0 - _BETA) - _R


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


_kept: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse; those for the usual block are kept."""
    if len(_kept[0]) > n:
        return _kept[0], _kept[1]
    size = max(n, BLOCK) + 1
    made = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    if size <= 8 * BLOCK:
        _kept[:] = made
    return made[0], made[1]


def runs_of_words(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All shingles, in the order of the texts: row and hash."""
    data, offsets = flat(column)
    n, rows = len(data), len(offsets) - 1
    b = np.frombuffer(bytes(data).translate(FOLD), np.uint8)
    letter = np.concatenate(([False], b != 32, [False]))
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    # A row's end inside letters ends one word and begins the next.
    inner = offsets[1:-1][letter[offsets[1:-1]] & letter[offsets[1:-1] + 1]] if rows > 1 else edge[:0]
    opens = letter[edge + 1]
    start, end = edge[opens], edge[~opens]
    if len(inner):
        once = inner[np.concatenate(([True], inner[1:] != inner[:-1]))]
        start, end = np.sort(np.concatenate((start, once))), np.sort(np.concatenate((end, once)))
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, back = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[b] * power[:n], out=total[1:])
    word = _mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(offsets, start, "right") - 1
    count = np.bincount(row, minlength=rows)
    # Runs of `words` words inside a row; of a shorter row, all its words.
    size = np.minimum(count, words)
    first = np.cumsum(count) - count
    head = ranges(first, np.where(count > 0, count - size + 1, 0))
    whole = size[row[head]] == words
    h = word[head]
    for k in range(1, words):
        h = h * np.uint64(_STEP) + word[np.minimum(head + k, len(word) - 1)]
    for i in np.flatnonzero(~whole).tolist():
        value = 0
        for w in word[head[i] : head[i] + size[row[head[i]]]].tolist():
            value = (value * _STEP + w) & (1 << 64) - 1
        h[i] = value
    return row[head], _mixed(h)


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row in order of row and hash: row, hash and frequency."""
    row, h = runs_of_words(column, words)
    if not len(h):
        return row, h, np.zeros(0, np.int64)
    bits = np.uint64(max(1, int(row[-1]).bit_length()))
    order = np.argsort((row.astype(np.uint64) << np.uint64(64) - bits) | (h >> bits))
    h, row = h[order], row[order]
    swapped = np.flatnonzero((h[1:] < h[:-1]) & (row[1:] == row[:-1]))
    if len(swapped):  # hashes that differ in the bits cut off only
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))))
    return row[new], h[new], np.diff(np.concatenate((new, [len(h)])))


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    return 1 + np.log((1 + n) / (1 + df))


class Weights:
    """Weights of shingles: their frequency times idf, over the idf of a shingle of one document; it
    knows the frequent ones, and is told the df of others; hashes ascend."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, n: int):
        order = np.argsort(hashes)
        self.hashes, self.n = hashes[order], n
        self.idf = self.share(df[order])

    def share(self, df: np.ndarray) -> np.ndarray:
        return (inverse_frequency(df, self.n) / inverse_frequency(np.ones(1), self.n)).astype(float)

    def frequent(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)] == h

    def of(self, h: np.ndarray, frequency: np.ndarray, places: np.ndarray, df: np.ndarray) -> np.ndarray:
        """places, df: of the shingles that stand in several documents and are not frequent."""
        w = frequency.astype(float)
        w[places] *= self.share(df)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            w[known] *= self.idf[at[known]]
        return w


def samples(row: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Consistent weighted samples: for each row that has shingles, in order, SAMPLES numbers that
    stand for (shingle, level)."""
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    size = np.diff(np.concatenate((first, [len(row)])))
    out = np.empty((len(first), SAMPLES), np.int64)
    other = np.flatnonzero(w != 1)
    ln_w = np.log(w[other])
    level = np.zeros(len(h))
    for d in range(SAMPLES):
        slot = (h * _ODD[d] >> np.uint64(64 - _BITS)).astype(np.int64)
        ln_a = _LN_A[slot]
        if len(other):
            at = slot[other]
            r, beta = _R[at], _BETA[at]
            level[other] = np.floor(ln_w / r + beta)
            ln_a[other] = _LN_C[at] - r * (level[other] - beta) - r
        least = np.minimum.reduceat(ln_a, first)
        hit = np.flatnonzero(ln_a == np.repeat(least, size))
        # Of equal ones the first, which has the least hash.
        best = hit[np.searchsorted(hit, first)]
        out[:, d] = _mixed(h[best] + level[best].astype(np.int64).astype(np.uint64) * np.uint64(_STEP)).view(np.int64)
    return out


def _summaries(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Frequent shingles of this task's texts with their occurrences, less `lost` of any shingle
        at most, which is under FREQUENT * 5 / 8 of the texts; and the number of texts."""
        held, counts, lost, n, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0, 0
        for batch in batches:
            for block in row_blocks(batch, "text", BLOCK):
                n += block.num_rows
                h, now = np.unique(runs_of_words(block.column(0), words)[1], return_counts=True)
                held, back = np.unique(np.concatenate((held, h)), return_inverse=True)
                counts = np.bincount(back, np.concatenate((counts, now)), len(held)).astype(np.int64)
                seen += int(now.sum())
                room = max(SUMMARY, int(2 * seen / n / FREQUENT))
                if len(held) > room:
                    cut = int(np.partition(counts, len(counts) - room - 1)[len(counts) - room - 1])
                    keep = counts > cut
                    held, counts, lost = held[keep], counts[keep] - cut, lost + cut
        cut = int(FREQUENT * n / 8)
        held, counts = held[counts > cut], counts[counts > cut]
        none = [0] * len(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *held.view(np.int64).tolist()], pa.int64()), pa.array([0, *counts.tolist()], pa.int64()), pa.array([n, *none], pa.int64()), pa.array([lost + cut, *none], pa.int64())],
            ["shingle", "n", "texts", "lost"],
        )

    return run


def _exact(candidates: np.ndarray, words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(candidates), np.int64)
        near_ = np.zeros(1 << 20, bool)
        near_[candidates >> np.uint64(44)] = True
        for batch in batches:
            for block in row_blocks(batch, "text", BLOCK):
                row, h = runs_of_words(block.column(0), words)
                maybe = np.flatnonzero(near_[h >> np.uint64(44)])
                at = np.minimum(np.searchsorted(candidates, h[maybe]), len(candidates) - 1)
                hit = candidates[at] == h[maybe]
                pair = np.unique(row[maybe[hit]] * len(candidates) + at[hit])
                counts += np.bincount(pair % len(candidates), minlength=len(candidates))
        yield pa.RecordBatch.from_arrays([pa.array(candidates.view(np.int64)), pa.array(counts)], ["shingle", "n"])

    return run


def shingle_weights(docs: DataFrame, words: int = WORDS) -> Weights:
    """Document frequencies, over all documents, of all shingles above FREQUENT."""
    only = docs.select("text")
    seen = stored(few(only.mapInArrow(_summaries(words), "shingle long, n long, texts long, lost long").groupBy("shingle").agg(*[F.sum(c).alias(c) for c in ("n", "texts", "lost")])))
    whole = seen.where("shingle IS NULL").first()
    n, lost = (whole["texts"], whole["lost"]) if whole else (0, 0)
    # Each has 3 / 8 of FREQUENT * n occurrences or more, which bounds their number.
    rows = seen.where(F.col("shingle").isNotNull() & (F.col("n") + lost > FREQUENT * n)).select("shingle").collect()
    candidates = np.sort(np.array([r["shingle"] for r in rows], np.int64).view(np.uint64))
    if not len(candidates):
        return Weights(np.zeros(0, np.uint64), np.zeros(0), n)
    rows = only.mapInArrow(_exact(candidates, words), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT * n).collect()
    return Weights(np.array([r["shingle"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], float), n)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers: how many, how wide the largest is, and their bytes, the lowest of all first."""
    values = np.ascontiguousarray(values, np.uint64)
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(values).to_bytes(4, "little") + bytes([width]) + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpacked(raw: bytes) -> np.ndarray:
    n, width = int.from_bytes(raw[:4], "little"), raw[4]
    out = np.zeros((n, 8), np.uint8)
    if n and width:
        out[:, :width] = np.frombuffer(pa.decompress(raw[5:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.uint64)


def _ascending(values: np.ndarray) -> bytes:
    values = values.astype(np.uint64)
    return packed(values - np.concatenate((np.zeros(1, np.uint64), values[:-1]))) if len(values) else packed(values)


def _places(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw)).astype(np.int64)


def _gathered(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of this task's documents, each a row: its number and its compressed documents."""
        first, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def closed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for block in held:
                    out.write_batch(block)
            return pa.RecordBatch.from_arrays([pa.array([first + made]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["run", "docs"])

        for batch in batches:
            for block in row_blocks(batch, "text", BLOCK):
                held.append(block)
                size += len(runs_of_words(block.column(1), words)[1])
                if size >= RUN:
                    yield closed()
                    made, held, size = made + 1, [], 0
        if held:
            yield closed()

    return run


def _blocks_of(docs: bytes) -> Iterator[pa.RecordBatch]:
    return iter(pa.ipc.open_stream(docs))


def _dealt(weights: Weights, words: int, bits: int) -> Callable:
    """slice, run, hashes: of each run the hashes that are not frequent, less the slice's first; and
    those that stand in several documents of the run: places and numbers."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, docs in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = np.concatenate([shingles(block.column(1), words)[1] for block in _blocks_of(docs.as_py())])
                h, n = np.unique(h[~weights.frequent(h)], return_counts=True)
                cut = np.append(np.searchsorted(h, starts), len(h))
                rows: list[tuple] = []
                for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                    if b > a:
                        many = np.flatnonzero(n[a:b] > 1)
                        rows.append((i, number, _ascending(h[a:b] - starts[i]), _ascending(many), packed(n[a:b][many])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int32(), pa.int64(), *[pa.binary()] * 3))], ["slice", "run", "hashes", "places", "many"])

    return run


def _counted(part: pa.Table) -> pa.Table:
    """Of one slice's rows: run, slice, and the places and df of hashes that stand in several documents."""
    lists = [np.cumsum(unpacked(x)) for x in part.column("hashes").to_pylist()]
    inside = [(_places(places), unpacked(many).astype(np.int64)) for places, many in zip(part.column("places").to_pylist(), part.column("many").to_pylist())]
    every = np.sort(np.concatenate(lists))
    # Those of several runs, and those of several documents of a run.
    several = np.unique(np.concatenate((every[1:][every[1:] == every[:-1]], *[h[places] for h, (places, _) in zip(lists, inside)])))
    df, met = np.zeros(len(several), np.int64), []
    for h, (places, many) in zip(lists, inside):
        at = np.searchsorted(several, h)
        held = np.flatnonzero(several[np.minimum(at, len(several) - 1)] == h) if len(several) else np.zeros(0, np.int64)
        n = np.ones(len(h), np.int64)
        n[places] = many
        df[at[held]] += n[held]
        met.append((held, at[held]))
    found = [(_ascending(held), packed(df[at])) for held, at in met]
    return pa.table({"run": part.column("run"), "slice": part.column("slice"), "places": pa.array([x for x, _ in found], pa.binary()), "df": pa.array([y for _, y in found], pa.binary())})


def _sign(weights: Weights, words: int, bits: int) -> Callable:
    """doc_id, node, samples, and places and df of the text's shingles that stand in several documents
    and are not frequent, of a run's documents."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    names = ["doc_id", "node", "samples", "places", "df"]

    def run(runs: pa.Table, told: pa.Table) -> pa.Table:
        blocks, out = [], []
        for docs in runs.column("docs").to_pylist():
            blocks += [(block, *shingles(block.column(1), words)) for block in _blocks_of(docs)]
        every = np.unique(np.concatenate([h[~weights.frequent(h)] for _, _, h, _ in blocks]))
        first, parts = np.searchsorted(every, starts), zip(*(told.column(c).to_pylist() for c in ("slice", "places", "df")))
        df = np.ones(len(every), np.int64)
        for i, places, many in parts:
            df[first[i] + _places(places)] = unpacked(many).astype(np.int64)
        several = every[df > 1]
        df = df[df > 1]
        for block, row, h, frequency in blocks:
            node = [hashlib.blake2b(x, digest_size=16).digest() for x in texts(block.column(1))]
            signed, places, many = ([None] * block.num_rows for _ in range(3))
            if len(row):
                at = np.minimum(np.searchsorted(several, h), max(0, len(several) - 1))
                known = np.flatnonzero(several[at] == h) if len(several) else np.zeros(0, np.int64)
                told_df = df[at[known]]
                drawn = samples(row, h, weights.of(h, frequency, known, told_df))
                ids = np.unique(row)
                begin, cut = np.searchsorted(row, ids), np.searchsorted(row[known], np.append(ids, block.num_rows))
                for k, i in enumerate(ids.tolist()):
                    signed[i] = drawn[k].tolist()
                    mine = slice(int(cut[k]), int(cut[k + 1]))
                    places[i], many[i] = _ascending(known[mine] - begin[k]), packed(told_df[mine])
            out.append(pa.table([block.column(0), pa.array(node, pa.binary()), pa.array(signed, pa.list_(pa.int64())), pa.array(places, pa.binary()), pa.array(many, pa.binary())], names=names))
        return pa.concat_tables(out)

    return run


def signatures(narrow: DataFrame, weights: Weights, words: int = WORDS) -> DataFrame:
    """doc_id, node, samples, places and df of all documents (doc_id, text)."""
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (max(SLICES, -(-size // SLICE_BYTES)) - 1).bit_length()
    with temporary(narrow.sparkSession) as store:
        runs = store(narrow.mapInArrow(_gathered(words), "run long, docs binary"))
        dealt = runs.mapInArrow(_dealt(weights, words, bits), "slice int, run long, hashes binary, places binary, many binary")
        told = dealt.groupBy("slice").applyInArrow(_counted, "run long, slice int, places binary, df binary")
        schema = "doc_id long, node binary, samples array<long>, places binary, df binary"
        return stored(runs.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(_sign(weights, words, bits), schema))


def _vectors(words: int) -> Callable:
    """Rows (node, text), of which those count whose text has the node's digest: an id that is
    repeated, or null, brings other texts too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in row_blocks(batch, "text", BLOCK):
                own = [hashlib.blake2b(x, digest_size=16).digest() == n for x, n in zip(texts(block.column(1)), block.column(0).to_pylist())]
                block = block.filter(pa.array(own, pa.bool_()))
                row, h, frequency = shingles(block.column(1), words)
                cut = np.searchsorted(row, np.arange(block.num_rows + 1))
                packed = [h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                many = [frequency[a:b].astype(np.int32).tobytes() if (frequency[a:b] > 1).any() else None for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(packed, pa.binary()), pa.array(many, pa.binary())], ["node", "hashes", "counts"])

    return run


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser over sum of the greater weights; (hashes, weights) by ascending hash."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    shared = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    union = float(a[1].sum() + b[1].sum()) - shared
    return shared / union if union else 0.0


def _vector(weights: Weights, h: bytes, c: bytes | None, places: bytes, df: bytes) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.frombuffer(h, np.uint64)
    return hashes, weights.of(hashes, np.frombuffer(c, np.int32) if c else np.ones(len(hashes)), _places(places), unpacked(df))


def _verify(weights: Weights, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, known = [], {}
            for i in range(batch.num_rows):
                if a[i] not in known:
                    known = {a[i]: _vector(weights, *(batch.column(c)[i].as_py() for c in range(2, 6)))}
                other = _vector(weights, *(batch.column(c)[i].as_py() for c in range(6, 10)))
                out.append(weighted_jaccard(known[a[i]], other) >= least - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["a", "b", "linked"])

    return run


def _agreement(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)


def _ends(*pairs: tuple[str, str]) -> Column:
    """One row for each of a row's pairs of columns: computed once, which a union would not be."""
    return F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs]))


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of its connected component, for all nodes of links (a, b). Up to
    BROADCAST_LABELS labels go to the edges, so that a round shuffles once; it takes four otherwise."""
    # A node is its own neighbour, so that the least label around it needs no join with its own.
    edges = checkpointed(few(links.select(_ends(("a", "b"), ("b", "a"), ("a", "a"), ("b", "b"))).distinct()))
    labels = checkpointed(few(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))))
    small = labels.count() <= BROADCAST_LABELS
    while True:
        known = lambda node, label, now=labels: (F.broadcast if small else lambda df: df)(now.select(F.col("node").alias(node), F.col("label").alias(label)))
        own = F.when(F.col("a") == F.col("b"), F.col("label"))
        lower = edges.join(known("b", "label"), "b").groupBy(F.col("a").alias("node")).agg(F.max(own).alias("old"), F.min("label").alias("new"))
        # Pointer jumping: the label of the label.
        moved = checkpointed(few(lower.join(known("new", "further"), "new").select("node", "old", F.least("new", "further").alias("label"))))
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels


def lines() -> list[list[int]]:
    """The lines of the affine plane of order SIDE = 4, as lists of points (sample numbers): over
    the field of 4 elements, y = m x + c for all m and c, and x = c for all c."""
    times = lambda m, x: 0 if not m or not x else (m - 1 + x - 1) % 3 + 1  # noqa: E731  powers of a generator; sums are bitwise
    sloped = [[x * SIDE + (times(m, x) ^ c) for x in range(SIDE)] for m in range(SIDE) for c in range(SIDE)]
    return sloped + [[c * SIDE + y for y in range(SIDE)] for c in range(SIDE)]


def _search(weights: Weights | None, least: float) -> Callable:
    """For a block of a bucket's members and one of the queries against it: the nodes of pairs that
    agree enough, as pairs with themselves (without weights), or the links among them (with weights
    and vectors). A pair counts in the first band that it shares, and nodes already joined by a link
    in this block are passed by."""
    plane = np.array(lines())

    def solve(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[bytes, bytes]] = []
        if not len(members) or not len(queries):
            return pd.DataFrame(found, columns=["a", "b"])
        own, asked = np.stack(members["samples"].to_numpy()), np.stack(queries["q_samples"].to_numpy())
        codes, both = pd.factorize(np.concatenate((members["label"].to_numpy(), queries["q_label"].to_numpy())))
        labels, askers = codes[: len(members)].copy(), codes[len(members) :].copy()
        names, asking = members["node"].to_numpy(), queries["q_node"].to_numpy()
        band, parent = int(members["band"].iloc[0]), list(range(len(both)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        vectors: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def vector(name: bytes, frame: pd.DataFrame, at: int, prefix: str) -> tuple[np.ndarray, np.ndarray]:
            if name not in vectors:
                vectors[name] = _vector(weights, *(frame[f"{prefix}{c}"].iloc[at] for c in VECTOR))
            return vectors[name]

        met = np.zeros(len(asked), bool), np.zeros(len(own), bool)
        step = max(1, 500_000 // own.size)
        for i in range(0, len(asked), step):
            same = asked[i : i + step, None, :] == own[None]
            agree = same.sum(2)
            first = same[:, :, plane].all(3).argmax(2) == band
            ok = (agree >= AGREE) & first & (askers[i : i + step, None] != labels[None])
            if weights is None:
                met[0][i : i + step] |= ok.any(1)
                met[1][:] |= ok.any(0)
                continue
            q, m = np.nonzero(ok)
            for k in np.argsort(-agree[q, m], kind="stable").tolist():
                x, y = i + int(q[k]), int(m[k])
                u, v = root(askers[x]), root(labels[y])
                if u != v and weighted_jaccard(vector(asking[x], queries, x, "q_"), vector(names[y], members, y, "")) >= least - 1e-9:
                    parent[u] = v
                    found.append((asking[x], names[y]))
        if weights is None:
            found = [(x, x) for x in {*asking[met[0]], *names[met[1]]}]
        return pd.DataFrame(found, columns=["a", "b"]).drop_duplicates()

    return solve


def near_duplicates(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, node (digest of its text), class_id and representative:
    whether it is the one with the least id."""
    narrow = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weights = shingle_weights(narrow, words)
    signed = signatures(narrow, weights, words)
    nodes = signed.where("samples IS NOT NULL").groupBy("node").agg(F.first("samples").alias("samples"), F.min("doc_id").alias("doc_id"))
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.col("samples")[i] for i in line]) for b, line in enumerate(lines())])
    keyed = nodes.select("node", F.posexplode(bands).alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = stored(few(keyed.join(shared, "key")))
    popular = stored(few(held.groupBy("node").agg(F.sum("n").alias("fame")).join(nodes, "node")))
    ranked = held.select("key", "node").join(popular.select("node", "fame"), "node")
    leaders = ranked.groupBy("key").agg(F.max_by("node", F.struct("fame", "node")).alias("leader"))
    led = stored(few(held.join(leaders, "key")))
    signs = lambda name: popular.select(F.col("node").alias(name), F.col("samples").alias(f"s_{name}"))

    def agreeing(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(signs("a"), "a").join(signs("b"), "b")
        return rows.where(_agreement(F.col("s_a"), F.col("s_b")) >= AGREE).select("a", "b")

    def vectors_of(wanted: DataFrame) -> DataFrame:
        found = _texts_of(narrow, popular.select("node", "doc_id").join(wanted, "node", "left_semi")).mapInArrow(_vectors(words), "node binary, hashes binary, counts binary")
        told = signed.select("node", "places", "df").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("places").alias("places"), F.first("df").alias("df"))
        return stored(found.join(told, "node"))

    def linked(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
        own = vectors.select(F.col("node").alias("a"), *VECTOR)
        other = vectors.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in VECTOR])
        rows = pairs.join(other, "b").join(own, "a").select("a", "b", *VECTOR, *[f"{c}_b" for c in VECTOR])
        return rows.mapInArrow(_verify(weights, least), "a binary, b binary, linked boolean").where("linked").select("a", "b")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    vectors: DataFrame | None = None

    def with_vectors(wanted: DataFrame) -> DataFrame:
        if vectors is None:
            return vectors_of(wanted)
        new = stored(few(wanted.join(vectors.select("node"), "node", "left_anti")))
        return vectors if new.isEmpty() else vectors.union(vectors_of(new))

    def labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
        labels = components(links)
        small = labels.count() <= BROADCAST_LABELS
        return rows.join(F.broadcast(labels) if small else labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    tried, links, found = None, None, None
    for _ in range(ROUNDS):
        # Of the buckets with several components, the nodes outside their leader's.
        here = led.withColumn("label", F.col("node")) if links is None else found
        first = here.where("node = leader").select("key", F.col("label").alias("own"))
        asks = here.join(first, "key").where("label <> own").groupBy("node", "leader").agg(F.count("*").alias("times"))
        if tried is not None:
            asks = asks.join(tried.select(F.col("a").alias("leader"), F.col("b").alias("node")), ["leader", "node"], "left_anti")
        chosen = stored(few(asks.groupBy(F.col("node").alias("b")).agg(F.max_by("leader", F.struct("times", "leader")).alias("a")).select("a", "b")))
        close = stored(few(agreeing(chosen)))
        if close.isEmpty():
            tried = chosen if tried is None else tried.union(chosen)
            break
        vectors = with_vectors(ends(close))
        new = stored(few(linked(close, vectors)))
        tried = chosen if tried is None else tried.union(chosen)
        links = new if links is None else links.union(new)
        found = stored(few(labelled(led, links)))
        if new.isEmpty():
            break
    if links is None:
        links = docs.sparkSession.createDataFrame([], "a binary, b binary")
    if found is None:
        found = led.withColumn("label", F.col("node"))

    # Buckets that hold more than one component, and their nodes outside the largest.
    per_label = found.groupBy("key", "label").agg(F.count("*").alias("m"))
    mixed = per_label.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count("*").alias("labels"), (F.sum("m") - F.max("m")).alias("outside")).where("labels > 1").drop("labels")
    open_ = stored(few(found.drop("leader").join(mixed, "key")))
    little, many = open_.where(F.col("n") <= SMALL), open_.where(F.col("n") > SMALL)
    ask = little.where("label <> main").select("key", F.col("node").alias("x"), F.col("label").alias("lx"))
    pairs = ask.join(little.select("key", F.col("node").alias("y"), "label"), "key").where("lx <> label")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    rest = stored(few(agreeing(pairs.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))))

    def searched(rows: DataFrame, chunk: int, search: Callable) -> DataFrame:
        """rows: key, band, n, outside, node, label, main and what search needs. Blocks of all nodes
        of a bucket against blocks of those outside its main component."""
        parts, asked = F.ceil(F.col("n") / chunk), F.ceil(F.col("outside") / chunk)
        own, every = lambda k: F.pmod(F.xxhash64("node"), k), lambda k: F.explode(F.sequence(F.lit(0).cast("long"), k - 1))
        kept = [c for c in rows.columns if c not in ("n", "outside", "main")]
        members = rows.select(*kept, own(parts).alias("m_block"), every(asked).alias("q_block"))
        queries = rows.where("label <> main").select(*kept, own(asked).alias("q_block"), every(parts).alias("m_block"))
        queries = queries.toDF(*[f"q_{c}" for c in queries.columns])
        return members.groupBy("key", "m_block", "q_block").cogroup(queries.groupBy("q_key", "q_m_block", "q_q_block")).applyInPandas(search, "a binary, b binary")

    wide = many.select("key", "band", "n", "outside", "node", "label", "main").join(popular.select("node", "samples"), "node")
    involved = stored(few(ends(searched(wide, CHUNK, _search(None, least)))))
    vectors = with_vectors(ends(rest).union(involved).distinct())
    links = links.union(linked(rest, vectors))
    links = links.union(searched(wide.join(involved, "node", "left_semi").join(vectors, "node"), VECTORS, _search(weights, least)))
    classed = labelled(signed.where("samples IS NOT NULL").select("doc_id", "node"), links)
    least_ids = classed.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    worded = classed.join(least_ids, "label").select("doc_id", "node", "class_id")
    single = signed.where("samples IS NULL").select("doc_id", "node", F.col("doc_id").alias("class_id"))
    return few(worded.union(single), 8).withColumn("representative", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _texts_of(narrow: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of the documents that have the ids of wanted nodes (node, doc_id)."""
    ids = checkpointed(few(wanted.select(F.col("doc_id").alias("_id"), "node")))
    joined = narrow.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col("doc_id").eqNullSafe(F.col("_id")))
    return joined.select("node", "text")


def keep_representatives(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """The documents, with all their columns, one of each class; repeated rows count once."""
    found = checkpointed(few(near_duplicates(docs, words, least)))
    at, id_, node = docs.columns.index("text"), unused(docs, "kept_id"), unused(docs, "kept_node")
    kept = found.where("representative").select(F.col("doc_id").alias(id_), F.col("node").alias(node)).distinct()
    small = found.count() <= BROADCAST_IDS

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(batch.num_columns - 1).to_pylist()
            keep = [hashlib.blake2b(x, digest_size=16).digest() == n for x, n in zip(texts(batch.column(at)), nodes)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    joined = docs.join(F.broadcast(kept) if small else kept, F.col("doc_id").cast("long").eqNullSafe(F.col(id_))).drop(id_)
    mine = joined.mapInArrow(own, joined.schema)
    ids = found.agg(F.count("*").alias("all"), F.count_distinct("doc_id").alias("ids")).first()
    if ids["all"] != ids["ids"]:
        has_word = F.coalesce(F.col("text").rlike(r"[A-Za-z0-9]|[^\x00-\x7F]"), F.lit(False))
        mine = mine.where(has_word).dropDuplicates(["doc_id", node]).union(mine.where(~has_word))
    return mine.select(*[F.col(f"`{c}`") for c in docs.columns])
