"""Packing: ids as the library gives them, gapless sequences, few of them, the same on every run."""

import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import prose
from tidewater.llm import packing
from tidewater.llm.queries import tokenizer_path
from tidewater.llm.storage import stored


@pytest.fixture(scope="module")
def vocabulary():
    try:
        return tokenizer_path("word_bpe_49k.json")
    except ImportError:
        pytest.skip("no vocabulary files")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def check_sequences(rows, capacity):
    """Every sequence starts at 0, has no gap and no more tokens than it may; the number of them."""
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_ids_equal_the_library_and_sequences_are_gapless(spark, awkward, vocabulary, capacity):
    tokenizers = pytest.importorskip("tokenizers")
    encoder = tokenizers.Tokenizer.from_file(vocabulary)
    extra = ["It's we'll 'tis ''s I'd've", "a...b ?! x,y.z 3.14 1999", "x y z\u0085w", "İstanbul ΑΣ ﬁ é ́", "汉字かな" * 900, "a\x1cb \x00c", "<|endoftext|>Up<|startoftext|> <|ENDOFTEXT|>", "w" * 700]
    df = awkward.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    want = []
    for key, text in texts_of(df):
        ids = encoder.encode(text, add_special_tokens=False).ids + [0]
        for i, s in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[s : s + capacity], "<u4")
            want.append((key or -1, i, s, len(part), zlib.crc32(part.tobytes())))
    got = packing.digest(df, vocabulary, capacity).collect()
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    n = check_sequences(got, capacity)
    counts = np.bincount([w[3] for w in want], minlength=capacity + 1)
    assert packing.lower_bound(counts) <= n <= packing.lower_bound(counts) + 1
    again = packing.digest(df.repartition(7), vocabulary, capacity).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_word_table_started_anew_and_foreign_vocabularies(monkeypatch, vocabulary):
    words = packing._Words(vocabulary)
    rng = random.Random(3)
    raw = [prose(rng, 50).encode() for _ in range(40)]
    want = [words.ids([t])[0] for t in raw]
    monkeypatch.setattr(packing, "KEPT", 3)
    assert [words.ids([t])[0] for t in raw] == want == words.code(raw)
    with pytest.raises(ValueError):
        packing._Words(tokenizer_path("byte_bpe_50k.json"))


def test_sequences_hold_the_documents(spark, awkward, vocabulary):
    capacity = 256
    cut = stored(packing.pieces(awkward, vocabulary, capacity))
    packed = packing.digest(awkward, vocabulary, capacity)
    whole = packing.sequences(packed, cut).collect()
    assert sum(r["n_tokens"] for r in whole) * 4 == sum(len(r["ids"]) for r in whole) == sum(len(r["ids"]) for r in cut.collect())
    by = {r["sequence_id"]: bytes(r["ids"]) for r in whole}
    for r in packed.collect():
        part = by[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert zlib.crc32(part) == r["ids_crc32"]


def test_empty(empty, vocabulary):
    assert packing.digest(empty, vocabulary).count() == 0


def exact_bins(lengths, capacity):
    """The least number of bins by trying everything."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in {x for x in rooms if x >= lengths[i]}:
            rest = list(rooms)
            rest[rest.index(r)] -= lengths[i]
            place(i + 1, rest)
        place(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def as_pieces(spark, lengths):
    rows = [(i, 0, 0, n, i) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


@pytest.mark.parametrize("seed", range(4))
def test_small_packings_are_the_least(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.choice((rng.randint(1, 30), rng.randint(20, 70))) for _ in range(12)]
    counts = np.bincount(lengths, minlength=101)
    least = exact_bins(lengths, 100)
    assert packing.lower_bound(counts) <= least
    assert check_sequences(packing.pack(as_pieces(spark, lengths), 100).collect(), 100) == least


def test_evolution_betters_decreasing_best_fit(spark):
    """Triples that fill a bin exactly, where decreasing best-fit leaves room."""
    rng = random.Random(11)
    lengths = []
    for _ in range(24):
        a, b = rng.randint(380, 490), rng.randint(250, 300)
        lengths += [a, b, 1000 - a - b]
    counts = np.bincount(lengths, minlength=1001)
    plain = packing.best_fit({}, iter(packing._shuffled(counts, np.random.default_rng(0), 0)), 1000)
    solution, bound = packing.evolved(as_pieces(spark, lengths), 1000)
    assert bound <= sum(solution.values()) < sum(plain.values())


def test_genetic_steps_keep_every_document():
    rng = np.random.default_rng(5)
    counts = np.zeros(301, np.int64)
    counts[rng.integers(1, 301, 80)] = rng.integers(1, 10**9, 80)
    held = lambda s: {x: sum(m * dict(c).get(x, 0) for c, m in s.items()) for x in np.flatnonzero(counts).tolist()}
    a, b = (packing.best_fit({}, iter(packing._shuffled(counts, rng, 1.0)), 300) for _ in range(2))
    want = {x: int(counts[x]) for x in np.flatnonzero(counts).tolist()}
    for s in (a, b, packing.crossover(a, b, counts, rng), packing.mutate(a, counts, rng), packing.unpacked(packing._packed_up(a))):
        assert held(s) == want and all(packing.room(c, 300) >= 0 for c in s)
        assert packing.lower_bound(counts) <= sum(s.values())
