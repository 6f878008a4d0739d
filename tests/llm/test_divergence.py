"""Source divergences against plain dictionaries, and slices against plain bytes."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import divergence, slices
from tidewater.llm.blocks import flat

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text)


def plain(rows, least_docs=3, most=200):
    docs = [(r["lang"] or "", r["source"] or "", TERM.findall(lowered(r["text"] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= least_docs]
        n = defaultdict(Counter)
        for _, source, terms in mine:
            n[source].update(t for t in terms if df[t] >= least_docs)
        whole = sum(n.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept)) for t in kept} for s, c in n.items()}
        q = {t: 1 + 10**9 * (whole[t] + 1) // (whole.total() + len(kept)) for t in kept}
        for s in n:
            parts = {"pair": [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in n if o != s]}
            parts["term"] = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, i + 1) for i, (t, v) in enumerate(items) if part == "pair" or i < most]
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def corpus(spark, n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "straße", "été", "a", "汉字", "b2b", "x_y", "naïve", "É", "zz", "long" * 20, "don't", "[x]", "{y}", "~", "\x00q"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [
        (rng.choice([1, 2, None]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(0, 40)))]) if rng.random() < 0.2 else " ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None]))
        for _ in range(n)
    ]
    rows += [(9, "only here", "rare", "a"), (9, "!!!", "rare", "b"), (9, "alone alone", "one", "z")] + [(5, "one word", "same", "s")] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("most", [4, 200])
def test_equal_to_dictionaries(spark, most, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_ROWS", 20)
    df = corpus(spark, 220, 1)
    got = rows_of(divergence.divergences(df, 3, most))
    assert got == plain(df.collect(), 3, most)
    assert rows_of(divergence.divergences(df.repartition(9), 3, most)) == got
    monkeypatch.setattr(divergence, "BROADCAST_LANGS", 0)
    assert rows_of(divergence.divergences(df, 3, most)) == got


def test_awkward_and_empty(awkward, empty):
    assert rows_of(divergence.divergences(awkward)) == plain(awkward.collect())
    assert divergence.divergences(empty).count() == 0


def test_hash_equals_the_library_and_collisions_stay_apart():
    xxhash = pytest.importorskip("xxhash")
    rng = random.Random(2)
    raw = [rng.randbytes(rng.randint(0, 70)) for _ in range(3000)] + [b"", b"a"] * 20 + [b"same slice of text"] * 9
    data, offsets = flat(pa.array(raw, pa.binary()))
    starts, ends = offsets[:-1], offsets[1:]
    assert slices.xxhash64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(x) for x in raw]
    for hashed in (slices.xxhash64, lambda d, a, b: (b - a).astype(np.uint64) % 5, lambda d, a, b: np.zeros(len(a), np.uint64)):
        own, first = slices.grouped(data, starts, ends, hashed)
        assert [raw[i] for i in first[own].tolist()] == raw and len(first) == len(set(raw))


def test_boundaries_equal_the_pattern():
    rng = random.Random(4)
    raw = ["".join(rng.choices("aZé汉 0_-\n", k=rng.randint(0, 30))) for _ in range(500)]
    data, offsets = flat(pa.array(raw))
    row, starts, ends = slices.boundaries(data, offsets)
    got = defaultdict(list)
    for r, a, b in zip(row.tolist(), starts.tolist(), ends.tolist()):
        got[r].append(data[a:b].tobytes().decode())
    assert [got[i] for i in range(len(raw))] == [TERM.findall(t) for t in raw]
    assert slices.boundaries(*flat(pa.array([], pa.string())))[0].size == 0


def test_shares_are_exact_for_large_counts():
    rng = random.Random(6)
    total = [rng.randint(2, 9 * 10**15) for _ in range(2000)]
    count = [rng.randint(0, t - 1) for t in total]
    assert divergence.share(np.array(count), np.array(total)).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(count, total)]
