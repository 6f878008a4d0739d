"""Exact repeated-substring removal with suffix arrays built by two-stage sorting.

A byte goes if a string of `width` bytes that covers it also starts earlier, in a document with a
smaller id or before in the same one. The steps:

1. Every string of `width` bytes (a window) has an anchor: its leftmost K-gram of least hash.
   Windows side by side with one anchor form a segment, at most width - K + 1 window starts. Equal
   windows have equal anchors, so they only meet where segments share an anchor's hash. Each batch
   of texts emits one row (anchor hash, segment hash, document, first start and number of starts) a
   segment; one whose text the batch holds earlier in order is a repeat already, marked so and dealt
   anywhere: of a passage in a third of all texts, its anchor's task gets one row a batch.
2. Rows are sorted by (anchor, segment, document, place) and read as a stream: an anchor met once
   holds nothing; all rows of one segment text after its first are repeats as a whole; and the
   first rows of two or more texts under one anchor are variants, to be compared.
3. Variants get their text. A suffix array over the variants of many anchors, some MB at a time, is
   made by two-stage sorting: only suffixes smaller than their successors are sorted directly, the
   rest are induced by scanning buckets in order; adjacent common prefixes of `width` bytes or more
   join equal windows, of which all but the first start are repeats. An anchor with more than
   VARIANTS variants (the edge of a passage that many documents hold) is split by window, so that
   no group is unbounded.
4. Each document's repeats are united and cut out.

The array orders suffixes by their first `width` bytes at least; what equals beyond that keeps the
order of places, which is all that windows need.

Defined results: null and empty texts have no bytes and lose none; texts under `width` bytes lose
none; rows that repeat an id and a text count as one document, and each gets its result; rows that
repeat an id with other texts are documents of their own, in order of a hash of the text; a null id
comes first; a very long text is cut whole, in segments of a batch; other columns are not read, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.blocks import flat, ranges, row_blocks, texts
from tidewater.llm.storage import bounded, checkpointed, few, stored, unused

WIDTH, K = 100, 28
VARIANTS = 4096
#: Bytes of text hashed at once; working arrays of 8 bytes a place should stay in the cache.
HASH_BYTES = 512 << 10
#: Bytes of variants under one suffix array.
ARRAY_BYTES = 384 << 10
END = 255  # no UTF-8 text holds it

_M = (1 << 64) - 1
_rng = np.random.default_rng(20240611)
_BYTE_A, _BYTE_S = (_rng.integers(0, 1 << 63, 256, dtype=np.uint64) for _ in range(2))
_BASE_A, _BASE_S = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


# Two-stage suffix sorting.


def _words(data: np.ndarray, depth: int) -> np.ndarray:
    """At each place, the next 8 bytes as a number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(depth + 16, np.uint8))).astype(np.uint64)
    for step, bits in ((1, 8), (2, 16), (4, 32)):
        padded = (padded[:-step] << np.uint64(bits)) | padded[step:]
    return padded


def _direct(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The places, sorted by the bytes that follow them, up to `depth`; then by place."""
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    tied = np.concatenate((key[1:] == key[:-1], [False])) if len(order) else np.zeros(0, bool)
    for offset in range(8, depth, 8):
        member = tied.copy()
        member[1:] |= tied[:-1]
        at = np.flatnonzero(member)
        if not len(at):
            break
        start = np.concatenate(([True], ~tied[:-1]))[at]
        group = np.cumsum(start)
        part = order[at]
        key = words[part + offset]
        moved = np.lexsort((key, group))
        order[at], key = part[moved], key[moved]
        tied[at[:-1]] = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
    return order


def suffix_array(data: np.ndarray, depth: int = 1 << 30) -> np.ndarray:
    """Places of the suffixes in order; beyond `depth` equal bytes the order is by place where a
    suffix is sorted directly. An ended suffix is smaller than its continuations."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    depth = min(depth, n)
    step = np.sign(np.diff(data.astype(np.int16)))
    step = np.concatenate((step, [-1]))  # the last suffix is larger than the empty one
    after = np.where(step != 0, np.arange(n), n - 1)
    after = np.minimum.accumulate(after[::-1])[::-1]
    smaller = step[after] > 0  # than its successor
    words = _words(data, depth)
    direct = _direct(words, np.flatnonzero(smaller), depth)
    own = np.searchsorted(data[direct], np.arange(257))  # direct suffixes by first byte
    fed: list[list[np.ndarray]] = [[] for _ in range(256)]
    fed[data[n - 1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        waiting, induced = fed[byte], []
        while waiting:  # a run of this byte feeds its own bucket
            part = waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
            induced.append(part)
            part = part[part > 0] - 1
            part = part[(data[part] == byte) & ~smaller[part]]
            waiting = [part] if len(part) else []
        whole = np.concatenate([*induced, direct[own[byte] : own[byte + 1]]]) if induced else direct[own[byte] : own[byte + 1]]
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[data[before] > byte]
        first = data[before]
        moved = np.argsort(first, kind="stable")
        before, first = before[moved], first[moved]
        cuts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if len(first) else []
        for a, b in zip(cuts, [*cuts[1:], len(first)]):
            fed[first[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Lengths, up to `limit`, of the common prefixes of each suffix and the one before it."""
    words, n = _words(data, limit), len(data)
    out = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    left, right = order[:-1], order[1:]
    for offset in range(0, limit, 8):
        same = words[left + offset] ^ words[right + offset]
        equal = same == 0
        out[at[equal]] = offset + 8
        diff = same[~equal]
        lead = np.zeros(len(diff), np.int64)
        for k in range(1, 8):
            lead[diff >> np.uint64(64 - 8 * k) == 0] = k
        out[at[~equal]] = offset + lead
        at, left, right = at[equal], left[equal], right[equal]
    room = np.minimum(n - order[1:], n - order[:-1])
    out[1:] = np.minimum(np.minimum(out[1:], limit), room)
    return out


# Anchors and segments.


def segments(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Of texts end to end: row, first start, number of starts, anchor hash and segment hash."""
    nothing = tuple(np.zeros(0, np.int64) for _ in range(5))
    n, reach = len(data), width - K + 1
    if n < width:
        return nothing
    # Hashes of K-grams, by doubling lengths.
    parts, h, size, base = {}, _BYTE_A[data], 1, _BASE_A
    while True:
        parts[size] = h, base
        if size * 2 > K:
            break
        h = h[:-size] * np.uint64(base) + h[size:]
        size, base = size * 2, base * base & _M
    done, gram = 0, None
    for size in sorted(parts, reverse=True):
        if done + size <= K:
            h, base = parts[size]
            gram = h if gram is None else gram[: len(h) - done] * np.uint64(base) + h[done:]
            done += size
    gram = _mixed(gram)
    # The leftmost least hash of each window: 33 bits of hash over 31 of place.
    low = (gram >> np.uint64(31) << np.uint64(31)) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while size * 2 <= reach:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (reach - size)], low[reach - size :])
    anchor = (low & np.uint64((1 << 31) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    inside = np.arange(len(anchor)) + width <= offsets[1:][row]
    change = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1]))))
    count = np.diff(np.concatenate((change, [len(anchor)])))
    keep = inside[change]
    first, count = change[keep], count[keep]
    # Segment hashes from prefix sums of byte values times powers of an odd base.
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE_S, np.uint64))), dtype=np.uint64)
    inverse = np.uint64(pow(_BASE_S, -1, 1 << 64))
    back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, inverse, np.uint64))), dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_S[data] * power[:n], dtype=np.uint64)))
    text = (total[first + count + width - 1] - total[first]) * back[first]
    text = _mixed(text * np.uint64(_BASE_A) + count.astype(np.uint64))
    owner = row[first]
    return owner, first - offsets[owner], count, gram[anchor[first]].view(np.int64), text.view(np.int64)


#: place: start and number of starts, packed; its complement where the batch holds the segment earlier.
ROWS = "anchor long, segment long, doc_id long, place long"


def _emit(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found, base = [], 0
            for block in row_blocks(batch, "text", HASH_BYTES):
                owner, start, n, anchor, segment = segments(*flat(block.column(1)), width)
                found.append((ids[base + owner], start << 8 | n, anchor, segment))
                base += block.num_rows
            if not found:
                continue
            doc, place, anchor, segment = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((place, doc, segment, anchor))
            a, s = anchor[order], segment[order]
            repeat = order[1:][(a[1:] == a[:-1]) & (s[1:] == s[:-1])]
            # These are decided: they need not meet their anchor's rows, so a hot one's are dealt evenly.
            anchor[repeat] = _mixed(doc[repeat].astype(np.uint64) * np.uint64(_BASE_A) + place[repeat].astype(np.uint64)).view(np.int64)
            place[repeat] = ~place[repeat]
            for k in range(0, len(doc), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (anchor, segment, doc, place)], ["anchor", "segment", "doc_id", "place"])

    return run


#: kind 0: repeats as a whole; 1: a variant; 2: a variant of an anchor with too many of them.
FOUND = "doc_id long, place long, anchor long, kind int"


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (anchor, segment, doc_id, place) to repeats and variants."""

    def table(doc: np.ndarray, place: np.ndarray, anchor: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), pa.array(anchor), pa.array(kind.astype(np.int32))], ["doc_id", "place", "anchor", "kind"])

    def decide(a: np.ndarray, s: np.ndarray, doc: np.ndarray, place: np.ndarray, again: np.ndarray, last: tuple | None, hot: bool) -> pa.RecordBatch:
        """Whole groups, or, if hot, a part of one that is known to have too many variants."""
        new_a = np.concatenate(([last is None or a[0] != last[0]], a[1:] != a[:-1]))
        new_s = (new_a | np.concatenate(([last is None or (a[0], s[0]) != last], s[1:] != s[:-1]))) & ~again
        group = np.cumsum(new_a) - new_a[0]
        kinds = np.bincount(group, new_s)[group]
        repeat, variant = ~new_s, new_s & ((kinds > 1) | hot)
        many = hot | (kinds > VARIANTS)
        keep = repeat | variant
        return table(doc[keep], place[keep], a[keep], np.where(repeat, 0, np.where(many, 2, 1))[keep])

    held: list[np.ndarray] | None = None
    last, hot = None, False
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        again = now[3] < 0
        now = [*now[:3], np.where(again, ~now[3], now[3]), again]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
            held = None
        if not len(now[0]):
            continue
        if hot:  # the part of the hot anchor that goes on
            end = int(np.searchsorted(now[0], last[0], "right"))
            if end:
                yield decide(*[x[:end] for x in now], last, True)
                last = (now[0][end - 1], now[1][end - 1])
            if end == len(now[0]):
                continue
            now, hot, last = [x[end:] for x in now], False, None
        cut = int(np.searchsorted(now[0], now[0][-1], "left"))
        if cut:
            yield decide(*[x[:cut] for x in now], None, False)
        held = [x[cut:] for x in now]
        if len(held[0]) > 4 * VARIANTS and np.count_nonzero(np.diff(held[1])) > VARIANTS:
            yield decide(*held, None, True)
            last, hot, held = (held[0][-1], held[1][-1]), True, None
    if held is not None:
        yield decide(*held, None, False)


def _places(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return packed >> 8, packed & 255


def _fetch(width: int, at_id: int, at_text: int) -> Callable:
    """Documents, with variants last, to pieces of text under a key: (key, doc_id, start, n, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            size = 0
            for doc, raw, listed in zip(batch.column(at_id).to_pylist(), texts(batch.column(at_text)), batch.column(batch.num_columns - 1)):
                v = listed.values
                keys, kinds = (v.field(i).to_pylist() for i in (1, 2))
                starts, counts = _places(v.field(0).to_numpy(zero_copy_only=False))
                for key, kind, start, n in zip(keys, kinds, starts.tolist(), counts.tolist()):
                    if kind == 1:
                        rows = [(key, doc, start, n, raw[start : start + n + width - 1])]
                    else:
                        rows = [(int.from_bytes(hashlib.blake2b(w, digest_size=8, key=key.to_bytes(8, "big", signed=True)).digest(), "big", signed=True), doc, p, 1, w) for p in range(start, start + n) for w in [raw[p : p + width]]]
                    for r in rows:
                        size += len(r[4])
                        for c, x in zip(out, r):
                            c.append(x)
                if size > 4 << 20:
                    yield _pieces(out)
                    out, size = [[] for _ in range(5)], 0
            yield _pieces(out)

    return run


PIECES = "key long, doc_id long, start int, n int, piece binary"


def _pieces(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [f.split()[0] for f in PIECES.split(", ")])


def repeated_windows(data: np.ndarray, first: np.ndarray, n: np.ndarray, rank: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces end to end, each with n[i] window starts from its first byte: the pieces and starts
    (counted in the piece) of windows that also occur earlier. rank: places in the corpus's order,
    which has consecutive numbers for the starts of a piece."""
    piece = np.repeat(np.arange(len(first)), n)
    inner = ranges(np.zeros(len(first), np.int64), n)
    at = np.full(len(data), -1, np.int64)
    at[first[piece] + inner] = np.arange(len(piece))
    order = suffix_array(data, -(-width // 8) * 8)
    same = common_prefixes(data, order, width) >= width
    group = np.cumsum(~same)
    window = at[order]
    group, window = group[window >= 0], window[window >= 0]
    place = rank[piece[window]] + inner[window]
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, place)
    again = np.sort(window[place > least[group]])
    return piece[again], inner[again]


def _compare(width: int) -> Callable:
    """Pieces in order of keys to repeats (doc_id, place)."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        doc, start, n = (t.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
        raw = texts(t.column(4))
        sizes = np.array([len(x) + 1 for x in raw], np.int64)
        data = np.frombuffer(bytes([END]).join(raw) + bytes([END]), np.uint8)
        order = np.lexsort((start, doc))
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.arange(len(doc)) * 256
        # Starts of one document may overlap between pieces only under one window each, so ranks
        # with room for a piece's starts keep the corpus's order.
        piece, inner = repeated_windows(data, np.cumsum(sizes) - sizes, n, rank, width)
        new = np.concatenate(([True], (piece[1:] != piece[:-1]) | (inner[1:] != inner[:-1] + 1))) if len(piece) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        count = np.diff(np.concatenate((head, [len(piece)])))
        place = (start[piece[head]] + inner[head]) << 8 | count
        return pa.RecordBatch.from_arrays([pa.array(doc[piece[head]]), pa.array(place)], ["doc_id", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            if held and size >= ARRAY_BYTES:  # end the array where a key ends
                cut = int(np.searchsorted(keys, held[-1].column(0)[-1].as_py(), "right"))
                if cut:
                    held.append(batch.slice(0, cut))
                if cut == len(keys):
                    continue
                yield solve(held)
                held, size, batch, keys = [], 0, batch.slice(cut), keys[cut:]
            while True:
                _, offsets = flat(batch.column(4))
                if size + offsets[-1] <= 2 * ARRAY_BYTES:
                    break
                stop = int(np.searchsorted(offsets, ARRAY_BYTES - size, "left"))
                stop = int(np.searchsorted(keys, keys[min(stop, len(keys) - 1)], "right"))
                if stop >= len(keys):
                    break
                yield solve([*held, batch.slice(0, stop)])
                held, size, batch, keys = [], 0, batch.slice(stop), keys[stop:]
            held.append(batch)
            size += int(offsets[-1])
        if held:
            yield solve(held)

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _without(raw: bytes, listed: pa.Scalar, width: int) -> tuple[list[bytes], int, int]:
    """What a text keeps without its repeats (packed starts and counts), the bytes and spans that go."""
    kept, removed, spans, done, low, high = [], 0, 0, 0, -1, -1
    if listed.is_valid:
        starts, counts = _places(np.sort(listed.values.to_numpy(zero_copy_only=False)))
        for a, b in zip([*starts.tolist(), len(raw) + 1], [*(starts + counts + width - 1).tolist(), len(raw) + 1]):
            if low >= 0 and a > high:
                kept.append(raw[done:low])
                removed, spans, done, low = removed + high - low, spans + 1, high, -1
            low, high = (a, b) if low < 0 else (low, max(high, b))
    kept.append(raw[done:])
    return kept, removed, spans


def _cut(width: int) -> Callable:
    """Documents (doc_id, text), with places last, to what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for raw, listed in zip(texts(batch.column(1)), batch.column(2)):
                kept, removed, spans = _without(raw, listed, width)
                for c, x in zip(out, (len(raw), removed, spans, b"".join(kept))):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _rewrite(width: int, columns: list[str]) -> Callable:
    """Whole documents, with places last, to documents with the text that is left, as
    keep_first_occurrences describes."""
    at_text, at_size = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, sizes, keep = [], [], []
            old = batch.column(at_size).to_pylist() if at_size is not None else [None] * batch.num_rows
            for raw, valid, listed, n in zip(texts(batch.column(at_text)), batch.column(at_text).is_valid().to_pylist(), batch.column(batch.num_columns - 1), old):
                kept, removed, _ = _without(raw, listed, width)
                left = b"".join(kept).decode("utf-8", "ignore")
                keep.append(not removed or bool(left.strip()))
                text.append(left if valid else None)
                sizes.append(len(left) if removed else n)
            made = list(batch.columns[:-1])
            made[at_text] = pa.array(text, batch.column(at_text).type)
            if at_size is not None:
                made[at_size] = pa.array(sizes, batch.column(at_size).type)
            yield pa.RecordBatch.from_arrays(made, columns).filter(pa.array(keep, pa.bool_()))

    return run


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents with unique ids, in the corpus's order; and, where the table's own ids are not
    unique and known, the table that leads back from (doc_id, digest) to them."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = narrow.agg(F.count("*").alias("all"), F.count_distinct("doc_id").alias("ids")).first()
    if n["all"] == n["ids"]:
        return narrow, None
    digest = F.coalesce(F.md5("text"), F.lit(""))
    ids = narrow.select(F.col("doc_id").alias("own_id"), digest.alias("digest")).distinct()
    ids = checkpointed(ids.orderBy(F.col("own_id").asc_nulls_first(), "digest").withColumn("doc_id", F.monotonically_increasing_id()))
    texts_ = narrow.withColumn("digest", digest).dropDuplicates(["doc_id", "digest"]).withColumnRenamed("doc_id", "_own")
    keyed = texts_.join(ids.withColumnRenamed("digest", "_digest"), F.col("_own").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("_digest")))
    return stored(keyed.select("doc_id", "text")), ids


def _repeats(unique: DataFrame, width: int) -> DataFrame:
    """The documents (with all columns of `unique`, whose ids are unique and known) and `places`,
    an array of packed starts and counts of windows that occur earlier, null without any. Both
    joins take whole documents, so that they share one exchange of texts."""
    parts = int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Known ids, said of both joins' texts: an inner join alone would filter, and exchange them anew.
    unique = unique.where("doc_id IS NOT NULL")
    rows = unique.select("doc_id", "text").mapInArrow(_emit(width), ROWS)
    sorted_rows = rows.repartition(parts, "anchor").sortWithinPartitions("anchor", "segment", "doc_id", "place")
    found = stored(few(sorted_rows.mapInArrow(_sift, FOUND)))
    name, listed = unused(unique, "repeat_id"), unused(unique, "places")
    variants = found.where("kind > 0").groupBy(F.col("doc_id").alias(name)).agg(F.collect_list(F.struct("place", "anchor", "kind")).alias(listed))
    at_id, at_text = unique.columns.index("doc_id"), unique.columns.index("text")
    with_ = lambda table, how: unique.hint("merge").join(table, F.col("doc_id") == F.col(name), how).drop(name)
    pieces = with_(variants, "inner").mapInArrow(_fetch(width, at_id, at_text), PIECES)
    ordered = pieces.repartition(parts, "key").sortWithinPartitions("key", "doc_id", "start")
    repeats = ordered.mapInArrow(_compare(width), "doc_id long, place long").unionByName(found.where("kind = 0").select("doc_id", "place"))
    united = repeats.groupBy(F.col("doc_id").alias(name)).agg(F.collect_list("place").alias(listed))
    return with_(united, "left")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, and kept, the bytes that stay."""
    unique, ids = _keyed(bounded(docs))
    cut = few(_repeats(unique, width).mapInArrow(_cut(width), RESULT), 8)
    if ids is None:
        return cut
    back = docs.select(F.col("doc_id").cast("long").alias("_own"), F.coalesce(F.md5("text"), F.lit("")).alias("_digest"))
    renamed = cut.withColumnRenamed("doc_id", "_key").join(ids.withColumnRenamed("doc_id", "_key2"), F.col("_key") == F.col("_key2"))
    whole = back.join(renamed, F.col("_own").eqNullSafe(F.col("own_id")) & (F.col("_digest") == F.col("digest")))
    return whole.select(F.col("_own").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def digest(removed: DataFrame) -> DataFrame:
    """The contract's columns of remove_repeats' rows."""
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], width: int = WIDTH) -> list[tuple]:
    """The contract's columns from a dictionary of all windows; for tests."""
    first: dict[bytes, tuple] = {}
    raw = {d: (t or "").encode() for d, t in docs}
    for d in sorted(raw):
        for p in range(len(raw[d]) - width + 1):
            first.setdefault(raw[d][p : p + width], (d, p))
    out = []
    for d, b in sorted(raw.items()):
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] != (d, p):
                gone[p : p + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def keep_first_occurrences(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents, with all their columns, without the bytes that repeat; characters that a cut
    goes through go as a whole. Documents of which only white space is left go; a text that lost
    nothing, null ones too, stays as it is, and n_chars, where there is one, is the new length."""
    docs = bounded(docs)
    n = docs.agg(F.count("*").alias("all"), F.count_distinct("doc_id").alias("ids")).first()
    if n["all"] == n["ids"] and dict(docs.dtypes)["doc_id"] == "bigint":
        return few(_repeats(docs, width).mapInArrow(_rewrite(width, docs.columns), docs.schema), 8)
    # Ids that are repeated or null: each text is told apart by its digest.
    own, mark = unused(docs, "cut_id"), unused(docs, "cut_digest")
    _, ids = _keyed(docs)
    ids = ids if ids is not None else docs.select(F.col("doc_id").cast("long").alias("own_id"), F.coalesce(F.md5("text"), F.lit("")).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"))
    wide = docs.withColumn(mark, F.coalesce(F.md5("text"), F.lit("")))
    named = ids.select(F.col("own_id").alias(own), F.col("digest").alias(f"{mark}_2"), F.col("doc_id").alias(f"{own}_2"))
    keyed = stored(wide.join(named, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.col(mark) == F.col(f"{mark}_2"))).drop(own, mark, f"{mark}_2"))
    first = keyed.select(F.col(f"{own}_2").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    places = _repeats(first, width).select(F.col("doc_id").alias(own), "places")
    joined = keyed.join(places, F.col(f"{own}_2") == F.col(own), "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.col("places").alias(unused(docs, "places")))
    return joined.mapInArrow(_rewrite(width, docs.columns), docs.schema)
