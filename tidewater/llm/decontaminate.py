"""Benchmark decontamination with a positional inverted index sharded by document.

`build_index` turns the documents into a stored table of shards, each of some MB of text: its
documents, its terms, and for every term the ascending positions where it stands (postings). The
table knows nothing of a benchmark and serves any number of searches; documents never move, so no
source, word or passage gathers in one task.

A search maps the items' terms to a shard's. An exact window is looked up from its rarest term in
that shard: its postings, less the term's offset in the window, are candidate starts, and the
offset-adjusted lists of the other terms are intersected with them from the next rarest on. Proximity
takes the `near_terms` distinct words of a window that are rarest in all documents (ties by the
word's bytes), and finds postings of the rarest with all others at most `near_reach` words away, in
any order and in one document.

The benchmark goes to the tasks in slices of at most `slice_bytes` bytes of text, one pass over the
index for each; the driver fetches a slice when the one before is done, and what a task holds is
bounded by one slice and one shard. Hits of several slices are kept by shard and place in it.

Defined results: a null or wordless document has no words, no hits and no items; a null or
wordless item has no window; an item without an id counts under the empty id, and items that repeat
an id as one item; an empty benchmark leaves all documents clean, an empty document table gives an
empty result; rows that repeat an id, or have none, each have a row of their own text; a very long
text is one shard, of some 40 bytes of memory a byte; other columns are not read, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.blocks import flat, ranges, row_blocks
from tidewater.llm.storage import bounded, few, stored

#: A-Z become a-z; ASCII other than letters and digits separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A byte that no UTF-8 text holds, as a word of its own, ends a document.
END = b" \xff "

INDEX = "doc_ids array<long>, n_words array<int>, terms binary, counts binary, postings binary"
HITS = "at int, spans array<struct<first:int,last:int>>, items array<string>, near_items array<string>"
_CODEC = "zstd"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Windows:
    """The windows of a slice of items, as rows of term numbers padded with -1."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        self.width, self.terms, ids = width, {}, {}
        rows, owner = [], []
        for item, text in items:
            found = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
            if not found:
                continue
            number = ids.setdefault("" if item is None else str(item), len(ids))
            for i in range(max(1, len(found) - width + 1)):
                part = found[i : i + width]
                rows.append(part + [-1] * (width - len(part)))
                owner.append(number)
        self.item_ids = list(ids)
        self.rows = np.array(rows, np.int32).reshape(-1, width)
        self.owner = np.array(owner, np.int32)
        self.sizes = (self.rows >= 0).sum(1)

    def rarest(self, counts: np.ndarray, terms: int) -> np.ndarray:
        """The `terms` rarest distinct terms of each window, first the rarest, -1 in a window that has
        fewer; counts: of all documents, by term number."""
        names = sorted(self.terms, key=self.terms.get)
        by_name = np.empty(len(names), np.int64)
        by_name[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        rank = np.empty(len(names), np.int64)
        rank[np.lexsort((by_name, counts))] = np.arange(len(names))
        back = np.argsort(rank)
        each = np.sort(np.where(self.rows >= 0, rank[self.rows], len(names)), 1)
        each[:, 1:][each[:, 1:] == each[:, :-1]] = len(names)
        each = np.sort(each, 1)[:, :terms]
        if each.shape[1] < terms:
            return np.full((len(each), terms), -1)
        return np.where((each < len(names)).all(1, keepdims=True), back[np.minimum(each, len(names) - 1)], -1)


class Shard:
    """A positional inverted index of the documents in one block of text. A document's end takes a
    position of its own, so that no phrase goes over it."""

    def __init__(self, n_words: np.ndarray, terms: list[bytes], counts: np.ndarray, postings: np.ndarray):
        self.n_words, self.terms, self.counts, self.postings = n_words, terms, counts, postings
        self.first = np.concatenate(([0], np.cumsum(n_words + 1)[:-1])).astype(np.int64)
        self.size = int(n_words.sum()) + len(n_words)

    @classmethod
    def of(cls, column: pa.Array) -> Shard:
        data, offsets = flat(column)
        raw, cuts = data.tobytes(), offsets.tolist()
        tokens = END.join([raw[a:b].translate(FOLD) for a, b in zip(cuts[:-1], cuts[1:])]).split()
        number = {w: i for i, w in enumerate(dict.fromkeys(tokens))}
        at = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
        last = number.pop(b"\xff", -1)
        ends = np.flatnonzero(at == last)
        first = np.concatenate(([0], ends + 1))
        n_words = np.concatenate((ends, [len(tokens)])) - first
        order = np.argsort(at, kind="stable").astype(np.int32)
        counts = np.bincount(at, minlength=len(number) + (last >= 0))
        if last >= 0:
            begin = int(counts[:last].sum())
            order = np.delete(order, slice(begin, begin + counts[last]))
            counts = np.delete(counts, last)
        return cls(n_words, list(number), counts, order)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        codec = pa.Codec(_CODEC)
        steps = np.diff(self.postings, prepend=0).astype("<i4")
        return tuple(len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in (b" ".join(self.terms), self.counts.astype("<i4").tobytes(), steps.tobytes()))

    @classmethod
    def unpacked(cls, n_words: np.ndarray, terms: bytes, counts: bytes, postings: bytes) -> Shard:
        codec = pa.Codec(_CODEC)
        raw = [codec.decompress(x[8:], size, asbytes=True) if (size := int.from_bytes(x[:8], "little")) else b"" for x in (terms, counts, postings)]
        steps = np.cumsum(np.frombuffer(raw[2], "<i4"), dtype=np.int64)
        return cls(n_words, raw[0].split(), np.frombuffer(raw[1], "<i4").astype(np.int64), steps)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1

    def meet(self, windows: Windows) -> None:
        """Takes the slice's terms: how often each occurs here, and where its postings begin."""
        own = np.array([windows.terms.get(w, -1) for w in self.terms], np.int64)
        here = np.flatnonzero(own >= 0)
        start = np.cumsum(self.counts) - self.counts
        self.count, self.start = np.zeros((2, len(windows.terms)), np.int64)
        self.count[own[here]], self.start[own[here]] = self.counts[here], start[here]
        # Postings ascend by term and position: one sorted key finds a position in a term's list.
        self.key = np.repeat(np.arange(len(self.counts)), self.counts) * (self.size + 1) + self.postings
        self.base = np.zeros(len(windows.terms), np.int64)
        self.base[own[here]] = here * (self.size + 1)

    def phrases(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Windows and the positions where they occur word for word."""
        rows, width = windows.rows, windows.width
        rare = np.where(rows >= 0, self.count[rows], np.iinfo(np.int64).max)
        live = np.flatnonzero((rare > 0).all(1))
        order = np.argsort(rare[live], axis=1, kind="stable")
        lead = order[:, 0]
        terms = rows[live, lead]
        n = self.count[terms]
        which, turn = np.repeat(live, n), np.repeat(np.arange(len(live)), n)
        begin = self.postings[ranges(self.start[terms], n)] - np.repeat(lead, n)
        keep = (begin >= 0) & (begin + windows.sizes[which] <= self.size)
        which, turn, begin = which[keep], turn[keep], begin[keep]
        for j in range(1, width):
            offset = order[turn, j]
            term = rows[which, offset]
            wanted = self.base[term] + begin + offset
            keep = (term < 0) | (self.key[np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)] == wanted)
            which, turn, begin = which[keep], turn[keep], begin[keep]
        return which, begin

    def near(self, chosen: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose chosen terms (rows, first the rarest, -1 for none) all lie, in one document,
        at most `reach` words from a posting of the first; with the documents."""
        live = np.flatnonzero((chosen[:, 0] >= 0) & (self.count[chosen] > 0).all(1)) if len(chosen) else np.zeros(0, np.int64)
        n = self.count[chosen[live, 0]]
        which = np.repeat(live, n)
        centre = self.postings[ranges(self.start[chosen[live, 0]], n)]
        for j in range(1, chosen.shape[1]):
            term = chosen[which, j]
            low, size = self.start[term], self.count[term]
            after = np.searchsorted(self.key, self.base[term] + centre)
            ok = np.zeros(len(which), bool)
            for side in (after, after - 1):
                inside = (side >= low) & (side < low + size)
                spot = self.postings[np.clip(side, 0, len(self.postings) - 1)]
                ok |= inside & (np.abs(spot - centre) <= reach) & (self.document(spot) == self.document(centre))
            which, centre = which[ok], centre[ok]
        return which, self.document(centre)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of documents (doc_id, text): a row (shard, INDEX) for each block of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            for block in row_blocks(batch, "text"):
                shard = Shard.of(block.column(1))
                row = [block.column(0).to_pylist(), shard.n_words.tolist(), *shard.packed()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [f.split()[0] for f in INDEX.split(", ")])

    made = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)
    return stored(few(made.select(F.monotonically_increasing_id().alias("shard"), "*")))


def _occurrences(index: DataFrame, windows: Windows) -> np.ndarray:
    """How often the slice's terms occur in all documents."""
    look = windows.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(look), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.unpacked(np.zeros(0, np.int64), row["terms"], row["counts"], b"")
                own = np.array([look.get(w, -1) for w in shard.terms], np.int64)
                n[own[own >= 0]] += shard.counts[own >= 0]
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], ["term", "n"])

    counts = np.zeros(len(look), np.int64)
    # A row for each term of the slice at most.
    for r in index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r["term"]] = r["n"]
    return counts


def _search(windows: Windows, chosen: np.ndarray, reach: int) -> Callable:
    """Rows (shard, INDEX) to a row (shard, HITS) for each document with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.list_(pa.string()), pa.list_(pa.string())]
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.unpacked(np.array(row["n_words"], np.int64), row["terms"], row["counts"], row["postings"])
                if not len(windows.rows) or not len(shard.postings):
                    continue
                shard.meet(windows)
                spans, found, close = {}, {}, {}
                which, begin = shard.phrases(windows)
                change = np.zeros(shard.size + 1, np.int64)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + windows.sizes[which], -1)
                low, high = _runs(np.cumsum(change[:-1]) > 0)
                for d, a, b in zip(shard.document(low).tolist(), low.tolist(), high.tolist()):
                    spans.setdefault(d, []).append({"first": a - int(shard.first[d]), "last": b - 1 - int(shard.first[d])})
                n = len(windows.item_ids)
                exact = np.unique(shard.document(begin) * n + windows.owner[which])
                which, docs = shard.near(chosen, reach)
                loose = np.unique(docs * n + windows.owner[which])
                for keys, into in ((exact, found), (np.setdiff1d(loose, exact), close)):
                    for k in keys.tolist():
                        into.setdefault(k // n, []).append(windows.item_ids[k % n])
                hit = sorted({*found, *close})
                columns = [[row["shard"]] * len(hit), hit, [spans.get(d, []) for d in hit], [sorted(found.get(d, [])) for d in hit], [sorted(close.get(d, [])) for d in hit]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "at", "spans", "items", "near_items"])

    return run


def _slices(items: DataFrame, slice_bytes: int) -> tuple[int, Callable]:
    """The number of slices that hold about slice_bytes of text, and what fetches one of them."""
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // slice_bytes))
    part = F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(n))
    return n, lambda k: [(r["item_id"], r["text"]) for r in items.where(part == k).select("item_id", "text").collect()]


def find_contamination(docs: DataFrame, items: DataFrame, width: int = 10, near_terms: int = 4, near_reach: int = 10, slice_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, spans (first and last word of each hit run), items
    (ids, sorted, with an exact window), near_items (ids without one, of which some window's
    `near_terms` rarest words lie within `near_reach` words of the rarest)."""
    return search(build_index(docs), items, width, near_terms, near_reach, slice_bytes)


def search(index: DataFrame, items: DataFrame, width: int = 10, near_terms: int = 4, near_reach: int = 10, slice_bytes: int = 32 << 20) -> DataFrame:
    """find_contamination's rows from a stored index."""
    n, fetch = _slices(items, slice_bytes)
    hits = None
    for k in range(n):
        windows = Windows(fetch(k), width)
        chosen = windows.rarest(_occurrences(index, windows), near_terms)
        part = stored(few(bounded(index).mapInArrow(_search(windows, chosen, near_reach), f"shard long, {HITS}")))
        hits = part if hits is None else hits.union(part)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        inside = np.zeros(max((s["last"] for spans in group["spans"] for s in spans), default=-1) + 1, bool)
        for spans in group["spans"]:
            for s in spans:
                inside[s["first"] : s["last"] + 1] = True
        low, high = _runs(inside)
        exact = {x for xs in group["items"] for x in xs}
        near = {x for xs in group["near_items"] for x in xs} - exact
        spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(low, high)]
        return pd.DataFrame({"shard": group["shard"][:1], "at": group["at"][:1], "spans": [spans], "items": [sorted(exact)], "near_items": [sorted(near)]})

    if n > 1:
        hits = hits.groupBy("shard", "at").applyInPandas(merge, f"shard long, {HITS}")
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("at", "doc"))
    joined = rows.join(hits, ["shard", "at"], "left")
    none = {name: F.from_json(F.lit("[]"), kind) for name, kind in (("spans", "array<struct<first:int,last:int>>"), ("items", "array<string>"), ("near_items", "array<string>"))}
    own = [F.col("doc.doc_ids").alias("doc_id"), F.col("doc.n_words").cast("long").alias("n_words")]
    return joined.select(*own, *[F.coalesce(name, empty).alias(name) for name, empty in none.items()])


def keep_clean(docs: DataFrame, items: DataFrame, width: int = 10, slice_bytes: int = 32 << 20) -> DataFrame:
    """The documents, with all their columns, in which no window of an item occurs."""
    at = docs.columns.index("text")

    def filter_(slice_: list[tuple[object, str | None]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(slice_, width)
            for batch in batches:
                for block in row_blocks(batch, "text"):
                    shard = Shard.of(block.column(at))
                    clean = np.ones(block.num_rows, bool)
                    if len(windows.rows) and len(shard.postings):
                        shard.meet(windows)
                        clean[shard.document(shard.phrases(windows)[1])] = False
                    yield block.filter(pa.array(clean))

        return run

    n, fetch = _slices(items, slice_bytes)
    for k in range(n):
        docs = bounded(docs).mapInArrow(filter_(fetch(k)), docs.schema)
        if k < n - 1:
            docs = stored(docs)
    return docs


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of find_contamination's rows."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.array_join("near_items", ",").alias("near_items"),
    )


def oracle_sql(width: int = 10, near_terms: int = 4, near_reach: int = 10, docs: str = "documents", items: str = "benchmark") -> str:
    """The query's columns as one DuckDB query, by joining windows of words."""
    words_of = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT doc_id, {words_of} AS w FROM {docs}), b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words_of} AS w FROM {items}),
p AS (SELECT item, w[i:i + {width - 1}] AS part FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
q AS (SELECT DISTINCT item, len(part) AS k, array_to_string(part, ' ') AS key FROM p),
t AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS key FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k)),
h AS (SELECT doc_id, item, i, q.k FROM t JOIN q ON t.key = q.key AND t.k = q.k),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
e AS (SELECT DISTINCT doc_id, item FROM h),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM e GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
c AS (SELECT word, count(*) AS n FROM u GROUP BY word),
r AS (SELECT key, item, word, row_number() OVER (PARTITION BY key, item ORDER BY coalesce(n, 0), word) AS turn
      FROM (SELECT DISTINCT key, item, unnest(string_split(key, ' ')) AS word FROM q) LEFT JOIN c USING (word)),
f AS (SELECT key, item, list(word ORDER BY turn) AS chosen FROM r WHERE turn <= {near_terms} GROUP BY key, item HAVING count(*) = {near_terms}),
l AS (SELECT f.key, f.item, chosen, doc_id, pos FROM f JOIN u ON u.word = f.chosen[1]),
o AS (SELECT l.key, l.item, l.doc_id, l.pos FROM l JOIN u ON u.doc_id = l.doc_id AND list_contains(l.chosen, u.word) AND abs(u.pos - l.pos) <= {near_reach}
      GROUP BY l.key, l.item, l.doc_id, l.pos HAVING count(DISTINCT u.word) = {near_terms}),
x AS (SELECT doc_id, string_agg(item, ',' ORDER BY item) AS near_items FROM (SELECT DISTINCT doc_id, item FROM o) ANTI JOIN e USING (doc_id, item) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN x USING (doc_id)
"""


def brute_force(docs: list[tuple], items: list[tuple], width: int = 10, near_terms: int = 4, near_reach: int = 10) -> list[tuple]:
    """The query's columns by comparing every window with every position; for tests."""
    out, counts = [], Counter(w for _, text in docs for w in words(text))
    for doc, text in docs:
        w, hit, names, near = words(text), set(), set(), set()
        for item, body in items:
            t = words(body)
            for i in range(max(1, len(t) - width + 1) if t else 0):
                part, name = t[i : i + width], "" if item is None else str(item)
                for s in range(len(w) - len(part) + 1):
                    if w[s : s + len(part)] == part:
                        hit.update(range(s, s + len(part)))
                        names.add(name)
                rare = sorted(set(part), key=lambda x: (counts[x], x))[:near_terms]
                if len(rare) == near_terms and any(x == rare[0] and set(rare) <= set(w[max(0, s - near_reach) : s + near_reach + 1]) for s, x in enumerate(w)):
                    near.add(name)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit), ",".join(sorted(near - names))))
    return out
