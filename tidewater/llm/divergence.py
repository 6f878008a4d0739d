"""How the sources of a language differ in their words: exact integer chi-squared divergences.

Terms are found byte by byte (`slices`): each block of documents is one flat buffer, a lookup table
gives boundaries, xxhash groups equal slices, and bytes are compared before anything is counted. A
task sends one row for each (lang, source, term) of a block; Spark sums them, keeps terms of enough
documents of their language, and deals each language's terms into blocks of BLOCK_ROWS counts. A
block is a CSR matrix of sources by terms: what a pair of sources owes to the block is summed with
`reduceat` over the rows, zero counts included by their number, so work follows the counts that are
there. Partial sums of the blocks are added by Spark. A term's row holds at most one count a source.

Shares are p = 1 + floor(10^9 (count + 1) / (N + V)) and terms of a sum floor((p - q)^2 / q), all in
64-bit integers: the quotient is taken in three steps of 1000, so N + V may reach 9 * 10^15.

Defined results: null text, lang and source are ''; a group without terms has the share of count 0
for every kept term; a language without kept terms has pairs of value 0 and no terms; repeated rows
and ids are documents of their own, so ids do not matter and may be null; ties are ordered by the
UTF-8 bytes of the item; texts of any length are counted whole; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidewater.llm.blocks import flat, ranges, row_blocks
from tidewater.llm.slices import LOWER, boundaries, grouped
from tidewater.llm.storage import bounded, checkpointed, few, stored

#: Bytes of text whose terms are grouped at once.
GROUP_BYTES = 4 << 20
#: Counts of a block of terms.
BLOCK_ROWS = 50_000
#: Rows of the table of languages up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_LANGS = 100_000
SCALE = 1000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]
    for batch in batches:
        for block in row_blocks(batch, "text", GROUP_BYTES):
            data, offsets = flat(block.column(0))
            data = LOWER[data]
            row, starts, ends = boundaries(data, offsets)
            term, first = grouped(data, starts, ends)
            # Groups of the block's rows, numbered by (lang, source).
            lang, source = (block.column(i).dictionary_encode() for i in (1, 2))
            wide = max(1, len(source.dictionary))
            key, group = np.unique(lang.indices.to_numpy() * np.int64(wide) + source.indices.to_numpy(), return_inverse=True)
            kinds = max(1, len(first))
            pair, n = np.unique(row * np.int64(kinds) + term, return_counts=True)
            cell, at = np.unique(group[pair // kinds] * np.int64(kinds) + pair % kinds, return_inverse=True)
            total = np.bincount(at, n, len(cell)).astype(np.int64)
            docs = np.bincount(at, minlength=len(cell))
            chief = first[cell % kinds] if len(cell) else first
            sizes = (ends - starts)[chief]
            raw = data[ranges(starts[chief], sizes)].tobytes()
            places = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            words = pa.StringArray.from_buffers(len(cell), pa.py_buffer(places.tobytes()), pa.py_buffer(raw))
            # A row without a term says that the group occurs.
            owner = np.concatenate((key[cell // kinds], key))
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(owner // wide)),
                    source.dictionary.take(pa.array(owner % wide)),
                    pa.concat_arrays([words, pa.nulls(len(key), pa.string())]),
                    pa.array(np.concatenate((total, np.zeros(len(key), np.int64)))),
                    pa.array(np.concatenate((docs, np.zeros(len(key), np.int64)))),
                ],
                names,
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); a null term: the group."""
    narrow = bounded(docs).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    each = narrow.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), by long division in base 1000."""
    rest, out = np.asarray(count, np.int64) + 1, np.int64(0)
    total = np.maximum(total, 1)
    for _ in range(3):
        digit, rest = np.divmod(rest * SCALE, total)
        out = out * SCALE + digit
    return 1 + out


def owed(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of a CSR matrix, of which some may be empty."""
    out = np.zeros(len(starts) - 1, np.int64)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, starts[full])
    return out


def _block(most: int):  # noqa: ANN202
    def run(block: pa.Table) -> pa.Table:
        lang = block.column("lang")[0].as_py()
        is_group = pc.is_null(block.column("term"))
        groups = block.filter(is_group).sort_by("source")
        names = groups.column("source").combine_chunks()
        size, v = groups.column("n").to_numpy() + groups.column("v").to_numpy(), groups.column("v")[0].as_py()
        whole = groups.column("total")[0].as_py() + v
        # Counts as a CSR matrix: rows are sources, columns are terms in the order of their bytes.
        cells = block.filter(pc.invert(is_group))
        coded = cells.column("term").combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        terms, place = coded.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        column = place[coded.indices.to_numpy()]
        row = pc.index_in(cells.column("source"), names).to_numpy().astype(np.int64)
        by = np.lexsort((column, row))
        row, column, n = row[by], column[by], cells.column("n").to_numpy()[by]
        total = cells.column("total").to_numpy()[by]
        starts = np.searchsorted(row, np.arange(len(names) + 1))
        p, absent = share(n, size[row]), share(np.zeros(len(names)), size)
        held = np.diff(starts)
        out = {"source": [], "part": [], "item": [], "value": []}

        def add(part: str, sources: pa.Array, items: pa.Array, values: np.ndarray) -> None:
            out["source"].append(sources)
            out["part"].append(pa.array([part] * len(sources), pa.string()))
            out["item"].append(items)
            out["value"].append(pa.array(values, pa.int64()))

        for t in range(len(names)):
            mine = slice(starts[t], starts[t + 1])
            q, there = np.full(len(terms), absent[t]), np.zeros(len(terms), bool)
            q[column[mine]], there[column[mine]] = p[mine], True
            both = there[column]
            value = _row_sums(owed(p, q[column]), starts)
            # Terms of the other source alone: all of its terms, less those that both hold.
            value += np.array([owed(a, p[mine]).sum() for a in absent]) - _row_sums(owed(absent[row], q[column]) * both, starts)
            value += (len(terms) - held - held[t] + _row_sums(both.astype(np.int64), starts)) * owed(absent, absent[t])
            others = np.flatnonzero(np.arange(len(names)) != t)
            add("pair", names.take(pa.array(others)), names.take(pa.array(np.full(len(others), t))), value[others])
        q = share(total, whole)
        value = np.where(p > q, owed(p, q), -1)
        for s in range(len(names)):
            mine = np.arange(starts[s], starts[s + 1])
            mine = mine[value[mine] >= 0]
            best = mine[np.argsort(-value[mine], kind="stable")[:most]]
            add("term", names.take(pa.array(np.full(len(best), s))), terms.take(pa.array(column[best])), value[best])
        joined = {k: pa.concat_arrays(x) if x else pa.array([], pa.int64() if k == "value" else pa.string()) for k, x in out.items()}
        return pa.table({"lang": pa.array([lang] * len(joined["value"]), pa.string()), **joined})

    return run


def divergences(docs: DataFrame, least_docs: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has the other sources of the language,
    part `term` the `most` kept terms that a source holds beyond its language's share."""
    counts = stored(term_counts(docs))
    of_term = Window.partitionBy("lang", "term")
    spread = counts.where("term IS NOT NULL").select(
        "lang", "source", "term", "n",
        F.sum("docs").over(of_term).alias("docs"),
        F.sum("n").over(of_term).alias("total"),
        (F.col("source") == F.min("source").over(of_term)).cast("long").alias("first"),
    )
    kept = stored(spread.where(F.col("docs") >= least_docs).drop("docs"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("v"), F.count("*").alias("cells"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").na.fill(0)
    groups = checkpointed(few(groups))
    blocks = F.greatest(F.lit(1), F.ceil(F.sum("cells") / BLOCK_ROWS)).cast("long")
    langs = checkpointed(few(groups.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("v").alias("v"), blocks.alias("blocks"))))
    table = F.broadcast(langs) if langs.count() <= BROADCAST_LANGS else langs
    cells = kept.join(table.select("lang", "v", "blocks"), "lang").select(
        "lang", "source", "term", "n", "total", "v", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    )
    every = groups.select("lang", "source", "n").join(table, "lang").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), "n", "total", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    schema = "lang string, source string, part string, item string, value long"
    parts = stored(cells.unionByName(every).groupBy("lang", "block").applyInArrow(_block(most), schema))
    ordered = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(ordered))
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= most)
    return ranked.unionByName(terms)


def oracle_sql(least_docs: int = 3, most: int = 200, table: str = "documents") -> str:
    """divergences() as one DuckDB query, dense and in 128-bit integers."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM {table}),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {least_docs}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS p FROM f WINDOW s AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n) AS n FROM f GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS q FROM l WINDOW s AS (PARTITION BY lang)),
m AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT
      FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
z AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM x)
SELECT * FROM z WHERE part = 'pair' OR rank <= {most}
"""
