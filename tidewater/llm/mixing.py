"""Mixing sources to target weights by Pareto order sampling.

Sources share a multiple of all words by weight; a target above max_copies times its source's
size stops there, and the excess goes to the others by weight (water filling, in closed form over
the table of sources). A document's expected copies are target / size of its source: the whole
part is allocated to every document, the fraction is its inclusion probability p. Documents are
ranked by the Pareto variable (u / (1 - u)) / (p / (1 - p)), with u from a hash of id and
text, and taken in that order until the source's remaining words are reached, to the nearest document.

The cut is found without ordering a source in one task: sizes are summed per source and rank bin
(at most BINS rows a source), bins before the cut are taken whole, and only the bin that holds the
cut, about one BINS-th of a source, is ordered.

Defined results: a null text or one of white space has size 0 and nothing taken; a null source is
a source of its own, last in order; sources of size 0 have target 0; a null id stays null, and its row
is drawn by its text alone; equal rows are equal in rank, and at the cut as many of them are taken as
the source has words for; rows that repeat an id with another text are drawn on their own; texts of
any length are counted whole; only doc_id, source and text are read, so extra columns do not matter;
empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.llm.storage import checkpointed, few

BINS = 4096
#: Rows of the table of sources up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, text: Column, seed: str = "") -> Column:
    """A number between 0 and 1, both excluded, from 52 bits of a hash of the key and the text: rows
    without a key are drawn by their text."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), known(key), F.lit("|"), known(F.md5(text)))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_copies: float) -> DataFrame:
    """sizes (source, source_size) with target: weights repeat over the sources in code-point
    order, nulls last. One row a source; the window has no key because it is over that table."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("fill", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    w = F.array(*[F.lit(float(x)) for x in weights])[F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))]
    ranked = (
        sizes.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * float(max_copies))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * float(share))
        .withColumn("place", F.row_number().over(filled))
    )
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    # The first place, in order of filling, whose level stays below its cap sets the water level.
    water = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("place", "level"))).over(everything)["level"]
    return (
        ranked.withColumn("level", level)
        .withColumn("water", water)
        .select("source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight"))).alias("target"))
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_copies: float = 2, seed: str = "", words: Column | None = None
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and copies."""
    text_size = size_of(F.col("text")) if words is None else words
    drawn = uniform(F.col("doc_id"), F.col("text"), seed)
    sized = checkpointed(docs.select("doc_id", "source", text_size.alias("size"), drawn.alias("u")))
    sources = checkpointed(few(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_copies)))
    small = sources.count() <= BROADCAST_SOURCES

    def with_source(rows: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        named = table.select(F.col("source").alias("_source"), *columns)
        return rows.join(F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")

    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    u, p = F.col("u"), F.col("p")
    odds = F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))
    ranked = (
        with_source(sized, sources, "source_size", "target")
        .withColumn("ratio", ratio)
        .withColumn("whole", F.floor("ratio"))
        .withColumn("p", F.col("ratio") - F.col("whole"))
        .withColumn("rank", odds)
        .withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS))
    )
    binned = ranked.where("p > 0").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max(F.col("p") * F.col("source_size")).alias("rest"))
    up_to = Window.partitionBy("source").orderBy("bin")
    cuts = checkpointed(few(
        binned.withColumn("before", F.sum("words").over(up_to) - F.col("words"))
        .where("before < rest")
        .groupBy("source")
        .agg(F.max("bin").alias("cut"), F.max_by("before", "bin").alias("before"), F.max("rest").alias("rest"))
    ))
    placed = with_source(ranked, cuts, "cut", "before", "rest")
    clear = placed.where("cut IS NULL OR bin IS NULL OR bin <> cut").withColumn("extra", F.coalesce(F.col("bin") < F.col("cut"), F.lit(False)))
    inside = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2
    at_cut = placed.where("bin = cut").withColumn("extra", reached <= F.col("rest"))
    copies = F.col("whole") + F.col("extra").cast("long")
    return clear.unionByName(at_cut).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def oracle_sql(weights: Sequence[float], share: float, max_copies: float, table: str = "documents") -> str:
    """mix() as one DuckDB query."""
    n, listed = len(weights), ", ".join(f"{float(x)!r}::DOUBLE" for x in weights)
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM {table}),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, ([{listed}])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {n} + 1)::BIGINT] AS weight,
        source_size * {float(max_copies)!r}::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * {float(share)!r}::DOUBLE AS total FROM src),
f AS (SELECT *, cap / weight AS fill, row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS place FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target
      FROM (SELECT *, min(CASE WHEN level <= fill THEN place END) OVER () AS stop FROM l) a
      LEFT JOIN (SELECT place AS p0, level AS water FROM l) b ON b.p0 = a.stop),
r AS (SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio
      FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(ratio)::BIGINT AS whole, ratio - floor(ratio) AS p FROM r),
k AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM q),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS reached FROM k WHERE p > 0
      UNION ALL SELECT *, NULL FROM k WHERE NOT p > 0)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN reached - size / 2.0::DOUBLE <= p * source_size THEN 1 ELSE 0 END))::BIGINT AS taken,
  (whole + CASE WHEN reached - size / 2.0::DOUBLE <= p * source_size THEN 1 ELSE 0 END)::BIGINT AS copies
FROM c
"""
