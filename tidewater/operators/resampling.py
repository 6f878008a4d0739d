"""Bootstrap intervals of metrics of ranked scores: all resamples in the same passes, no row copied.

A row's Poisson weight in a resample is drawn from a hash of its key by integer arithmetic, so weights
are computed where they are needed and never stored or shuffled. Scores are cut into ranges of about
equal size. A range's task sorts its scores once and takes the running sums of all resamples together,
over blocks of BLOCK weights; ranges are joined by their sums, of which there are as many as resamples. Rows that share a score with
many others travel as one row of weight sums, so that a common score is no task's burden."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewater.sources.shared import temporary

#: Scores are cut into at least so many ranges, of about so many rows.
PARTS, PART_ROWS = 16, 200_000
#: Rows of a batch with one score (and group) from which on they travel as sums.
TOGETHER = 32
#: Weights computed at once.
BLOCK = 2_000_000
# The modulus of the draws, and bounds of the Poisson distribution of mean 1.
PRIME = 2**31 - 1
BOUNDS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
_STEPS = (12345, 67891, 24689)


def key_number(key: Column) -> Column:
    """52 bits of the key's hash."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("long")


def weights(number: np.ndarray, resamples: int, seed: int = 0) -> np.ndarray:
    """Poisson weights (rows, resamples): a multiple of the number's low part, differing by resample,
    plus its high part, squared three times modulo a prime."""
    turn = ((np.arange(1, resamples + 1, dtype=np.int64) + seed * 1_000_003) * 1103515245 + 12345) % PRIME
    x = ((number % PRIME)[:, None] * turn + (number // PRIME)[:, None]) % PRIME
    for c in _STEPS:
        x = (x * x + c) % PRIME
    return np.searchsorted(np.array(BOUNDS) * PRIME, x, "left").astype(np.int64)


def weight_sql(number: str, resample: str, seed: int = 0) -> str:
    """weights() as DuckDB SQL over a number and a resample from 1 on."""
    x = f"((({number}) % {PRIME}) * (((({resample}) + {seed * 1_000_003}) * 1103515245 + 12345) % {PRIME}) + ({number}) // {PRIME}) % {PRIME}"
    for c in _STEPS:
        x = f"list_transform([{x}], lambda z: (z * z + {c}) % {PRIME})[1]"
    return f"list_transform([{x}], lambda z: {' + '.join(f'(z > {b * PRIME!r}::DOUBLE)::INT' for b in BOUNDS)})[1]"


def _sums(number: np.ndarray, at: np.ndarray, n: int, resamples: int, seed: int) -> np.ndarray:
    """Weight sums (n, resamples) of rows by their place; rows in order of it."""
    out, step = np.zeros((n, resamples), np.int64), max(1, BLOCK // resamples)
    for i in range(0, len(number), step):
        w = weights(number[i : i + step], resamples, seed)
        place = at[i : i + step]
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, int)
        out[place[first]] += np.add.reduceat(w, first, axis=0)
    return out


_ROWS = "part int, g string, score double, label int, number long, sums binary"


def _dealt(cuts: np.ndarray, resamples: int, seed: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, label, number = (batch.column(c).to_numpy() for c in ("score", "label", "number"))
            coded = batch.column("g").dictionary_encode()
            group = coded.indices.to_numpy()
            order = np.lexsort((label, score, group))
            score, label, number, group = score[order], label[order], number[order], group[order]
            same = (score[1:] == score[:-1]) & (label[1:] == label[:-1]) & (group[1:] == group[:-1])
            first = np.flatnonzero(np.concatenate(([True], ~same))) if len(score) else np.zeros(0, int)
            size = np.diff(np.concatenate((first, [len(score)])))
            many = np.repeat(size >= TOGETHER, size)
            heads = first[size >= TOGETHER]
            summed = _sums(number[many], np.repeat(np.arange(len(heads)), size[size >= TOGETHER]), len(heads), resamples, seed)
            kept = np.concatenate((np.flatnonzero(~many), heads))
            raw = [None] * int((~many).sum()) + [s.astype("<i8").tobytes() for s in summed]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.searchsorted(cuts, score[kept]).astype(np.int32)), coded.dictionary.take(pa.array(group[kept])),
                    pa.array(score[kept]), pa.array(label[kept].astype(np.int32)), pa.array(number[kept]), pa.array(raw, pa.binary()),
                ],
                ["part", "g", "score", "label", "number", "sums"],
            )

    return run


def _levels(rows: pa.Table, resamples: int, seed: int, down: bool = False) -> Iterator[tuple[str, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """For each group of a range: its name, and the weights of positives and negatives (distinct
    scores from the lowest on, resamples) in blocks of about BLOCK weights, the last one first if down."""
    for name in sorted(set(rows.column("g").to_pylist())):
        mine = rows.filter(pa.compute.equal(rows.column("g"), name))
        mine = mine.take(pa.array(np.argsort(mine.column("score").to_numpy(), kind="stable")))
        score, label, number = (mine.column(c).to_numpy() for c in ("score", "label", "number"))
        scores, at = np.unique(score, return_inverse=True)
        raw = mine.column("sums")
        single, step = raw.is_null().to_numpy(), max(1, BLOCK // resamples)

        def block(first: int) -> tuple[np.ndarray, np.ndarray]:
            n, both = min(step, len(scores) - first), []  # noqa: B023
            a, b = np.searchsorted(at, (first, first + n))  # noqa: B023
            for positive in (True, False):
                own = (label[a:b] > 0) == positive  # noqa: B023
                i = a + np.flatnonzero(single[a:b] & own)  # noqa: B023
                total = _sums(number[i], at[i] - first, n, resamples, seed)  # noqa: B023
                for j in (a + np.flatnonzero(~single[a:b] & own)).tolist():  # noqa: B023
                    total[at[j] - first] += np.frombuffer(raw[j].as_py(), "<i8")  # noqa: B023
                both.append(total)
            return both[0], both[1]

        firsts = range(0, len(scores), step)
        yield name, map(block, reversed(firsts) if down else firsts)


def _raw(values: Sequence[np.ndarray], kind: str) -> pa.Array:
    return pa.array([v.astype(kind).tobytes() for v in values], pa.binary())


def ranked(df: DataFrame, key: str, label: str, score: str, by: str | None = None, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """by (if given, as a string), resample, auroc and average_precision of every resample; both null
    if it has one class only. Rows without label or score take no part."""
    spark = df.sparkSession
    g = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    rows = df.select(
        g.alias("g"), F.col(score).cast("double").alias("score"), (F.col(label) > 0).cast("int").alias("label"),
        key_number(F.col(key)).alias("number")
    )
    rows = rows.where("score IS NOT NULL AND NOT isnan(score) AND label IS NOT NULL AND number IS NOT NULL")
    seen = rows.agg(F.count("*").alias("n"), F.percentile_approx("score", [i / 1024 for i in range(1, 1024)], 10_000).alias("cuts")).first()
    parts = min(1024, max(PARTS, seen["n"] // PART_ROWS))
    cuts = np.unique(np.array(seen["cuts"] or [], float)[:: max(1, 1024 // parts)])

    def totals(rows: pa.Table) -> pa.Table:
        out = []
        for name, blocks in _levels(rows, resamples, seed):
            p, n, u = np.zeros((3, resamples))
            for pos, neg in blocks:
                u += (pos * (n + np.cumsum(neg, 0) - neg / 2.0)).sum(0)
                p, n = p + pos.sum(0), n + neg.sum(0)
            out.append((rows.column("part")[0].as_py(), name, p, n, u))
        part, names, *sums = zip(*out)
        return pa.table({"part": pa.array(part, pa.int32()), "g": pa.array(names), **{c: _raw(v, "<f8") for c, v in zip(("p", "n", "u"), sums)}})

    def offsets(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        p, n, u = (np.stack([np.frombuffer(r, "<f8") for r in rows.column(c).to_pylist()]) for c in ("p", "n", "u"))
        all_p, all_n = p.sum(0), n.sum(0)
        area = (u + p * (np.cumsum(n, 0) - n)).sum(0)
        m = len(p)
        return pa.table({
            "part": rows.column("part"), "g": rows.column("g"), "above_p": _raw(all_p - np.cumsum(p, 0), "<f8"), "above_n": _raw(all_n - np.cumsum(n, 0), "<f8"),
            "p": _raw([all_p] * m, "<f8"), "n": _raw([all_n] * m, "<f8"), "u": _raw([area] * m, "<f8"),
        })

    def precision(rows: pa.Table, known: pa.Table) -> pa.Table:
        at = {r["g"]: r for r in known.to_pylist()}
        out = []
        for name, blocks in _levels(rows, resamples, seed, down=True):
            get = lambda c: np.frombuffer(at[name][c], "<f8")  # noqa: E731, B023
            above_p, above_n, ap = get("above_p"), get("above_n"), np.zeros(resamples)
            for pos, neg in blocks:
                tp, fp = above_p + np.cumsum(pos[::-1], 0), above_n + np.cumsum(neg[::-1], 0)
                ap += (tp / np.maximum(tp + fp, 1) * pos[::-1]).sum(0)
                above_p, above_n = tp[-1], fp[-1]
            out.append((name, ap, get("p"), get("n"), get("u")))
        names, *values = zip(*out)
        return pa.table({"g": pa.array(names), **{c: _raw(v, "<f8") for c, v in zip(("ap", "p", "n", "u"), values)}})

    def joined(rows: pa.Table) -> pa.Table:
        ap = sum(np.frombuffer(r, "<f8") for r in sorted(rows.column("ap").to_pylist()))
        p, n, u = (np.frombuffer(rows.column(c)[0].as_py(), "<f8") for c in ("p", "n", "u"))
        both = (p > 0) & (n > 0)
        value = lambda a, b: pa.array(a / np.where(both, b, 1), mask=~both)
        return pa.table({
            "g": pa.array([rows.column("g")[0].as_py()] * resamples), "resample": pa.array(np.arange(1, resamples + 1, dtype=np.int32)),
            "auroc": value(u, p * n), "average_precision": value(ap, p),
        })

    with temporary(spark) as store:
        ranges = store(rows.mapInArrow(_dealt(cuts, resamples, seed), _ROWS))
        each = ranges.groupBy("part").applyInArrow(totals, "part int, g string, p binary, n binary, u binary")
        above = store(each.groupBy("g").applyInArrow(offsets, "part int, g string, above_p binary, above_n binary, p binary, n binary, u binary"))
        part = ranges.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(precision, "g string, ap binary, p binary, n binary, u binary")
        found = part.groupBy("g").applyInArrow(joined, "g string, resample int, auroc double, average_precision double")
        shared = found.checkpoint()
    return shared.withColumnRenamed("g", by) if by else shared.drop("g")


def intervals(resampled: DataFrame, metrics: Sequence[str], by: str | None = None, at_least: int = 1) -> DataFrame:
    """by, metric, lo, hi, se and valid: the 95 % percentile interval and standard error of each metric
    over the resamples that give it; unknown if fewer than `at_least` do."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])
    keys = [by] if by else []
    long = resampled.select(*keys, F.inline(cells)).groupBy(*keys, "metric")
    enough = F.count("v") >= at_least
    return long.agg(
        *[
            F.when(enough, f).alias(n) for n,
            f in (("lo", F.percentile("v", 0.025)), ("hi", F.percentile("v", 0.975)), ("se", F.stddev_samp("v")))
        ], F.count("v").alias("valid")
    )


def regression(df: DataFrame, key: str, actual: str, predicted: str, by: str | None = None, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """by (if given, as a string), resample, r2 and mse of every resample, from sums alone: one scan."""
    g = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    rows = df.select(
        g.alias("g"), F.col(actual).cast("double").alias("y"), F.col(predicted).cast("double").alias("f"),
        key_number(F.col(key)).alias("number")
    )
    rows = rows.where("y IS NOT NULL AND f IS NOT NULL AND number IS NOT NULL AND NOT isnan(y) AND NOT isnan(f)")
    # An origin near the values keeps the sums of squares exact enough; it changes rounding only.
    origin = rows.limit(1000).agg(F.avg("y")).first()[0] or 0.0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            y, f, number = (batch.column(c).to_numpy() for c in ("y", "f", "number"))
            coded, step = batch.column("g").dictionary_encode(), max(1, BLOCK // resamples)
            group = coded.indices.to_numpy()
            parts = np.stack([np.ones(len(y)), y - origin, (y - origin) ** 2, (y - f) ** 2], 1)
            for i in range(0, len(y), step):
                w = weights(number[i : i + step], resamples, seed)
                for k, name in enumerate(coded.dictionary.to_pylist()):
                    mine = group[i : i + step] == k
                    total[name] = total.get(name, 0) + w[mine].T @ parts[i : i + step][mine]
        for name, t in total.items():
            columns = [pa.array([name] * resamples), pa.array(np.arange(1, resamples + 1, dtype=np.int32)), *(pa.array(t[:, i]) for i in range(4))]
            yield pa.RecordBatch.from_arrays(columns, ["g", "resample", "n", "y", "yy", "e"])

    each = rows.mapInArrow(sums, "g string, resample int, n double, y double, yy double, e double")
    out = each.groupBy("g", "resample").agg(*[F.sum(c).alias(c) for c in ("n", "y", "yy", "e")])
    spread = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    r2 = F.when((F.col("n") > 0) & (spread > 1e-12 * F.col("yy")), 1 - F.col("e") / spread)
    found = out.select("g", "resample", r2.alias("r2"), F.when(F.col("n") > 0, F.col("e") / F.col("n")).alias("mse"))
    return found.withColumnRenamed("g", by) if by else found.drop("g")


def rates(df: DataFrame, key: str, label: str, predicted: str, by: str | None = None, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """by (if given, as a string), resample, sensitivity and specificity of every resample, from sums
    alone; null for a class that a resample has no row of."""
    out = []
    for name, positive in (("sensitivity", True), ("specificity", False)):
        kept = df.where((F.col(label) > 0) == positive).withColumn("_hit", ((F.col(predicted) > 0) == positive).cast("double"))
        # The mean square of 1 - hit is the share that is missed.
        each = regression(kept.withColumn("_one", F.lit(1.0)), key, "_hit", "_one", by, resamples, seed)
        keys = [by] if by else []
        out.append(each.select(*keys, "resample", (1 - F.col("mse")).alias(name)))
    return out[0].join(out[1], [*([by] if by else []), "resample"], "full")
