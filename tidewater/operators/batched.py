"""Many clusterings in the same passes: starts, numbers of clusters and resamples of k-means and of
Gaussian mixtures.

Rows are scanned once an iteration, whatever the number of runs: a task computes the distances of its
rows to the centres of all runs by one matrix product, and sums what a step needs by run. The sums of a
run meet in one task, and the driver reads centres, never rows. Runs that have come to rest leave the
passes. Resamples are Poisson weights from a hash of the key, so no row is copied, and first centres
are drawn by k-means++, whose draws are hashes too: reruns and any partitioning agree."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewater.operators.resampling import key_number, weights

#: Distances that a task computes at once.
BLOCK = 2_000_000
#: The column of stored weights.
DRAWN = "drawn"
#: Added to the variances of a mixture's components (fixed value).
FLOOR = 1e-6


@dataclass(frozen=True)
class Run:
    """k clusters from the start `seed`, over all rows or (from 1 on) one of the resamples."""

    k: int
    seed: int = 0
    resample: int = 0


@dataclass
class Clustering:
    """A run's centres, and its summed squared distances."""

    run: Run
    centres: np.ndarray
    cost: float


@dataclass
class Mixture:
    """Components of a Gaussian mixture, and the mean log-likelihood of a row."""

    run: Run
    share: np.ndarray
    mean: np.ndarray
    covariance: np.ndarray
    likelihood: float

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log of share times density, rows times components."""
        out = np.empty((len(x), len(self.share)))
        for c in range(len(self.share)):
            root = np.linalg.cholesky(self.covariance[c])
            z = np.linalg.solve(root, (x - self.mean[c]).T)
            out[:, c] = np.log(max(self.share[c], 1e-300)) - (z * z).sum(0) / 2 - np.log(np.diag(root)).sum() - x.shape[1] / 2 * np.log(2 * np.pi)
        return out


def points(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """number (of the key) and the columns as doubles; rows with an unknown value take no part. Kept
    in the shared folder while passes read it, dealt to all cores: few bytes are many distances."""
    rows = df.select(key_number(F.col(key)).alias("number"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    known = " AND ".join(["number IS NOT NULL", *[f"x{i} IS NOT NULL AND NOT isnan(x{i})" for i in range(len(columns))]])
    return rows.where(known).repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "number").checkpoint()


def _weighed(rows: DataFrame, resamples: int) -> DataFrame:
    """`points` with each row's weights in so many resamples, a byte each: passes read them instead of
    drawing them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn, number = [], batch.column(0).to_numpy()
            for i in range(0, len(number), step):
                drawn += [w.tobytes() for w in weights(number[i : i + step], resamples).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.binary())], [*batch.schema.names, DRAWN])

    step = max(1, BLOCK // resamples)
    return rows.mapInArrow(run, ", ".join([f"{c} {t}" for c, t in rows.dtypes] + [f"{DRAWN} binary"])).checkpoint()


def _blocks(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of rows, or their stored weights (rows, resamples), and the rows."""
    for batch in batches:
        stored = batch.schema.names[-1] == DRAWN
        x = np.stack([batch.column(i).to_numpy() for i in range(1, batch.num_columns - stored)], 1)
        number, step = batch.column(0).to_numpy(), max(1, BLOCK // max(1, wide))
        if stored and len(x):
            number = np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), np.uint8).reshape(len(x), -1)
        for i in range(0, len(x), step):
            yield number[i : i + step], x[i : i + step]


def _weight(number: np.ndarray, runs: Sequence[Run]) -> np.ndarray:
    """Weights (rows, runs) of the rows in each run's resample."""
    last = max(r.resample for r in runs)
    if number.ndim == 2:
        return np.concatenate((np.ones((len(number), 1), np.uint8), number), 1)[:, [r.resample for r in runs]].astype(float)
    drawn = np.concatenate((np.ones((len(number), 1), np.int64), weights(number, last) if last else np.ones((len(number), 0), np.int64)), 1)
    return drawn[:, [r.resample for r in runs]].astype(float)


def uniform(number: np.ndarray, seeds: np.ndarray, step: int) -> np.ndarray:
    """Numbers above 0 and below 1 (rows, seeds), by a 64-bit mix of key, seed and step."""
    with np.errstate(over="ignore"):
        x = number.astype(np.uint64)[:, None] + (
            (seeds.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95) + np.uint64(step + 1) * np.uint64(0x9E3779B97F4A7C15)
        )
        for multiplier in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(29))) * np.uint64(multiplier)
    return ((x >> np.uint64(11)) + 0.5) / float(1 << 53)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres (any leading dimensions of the latter)."""
    flat = centres.reshape(-1, x.shape[1])
    d = (x * x).sum(1)[:, None] - 2 * x @ flat.T + (flat * flat).sum(1)
    return np.maximum(d, 0).reshape(len(x), *centres.shape[:-1])


def _summed(rows: DataFrame, sums: Callable[[np.ndarray, np.ndarray], dict[int, np.ndarray]], wide: int) -> dict[int, np.ndarray]:
    """Sums by run of what `sums` gives for each block of rows: partial sums of the tasks are added in
    a fixed order, as sums of doubles depend on it."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for number, x in _blocks(batches, wide):
            for run, s in sums(number, x).items():
                total[run] = total.get(run, 0) + s
        if total:
            raw = [t.astype("<f8").tobytes() for t in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(raw, pa.binary())], ["run", "sums"])

    def added(rows: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(r, "<f8") for r in sorted(rows.column("sums").to_pylist()))
        return pa.table({"run": rows.column("run")[:1], "sums": pa.array([s.tobytes()], pa.binary())})

    schema = "run int, sums binary"
    found = rows.mapInArrow(partial, schema).groupBy("run").applyInArrow(added, schema).collect()
    return {r["run"]: np.frombuffer(bytes(r["sums"]), "<f8") for r in found}


def first_centres(rows: DataFrame, runs: Sequence[Run], p: int) -> list[np.ndarray]:
    """k-means++ for all runs at once, in as many passes as the largest has clusters: of each run the
    row with the least exponential draw, at a rate of its weight and squared distance."""
    chosen: list[list[np.ndarray]] = [[] for _ in runs]
    seeds = np.array([r.seed for r in runs])
    for step in range(max(r.k for r in runs)):
        open_ = [i for i, r in enumerate(runs) if r.k > step and len(chosen[i]) == step]
        held = {i: np.array(chosen[i]) for i in open_}

        def nearest(batches: Iterator[pa.RecordBatch], step: int = step, open_: list[int] = open_, held: dict = held) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, np.ndarray]] = {}
            for number, x in _blocks(batches, len(open_) * max(1, step)):
                w, u = _weight(number, [runs[i] for i in open_]), uniform(number, seeds[open_], step)
                for j, i in enumerate(open_):
                    rate = w[:, j] * (_distances(x, held[i]).min(1) if step else 1.0)
                    with np.errstate(divide="ignore"):
                        value = np.where(rate > 0, -np.log(u[:, j]) / rate, np.inf)
                    at = int(value.argmin())
                    if np.isfinite(value[at]) and (i not in best or value[at] < best[i][0]):
                        best[i] = float(value[at]), x[at]
            if best:
                run, found = zip(*best.items())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run, pa.int32()), pa.array([f[0] for f in found]), pa.array([f[1].tolist() for f in found], pa.list_(pa.float64()))],
                    ["run", "value", "x"]
                )

        if open_:
            found = rows.mapInArrow(
                nearest, "run int, value double, x array<double>"
            ).groupBy("run").agg(F.min(F.struct("value", "x"))["x"].alias("x"))
            for r in found.collect():
                chosen[r["run"]].append(np.array(r["x"]))
    # Fewer different rows than clusters: the last one stands for the rest.
    return [np.array([c[min(i, len(c) - 1)] for i in range(r.k)]) if c else np.zeros((r.k, p)) for r, c in zip(runs, chosen)]


def lloyd(rows: DataFrame, runs: Sequence[Run], centres: Sequence[np.ndarray], active: Sequence[int]) -> dict[int, tuple[np.ndarray, float]]:
    """One step of k-means for the active runs: new centres and the cost of the former ones. A cluster
    without rows keeps its centre."""
    p = centres[0].shape[1]
    ends = np.cumsum([0, *[runs[i].k for i in active]])
    stacked = np.concatenate([centres[i] for i in active])

    def sums(number: np.ndarray, x: np.ndarray) -> dict[int, np.ndarray]:
        w, d, at = _weight(number, [runs[i] for i in active]), _distances(x, stacked), np.arange(len(x))
        # Weights at each run's nearest centres: one product sums the rows of all clusters of all runs.
        chosen, cost = np.zeros(d.shape), np.empty(len(active))
        for j in range(len(active)):
            own = ends[j] + d[:, ends[j] : ends[j + 1]].argmin(1)
            chosen[at, own] = w[:, j]
            cost[j] = w[:, j] @ d[at, own]
        total = chosen.T @ np.concatenate((x, np.ones((len(x), 1))), 1)
        return {i: np.concatenate((total[ends[j] : ends[j + 1]].ravel(), cost[j : j + 1])) for j, i in enumerate(active)}

    found = _summed(rows, sums, len(stacked))
    out = {}
    for i in active:
        raw = found[i] if i in found else np.zeros(runs[i].k * (p + 1) + 1)
        t = raw[:-1].reshape(runs[i].k, p + 1)
        n = t[:, p:]
        out[i] = np.where(n > 0, t[:, :p] / np.maximum(n, 1e-300), centres[i]), float(raw[-1])
    return out


def kmeans(rows: DataFrame, runs: Sequence[Run], iterations: int = 300, tol: float = 1e-8) -> list[Clustering]:
    """k-means of all runs over `points`, each until its centres rest."""
    p = len(rows.columns) - 1
    centres = first_centres(rows, runs, p)
    cost, active = [np.inf] * len(runs), list(range(len(runs)))
    if any(r.resample for r in runs):
        rows = _weighed(rows, max(r.resample for r in runs))
    for _ in range(iterations):
        still = []
        for i, (moved, before) in lloyd(rows, runs, centres, active).items():
            if np.abs(moved - centres[i]).max(initial=0) > tol:
                still.append(i)
            centres[i], cost[i] = moved, before
        active = still
        if not active:
            break
    if active:  # the costs of the last centres
        for i, (_, now) in lloyd(rows, runs, centres, active).items():
            cost[i] = now
    return [Clustering(r, c, e) for r, c, e in zip(runs, centres, cost)]


def elbow(df: DataFrame, key: str, columns: Sequence[str], ks: Iterable[int], starts: int = 10) -> tuple[DataFrame, dict[int, Clustering]]:
    """k, cost: the least cost of so many starts for each k, and those clusterings."""
    runs = [Run(k, s) for k in ks for s in range(starts)]
    best: dict[int, Clustering] = {}
    for c in kmeans(points(df, key, columns), runs):
        if c.run.k not in best or c.cost < best[c.run.k].cost:
            best[c.run.k] = c
    return df.sparkSession.createDataFrame([(k, c.cost) for k, c in best.items()], "k int, cost double"), best


def labelled(df: DataFrame, columns: Sequence[str], centres: dict[str, np.ndarray]) -> DataFrame:
    """The rows with the number of the nearest centre under each name; null if a value is unknown."""
    names, kept = list(centres), list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], 1)
            known = np.isfinite(x).all(1)
            found = [pa.array(_distances(np.nan_to_num(x), centres[n]).argmin(1).astype(np.int32), mask=~known) for n in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*kept, *names])

    return df.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + [f"`{n}` int" for n in names]))


def stability(df: DataFrame, key: str, columns: Sequence[str], label: str, k: int, resamples: int = 100, seed: int = 0) -> DataFrame:
    """original, stability: the share, over resamples, of pairs of a cluster's members that were both
    drawn and fall together again. Pairs are counted from counts of (resample, original, new)."""
    runs = [Run(k, seed, b + 1) for b in range(resamples)]
    named = df.where(F.col(label).isNotNull())
    found = kmeans(points(named, key, columns), runs)
    stacked = np.stack([c.centres for c in found])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy() for i in range(2, batch.num_columns)], 1)
            drawn = _weight(batch.column(0).to_numpy(), runs) > 0
            coded = batch.column(1).dictionary_encode()
            group, step = coded.indices.to_numpy(), max(1, BLOCK // (k * resamples))
            for i in range(0, len(x), step):
                own = _distances(x[i : i + step], stacked).argmin(2)
                for g, name in enumerate(coded.dictionary.to_pylist()):
                    mine = (group[i : i + step] == g)[:, None] & drawn[i : i + step]
                    total[name] = total.get(name, 0) + np.stack([(mine & (own == c)).sum(0) for c in range(k)], 1)
        for name, t in total.items():
            b, c = np.nonzero(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(b)), pa.array(b.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(t[b, c])],
                ["original", "resample", "new", "n"]
            )

    known = " AND ".join(["number IS NOT NULL", *[f"x{i} IS NOT NULL AND NOT isnan(x{i})" for i in range(len(columns))]])
    rows = named.select(
        key_number(F.col(key)).alias("number"), F.col(label).cast("string").alias("original"),
        *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    ).where(known)
    cells = rows.mapInArrow(
        counts, "original string, resample int, new int, n long"
    ).groupBy("original", "resample", "new").agg(F.sum("n").alias("n"))
    two = lambda c: c * (c - 1) / 2.0
    each = cells.groupBy("original", "resample").agg(F.sum(two(F.col("n"))).alias("together"), F.sum("n").alias("m"))
    pairs = F.sum(two(F.col("m")))
    out = each.groupBy("original").agg(F.try_divide(F.sum("together"), pairs).alias("stability"))
    kind = dict(df.dtypes)[label]
    return out.select(F.col("original").cast(kind).alias("original"), "stability")


def mixtures(rows: DataFrame, starts: Sequence[Clustering], iterations: int = 100, tol: float = 1e-3) -> list[Mixture]:
    """Gaussian mixtures with full covariances by expectation and maximisation, from the clusters of
    `starts` (over all rows), each until the mean log-likelihood gains less than `tol`."""
    p = len(rows.columns) - 1
    size = lambda k: k * (1 + p + p * p) + 2

    def moments(resp: np.ndarray, x: np.ndarray, like: float) -> np.ndarray:
        second = resp.T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        return np.concatenate((resp.sum(0), (resp.T @ x).ravel(), second.ravel(), [like, len(x)]))

    def maximised(run: Run, t: np.ndarray) -> Mixture:
        k = run.k
        n = np.maximum(t[:k], 1e-10)
        mean = t[k : k + k * p].reshape(k, p) / n[:, None]
        second = t[k + k * p : k + k * p + k * p * p].reshape(k, p, p) / n[:, None, None]
        covariance = second - np.einsum("ci,cj->cij", mean, mean)
        covariance = (covariance + covariance.transpose(0, 2, 1)) / 2 + FLOOR * np.eye(p)
        return Mixture(run, n / n.sum(), mean, covariance, float(t[-2] / max(1.0, t[-1])))

    def first(number: np.ndarray, x: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        for i, s in enumerate(starts):
            own = _distances(x, s.centres).argmin(1)
            out[i] = moments((own[:, None] == np.arange(s.run.k)).astype(float), x, 0.0)
        return out

    wide = sum(size(s.run.k) for s in starts)
    sums = _summed(rows, first, wide)
    found = [maximised(s.run, sums.get(i, np.zeros(size(s.run.k)))) for i, s in enumerate(starts)]
    likelihood, active = [-np.inf] * len(starts), list(range(len(starts)))
    for _ in range(iterations):

        def step(number: np.ndarray, x: np.ndarray, active: list[int] = active) -> dict[int, np.ndarray]:
            out = {}
            for i in active:
                logs = found[i].logs(x)
                top = logs.max(1, keepdims=True)
                each = top[:, 0] + np.log(np.exp(logs - top).sum(1))
                out[i] = moments(np.exp(logs - each[:, None]), x, float(each.sum()))
            return out

        sums, still = _summed(rows, step, wide), []
        for i in active:
            if i not in sums:
                continue
            found[i] = maximised(starts[i].run, sums[i])
            if found[i].likelihood - likelihood[i] >= tol:
                still.append(i)
            likelihood[i] = found[i].likelihood
        active = still
        if not active:
            break
    return found


def mixed(df: DataFrame, columns: Sequence[str], model: Mixture, ambiguous: float = 0.6) -> DataFrame:
    """The rows with the likeliest component, its posterior, and whether that is below `ambiguous`."""
    kept = list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], 1)
            known = np.isfinite(x).all(1)
            logs = model.logs(np.nan_to_num(x))
            share = np.exp(logs - logs.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            top = share.max(1)
            found = [pa.array(v, mask=~known) for v in (share.argmax(1).astype(np.int32), top, top < ambiguous)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*kept, "component", "posterior", "ambiguous"])

    return df.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + ["component int", "posterior double", "ambiguous boolean"]))
