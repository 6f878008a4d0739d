"""Elastic-net paths from Gram matrices: one scan of the rows, whatever the folds and penalties.

A task sums products of the columns by fold; the sums of all tasks, a matrix of columns for each fold,
are all that the driver reads. What a model without a fold would see is the whole less that fold, so
means, scales, coefficients and the errors of left-out rows follow by algebra, for every fold, mixing
ratio and penalty. Coordinate descent runs over all of these at once, from the largest penalty on, each
from the one before.

The target is 1/(2n) RSS + a (l |w|_1 + (1 - l)/2 |w|_2^2) on columns of mean 0 and population SD 1.
Columns may be scaled by the rows of each fold's fit (as a scaler inside a pipeline is) or once by all
rows to learn from (as one before the search is). A constant column keeps coefficient 0."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The published grids.
ALPHAS, RATIOS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0), (0.1, 0.3, 0.5, 0.7, 0.9, 1.0)
PATH_RATIOS, PATH_LENGTH, PATH_SPAN = (0.1, 0.5, 0.7, 0.9, 1.0), 100, 1e-3
#: Rows whose means serve as the origin of the sums: it changes rounding, not results.
ORIGIN_ROWS = 1000


@dataclass
class Moments:
    """Sums by fold of columns (the label last): rows, values and products less the origin."""

    features: list[str]
    origin: np.ndarray
    n: np.ndarray
    first: np.ndarray
    second: np.ndarray

    def without(self, fold: int | None) -> tuple[float, np.ndarray, np.ndarray]:
        """Rows, means (less the origin) and covariances of the rows outside the fold."""
        kept = np.arange(len(self.n)) != (-1 if fold is None else fold)
        n = self.n[kept].sum()
        mean = self.first[kept].sum(0) / max(n, 1)
        return n, mean, self.second[kept].sum(0) / max(n, 1) - np.outer(mean, mean)


@dataclass
class Fit:
    """A chosen penalty with its mean squared error over the folds, and the model of all rows."""

    alpha: float
    ratio: float
    mse: float
    intercept: float
    coefficients: dict[str, float]
    scaled: dict[str, float]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, sum((F.col(f"`{c}`") * b for c, b in self.coefficients.items()), F.lit(self.intercept)))


def moments(df: DataFrame, features: Sequence[str], label: str, fold: str, folds: int) -> Moments:
    """Rows with an unknown feature, label or fold take no part. One scan, and a look at some rows."""
    names = [*features, label]
    rows = df.select(F.col(fold).cast("int").alias("fold"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    rows = rows.where(" AND ".join([f"fold >= 0 AND fold < {folds}", *[f"x{i} IS NOT NULL AND NOT isnan(x{i})" for i in range(len(names))]]))
    some = rows.limit(ORIGIN_ROWS).agg(*[F.avg(f"x{i}") for i in range(len(names))]).first()
    origin, m = np.array([v or 0.0 for v in some]), len(names)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, m + 1, m + 1))
        for batch in batches:
            part = batch.column(0).to_numpy()
            x = np.stack([np.ones(len(part)), *(batch.column(i + 1).to_numpy() - origin[i] for i in range(m))], 1)
            for k in np.unique(part).tolist():
                mine = x[part == k]
                total[k] += mine.T @ mine
        for k in np.flatnonzero(total[:, 0, 0]).tolist():
            i, j = np.triu_indices(m + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[k][i, j])],
                ["fold", "i", "j", "s"]
            )

    out = np.zeros((folds, m + 1, m + 1))
    for r in rows.mapInArrow(sums, "fold int, i int, j int, s double").groupBy("fold", "i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["fold"], r["i"], r["j"]] = out[r["fold"], r["j"], r["i"]] = r["s"]
    return Moments(list(features), origin, out[:, 0, 0], out[:, 0, 1:], out[:, 1:, 1:])


def descend(gram: np.ndarray, target: np.ndarray, alphas: np.ndarray, ratios: np.ndarray, tol: float = 1e-10, sweeps: int = 10_000) -> np.ndarray:
    """Coefficients (problems, alphas, features) for Gram matrices and targets of many problems at
    once: alphas (problems, steps), from the largest on, and a ratio for each problem."""
    problems, p = target.shape
    w, out = np.zeros((problems, p)), np.zeros((*alphas.shape, p))
    size = np.einsum("bjj->bj", gram)
    for step in range(alphas.shape[1]):
        soft, ridge = alphas[:, step] * ratios, alphas[:, step] * (1 - ratios)
        for _ in range(sweeps):
            moved = 0.0
            for j in range(p):
                rest = target[:, j] - np.einsum("bi,bi->b", gram[:, j], w) + size[:, j] * w[:, j]
                new = np.sign(rest) * np.maximum(np.abs(rest) - soft, 0)
                new = np.divide(new, size[:, j] + ridge, out=np.zeros(problems), where=size[:, j] > 0)
                moved = max(moved, float(np.abs(new - w[:, j]).max()))
                w[:, j] = new
            if moved <= tol * max(1.0, float(np.abs(w).max())):
                break
        out[:, step] = w
    return out


def _scaled(m: Moments, fold: int | None, by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram matrix and target of the scaled columns outside the fold, and the scales."""
    _, _, c = m.without(fold)
    sd = np.sqrt(np.maximum(np.diag(c)[:-1], 0)) if by is None else by
    sd = np.where(sd > 1e-12 * (1 + np.abs(m.origin[:-1])), sd, np.inf)
    return c[:-1, :-1] / np.outer(sd, sd), c[:-1, -1] / sd, sd


def search(
    m: Moments, alphas: Sequence[float] | None = ALPHAS, ratios: Sequence[float] = RATIOS, scale_in_folds: bool = True
) -> tuple[Fit, list[tuple[float, float, float]]]:
    """The penalty with the least mean squared error over the folds, and (alpha, ratio, mse) of all.
    Without alphas, each ratio has a path of PATH_LENGTH from the penalty that leaves no coefficient."""
    known = [k for k in range(len(m.n)) if m.n[k] > 0 and m.n.sum() > m.n[k]]
    gram, target, sd = _scaled(m, None)
    paths = []
    for ratio in ratios:
        top = float(np.abs(target).max(initial=0)) / ratio or 1.0
        paths.append(np.array(sorted(alphas, reverse=True)) if alphas else top * PATH_SPAN ** (np.arange(PATH_LENGTH) / (PATH_LENGTH - 1)))
    steps = np.array(paths)
    by = None if scale_in_folds else sd
    fits = [_scaled(m, k, by) for k in known]
    problems = [(i, r) for i in range(len(known)) for r in range(len(ratios))]
    mse = np.zeros(steps.shape)
    if problems:
        w = descend(
            np.array([fits[i][0] for i, _ in problems]), np.array([fits[i][1] for i, _ in problems]),
            np.array([steps[r] for _, r in problems]), np.array([ratios[r] for _, r in problems])
        )
        for (i, r), path in zip(problems, w):
            k = known[i]
            _, mean, _ = m.without(k)
            for s, b in enumerate(path / fits[i][2]):
                # The left-out rows' squared errors, from their sums: y - b x - c for each.
                z, c = np.append(-b, 1.0), mean[-1] - b @ mean[:-1]
                mse[r, s] += (z @ m.second[k] @ z - 2 * c * z @ m.first[k] + c * c * m.n[k]) / m.n[k] / len(known)
    order = [(float(mse[r, s]), r, s) for r in range(len(ratios)) for s in range(steps.shape[1])]
    error, r, s = min(order)
    (whole,) = descend(gram[None], target[None], steps[r][None, : s + 1], np.array([ratios[r]]))
    b = whole[-1] / sd
    _, mean, _ = m.without(None)
    place = m.origin + mean
    fit = Fit(
        float(steps[r, s]), float(ratios[r]), error, float(place[-1] - b @ place[:-1]), dict(zip(m.features, b.tolist())),
        dict(zip(m.features, whole[-1].tolist()))
    )
    return fit, [(float(steps[i, j]), float(ratios[i]), e) for e, i, j in order]


def least_squares(m: Moments, fold: int | None, others: bool = True) -> tuple[float, np.ndarray]:
    """Intercept and coefficients by least squares (of least norm where columns depend on each other),
    learned from the rows outside the fold, or from the fold alone."""
    kept = np.arange(len(m.n)) != (-1 if fold is None else fold)
    kept = kept if others else ~kept
    n = max(m.n[kept].sum(), 1)
    mean = m.first[kept].sum(0) / n
    c = m.second[kept].sum(0) / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(c)[:-1], 0))
    sd = np.where(sd > 1e-12 * (1 + np.abs(m.origin[:-1])), sd, np.inf)
    b = np.linalg.lstsq(c[:-1, :-1] / np.outer(sd, sd), c[:-1, -1] / sd, rcond=1e-10)[0] / sd
    place = m.origin + mean
    return float(place[-1] - b @ place[:-1]), b


def fold_predictions(
    df: DataFrame, key: str, features: Sequence[str], label: str, fold: str, folds: int = 5, reverse: bool = False,
    solve: Callable[[Moments, int, bool], tuple[float, np.ndarray]] = least_squares
) -> DataFrame:
    """run, key, actual, predicted: every fold by a model of the others or, in reverse, every other
    fold by a model of one. Models come from the sums of the folds (`solve`), so rows are scanned once
    for all of them, and once to be predicted."""
    m = moments(df, features, label, fold, folds)
    models = {k: solve(m, k, not reverse) for k in range(folds) if m.n[k] > 0 and m.n.sum() > m.n[k]}
    guess = lambda c, b: sum((F.col(f"`{f}`") * float(w) for f, w in zip(features, b)), F.lit(float(c)))
    asked = lambda k: (F.col(fold) != k) if reverse else (F.col(fold) == k)
    runs = F.array(*[F.when(asked(k), F.struct(F.lit(k).cast("long").alias("run"), guess(*v).alias("predicted"))) for k, v in models.items()])
    known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*features, label)))
    if not models:
        runs = F.expr("CAST(array() AS array<struct<run: bigint, predicted: double>>)")
    out = known.select(F.col(key), F.col(label).cast("double").alias("actual"), F.inline(F.filter(runs, lambda r: r.isNotNull())))
    return out.select("run", key, "actual", "predicted")
