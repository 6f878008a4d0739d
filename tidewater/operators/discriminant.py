"""Linear classifiers whose fits share their passes: elastic-net logistic models of many classes, folds
and penalties, and partial least squares by its number of components.

Logistic models are fitted by proximal Newton steps. One pass gives the gradients and Hessians of all
models by two matrix products over a block of rows; the driver reads sums of columns, not rows, and
solves the steps by coordinate descent. A step that does not lower its model's objective is halved.
Partial least squares needs no pass of its own: its components are in the span of powers of the Gram
matrix (`paths.Moments`).

Settings are chosen by the average precision of left-out rows. Scores of all models are counted by bin
in one more pass, so no row is copied for a model; scores of one bin count as tied."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewater.operators.batched import BLOCK
from tidewater.operators.paths import Moments, moments

# The published strengths and mixing ratios.
STRENGTHS, RATIOS = tuple(10.0 ** (-4 + 8 * i / 9) for i in range(10)), (0.1, 0.5, 0.7, 0.9, 1.0)
#: Bins of scores, and the scores beyond which they count as the last bin's.
BINS, LOGIT_ENDS, SCORE_ENDS = 4096, (-20.0, 20.0), (-2.0, 3.0)
MOST_COMPONENTS = 11


@dataclass(frozen=True)
class Problem:
    """A model: which class against the rest, without which fold, at which penalty (strength C of the
    sum of losses, and mixing ratio; none for a plain model)."""

    label: int
    fold: int | None
    strength: float | None = None
    ratio: float = 0.0


@dataclass
class Linear:
    """A chosen model: intercept and coefficients of the columns as they are."""

    intercept: float
    coefficients: dict[str, float]
    problem: Problem | None
    score: float

    def margin(self) -> F.Column:
        return sum((F.col(f"`{c}`") * b for c, b in self.coefficients.items()), F.lit(self.intercept))

    def probability(self) -> F.Column:
        return 1 / (1 + F.exp(-self.margin()))


def _blocks(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """label, fold and columns of blocks of rows."""
    for batch in batches:
        x = np.stack([batch.column(i).to_numpy() for i in range(2, batch.num_columns)], 1)
        label, fold, step = batch.column(0).to_numpy(), batch.column(1).to_numpy(), max(1, BLOCK // max(1, wide))
        for i in range(0, len(x), step):
            yield label[i : i + step], fold[i : i + step], x[i : i + step]


def _rows(df: DataFrame, features: Sequence[str], label: str, fold: str) -> DataFrame:
    """label, fold and columns of the rows that are known in full, kept while passes read them."""
    rows = df.select(
        F.col(label).cast("int").alias("label"), F.col(fold).cast("int").alias("fold"),
        *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    )
    return rows.where(
        " AND ".join(["label IS NOT NULL AND fold IS NOT NULL", *[f"x{i} IS NOT NULL AND NOT isnan(x{i})" for i in range(len(features))]])
    ).checkpoint()


def _kept(fold: np.ndarray, folds: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each row (rows, models) is left out by the model's fold, or is not. Folds: -1 for none."""
    return (fold[:, None] == folds) == inside


def _added(name: str) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(r, "<f8") for r in sorted(rows.column("sums").to_pylist()))
        return pa.table({name: rows.column(name)[:1], "sums": pa.array([s.tobytes()], pa.binary())})

    return run


def average_precision(positive: np.ndarray, negative: np.ndarray) -> float | None:
    """From counts by score, lowest first: precision at each score times the recall it adds."""
    tp, fp = np.cumsum(positive[::-1]), np.cumsum(negative[::-1])
    if not len(tp) or not tp[-1] or not fp[-1]:
        return None
    return float((tp / np.maximum(tp + fp, 1) * positive[::-1]).sum() / tp[-1])


def left_out_precision(
    rows: DataFrame, problems: Sequence[Problem], score: Callable[[np.ndarray], np.ndarray], ends: tuple[float, float]
) -> list[float | None]:
    """Each model's average precision over the rows of its fold; score: columns to (rows, models)."""
    labels, folds = np.array([p.label for p in problems]), np.array([-1 if p.fold is None else p.fold for p in problems])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(problems), 2, BINS))
        for label, fold, x in _blocks(batches, len(problems)):
            at = np.clip((score(x) - ends[0]) / (ends[1] - ends[0]) * BINS, 0, BINS - 1).astype(np.int64)
            row, model = np.nonzero(_kept(fold, folds, True))
            place = (model * 2 + (label[row] != labels[model])) * BINS + at[row, model]
            total += np.bincount(place, minlength=total.size).reshape(total.shape)
        some = np.flatnonzero(total.any((1, 2)))
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([total[i].tobytes() for i in some], pa.binary())], ["model", "sums"]
            )

    def scored(table: pa.Table) -> pa.Table:
        pos, neg = np.frombuffer(_added("model")(table).column("sums")[0].as_py(), "<f8").reshape(2, BINS)
        return pa.table({"model": table.column("model")[:1], "score": pa.array([average_precision(pos, neg)], pa.float64())})

    found = rows.mapInArrow(counts, "model int, sums binary").groupBy("model").applyInArrow(scored, "model int, score double").collect()
    known = {r["model"]: r["score"] for r in found}
    return [known.get(i) for i in range(len(problems))]


def _descend(h: np.ndarray, g: np.ndarray, w: np.ndarray, soft: np.ndarray, ridge: np.ndarray, sweeps: int = 500) -> np.ndarray:
    """Coefficients that minimise g d + d h d / 2 + penalties of w + d (models, columns), d = new - w;
    the last column is the intercept, which has no penalty."""
    p, new = w.shape[1], w.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in range(p):
            size = h[:, j, j]
            # What is left for column j, the others' steps taken; the ridge pulls on the whole coefficient.
            rest = size * new[:, j] - g[:, j] - np.einsum("bi,bi->b", h[:, j], new - w)
            value = rest if j == p - 1 else np.sign(rest) * np.maximum(np.abs(rest) - soft, 0)
            under = size + (0.0 if j == p - 1 else ridge)
            value = np.divide(value, under, out=np.zeros_like(value), where=size > 1e-14)
            moved = max(moved, float(np.abs(value - new[:, j]).max(initial=0)))
            new[:, j] = value
        if moved < 1e-10:
            break
    return new


def fit_logistic(rows: DataFrame, problems: Sequence[Problem], mean: np.ndarray, sd: np.ndarray, steps: int = 60, tol: float = 1e-7) -> np.ndarray:
    """Coefficients of the scaled columns and, last, the intercept, for every model. The objective is
    the mean log loss plus (l1 |w| + (1 - l1)/2 w^2) / (C n), w without the intercept."""
    p = len(mean)
    labels, folds = np.array([q.label for q in problems]), np.array([-1 if q.fold is None else q.fold for q in problems])
    up = np.triu_indices(p + 1)
    size = 2 + p + 1 + len(up[0])

    def run_pass(w: np.ndarray, active: np.ndarray) -> dict[int, np.ndarray]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(active), size))
            for label, fold, x in _blocks(batches, len(active) + len(up[0])):
                z = np.concatenate(((x - mean) / sd, np.ones((len(x), 1))), 1)
                margin = z @ w[active].T
                kept, y = _kept(fold, folds[active], False), label[:, None] == labels[active]
                prob = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                loss = np.logaddexp(0, np.where(y, -margin, margin))
                total[:, 0] += kept.sum(0)
                total[:, 1] += (loss * kept).sum(0)
                total[:, 2 : p + 3] += ((prob - y) * kept).T @ z
                total[:, p + 3 :] += (prob * (1 - prob) * kept).T @ (z[:, up[0]] * z[:, up[1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(active), dtype=np.int32)), pa.array([t.tobytes() for t in total], pa.binary())],
                ["model", "sums"]
            )

        found = rows.mapInArrow(sums, "model int, sums binary").groupBy("model").applyInArrow(_added("model"), "model int, sums binary").collect()
        return {int(active[r["model"]]): np.frombuffer(bytes(r["sums"]), "<f8") for r in found}

    w, held = np.zeros((len(problems), p + 1)), np.zeros((len(problems), p + 1))
    goal, step = np.full(len(problems), np.inf), np.zeros((len(problems), p + 1))
    active = np.arange(len(problems))
    l1 = np.array([q.ratio if q.strength else 0.0 for q in problems])
    inverse = np.array([1 / q.strength if q.strength else 0.0 for q in problems])
    for _ in range(steps):
        sums, still = run_pass(w, active), []
        ready = []
        for i in active.tolist():
            t = sums.get(i)
            if t is None or not t[0]:
                continue
            n = t[0]
            penalty = inverse[i] / n * (l1[i] * np.abs(w[i, :-1]).sum() + (1 - l1[i]) / 2 * (w[i, :-1] ** 2).sum())
            now = t[1] / n + penalty
            if now > goal[i] + 1e-12:  # not lower: half of the way
                step[i] /= 2
                w[i] = held[i] + step[i]
                if np.abs(step[i]).max() > tol:
                    still.append(i)
                else:
                    w[i] = held[i]
                continue
            goal[i], held[i] = now, w[i]
            ready.append(i)
        if ready:
            t = np.stack([sums[i] for i in ready])
            n, h = t[:, 0], np.zeros((len(ready), p + 1, p + 1))
            h[:, up[0], up[1]] = h[:, up[1], up[0]] = t[:, p + 3 :] / n[:, None]
            h += 1e-9 * np.eye(p + 1)
            at = np.array(ready)
            new = _descend(h, t[:, 2 : p + 3] / n[:, None], held[at], inverse[at] * l1[at] / n, inverse[at] * (1 - l1[at]) / n)
            for i, moved in zip(ready, new):
                step[i] = moved - held[i]
                w[i] = moved
                if np.abs(step[i]).max() > tol:
                    still.append(i)
        active = np.array(sorted(still), np.int64)
        if not len(active):
            break
    if len(active):
        w[active] = held[active]
    return w


def logistic(
    df: DataFrame, features: Sequence[str], label: str, labels: Sequence[int], fold: str, folds: int = 5, strengths: Sequence[float] | None = STRENGTHS, ratios: Sequence[float] = RATIOS
) -> dict[int, Linear]:
    """For every listed label a model of it against all others, at the penalty with the best mean
    average precision over the folds (ties: the stronger penalty); without strengths, plain models."""
    rows = _rows(df, features, label, fold)
    known = rows.agg(*[f(f"x{i}") for i in range(len(features)) for f in (F.avg, F.stddev_pop)]).first()
    mean, sd = (np.array([known[2 * i + k] or 0.0 for i in range(len(features))]) for k in (0, 1))
    sd = np.where(sd > 1e-12 * (1 + np.abs(mean)), sd, np.inf)
    grid = [(c, r) for c in sorted(strengths) for r in ratios] if strengths else [(None, 0.0)]
    problems = [Problem(y, k, c, r) for y in labels for c, r in grid for k in (None, *range(folds))]
    w = fit_logistic(rows, problems, mean, sd)
    score = left_out_precision(rows, problems, lambda x: ((x - mean) / sd) @ w[:, :-1].T + w[:, -1], LOGIT_ENDS)
    out = {}
    for y in labels:
        best = None
        for c, r in grid:
            found = [s for q, s in zip(problems, score) if (q.label, q.strength, q.ratio) == (y, c, r) and q.fold is not None and s is not None]
            value = float(np.mean(found)) if found else -np.inf
            if best is None or value > best[0]:
                best = value, problems.index(Problem(y, None, c, r))
        b = w[best[1], :-1] / sd
        out[y] = Linear(float(w[best[1], -1] - b @ mean), dict(zip(features, b.tolist())), problems[best[1]], best[0])
    return out


def pls_coefficients(gram: np.ndarray, target: np.ndarray, most: int) -> np.ndarray:
    """Coefficients (components, columns) of partial least squares of one label, from the covariances
    of the columns and theirs with the label: directions without correlation, one after another."""
    p, s = len(target), target.copy()
    basis, b, out = np.zeros((p, 0)), np.zeros(p), []
    floor = 1e-12 * max(1e-300, float(np.abs(target).max(initial=0)))
    for _ in range(most):
        size = s @ gram @ s
        if np.abs(s).max(initial=0) > floor and size > 0:
            r = s / np.sqrt(size)
            load = gram @ r
            b = b + r * (r @ target)
            v = load - basis @ (basis.T @ load)
            v /= np.linalg.norm(v)
            basis = np.column_stack((basis, v))
            s = s - v * (v @ s)
        out.append(b)
    return np.array(out).reshape(most, p)


def partial_least_squares(
    df: DataFrame, features: Sequence[str], label: str, fold: str, folds: int = 5, most: int = MOST_COMPONENTS
) -> tuple[Linear, list[float]]:
    """The model of a 0/1 label with the number of components (up to `most`, and the columns) whose mean
    average precision over the folds is best, and that of each number. Columns are scaled by all rows
    to learn from; a score of 0.5 or more is a positive."""
    rows = _rows(df, features, label, fold)
    m = moments(df, features, label, fold, folds)
    most = min(most, len(features))

    def fitted(k: int | None) -> tuple[np.ndarray, np.ndarray]:
        _, at, c = m.without(k)
        b = pls_coefficients(c[:-1, :-1] / np.outer(sd, sd), c[:-1, -1] / sd, most) / sd
        place = m.origin + at
        return b, place[-1] - b @ place[:-1]

    sd = scales(m)
    known = [k for k in range(folds) if m.n[k] > 0]
    each = [fitted(k) for k in known]
    problems = [Problem(1, k, a) for k in known for a in range(1, most + 1)]
    found: list[float] = []
    if problems:
        b, c = np.concatenate([e[0] for e in each]), np.concatenate([e[1] for e in each])
        score = left_out_precision(rows, problems, lambda x: x @ b.T + c, SCORE_ENDS)
        for a in range(1, most + 1):
            some = [s for q, s in zip(problems, score) if q.strength == a and s is not None]
            found.append(float(np.mean(some)) if some else -np.inf)
    best = int(np.argmax(found)) if found else 0
    b, c = fitted(None)
    return Linear(float(c[best]), dict(zip(features, b[best].tolist())), Problem(1, None, best + 1), found[best] if found else -np.inf), found


def scales(m: Moments) -> np.ndarray:
    _, _, c = m.without(None)
    sd = np.sqrt(np.maximum(np.diag(c)[:-1], 0))
    return np.where(sd > 1e-12 * (1 + np.abs(m.origin[:-1])), sd, np.inf)
