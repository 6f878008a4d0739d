"""Second-order boosted trees from histograms, many settings and folds in the same passes.

Features become codes of quantile bins once. Trees grow level by level: every task sums gradients and
Hessians of its rows by (run, node, feature, bin), the sums of a node meet in one task, which finds the
best cut, and only cuts reach the driver. A run is a setting and the fold that it leaves out; all runs
of a grid share every pass over the rows, so a grid costs as many passes as its deepest setting has
levels, times rounds. Rows keep the margins of all runs in a stored table, renewed every RENEWED
rounds; trees since then are applied while rows are read, so a lost executor costs its part only.

A node's gain is GL^2 / (HL + penalty) + GR^2 / (HR + penalty) - G^2 / (H + penalty), a leaf's value
-rate G / (H + penalty). Rows are drawn by tree from a hash of their key, columns by tree from a seed,
alike for all runs with the same shares. Unknown values have a bin of their own, and each cut sends
them to the side that gains more. Equal gains take the first feature and the lowest cut."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewater.functions.numeric import finite
from tidewater.functions.trees import Leaf
from tidewater.operators.discriminant import BINS, LOGIT_ENDS, average_precision
from tidewater.operators.statistics import once, running
from tidewater.sources.shared import temporary

#: Code of an unknown value, and rounds after which margins are stored anew.
UNKNOWN, RENEWED = 255, 10
#: Sums of gradients and Hessians that a task holds at once: more runs take several passes a level.
CELLS = 8_000_000
#: Rows, each with the margins of all runs, that a task computes and hands on at once.
STEP = 2048
# The published grids of the regressors.
GRID = {"rounds": (100, 200, 300), "depth": (3, 5, 7), "rate": (0.01, 0.05, 0.1), "rows": (0.7, 1.0), "columns": (0.7, 1.0)}
ATTRIBUTION_GRID = {"rounds": (100, 300, 500), "depth": (3, 4, 5), "rate": (0.01, 0.05, 0.1), "rows": (0.8, 1.0), "columns": (0.8, 1.0)}
SMALL_GRID = {"rounds": (100, 200), "depth": (2, 3, 4), "rate": (0.03, 0.1), "rows": (1.0,), "columns": (1.0,)}


@dataclass(frozen=True)
class Setting:
    depth: int = 6
    rate: float = 0.3
    rows: float = 1.0
    columns: float = 1.0


@dataclass
class Trees:
    """One tree for each run, nodes in heap order: the children of i are 2 i + 1 and 2 i + 2. A node
    whose feature is negative is a leaf; every node has the value that it would have as a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    unknown_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, runs: int, depth: int) -> Trees:
        shape = (runs, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape, bool), *(np.zeros(shape) for _ in range(3)))

    def nodes(self, run: int, codes: np.ndarray) -> np.ndarray:
        """The node at which each row ends in the run's tree."""
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        feature, cut, left = self.feature[run], self.cut[run], self.unknown_left[run]
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return at
            code = codes[rows, np.maximum(feature[at], 0)]
            goes_left = np.where(code == UNKNOWN, left[at], code <= cut[at])
            at = np.where(inner, 2 * at + 2 - goes_left, at)


@dataclass
class Boosted:
    """The trees of all runs, round by round, and what is needed to apply them."""

    features: list[str]
    edges: list[np.ndarray]
    settings: list[Setting]
    folds: list[int | None]
    base: np.ndarray
    loss: str
    rounds: list[Trees] = field(default_factory=list)

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.where(np.isfinite(x[:, j]), np.searchsorted(edges, x[:, j]), UNKNOWN)
        return out

    def margins(self, codes: np.ndarray, run: int, rounds: int) -> np.ndarray:
        out = np.full(len(codes), self.base[run])
        for trees in self.rounds[:rounds]:
            out += trees.value[run][trees.nodes(run, codes)]
        return out

    def leaves(self, run: int, rounds: int) -> list[Leaf]:
        """The run's leaves for Shapley attributions of known values."""
        out = []
        for trees in self.rounds[:rounds]:
            todo = [(0, {})]
            while todo:
                node, path = todo.pop()
                f = int(trees.feature[run, node])
                if f < 0:
                    at = sorted(path)
                    out.append(Leaf(float(trees.value[run, node]), tuple(at), *(tuple(path[i][k] for i in at) for k in range(3))))
                    continue
                cut, (low, high, share) = float(self.edges[f][trees.cut[run, node]]), path.get(f, (-np.inf, np.inf, 1.0))
                for child in (2 * node + 1, 2 * node + 2):
                    went = share * trees.cover[run, child] / trees.cover[run, node]
                    todo.append((child, path | {f: (low, min(high, cut), went) if child % 2 else (max(low, cut), high, went)}))
        return out

    def importances(self, run: int, rounds: int) -> dict[str, float]:
        """Each feature's mean gain of a cut, as a share of the sum over features."""
        feature = np.concatenate([t.feature[run] for t in self.rounds[:rounds]])
        gain = np.concatenate([t.gain[run] for t in self.rounds[:rounds]])
        mean = np.array([gain[feature == j].mean() if (feature == j).any() else 0.0 for j in range(len(self.features))])
        return dict(zip(self.features, (mean / (mean.sum() or 1.0)).tolist()))


def grid(options: dict[str, Sequence[float]]) -> tuple[list[Setting], list[int]]:
    """The settings of a grid, and the rounds after which each is scored: fewer rounds are a part of
    the same run."""
    names = ("depth", "rate", "rows", "columns")
    return [Setting(*values) for values in product(*(options[n] for n in names))], sorted(options["rounds"])


def drawn(ids: np.ndarray, round_: int, seed: int) -> np.ndarray:
    """A number in [0, 1) for each key and round, by a 64-bit mix."""
    with np.errstate(over="ignore"):
        x = ids.view(np.uint64) + np.uint64((round_ + 1) * 0x9E3779B97F4A7C15 + seed & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _slope(loss: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if loss == "squared":
        return margin - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-margin))
    return p - y, np.maximum(p * (1 - p), 1e-16)


def _fixed(column: pa.Array, kind: type, wide: int) -> np.ndarray:
    """A binary column of rows of so many numbers, read in place."""
    large = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    first = int(np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset]) if len(column) else 0
    return np.frombuffer(data or b"", kind, len(column) * wide, first).reshape(len(column), wide)


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of numbers as a binary column, without an object for each."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.strides[0])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of STEP rows at most, so that what a task holds does not follow the table."""
    for batch in batches:
        for i in range(0, batch.num_rows, STEP):
            yield batch.slice(i, STEP)


def _rows(batch: pa.RecordBatch, runs: int, features: int) -> tuple[np.ndarray, ...]:
    plain = (batch.column(c).to_numpy() for c in ("id", "y", "fold"))
    return *plain, _fixed(batch.column("codes"), np.uint8, features), _fixed(batch.column("f"), np.float64, runs)


def _moved(f: np.ndarray, codes: np.ndarray, since: list[Trees]) -> np.ndarray:
    f = f.copy()
    for trees in since:
        for run in range(f.shape[1]):
            f[:, run] += trees.value[run][trees.nodes(run, codes)]
    return f


def _pass(model: Boosted, since: list[Trees], partial: Trees, runs: Sequence[int], level: int, round_: int, seed: int, bins: int):  # noqa: ANN202
    """Sums of one level: a row for each run and node of the level that the task has rows of."""
    p, first = len(model.features), 2**level - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in _slices(batches):
            ids, y, fold, codes, f = _rows(batch, len(model.settings), p)
            u, slots = drawn(ids, round_, seed), np.minimum(codes, bins).astype(np.int64) + np.arange(p) * (bins + 1)
            for r in runs:
                at = partial.nodes(r, codes) - first
                keep = np.flatnonzero((at >= 0) & (u < model.settings[r].rows) & (fold != (-1 if model.folds[r] is None else model.folds[r])))
                margin = f[keep, r]
                for trees in since:
                    margin = margin + trees.value[r][trees.nodes(r, codes[keep])]
                g, h = _slope(model.loss, margin, y[keep])
                cells = (at[keep, None] * (p * (bins + 1)) + slots[keep]).ravel()
                size = 2**level * p * (bins + 1)
                both = np.stack([np.bincount(cells, np.repeat(w, p), size) for w in (g, h)])
                sums[r] = sums.get(r, 0) + both
        rows = []
        for r, both in sums.items():
            table = both.reshape(2, 2**level, p, bins + 1)
            for node in np.flatnonzero(table[1].any((1, 2))).tolist():
                rows.append((r, node + first, table[:, node].tobytes()))
        if rows:
            run_, node, raw = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(run_, pa.int32()), pa.array(node, pa.int32()), pa.array(raw, pa.binary())], ["run", "node", "sums"]
            )

    return run


def _best(columns: np.ndarray, bins: int, penalty: float, least: float):  # noqa: ANN202
    """The best cut of a node, from the sums of all tasks; columns: which features a run may use."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        r, node = (k.as_py() for k in key)
        p = columns.shape[1]
        # In a fixed order, as sums of doubles depend on it.
        sums = sum(np.frombuffer(raw, np.float64).reshape(2, p, bins + 1) for raw in sorted(rows.column("sums").to_pylist()))
        total = sums[:, 0].sum(1)
        score = lambda g, h: g * g / (h + penalty)
        known, unknown = np.cumsum(sums[:, :, :bins], 2), sums[:, :, bins:]
        best = (0.0, -1, 0, False, 0.0, 0.0)
        for unknown_left in (False, True):
            left = known + unknown if unknown_left else known
            right = total[:, None, None] - left
            gain = score(*left) + score(*right) - score(*total)
            gain[(left[1] < least) | (right[1] < least) | ~columns[r][:, None]] = -np.inf
            gain[:, -1] = -np.inf
            f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, cut] > best[0]:
                best = (float(gain[f, cut]), int(f), int(cut), unknown_left, float(left[0, f, cut]), float(left[1, f, cut]))
        return pa.Table.from_pylist(
            [
                dict(
                    run=r, node=node, gain=best[0], feature=best[1], cut=best[2], unknown_left=best[3], gl=best[4], hl=best[5],
                    g=float(total[0]), h=float(total[1])
                )
            ],
            _CUT,
        )

    return run


_CUT = pa.schema(
    [("run", pa.int32()), ("node", pa.int32()), ("gain", pa.float64()), ("feature", pa.int32()), ("cut", pa.int32()), ("unknown_left", pa.bool_())]
    + [(c, pa.float64()) for c in ("gl", "hl", "g", "h")]
)
_CUT_SQL = "run int, node int, gain double, feature int, cut int, unknown_left boolean, gl double, hl double, g double, h double"


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """The upper ends of each feature's quantile bins but the last, each the least value at which that
    share of the known values is reached. They are exact whatever the number of rows, from counts by
    value whose running sums are taken in ranges; fewer than `bins` values a feature are fetched."""
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), finite(F.col(f"`{c}`")).alias("x")) for i, c in enumerate(features)])
    counts = once(df.select(F.inline(cells)).where("x IS NOT NULL").groupBy("feature", "x").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    placed = running(counts, ["feature"], "x", "n").join(sizes, "feature")
    # The first and the last end that a value reaches, of those that no lesser one does.
    ends = placed.withColumns({"_first": F.expr(f"below_n * {bins} div total + 1"), "_last": F.expr(f"least((below_n + n) * {bins} div total, {bins - 1})")})
    found = [[] for _ in features]
    for r in ends.where("_first <= _last").select("feature", "x").collect():
        found[r["feature"]].append(r["x"])
    return [np.unique(np.array(x, float)) for x in found]


def boost(
    df: DataFrame, key: str, features: Sequence[str], label: str, settings: Sequence[Setting], rounds: int, folds: int = 0, fold: str | None = None,
    loss: str = "squared", bins: int = 64, penalty: float = 1.0, least: float = 1.0, seed: int = 0, score_at: Sequence[int] = (),
) -> tuple[Boosted, DataFrame | None]:
    """The trees of every setting, for all rows and, given a column of folds from 0 on, without each
    of them; and, after the rounds in `score_at`, what the left-out rows sum up to: run, rounds, n,
    error (squares), y, yy, and the average precision of a logistic loss. loss: squared, or logistic for a 0/1 label."""
    if bins >= UNKNOWN:
        raise ValueError(f"at most {UNKNOWN - 1} bins")
    runs = [(s, k) for s in settings for k in (None, *range(folds))]
    of_fold = F.col(fold).cast("int") if fold else F.lit(-2)
    rows = df.select(
        F.xxhash64(key).alias("id"), F.col(label).cast("double").alias("y"), of_fold.alias("fold"),
        *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    )
    rows = rows.where("y IS NOT NULL AND NOT isnan(y)")
    edges = quantile_edges(rows, [f"x{i}" for i in range(len(features))], bins)
    sums = {r["fold"]: (r["n"], r["y"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()}
    mean = []
    for _, k in runs:
        n, y = (sum(v[i] for f, v in sums.items() if k is None or f != k) for i in (0, 1))
        mean.append(y / n if n else 0.0)
    base = np.array(mean)
    if loss == "logistic":
        at = np.clip(base, 1e-6, 1 - 1e-6)
        base = np.log(at / (1 - at))
    model = Boosted(list(features), edges, [s for s, _ in runs], [k for _, k in runs], base, loss)
    deepest, p = max(s.depth for s in settings), len(features)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = np.stack([batch.column(3 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(p)], 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), _binary(model.codes(x)), _binary(np.tile(base, (len(x), 1)))],
                ["id", "y", "fold", "codes", "f"]
            )

    schema = "id long, y double, fold int, codes binary, f binary"
    with temporary(df.sparkSession) as store:
        state, since, scores = store(rows.mapInArrow(coded, schema)), [], []
        for t in range(rounds):
            partial = Trees.empty(len(runs), deepest)
            columns = np.zeros((len(runs), p), bool)
            for share in {s.columns for s in settings}:
                chosen = np.random.default_rng([seed, t]).permutation(p)[: max(1, int(share * p))]
                for r in [r for r, (s, _) in enumerate(runs) if s.columns == share]:
                    columns[r, chosen] = True
            open_ = list(range(len(runs)))
            for level in range(deepest):
                growing = [r for r in open_ if runs[r][0].depth > level]
                at_once = max(1, CELLS // (2**level * p * (bins + 1) * 2))
                open_ = []
                for i in range(0, len(growing), at_once):
                    found = _cuts(state, model, since, partial, growing[i : i + at_once], level, t, seed, bins, columns, penalty, least)
                    open_ += sorted({c["run"] for c in found if c["feature"] >= 0})
                    _grow(partial, found, runs, penalty)
                if not open_:
                    break
            model.rounds.append(partial)
            since = [*since, partial]
            if len(since) == RENEWED or t + 1 in score_at:
                state, since = store(state.mapInArrow(_renew(len(runs), p, since), schema)), []
            if t + 1 in score_at:
                scores += _left_out(state, model, t + 1)
        sums_schema = "run int, rounds int, n long, error double, y double, yy double, precision double"
        return model, df.sparkSession.createDataFrame(scores, sums_schema) if score_at else None


def _cuts(state, model, since, partial, growing, level, t, seed, bins, columns, penalty, least):  # noqa: ANN001, ANN202
    each = state.mapInArrow(_pass(model, since, partial, growing, level, t, seed, bins), "run int, node int, sums binary")
    return each.groupBy("run", "node").applyInArrow(_best(columns, bins, penalty, least), _CUT_SQL).collect()


def _grow(partial: Trees, found: list, runs: list, penalty: float) -> None:
    for c in found:
        r, node, rate = c["run"], c["node"], runs[c["run"]][0].rate
        if node == 0:
            partial.value[r, 0], partial.cover[r, 0] = -rate * c["g"] / (c["h"] + penalty), c["h"]
        if c["feature"] < 0:
            continue
        partial.feature[r, node], partial.cut[r, node], partial.unknown_left[r, node], partial.gain[r, node] = c["feature"], c["cut"], c["unknown_left"], c["gain"]
        for child, g, h in ((2 * node + 1, c["gl"], c["hl"]), (2 * node + 2, c["g"] - c["gl"], c["h"] - c["hl"])):
            partial.value[r, child], partial.cover[r, child] = -rate * g / (h + penalty), h


def _renew(runs: int, p: int, since: list[Trees]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            *_, codes, f = _rows(batch, runs, p)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), _binary(_moved(f, codes, since))], batch.schema.names)

    return run


def _left_out(state: DataFrame, model: Boosted, rounds: int) -> list[tuple]:
    """Sums over the left-out rows of each run, in one scan of the margins; with a logistic loss also
    their average precision, from counts of positives and negatives by bin of the margin."""
    runs, p, ranked = len(model.folds), len(model.features), model.loss == "logistic"
    wide = 4 + 2 * BINS * ranked

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((runs, wide))
        for batch in _slices(batches):
            _, y, fold, _, f = _rows(batch, runs, p)
            for r, k in enumerate(model.folds):
                if k is None:
                    continue
                out = fold == k
                guess = 1 / (1 + np.exp(-f[out, r])) if ranked else f[out, r]
                total[r, :4] += out.sum(), ((y[out] - guess) ** 2).sum(), y[out].sum(), (y[out] ** 2).sum()
                if ranked:
                    at = np.clip((f[out, r] - LOGIT_ENDS[0]) / (LOGIT_ENDS[1] - LOGIT_ENDS[0]) * BINS, 0, BINS - 1).astype(np.int64)
                    total[r, 4:] += np.bincount(at + BINS * (y[out] <= 0), minlength=2 * BINS)
        held = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([total[i].tobytes() for i in held], pa.binary())], ["run", "sums"])

    def added(rows: pa.Table) -> pa.Table:
        t = sum(np.frombuffer(r, np.float64) for r in sorted(rows.column("sums").to_pylist()))
        found = {c: [float(v)] for c, v in zip(("n", "error", "y", "yy"), t)}
        precision = average_precision(t[4 : 4 + BINS], t[4 + BINS :]) if ranked else None
        return pa.table({"run": rows.column("run")[:1], **found, "precision": pa.array([precision], pa.float64())})

    each = state.mapInArrow(sums, "run int, sums binary").groupBy("run").applyInArrow(
        added, "run int, n double, error double, y double, yy double, precision double"
    )
    return [(r["run"], rounds, int(r["n"]), r["error"], r["y"], r["yy"], r["precision"]) for r in each.collect()]


def chosen(model: Boosted, scores: DataFrame, by: str = "mse") -> list[dict]:
    """The settings from the best on by their mean over the folds: mse, r2 or precision; with the run
    that learned from all rows. Equal ones are in order of rounds and of the settings given."""
    each: dict[tuple[Setting, int], list[tuple[float, float, float]]] = {}
    for r in scores.collect():
        spread = r["yy"] - r["y"] ** 2 / r["n"]
        values = r["error"] / r["n"], 1 - r["error"] / spread if spread > 0 else np.nan, np.nan if r["precision"] is None else r["precision"]
        each.setdefault((model.settings[r["run"]], r["rounds"]), []).append(values)
    whole = {s: r for r, (s, k) in enumerate(zip(model.settings, model.folds)) if k is None}
    out = []
    for (s, n), v in each.items():
        mean = [float(np.mean([x for x in c if not np.isnan(x)] or [np.nan])) for c in zip(*v)]
        out.append({"setting": s, "rounds": n, **dict(zip(("mse", "r2", "precision"), mean)), "run": whole[s]})
    sign = 1 if by == "mse" else -1
    return sorted(out, key=lambda o: (np.isnan(o[by]), sign * o[by], o["rounds"], o["run"]))


def predict(df: DataFrame, model: Boosted, runs: dict[str, tuple[int, int]]) -> DataFrame:
    """The rows with a column for each name: what the run says after so many rounds (a probability if
    the loss is logistic). A scan in batches."""
    names, columns = list(runs), list(df.columns)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in model.features], 1)
            codes = model.codes(x)
            found = [model.margins(codes, *runs[n]) for n in names]
            found = [1 / (1 + np.exp(-m)) for m in found] if model.loss == "logistic" else found
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], [*columns, *names])

    return df.mapInArrow(apply, ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + [f"`{n}` double" for n in names]))
