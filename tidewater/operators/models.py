"""Supervised models on wide tables with Spark ML, tuned by cross-validation, scored as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window, functions as F

from tidewater.functions.trees import Leaf, attributions
from tidewater.operators.prep import standardise
from tidewater.operators.statistics import average_precision, regression_scores

L1_RATIOS, ALPHAS = (0.1, 0.5, 0.7, 0.9, 1.0), (0.01, 0.1, 1.0, 10.0)
TREES = tuple({"maxDepth": d, "maxIter": n, "stepSize": s} for d in (2, 3, 4) for n in (100, 200) for s in (0.03, 0.1))
#: Penalties of the logistic models: ten, in equal steps of their logarithm from 1e4 to 1e-4.
STRENGTHS = tuple(10 ** (4 - 8 * i / 9) for i in range(10))
MIN_ROWS = 20


@dataclass
class Fitted:
    """A model with the scaling of its features and the settings that cross-validation chose."""

    model: Model
    features: list[str]
    settings: dict[str, float]
    score: float

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        out = self.model.transform(_vector(df, self.features))
        value = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
        return out.withColumn("_p", value).drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("_p", name)

    def coefficients(self) -> dict[str, float]:
        inner = self.model.stages[-1] if isinstance(self.model, PipelineModel) else self.model
        values = inner.featureImportances if hasattr(inner, "featureImportances") else inner.coefficients
        return dict(zip(self.features, values.toArray().tolist()))


def _vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def folds(df: DataFrame, key: str, n: int = 5, seed: int = 0) -> DataFrame:
    """A fold for each row, from a hash of its key: reruns and any partitioning agree."""
    text = F.concat_ws("|", F.lit(seed).cast("string"), F.col(key).cast("string"))
    return df.withColumn("fold", F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n)


def elastic_settings(alpha: float, l1_ratio: float, sd_label: float) -> dict[str, float]:
    """Spark's parameters for 1/(2n) RSS + alpha (l1 |w| + (1 - l1)/2 w^2) on standardised columns:
    Spark scales the label, and with it only the ridge part."""
    total = alpha * l1_ratio + alpha * (1 - l1_ratio) * sd_label
    return {"regParam": total, "elasticNetParam": alpha * l1_ratio / total if total else 0.0}


def _tune(
    df: DataFrame, key: str, grid: Sequence[dict[str, float]], fit: Callable, score: Callable[[DataFrame], float], n_folds: int
) -> tuple[dict[str, float], float]:
    parted = folds(df, key, n_folds).persist()
    best: tuple[dict[str, float], float] = (dict(grid[0]), -np.inf)
    try:
        for settings in grid if len(grid) > 1 else []:
            scores = [
                s for k in range(n_folds) if (
                    s := score(fit(parted.where(F.col("fold") != k), settings).transform(parted.where(F.col("fold") == k)))
                ) is not None
            ]
            if scores and (mean := float(np.mean(scores))) > best[1]:
                best = dict(settings), mean
    finally:
        parted.unpersist()
    return best


def _r2(label: str) -> Callable[[DataFrame], float | None]:
    return lambda p: regression_scores(p, label, "prediction").first()["r2"]


def _ap(label: str) -> Callable[[DataFrame], float | None]:
    def score(p: DataFrame) -> float | None:
        row = average_precision(p.withColumn("_s", vector_to_array("probability")[1]), label, "_s").first()
        return row["average_precision"] if row["n_positive"] else None

    return score


def _estimate(kind: type, label: str, **fixed: object) -> Callable[[DataFrame, dict[str, float]], Model]:
    return lambda df, settings: kind(featuresCol="features", labelCol=label, **fixed, **settings).fit(df)


def fit_model(
    df: DataFrame, key: str, features: Sequence[str], label: str, kind: str, grid: Sequence[dict[str, float]] | None = None,
    n_folds: int = 5
) -> Fitted:
    """kind: ols, elastic_net, boosted, logistic, elastic_logistic or boosted_classifier. Features
    should be standardised (population SD) for the penalised kinds."""
    rows = _vector(df.select(key, label, *features), features)
    if kind in ("ols", "elastic_net"):
        sd = float(df.agg(F.stddev_pop(label).alias("s")).first()["s"] or 1.0)
        default = [
            elastic_settings(a, r, sd) for a in ALPHAS for r in L1_RATIOS
        ] if kind == "elastic_net" else [{"regParam": 0.0, "elasticNetParam": 0.0}]
        fit, score = _estimate(LinearRegression, label, standardization=False, maxIter=200, tol=1e-8), _r2(label)
    elif kind == "boosted":
        default, fit, score = TREES, _estimate(GBTRegressor, label, seed=0), _r2(label)
    elif kind in ("logistic", "elastic_logistic"):
        default = [{"regParam": a, "elasticNetParam": r} for a in STRENGTHS for r in L1_RATIOS] if kind == "elastic_logistic" else [{"regParam": 0.0}]
        fit, score = _estimate(LogisticRegression, label, standardization=False, maxIter=100), _ap(label)
    elif kind == "boosted_classifier":
        default, fit, score = TREES, _estimate(GBTClassifier, label, seed=0), _ap(label)
    else:
        raise ValueError(f"unknown kind {kind}")
    settings, best = _tune(rows, key, list(grid or default), fit, score, n_folds)
    return Fitted(fit(rows, settings), list(features), settings, best)


def groups_to_fit(df: DataFrame, group: str, label: str | None = None, at_least: int = MIN_ROWS) -> list[object]:
    """Groups with enough rows and, given a label, both classes; one row a group is fetched."""
    n = df.groupBy(group).agg(F.count("*").alias("n"), (F.count_distinct(label) if label else F.lit(2)).alias("classes"))
    return [r[group] for r in n.where((F.col("n") >= at_least) & (F.col("classes") > 1)).orderBy(group).collect()]


def ablation(
    df: DataFrame, key: str, label: str, scenarios: dict[str, Sequence[str]], kind: str, learn: str = "split = 'train'",
    test: str = "split = 'test'", grid: Sequence[dict[str, float]] | None = None
) -> DataFrame:
    """Predictions of each scenario's model for the test rows: scenario, key, actual, predicted."""
    out = None
    for name, features in scenarios.items():
        scaled = standardise(df, features, suffix="_z", learn=learn)
        z = [f"{c}_z" for c in features]
        known = scaled.na.fill(0.0, z).where(F.col(label).isNotNull())
        fitted = fit_model(known.where(learn), key, z, label, kind, grid)
        part = fitted.predict(known.where(test), "predicted").select(F.lit(name).alias("scenario"), key, F.col(label).alias("actual"), "predicted")
        out = part if out is None else out.unionByName(part)
    return out


def coefficients_table(
    df: DataFrame, group: str, key: str, features: Sequence[str], label: str, kind: str = "ols", learn: str = "split = 'train'",
    test: str = "split = 'test'", grid: Sequence[dict[str, float]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """A model for every group with MIN_ROWS to learn from, on columns scaled by its own learning
    rows: coefficients (group, feature, coefficient) and scores of its test rows (group, r2, mse, n)."""
    spark, rows, scores = df.sparkSession, [], None
    kind_of = dict(df.dtypes)[group]
    for g in groups_to_fit(df.where(learn), group):
        part = standardise(df.where(F.col(group) == g), features, learn=learn)
        z = [f"{c}_z" for c in features]
        known = part.na.fill(0.0, z).where(F.col(label).isNotNull())
        fitted = fit_model(known.where(learn), key, z, label, kind, grid)
        rows += [(g, f.removesuffix("_z"), v) for f, v in fitted.coefficients().items()]
        one = regression_scores(fitted.predict(known.where(test), "_p"), label, "_p", [group])
        scores = one if scores is None else scores.unionByName(one)
    return spark.createDataFrame(
        rows, f"`{group}` {kind_of}, feature string, coefficient double"
    ), scores if scores is not None else spark.createDataFrame([], f"`{group}` {kind_of}, r2 double, mse double, n long")


def mean_absolute(attributed: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, mean_abs: the mean absolute attribution of each feature, in one aggregation."""
    return attributed.agg(*[F.avg(F.abs(c)).alias(c) for c in features]).unpivot([], list(features), "feature", "mean_abs")


def linear_attributions(df: DataFrame, coefficients: dict[str, float], key: str) -> DataFrame:
    """Each feature's coefficient times its value less its mean."""
    means = df.agg(*[F.avg(c).alias(c) for c in coefficients]).first()
    return df.select(key, *[((F.col(c) - means[c]) * b).alias(c) for c, b in coefficients.items()])


def dealt(df: DataFrame, column: str, key: str, seed: int, parts: int = 64) -> DataFrame:
    """The rows with the column's values dealt anew: rows and values are put into parts by two
    hashes of the key and matched by their place in a part, so nothing is ordered as a whole; the
    few rows without a match keep their value."""

    def placed(rows: DataFrame, salt: int) -> DataFrame:
        h = F.xxhash64(F.lit(seed), F.lit(salt), F.lit(column), F.col(key))
        rows = rows.withColumn("_part", F.pmod(h, F.lit(parts))).withColumn("_h", h)
        return rows.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy("_h", key))).drop("_h")

    values = placed(df.select(key, F.col(column).alias("_v")), 1).drop(key)
    joined = placed(df, 0).join(values, ["_part", "_place"], "left")
    return joined.withColumn(column, F.coalesce("_v", column)).select(*df.columns)


def permutation_importance(df: DataFrame, fitted: Fitted, label: str, key: str, repeats: int = 3) -> DataFrame:
    """Loss of R2 when a feature's values are dealt anew."""
    base = regression_scores(fitted.predict(df), label, "prediction").first()["r2"]
    rows = []
    for c in fitted.features:
        losses = [base - regression_scores(fitted.predict(dealt(df, c, key, k)), label, "prediction").first()["r2"] for k in range(repeats)]
        rows.append((c, float(np.mean(losses))))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def leaves(model: Model) -> list[Leaf]:
    """The leaves of a boosted or single tree model of continuous features."""
    trees, weights = (model.trees, model.treeWeights) if hasattr(model, "trees") else ([model], [1.0])
    out: list[Leaf] = []
    for tree, weight in zip(trees, weights):
        todo = [(tree._call_java("rootNode"), {})]
        while todo:
            node, path = todo.pop()
            if node.subtreeDepth() == 0:
                at = sorted(path)
                out.append(Leaf(weight * node.prediction(), tuple(at), *(tuple(path[f][k] for f in at) for k in range(3))))
                continue
            f, cut, rows = int(node.split().featureIndex()), float(node.split().threshold()), float(node.impurityStats().count())
            for child, side in ((node.leftChild(), 0), (node.rightChild(), 1)):
                low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                went = float(child.impurityStats().count()) / rows
                todo.append((child, path | {f: (low, min(high, cut), share * went) if side == 0 else (max(low, cut), high, share * went)}))
    return out


def tree_attributions(df: DataFrame, fitted: Fitted, key: str) -> DataFrame:
    """Each row's Shapley values of a boosted regression (of a classifier: in log-odds halves), one
    column a feature; with the mean prediction they add up to the row's. A scan in batches."""
    found, names = leaves(fitted.model), list(fitted.features)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.concat([frame[[key]], pd.DataFrame(attributions(found, frame[names].to_numpy(float)), columns=names, index=frame.index)], axis=1)

    return df.select(key, *names).mapInPandas(run, ", ".join([f"{key} {dict(df.dtypes)[key]}", *[f"{n} double" for n in names]]))
