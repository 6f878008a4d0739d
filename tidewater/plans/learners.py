"""Queries of models that share their passes over the rows, each beside a case that SQL can express."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.operators import batched, boosting, cluster, discriminant, models, paths, prep, resampling, statistics
from tidewater.operators.batched import Run
from tidewater.plans.cohort import COHORT, cohort
from tidewater.plans.registry import query, rounded

FEATURES = ["n_orders", "lab_a", "balance"]
K_SQL = COHORT + ", k AS (SELECT id, study_group, split, n_orders::DOUBLE AS n_orders, lab_a, lab_b, balance FROM cohort WHERE lab_b IS NOT NULL)"
#: Folds as `models.folds` deals them.
_FOLD = "('0x' || substr(md5('0|' || id), 1, 8))::BIGINT % 5"


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants with a target: features as doubles, and a fold of five."""
    rows = cohort(spark, sf_dir).where("lab_b IS NOT NULL")
    return models.folds(
        rows.select("id", "study_group", "split", F.col("n_orders").cast("double").alias("n_orders"), "lab_a", "lab_b", "balance"),
        "id"
    )


def high(rows: DataFrame) -> DataFrame:
    """With `label`: whether the target is among the upper 30 % of the learning rows."""
    return prep.quantile_label(rows, "lab_b", 0.7, F.col("split") == "train")


# Boosted trees.

_EDGES = ", ".join(f"{i / 8}" for i in range(1, 8))
STUMP_SQL = K_SQL + f""",
t AS (SELECT *, (SELECT avg(lab_b) FROM k WHERE split = 'train') - lab_b AS g FROM k WHERE split = 'train'),
l AS (UNPIVOT t ON {", ".join(FEATURES)} INTO NAME feature VALUE x),
e AS (SELECT DISTINCT feature, unnest(q) AS threshold FROM (SELECT feature, quantile_disc(x, [{_EDGES}]) AS q FROM l GROUP BY feature)),
c AS (SELECT e.feature, threshold, sum(g) FILTER (x <= threshold) AS gl, count(*) FILTER (x <= threshold) AS hl, sum(g) AS g, count(*) AS h
      FROM e JOIN l ON l.feature = e.feature GROUP BY e.feature, threshold HAVING count(*) FILTER (x > threshold) > 0),
s AS (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM c)
SELECT feature, round_even(threshold, 4) AS threshold, hl AS n_left, h - hl AS n_right, round_even(gain / 1e9, 3) AS gain,
  round_even(-gl / (hl + 1), 2) AS value_left, round_even((gl - g) / (h - hl + 1), 2) AS value_right
FROM s ORDER BY s.gain DESC LIMIT 1"""


@query("boosted_stump", STUMP_SQL)
def boosted_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree of one cut: the best gain over the quantile bins of all features."""
    model, _ = boosting.boost(known(spark, sf_dir).where("split = 'train'"), "id", FEATURES, "lab_b", [boosting.Setting(1, 1.0)], 1, bins=8)
    t = model.rounds[0]
    f = int(t.feature[0, 0])
    row = (
        model.features[f], float(model.edges[f][t.cut[0, 0]]), int(t.cover[0, 1]), int(t.cover[0, 2]), float(t.gain[0, 0]) / 1e9,
        float(t.value[0, 1]), float(t.value[0, 2])
    )
    found = spark.createDataFrame(
        [row], "feature string, threshold double, n_left long, n_right long, gain double, value_left double, value_right double"
    )
    return found.withColumns({c: F.bround(c, d) for c, d in (("threshold", 4), ("gain", 3), ("value_left", 2), ("value_right", 2))})


#: Every option of the grid of 108, with fewer rounds and depths: README has the time of the whole.
GRID = {"rounds": (4, 8, 12), "depth": (2, 3), "rate": (0.1, 0.3), "rows": (0.7, 1.0), "columns": (0.7, 1.0)}


def boosted_grid(spark: SparkSession, sf_dir: str, options: dict = GRID, folds: int = 5) -> DataFrame:
    """All settings of a grid by their mean squared error over the folds, and the scores of the best one
    on the test rows: place, setting, mse, r2, test_r2 (of place 1)."""
    settings, rounds = boosting.grid(options)
    rows = known(spark, sf_dir)
    model, scores = boosting.boost(
        rows.where("split = 'train'"), "id", FEATURES, "lab_b", settings, rounds[-1], folds=folds, fold="fold", score_at=rounds
    )
    order = boosting.chosen(model, scores)
    guessed = boosting.predict(rows.where("split = 'test'"), model, {"guess": (order[0]["run"], order[0]["rounds"])})
    test = statistics.regression_scores(guessed, "lab_b", "guess").first()["r2"]
    listed = [
        (
            i, o["setting"].depth, o["setting"].rate, o["setting"].rows, o["setting"].columns, o["rounds"], o["mse"], o["r2"],
            test if i == 1 else None
        ) for i,
        o in enumerate(order, 1)
    ]
    return spark.createDataFrame(
        listed,
        "place int, depth int, rate double, rows double, columns double, rounds int, mse double, r2 double, test_r2 double"
    )


query("boosted_grid")(boosted_grid)


@query("boosted_classes")
def boosted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted classifiers by average precision over the folds, and that of the best on test rows."""
    settings, rounds = boosting.grid({"rounds": (6, 12), "depth": (2, 3), "rate": (0.1, 0.3), "rows": (1.0,), "columns": (1.0,)})
    rows = high(known(spark, sf_dir))
    model, scores = boosting.boost(
        rows.where("split = 'train'"), "id", FEATURES[1:], "label", settings, rounds[-1], folds=5, fold="fold", loss="logistic",
        score_at=rounds
    )
    order = boosting.chosen(model, scores, "precision")
    guessed = boosting.predict(rows.where("split = 'test'"), model, {"p": (order[0]["run"], order[0]["rounds"])})
    test = statistics.average_precision(guessed, "label", "p").first()["average_precision"]
    listed = [(i, o["setting"].depth, o["setting"].rate, o["rounds"], o["precision"], test if i == 1 else None) for i, o in enumerate(order, 1)]
    return spark.createDataFrame(listed, "place int, depth int, rate double, rounds int, precision double, test_precision double")


# Elastic nets.

_GRID_VALUES = ", ".join(f"({a}::DOUBLE, {r}::DOUBLE)" for a in paths.ALPHAS for r in paths.RATIOS)
ELASTIC_SQL = K_SQL + f""", f AS (SELECT n_orders AS x, lab_b / 1e5 AS y, {_FOLD} AS fold FROM k WHERE split = 'train'), r AS (SELECT * FROM range(0, 5) AS t(run)),
m AS (SELECT run, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS s, covar_pop(x, y) / stddev_pop(x) AS t FROM f, r WHERE fold <> run GROUP BY run),
w AS (SELECT *, sign(t) * greatest(abs(t) - alpha * ratio, 0) / (1 + alpha * (1 - ratio)) / s AS b FROM m, (VALUES {_GRID_VALUES}) AS g(alpha, ratio)),
e AS (SELECT run, alpha, ratio, avg(pow(y - my - b * (x - mx), 2)) AS mse FROM w JOIN f ON fold = run GROUP BY ALL)
SELECT alpha, ratio, round_even(avg(mse), 8) AS mse FROM e GROUP BY ALL"""


@query("elastic_grid_errors", ELASTIC_SQL)
def elastic_grid_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid of one feature, scaled inside the folds: soft thresholds, and their left-out errors."""
    rows = known(spark, sf_dir).where("split = 'train'").withColumn("y", F.col("lab_b") / 1e5)
    _, table = paths.search(paths.moments(rows, ["n_orders"], "y", "fold", 5))
    return rounded(spark.createDataFrame(table, "alpha double, ratio double, mse double"), 8)


def _elastic(spark: SparkSession, sf_dir: str, alphas: tuple | None, ratios: tuple, in_folds: bool) -> DataFrame:
    rows = known(spark, sf_dir)
    fit, _ = paths.search(paths.moments(rows.where("split = 'train'"), FEATURES, "lab_b", "fold", 5), alphas, ratios, in_folds)
    scores = statistics.regression_scores(fit.predict(rows.where("split = 'test'"), "guess"), "lab_b", "guess", ["study_group"])
    return scores.withColumns({"alpha": F.lit(fit.alpha), "ratio": F.lit(fit.ratio)})


@query("elastic_net_scores")
def elastic_net_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of 36 penalties over five folds, whose columns are scaled inside each fold."""
    return _elastic(spark, sf_dir, paths.ALPHAS, paths.RATIOS, True)


@query("elastic_path_scores")
def elastic_path_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path of 100 penalties for each of five ratios, on columns that are scaled once."""
    return _elastic(spark, sf_dir, None, paths.PATH_RATIOS, False)


SHARES_SQL = K_SQL + """, t AS (SELECT study_group, row_number() OVER (ORDER BY study_group) - 1 AS label FROM (SELECT DISTINCT study_group FROM k WHERE split = 'train'))
SELECT label::INT AS label, round_even(avg((k.study_group = t.study_group)::INT), 6) AS share FROM t, k WHERE split = 'train' GROUP BY label"""


@query("one_against_rest_shares", SHARES_SQL)
def one_against_rest_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models whose penalty leaves the intercept alone: each says its class's share."""
    rows = known(spark, sf_dir).where("split = 'train'")
    names = sorted(r["study_group"] for r in rows.select("study_group").distinct().collect())
    coded = rows.withColumn("label", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("study_group")) - 1)
    found = discriminant.logistic(coded, FEATURES, "label", range(len(names)), "fold", 5, (1e-7,), (1.0,))
    return spark.createDataFrame([(i, round(1 / (1 + math.exp(-m.intercept)), 6)) for i, m in found.items()], "label int, share double")


@query("elastic_classes")
def elastic_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic elastic net at the best of 50 penalties over five folds, scored on test rows."""
    rows = high(known(spark, sf_dir))
    model = discriminant.logistic(rows.where("split = 'train'"), FEATURES[1:], "label", [1], "fold")[1]
    scores = statistics.average_precision(rows.where("split = 'test'").withColumn("p", model.probability()), "label", "p")
    return scores.withColumns({"strength": F.lit(model.problem.strength), "ratio": F.lit(model.problem.ratio), "folds_precision": F.lit(model.score)})


# Partial least squares.

PLS_SQL = K_SQL + """, t AS (SELECT *, (lab_b >= (SELECT quantile_cont(lab_b, 0.7) FROM k WHERE split = 'train'))::INT AS label FROM k),
m AS (SELECT avg(n_orders) AS ma, avg(lab_a) AS mb, stddev_pop(n_orders) AS sa, stddev_pop(lab_a) AS sb, avg(label) AS my,
      covar_pop(n_orders, label) / stddev_pop(n_orders) AS ca, covar_pop(lab_a, label) / stddev_pop(lab_a) AS cb, corr(n_orders, lab_a) AS r FROM t WHERE split = 'train'),
q AS (SELECT *, (ca * ca + cb * cb) / (ca * ca + cb * cb + 2 * ca * cb * r) AS f FROM m)
SELECT id, label, round_even(my + f * (ca * (n_orders - ma) / sa + cb * (lab_a - mb) / sb), 8) AS score FROM t, q WHERE split = 'test'"""


@query("pls_one_component", PLS_SQL)
def pls_one_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = high(known(spark, sf_dir))
    model, _ = discriminant.partial_least_squares(rows.where("split = 'train'"), FEATURES[:2], "label", "fold", most=1)
    return rounded(rows.where("split = 'test'").select("id", "label", model.margin().alias("score")), 8)


@query("pls_scores")
def pls_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the number of components with the best precision over the folds: its rates and precision on
    rows it did not learn from."""
    rows = high(known(spark, sf_dir))
    model, _ = discriminant.partial_least_squares(rows.where("split = 'train'"), FEATURES, "label", "fold")
    test = rows.where("split = 'test'").withColumn("score", model.margin()).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    precision = statistics.average_precision(test, "label", "score").first()["average_precision"]
    added = {"average_precision": F.lit(precision).cast("double"), "components": F.lit(model.problem.strength)}
    return statistics.rates(test, "label", "predicted").withColumns(added)


# Resampled metrics.

_W = resampling.weight_sql("h", "resample")
_HASHED = K_SQL + ", h AS (SELECT *, ('0x' || substr(md5(id::VARCHAR), 1, 13))::BIGINT AS h FROM k), "
_ENDS = "round_even(quantile_cont(v, 0.025), 6) AS lo, round_even(quantile_cont(v, 0.975), 6) AS hi, round_even(stddev_samp(v), 6) AS se, count(v) AS valid"
RANKED_SQL = _HASHED + f"""w AS (SELECT study_group, resample, n_orders AS s, sum({_W}) FILTER (lab_b > 3e5) AS p, sum({_W}) FILTER (lab_b <= 3e5) AS q FROM h, range(1, 1001) AS t(resample) GROUP BY ALL),
c AS (SELECT study_group, resample, s, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM w),
a AS (SELECT *, sum(q) OVER u - q AS below, sum(p) OVER d AS tp, sum(q) OVER d AS fp FROM c
      WINDOW u AS (PARTITION BY study_group, resample ORDER BY s), d AS (PARTITION BY study_group, resample ORDER BY s DESC)),
m AS (SELECT study_group, resample, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(p * (below + q / 2e0)) / (sum(p) * sum(q)) END AS auroc,
      CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(CASE WHEN p > 0 THEN p * tp / (tp + fp)::DOUBLE ELSE 0e0 END) / sum(p) END AS average_precision FROM a GROUP BY ALL),
l AS (SELECT study_group, 'auroc' AS metric, auroc AS v FROM m UNION ALL SELECT study_group, 'average_precision', average_precision FROM m) SELECT study_group, metric, {_ENDS} FROM l GROUP BY ALL"""


@query("bootstrap_ranked", RANKED_SQL)
def bootstrap_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1000 resamples of the area under the ROC curve and the average precision of each group."""
    rows = known(spark, sf_dir).withColumn("y", (F.col("lab_b") > 3e5).cast("int"))
    each = resampling.ranked(rows, "id", "y", "n_orders", "study_group")
    return rounded(resampling.intervals(each, ["auroc", "average_precision"], "study_group"), 6)


FITTED_SQL = _HASHED + f"""w AS (SELECT study_group, resample, {_W} AS w, lab_b / 1e5 AS y, (lab_a * 1.5) / 1e5 AS f FROM h, range(1, 2001) AS t(resample)),
s AS (SELECT study_group, resample, sum(w) AS n, sum(w * y) / sum(w) AS m, sum(w * (y - f) * (y - f)) AS e FROM w GROUP BY ALL),
d AS (SELECT study_group, resample, n, e, sum(w * (y - m) * (y - m)) AS v FROM w JOIN s USING (study_group, resample) GROUP BY ALL),
x AS (SELECT study_group, CASE WHEN v > 1e-9 THEN 1 - e / v END AS r2, CASE WHEN n > 0 THEN e / n END AS mse FROM d),
l AS (SELECT study_group, 'r2' AS metric, r2 AS v FROM x UNION ALL SELECT study_group, 'mse', mse FROM x) SELECT study_group, metric, {_ENDS} FROM l GROUP BY ALL"""


@query("bootstrap_fit", FITTED_SQL)
def bootstrap_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2000 resamples of R2 and mean squared error of a fixed formula in each group."""
    rows = known(spark, sf_dir).select("id", "study_group", (F.col("lab_b") / 1e5).alias("y"), (F.col("lab_a") * 1.5 / 1e5).alias("f"))
    return rounded(resampling.intervals(resampling.regression(rows, "id", "y", "f", "study_group", 2000), ["r2", "mse"], "study_group"), 6)


# Clusterings.

LABS = ["balance", "lab_a", "lab_b", "lab_u", "n_orders"]
Z = [f"{c}_z" for c in LABS]


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants with all values known, standardised, with a fold."""
    rows = cohort(spark, sf_dir).select("id", "study_group", "split", *[F.col(c).cast("double").alias(c) for c in LABS]).na.drop()
    return models.folds(prep.standardise(rows, LABS), "id")


LLOYD_SQL = COHORT + """, k AS (SELECT id, balance / 1e3 AS x, lab_a / 1e4 AS y FROM cohort WHERE lab_a IS NOT NULL),
c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, x AS cx, y AS cy FROM k ORDER BY id LIMIT 4),
d AS (SELECT id, x, y, cluster, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM k, c),
o AS (SELECT id, any_value(x) AS x, any_value(y) AS y, arg_min(cluster, (d2, cluster)) AS cluster FROM d GROUP BY id)
SELECT cluster::INT AS cluster, count(*) AS n, round_even(avg(x), 8) AS x, round_even(avg(y), 8) AS y FROM o GROUP BY cluster"""


@query("lloyd_step", LLOYD_SQL)
def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of k-means from the first four participants, and the sizes of their clusters."""
    rows = cohort(spark, sf_dir).where("lab_a IS NOT NULL").select("id", (F.col("balance") / 1e3).alias("x"), (F.col("lab_a") / 1e4).alias("y"))
    centres = np.array([(r["x"], r["y"]) for r in rows.orderBy("id").limit(4).collect()])
    moved = batched.lloyd(batched.points(rows, "id", ["x", "y"]), [Run(4)], [centres], [0])[0][0]
    sizes = batched.labelled(rows, ["x", "y"], {"cluster": centres}).groupBy("cluster").agg(F.count("*").alias("n"))
    listed = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(moved)], "cluster int, x double, y double")
    return rounded(listed.join(sizes, "cluster"), 8)


@query("elbow_costs")
def elbow_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cost of ten starts for two to eight clusters."""
    return batched.elbow(panel(spark, sf_dir), "id", Z, range(2, 9))[0]


def best_of(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, batched.Clustering]:
    """The panel with the cluster of the best of ten starts, numbered by the mean of two columns."""
    rows = panel(spark, sf_dir)
    best = batched.elbow(rows, "id", Z, [k])[1][k]
    named = batched.labelled(rows, Z, {"raw": best.centres})
    return cluster.canonical_labels(named, "raw", ["balance_z", "lab_a_z"]), best


@query("kmeans_profile")
def kmeans_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    named, _ = best_of(spark, sf_dir, 3)
    return named.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in LABS])


@query("mixture_agreement")
def mixture_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the likeliest of ten mixtures: its agreement with the best k-means, and doubtful rows."""
    named, _ = best_of(spark, sf_dir, 3)
    rows = batched.points(named, "id", Z)
    found = batched.mixtures(rows, batched.kmeans(rows, [Run(3, s) for s in range(10)]))
    both = statistics.once(batched.mixed(named, Z, max(found, key=lambda m: m.likelihood)))
    return statistics.adjusted_rand(both, "cluster", "component").withColumn("n_ambiguous", F.lit(both.where("ambiguous").count()))


@query("cluster_stability")
def cluster_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 resamples of the best k-means of three."""
    named, _ = best_of(spark, sf_dir, 3)
    return batched.stability(named, "id", Z, "cluster", 3)


@query("forced_clusters_predicted")
def forced_clusters_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four clusters, each predicted against the rest from other columns by an elastic net: average
    precision and sensitivity on test rows, with their intervals."""
    named, _ = best_of(spark, sf_dir, 4)
    found = discriminant.logistic(named.where("split = 'train'"), ["lab_a_z", "n_orders_z"], "cluster", range(4), "fold")
    out = None
    for c, model in found.items():
        test = named.where("split = 'test'").select("id", (F.col("cluster") == c).cast("int").alias("y"), model.probability().alias("p"))
        test = statistics.once(test.withColumn("predicted", (F.col("p") >= 0.5).cast("int")))
        ranked = resampling.intervals(resampling.ranked(test, "id", "y", "p"), ["average_precision"])
        rates = resampling.intervals(resampling.rates(test, "id", "y", "predicted"), ["sensitivity"])
        whole = statistics.average_precision(test, "y", "p").first(), statistics.rates(test, "y", "predicted").first()
        value = F.when(
            F.col("metric") == "sensitivity", F.lit(whole[1]["sensitivity"]).cast("double")
        ).otherwise(F.lit(whole[0]["average_precision"]).cast("double"))
        part = ranked.unionByName(rates).select(
            F.lit(c).alias("cluster"), "metric", value.alias("value"), "lo", "hi", "valid",
            F.lit(whole[0]["n_positive"]).cast("long").alias("n_positive")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "lowess_lines",
    COHORT + "SELECT nation, id, n_orders::DOUBLE AS x, round_even(3e0 * n_orders + nation, 6) AS smooth FROM cohort WHERE n_orders IS NOT NULL"
)
def lowess_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local lines over points of a straight line, one of each nation, lie on it."""
    rows = cohort(spark, sf_dir).where("n_orders IS NOT NULL").select("nation", "id", F.col("n_orders").cast("double").alias("x"))
    lines = rows.withColumn("y", 3.0 * F.col("x") + F.col("nation"))
    return rounded(statistics.smoothed(lines, "nation", "id", "x", "y"), 6)


CANONICAL_SQL = K_SQL + """, c AS (SELECT corr(lab_a, lab_b) AS r FROM k)
SELECT 1 AS component, round_even(abs(r), 6) AS correlation, variable, 1e0 AS size FROM c, (VALUES ('lab_a'), ('lab_b')) AS v(variable)"""


@query("canonical_pair", CANONICAL_SQL)
def canonical_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one column on each side: the canonical correlation is theirs, and each is its own component."""
    found = cluster.canonical_correlation(known(spark, sf_dir), ["lab_a"], ["lab_b"], 1)
    rows = spark.createDataFrame(found).select(F.col("component").cast("int").alias("component"), "correlation", "variable", F.abs("loading").alias("size"))
    return rounded(rows, 6)
