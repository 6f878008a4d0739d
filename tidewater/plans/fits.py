"""Queries of p values, resampling and models that have a closed form, beside that form in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.operators import cluster, models, paths, prep, selection, statistics
from tidewater.plans.cohort import COHORT, cohort
from tidewater.plans.registry import query, rounded
from tidewater.plans.tests import _U

# Tail probabilities in SQL. Normal: 1 less the series of the error function, whose terms are positive.
_X = "(abs({z}) / sqrt(2e0))"
NORMAL_P = (
    "(CASE WHEN {z} = 0 THEN 1e0 ELSE greatest(0e0, 1 - 2 / sqrt(pi()) * exp(-" + _X + " * " + _X + ") * "
    "list_sum(list_transform(range(0, 150), lambda n: exp(n * ln(2e0) + (2 * n + 1) * ln(" + _X + ") - (lgamma(2 * n + 2) - n * ln(2e0) - lgamma(n + 1)))))) END)"
)
#: Chi squared with an even number of degrees of freedom.
CHI2_P = "(exp(-{x} / 2) * list_sum(list_transform(range(0, ({dof} // 2)::BIGINT), lambda i: CASE WHEN i = 0 THEN 1e0 ELSE exp(i * ln({x} / 2) - lgamma(i + 1)) END)))"
#: Student's t, two-sided, by the finite sums for even and odd degrees; {t} and {v}: columns.
_COS2 = "({v} / ({v} + {t} * {t}))"
T_P = (
    "(CASE WHEN {v} % 2 = 0 THEN 1 - abs({t}) / sqrt({v} + {t} * {t}) * list_sum(list_transform(range(0, ({v} // 2)::BIGINT), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) + k * ln(" + _COS2 + ")) / sqrt(pi()))) "
    "ELSE 1 - 2 / pi() * (atan(abs({t}) / sqrt({v})) + abs({t}) * sqrt({v}) / ({v} + {t} * {t}) * coalesce(list_sum(list_transform(range(0, (({v} - 1) // 2)::BIGINT), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5) + k * ln(" + _COS2 + ")) * sqrt(pi()) / 2)), 0)) END)"
)


@query("mann_whitney_p", _U + f""", q AS (SELECT *, greatest(abs(u_statistic - n_1 * n_2 / 2e0) - 0.5, 0) / s AS z FROM v), t AS (SELECT *, {NORMAL_P.format(z="z")} AS p FROM q)
SELECT group_1, group_2, round_even(p, 6) AS p_value, round_even(least(p * count(*) OVER (), 1e0), 6) AS p_value_bonferroni FROM t""")
def mann_whitney_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        statistics.pairwise_u(cohort(spark, sf_dir), "study_group", "lab_b").select("group_1", "group_2", "p_value", "p_value_bonferroni"),
        6
    )


_RANKED = ", r AS (SELECT study_group, rank() OVER (ORDER BY lab_b) + (count(*) OVER (PARTITION BY lab_b) - 1) / 2e0 AS rk, count(*) OVER (PARTITION BY lab_b) AS t FROM cohort WHERE lab_b IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS n, sum(t * t - 1e0) AS ties FROM r) "


@query("one_vs_rest_p", COHORT + _RANKED + f""", g AS (SELECT study_group AS level, count(*) AS k, sum(rk) AS s FROM r GROUP BY study_group HAVING count(*) >= 15), u AS (SELECT level, k, s - k * (k + 1) / 2e0 AS u, n, ties FROM g, n),
q AS (SELECT level, greatest(abs(u - k * (n - k) / 2) - 0.5, 0) / sqrt(k * (n - k) / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u) SELECT level, round_even({NORMAL_P.format(z="z")}, 6) AS p_value FROM q""")
def one_vs_rest_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.one_vs_rest_u(cohort(spark, sf_dir), "study_group", "lab_b").select("level", "p_value"), 6)


@query("kruskal_p", COHORT + _RANKED + f""", g AS (SELECT sum(rk) AS s, count(*) AS k FROM r GROUP BY study_group), h AS (SELECT (12 / (n * (n + 1)) * sum(s * s / k) - 3 * (n + 1)) / (1 - ties / (n * n - 1) / n) AS x, count(*) - 1 AS dof FROM g, n GROUP BY n, ties)
SELECT dof, round_even({CHI2_P.format(x="x", dof="dof")}, 6) AS p_value FROM h""")
def kruskal_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.kruskal(cohort(spark, sf_dir), "study_group", "lab_b").select("dof", "p_value"), 6)


@query("chi_square_p", COHORT + f""", c AS (SELECT study_group AS a, nation % 5 AS b, count(*) AS o FROM cohort GROUP BY ALL), t AS (SELECT sum(o) AS n FROM c),
e AS (SELECT a, b, x.k * y.k / n::DOUBLE AS e FROM (SELECT a, sum(o) AS k FROM c GROUP BY a) x, (SELECT b, sum(o) AS k FROM c GROUP BY b) y, t),
s AS (SELECT sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e) AS x, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM e LEFT JOIN c USING (a, b)) SELECT dof, round_even({CHI2_P.format(x="x", dof="dof")}, 6) AS p_value FROM s""")
def chi_square_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        statistics.chi_square(cohort(spark, sf_dir).withColumn("region", F.col("nation") % 5), "study_group", "region").select("dof", "p_value"),
        6
    )


@query("chi_square_yates", COHORT + """, c AS (SELECT split AS a, lab_b > 300000 AS b, count(*)::DOUBLE AS o FROM cohort WHERE lab_b IS NOT NULL GROUP BY ALL), t AS (SELECT sum(o) AS n FROM c),
e AS (SELECT a, b, x.k * y.k / n AS e FROM (SELECT a, sum(o) AS k FROM c GROUP BY a) x, (SELECT b, sum(o) AS k FROM c GROUP BY b) y, t)
SELECT round_even(sum(pow(greatest(abs(coalesce(o, 0) - e) - 0.5, 0), 2) / e), 6) AS chi2, 1::BIGINT AS dof FROM e LEFT JOIN c USING (a, b)""")
def chi_square_yates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohort(spark, sf_dir).where("lab_b IS NOT NULL").withColumn("high", F.col("lab_b") > 300000)
    return rounded(statistics.chi_square(rows, "split", "high").select("chi2", "dof"), 6)


@query("spearman_p", COHORT + f""", r AS (SELECT rank() OVER (ORDER BY lab_a) + (count(*) OVER (PARTITION BY lab_a) - 1) / 2e0 AS x, rank() OVER (ORDER BY balance) + (count(*) OVER (PARTITION BY balance) - 1) / 2e0 AS y FROM cohort WHERE lab_a IS NOT NULL AND balance IS NOT NULL),
s AS (SELECT corr(x, y) AS rho, count(*) AS n FROM r), t AS (SELECT rho, n, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, n - 2 AS v FROM s) SELECT n, round_even({T_P.format(t="t", v="v")}, 6) AS p_value FROM t""")
def spearman_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.spearman(cohort(spark, sf_dir), "lab_a", "balance").select("n", "p_value"), 6)


_WEIGHT = " + ".join(
    f"(u > {b})::INT" for b in (
        0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183,
        0.9999167588507119
    )
)


def _bootstrap_sql(resamples: int, at_least: int, where: str) -> str:
    return COHORT + f""", d AS (SELECT study_group, resample, balance, ('0x' || substr(md5('0|' || resample || '|' || id), 1, 13))::BIGINT / 4503599627370496e0 AS u FROM cohort, range(1, {resamples + 1}) AS t(resample) WHERE {where}),
w AS (SELECT study_group, resample, balance, {_WEIGHT} AS w FROM d), e AS (SELECT study_group, resample, sum(w * balance) / sum(w) AS m FROM w GROUP BY ALL HAVING sum(w) > 0)
SELECT study_group, CASE WHEN count(m) >= {at_least} THEN round_even(quantile_cont(m, 0.025), 6) END AS m_lo, CASE WHEN count(m) >= {at_least} THEN round_even(quantile_cont(m, 0.975), 6) END AS m_hi,
CASE WHEN count(m) >= {at_least} THEN round_even(stddev_samp(m), 6) END AS m_se, count(m) AS m_valid FROM e GROUP BY study_group"""


@query("bootstrap_interval", _bootstrap_sql(1000, 1, "true"))
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1000 resamples of each group's mean balance."""
    return rounded(
        statistics.bootstrap_means(
            cohort(spark, sf_dir).select("id", "study_group", "balance"), "id", {"m": "balance"}, resamples=1000,
            by=["study_group"]
        ),
        6
    )


@query("bootstrap_guarded", _bootstrap_sql(15, 20, "true"))
def bootstrap_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer resamples than an interval needs: it is unknown."""
    return rounded(
        statistics.bootstrap_means(
            cohort(spark, sf_dir).select("id", "study_group", "balance"), "id", {"m": "balance"}, resamples=15,
            by=["study_group"], at_least=20
        ),
        6
    )


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir).where("lab_b IS NOT NULL").select(
        "id", "study_group", "split", F.col("n_orders").cast("double").alias("n_orders"), "lab_a", "lab_b"
    )


_LINES = COHORT + ", k AS (SELECT * FROM cohort WHERE lab_b IS NOT NULL), m AS (SELECT study_group, regr_slope(lab_b, n_orders) AS b, regr_intercept(lab_b, n_orders) AS c, stddev_pop(n_orders) AS s, count(*) AS n FROM k WHERE split = 'train' GROUP BY study_group HAVING count(*) >= 20) "


@query(
    "per_group_scores",
    _LINES + "SELECT study_group, round_even(1 - avg(pow(lab_b - c - b * n_orders, 2)) / var_pop(lab_b), 6) AS r2, round_even(avg(pow(lab_b - c - b * n_orders, 2)) / 1e6, 2) AS mse, count(*) AS n FROM k JOIN m USING (study_group) WHERE split = 'test' GROUP BY study_group"
)
def per_group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model for each group with rows enough, scored on its own test rows."""
    scores = models.coefficients_table(_known(spark, sf_dir), "study_group", "id", ["n_orders"], "lab_b")[1]
    return scores.select("study_group", F.bround("r2", 6).alias("r2"), F.bround(F.col("mse") / 1e6, 2).alias("mse"), "n")


@query("per_group_coefficients", _LINES + "SELECT study_group, 'n_orders' AS feature, round_even(b * s, 4) AS coefficient FROM m")
def per_group_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.coefficients_table(_known(spark, sf_dir), "study_group", "id", ["n_orders"], "lab_b")[0], 4)


_TWO = """, p AS (SELECT *, n_orders::DOUBLE AS x, lab_a AS y, lab_b AS t FROM cohort WHERE lab_b IS NOT NULL), c AS (SELECT var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, t) AS xt, covar_pop(y, t) AS yt, avg(x) AS mx, avg(y) AS my, avg(t) AS mt FROM p WHERE split = 'train'),
b AS (SELECT (xt * yy - yt * xy) / (xx * yy - xy * xy) AS bx, (yt * xx - xt * xy) / (xx * yy - xy * xy) AS by_, mx, my, mt, xt / xx AS b1 FROM c),
g AS (SELECT study_group, t, mt + bx * (x - mx) + by_ * (y - my) AS two, mt + b1 * (x - mx) AS one FROM p, b WHERE split = 'test') """


@query(
    "ols_scores",
    COHORT + _TWO + "SELECT study_group, round_even(1 - avg((t - two) * (t - two)) / var_pop(t), 6) AS r2, round_even(avg((t - two) * (t - two)) / 1e6, 2) AS mse, count(*) AS n FROM g GROUP BY study_group"
)
def ols_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares on two columns, pooled, scored by group."""
    rows = prep.standardise(_known(spark, sf_dir), ["n_orders", "lab_a"], learn="split = 'train'")
    fitted = models.fit_model(rows.where("split = 'train'"), "id", ["n_orders_z", "lab_a_z"], "lab_b", "ols")
    scores = statistics.regression_scores(fitted.predict(rows.where("split = 'test'"), "guess"), "lab_b", "guess", ["study_group"])
    return scores.select("study_group", F.bround("r2", 6).alias("r2"), F.bround(F.col("mse") / 1e6, 2).alias("mse"), "n")


@query(
    "ablation_scores",
    COHORT + _TWO + """SELECT '1_base' AS scenario, round_even(1 - avg((t - one) * (t - one)) / var_pop(t), 6) AS r2, count(*) AS n FROM g UNION ALL SELECT '2_add_lab_a', round_even(1 - avg((t - two) * (t - two)) / var_pop(t), 6), count(*) FROM g"""
)
def ablation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    guesses = models.ablation(_known(spark, sf_dir), "id", "lab_b", selection.one_added(["n_orders"], ["lab_a"]), "ols")
    return rounded(statistics.regression_scores(guesses, "actual", "predicted", ["scenario"]).select("scenario", "r2", "n"), 6)


def _folded(spark: SparkSession, sf_dir: str, reverse: bool) -> DataFrame:
    rows = models.folds(_known(spark, sf_dir), "id")
    return rounded(paths.fold_predictions(rows, "id", ["n_orders"], "lab_b", "fold", reverse=reverse), 4)


_FOLDED = ", f AS (SELECT id, n_orders AS x, lab_b AS t, ('0x' || substr(md5('0|' || id), 1, 8))::BIGINT % 5 AS fold FROM cohort WHERE lab_b IS NOT NULL), r AS (SELECT * FROM range(0, 5) AS t(run)) "


@query(
    "fold_protocol",
    COHORT + _FOLDED + ", m AS (SELECT run, regr_slope(t, x) AS b, regr_intercept(t, x) AS c FROM f, r WHERE fold <> run GROUP BY run) SELECT run, id, t AS actual, round_even(c + b * x, 4) AS predicted FROM f JOIN m ON fold = run"
)
def fold_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold is predicted by a regressor that learned from the others."""
    return _folded(spark, sf_dir, False)


@query(
    "fold_to_others",
    COHORT + _FOLDED + ", m AS (SELECT run, regr_slope(t, x) AS b, regr_intercept(t, x) AS c FROM f, r WHERE fold = run GROUP BY run) SELECT run, id, t AS actual, round_even(c + b * x, 4) AS predicted FROM f JOIN m ON fold <> run"
)
def fold_to_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each other fold is predicted by a regressor that learned from one."""
    return _folded(spark, sf_dir, True)


@query(
    "mean_absolute_attribution",
    COHORT + ", k AS (SELECT n_orders, lab_a FROM cohort WHERE lab_b IS NOT NULL), m AS (SELECT avg(n_orders) AS a, avg(lab_a) AS b FROM k) SELECT 'n_orders' AS feature, round_even(avg(abs(2 * (n_orders - a))), 6) AS mean_abs FROM k, m UNION ALL SELECT 'lab_a', round_even(avg(abs(0.5 * (lab_a - b))), 6) FROM k, m"
)
def mean_absolute_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = models.linear_attributions(_known(spark, sf_dir), {"n_orders": 2.0, "lab_a": 0.5}, "id")
    return rounded(models.mean_absolute(each, ["n_orders", "lab_a"]), 6)


_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2e0 AS r{0}"
FORMULA_SQL = COHORT + f""", k AS (SELECT lab_b AS t, lab_a * 1.5 AS f, n_orders * 20000e0 AS m FROM cohort WHERE lab_b IS NOT NULL),
r AS (SELECT *, {", ".join(_RANK.format(c) for c in "tfm")} FROM k)
SELECT round_even(1 - avg((t - f) * (t - f)) / var_pop(t), 6) AS formula_r2, round_even(avg((t - f) * (t - f)) / 1e6, 2) AS formula_mse,
  round_even(1 - avg((t - m) * (t - m)) / var_pop(t), 6) AS model_r2, round_even(avg((t - m) * (t - m)) / 1e6, 2) AS model_mse,
  round_even(corr(rt, rf), 6) AS formula_rho, round_even(corr(rt, rm), 6) AS model_rho FROM r"""


@query("formula_scores", FORMULA_SQL)
def formula_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _known(spark, sf_dir).withColumn("guess", F.col("n_orders") * 20000.0)
    found = statistics.formula_against_model(rows, F.col("lab_a") * 1.5, "lab_b", "guess")
    return found.select(*[(F.bround(F.col(c) / 1e6, 2) if c.endswith("mse") else F.bround(c, 6)).alias(c) for c in found.columns])


@query(
    "thresholded_rates",
    COHORT + ", k AS (SELECT lab_b > 300000 AS y, lab_a > 150000 AS p FROM cohort WHERE lab_b IS NOT NULL) SELECT round_even(count(*) FILTER (y AND p) / count(*) FILTER (y)::DOUBLE, 6) AS sensitivity, round_even(count(*) FILTER (NOT y AND NOT p) / count(*) FILTER (NOT y)::DOUBLE, 6) AS specificity, round_even(avg((y = p)::INT), 6) AS accuracy, count(*) AS n FROM k"
)
def thresholded_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regression's score taken as a class by a cut."""
    rows = _known(spark, sf_dir).withColumn("label", (F.col("lab_b") > 300000).cast("int"))
    return rounded(statistics.rates(statistics.thresholded(rows, "lab_a", 150000.0000001), "label", "predicted"), 6)


_Z = ", k AS (SELECT id, balance, lab_a, lab_b FROM cohort WHERE lab_b IS NOT NULL), z AS (SELECT id, balance, (lab_a - avg(lab_a) OVER ()) / stddev_pop(lab_a) OVER () AS a, (lab_b - avg(lab_b) OVER ()) / stddev_pop(lab_b) OVER () AS b FROM k) "


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prep.standardise(cohort(spark, sf_dir).where("lab_b IS NOT NULL").select("id", "balance", "lab_a", "lab_b"), ["lab_a", "lab_b"])
    return cluster.principal_components(rows, ["lab_a_z", "lab_b_z"], 2)[0]


@query(
    "principal_components",
    COHORT + _Z + "SELECT id, round_even(abs(a + b) / sqrt(2e0), 5) AS pc1, round_even(abs(a - b) / sqrt(2e0), 5) AS pc2 FROM z"
)
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two standardised columns that correlate positively; sizes, as signs are a convention."""
    return rounded(_pair(spark, sf_dir).select("id", F.abs("pc1").alias("pc1"), F.abs("pc2").alias("pc2")), 5)


@query(
    "supplementary_variables",
    COHORT + _Z + "SELECT 'balance' AS variable, 'pc1' AS component, round_even(abs(corr(balance, a + b)), 5) AS r FROM z UNION ALL SELECT 'balance', 'pc2', round_even(abs(corr(balance, a - b)), 5) FROM z"
)
def supplementary_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster.supplementary(_pair(spark, sf_dir), ["pc1", "pc2"], ["balance"])
    return rounded(found.withColumn("r", F.abs("r")), 5)


@query(
    "canonical_clusters",
    COHORT + ", k AS (SELECT id, nation % 4 AS raw, balance, lab_b FROM cohort WHERE lab_b IS NOT NULL), o AS (SELECT raw, row_number() OVER (ORDER BY avg((balance + lab_b) / 2), raw) - 1 AS cluster FROM k GROUP BY raw) SELECT id, cluster::INT AS cluster FROM k JOIN o USING (raw)",
)
def canonical_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters numbered by their mean, whatever their labels were."""
    rows = cohort(spark, sf_dir).where("lab_b IS NOT NULL").select("id", (F.col("nation") % 4).alias("raw"), "balance", "lab_b")
    return cluster.canonical_labels(rows, "raw", ["balance", "lab_b"]).select("id", "cluster")
