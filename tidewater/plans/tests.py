"""Queries of statistical tests, metrics and pairs of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.operators import pairs, prep, statistics
from tidewater.plans.cohort import COHORT, cohort
from tidewater.plans.registry import query, rounded, table

_U = COHORT + """, p AS (SELECT a.study_group AS group_1, b.study_group AS group_2 FROM (SELECT DISTINCT study_group FROM cohort) a JOIN (SELECT DISTINCT study_group FROM cohort) b ON a.study_group < b.study_group),
r AS (SELECT group_1, group_2, study_group, lab_b, rank() OVER w + (count(*) OVER (PARTITION BY group_1, group_2, lab_b) - 1) / 2e0 AS rk, count(*) OVER (PARTITION BY group_1, group_2, lab_b) AS t
FROM p JOIN cohort ON study_group IN (group_1, group_2) WHERE lab_b IS NOT NULL WINDOW w AS (PARTITION BY group_1, group_2 ORDER BY lab_b)),
u AS (SELECT group_1, group_2, count(*) FILTER (study_group = group_1) AS n_1, count(*) FILTER (study_group = group_2) AS n_2, sum(rk) FILTER (study_group = group_1) AS r1, sum(t * t - 1e0) AS ties FROM r GROUP BY ALL),
v AS (SELECT *, r1 - n_1 * (n_1 + 1) / 2e0 AS u_statistic, sqrt(n_1 * n_2 / 12e0 * (n_1 + n_2 + 1 - ties / ((n_1 + n_2) * (n_1 + n_2 - 1e0)))) AS s FROM u) """


@query(
    "mann_whitney_pairs",
    _U + "SELECT group_1, group_2, n_1, n_2, u_statistic, round_even(greatest(abs(u_statistic - n_1 * n_2 / 2e0) - 0.5, 0) / s, 6) AS z FROM v"
)
def mann_whitney_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        statistics.pairwise_u(cohort(spark, sf_dir), "study_group", "lab_b").select("group_1", "group_2", "n_1", "n_2", "u_statistic", "z"),
        6
    )


@query("pairwise_auroc", _U + "SELECT group_1, group_2, round_even(1 - u_statistic / (n_1 * n_2), 6) AS auroc FROM v")
def pairwise_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.pairwise_u(cohort(spark, sf_dir), "study_group", "lab_b").select("group_1", "group_2", "auroc"), 6)


_R = COHORT + ", k AS (SELECT *, rank() OVER (ORDER BY lab_b) + (count(*) OVER (PARTITION BY lab_b) - 1) / 2e0 AS rk, count(*) OVER (PARTITION BY lab_b) AS t FROM cohort WHERE lab_b IS NOT NULL) "


@query(
    "one_vs_rest_u",
    _R
    + """, g AS (SELECT nation AS level, count(*) AS n_level, sum(rk) AS r, (SELECT count(*) FROM k) AS n, (SELECT sum(t * t - 1e0) FROM k) AS ties FROM k GROUP BY nation HAVING count(*) >= 15)
SELECT level, n_level, r - n_level * (n_level + 1) / 2e0 AS u_statistic, round_even(greatest(abs(r - n_level * (n_level + 1) / 2e0 - n_level * (n - n_level) / 2e0) - 0.5, 0) / sqrt(n_level * (n - n_level) / 12e0 * (n + 1 - ties / (n * (n - 1e0)))), 6) AS z FROM g""",
)
def one_vs_rest_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.one_vs_rest_u(cohort(spark, sf_dir), "nation", "lab_b").select("level", "n_level", "u_statistic", "z"), 6)


@query(
    "kruskal",
    _R
    + """, g AS (SELECT study_group, sum(rk) AS r, count(*) AS n FROM k GROUP BY study_group), a AS (SELECT sum(n) AS n, sum(r * r / n) AS s, count(*) - 1 AS dof FROM g), c AS (SELECT sum(t * t - 1e0) AS ties FROM k)
SELECT round_even((12e0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n::DOUBLE * n * n - n)), 6) AS h, dof, n::BIGINT AS n FROM a, c""",
)
def kruskal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.kruskal(cohort(spark, sf_dir), "study_group", "lab_b").select("h", "dof", "n"), 6)


@query(
    "chi_square",
    """WITH o AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS o FROM orders GROUP BY ALL), r AS (SELECT a, sum(o) AS r FROM o GROUP BY a), c AS (SELECT b, sum(o) AS c FROM o GROUP BY b),
e AS (SELECT coalesce(o, 0) AS o, r * c / (SELECT sum(o) FROM o)::DOUBLE AS e FROM r CROSS JOIN c LEFT JOIN o USING (a, b))
SELECT round_even(sum((o - e) * (o - e) / e), 6) AS chi2, ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS dof FROM e""",
)
def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.chi_square(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus").select("chi2", "dof"), 6)


_RANK2 = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2e0"


@query(
    "spearman",
    COHORT + f", k AS (SELECT {_RANK2.format('lab_a')} AS x, {_RANK2.format('lab_u')} AS y FROM cohort WHERE lab_a IS NOT NULL AND lab_u IS NOT NULL) SELECT round_even(corr(x, y), 6) AS rho, count(*) AS n FROM k"
)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.spearman(cohort(spark, sf_dir), "lab_a", "lab_u").select("rho", "n"), 6)


@query(
    "spearman_bonferroni",
    COHORT
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round_even(corr(x, y), 6) AS rho, count(*) AS n FROM (SELECT {_RANK2.format(c)} AS x, {_RANK2.format('lab_b')} AS y FROM cohort WHERE {c} IS NOT NULL AND lab_b IS NOT NULL)" for c in ("balance", "n_orders", "lab_a", "lab_u")
    ),
)
def spearman_bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        statistics.spearman_table(cohort(spark, sf_dir), ["balance", "n_orders", "lab_a", "lab_u"], "lab_b").select("feature", "rho", "n"),
        6
    )


@query(
    "ols_line",
    COHORT + "SELECT study_group, round_even(regr_slope(lab_b, lab_a), 6) AS slope, round_even(regr_intercept(lab_b, lab_a), 4) AS intercept, regr_count(lab_b, lab_a)::BIGINT AS n FROM cohort GROUP BY study_group"
)
def ols_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statistics.ols_line(cohort(spark, sf_dir), "lab_a", "lab_b", ["study_group"])
    return rows.select("study_group", F.bround("slope", 6).alias("slope"), F.bround("intercept", 4).alias("intercept"), "n")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


_S = "WITH s AS (SELECT doc_id, quality AS y, n_chars AS x, lang FROM labels JOIN documents USING (doc_id)), c AS (SELECT x AS threshold, sum(y) AS p, sum(1 - y) AS q FROM s GROUP BY x), t AS (SELECT *, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(q) OVER (ORDER BY threshold DESC) AS fp, sum(p) OVER () AS pos, sum(q) OVER () AS neg FROM c) "


@query(
    "roc_points",
    _S + "SELECT threshold, round_even(tp / nullif(pos, 0)::DOUBLE, 9) AS tpr, round_even(fp / nullif(neg, 0)::DOUBLE, 9) AS fpr FROM t"
)
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.roc_points(_scored(spark, sf_dir), "quality", "n_chars"))


@query(
    "average_precision",
    _S + "SELECT round_even(sum(tp::DOUBLE / (tp + fp) * p / pos), 9) AS average_precision, max(pos)::BIGINT AS n_positive, (max(pos) + max(neg))::BIGINT AS n FROM t"
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.average_precision(_scored(spark, sf_dir), "quality", "n_chars"))


@query(
    "confusion",
    "SELECT quality AS actual, (n_chars >= 500)::INT AS predicted, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL"
)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.confusion(_scored(spark, sf_dir).withColumn("guess", F.col("n_chars") >= 500), "quality", "guess")


@query(
    "sens_spec",
    "SELECT lang, round_even(avg((n_chars >= 500)::INT::DOUBLE) FILTER (quality = 1), 9) AS sensitivity, round_even(avg((n_chars < 500)::INT::DOUBLE) FILTER (quality = 0), 9) AS specificity, round_even(avg(((n_chars >= 500)::INT = quality)::INT::DOUBLE), 9) AS accuracy, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang",
)
def sens_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("guess", (F.col("n_chars") >= 500).cast("int"))
    return rounded(statistics.rates(rows, "quality", "guess", ["lang"]))


@query(
    "r2_mse",
    "SELECT l_returnflag, round_even(1 - avg(pow(l_extendedprice - l_quantity * 2500e0, 2)) / var_pop(l_extendedprice), 6) AS r2, round_even(avg(pow(l_extendedprice - l_quantity * 2500e0, 2)), 0) AS mse, count(*) AS n FROM lineitem GROUP BY l_returnflag"
)
def r2_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("guess", F.col("l_quantity") * 2500.0)
    return statistics.regression_scores(rows, "l_extendedprice", "guess", ["l_returnflag"]).select(
        "l_returnflag", F.bround("r2", 6).alias("r2"), F.bround("mse", 0).alias("mse"), "n"
    )


@query(
    "subgroup_scores",
    COHORT + ", f AS (SELECT regr_slope(lab_b, lab_a) AS m, regr_intercept(lab_b, lab_a) AS c FROM cohort WHERE split = 'train') SELECT study_group, round_even(1 - avg(pow(lab_b - (m * lab_a + c), 2)) / var_pop(lab_b), 6) AS r2, count(*) AS n FROM cohort, f WHERE split = 'test' AND lab_a IS NOT NULL GROUP BY study_group"
)
def subgroup_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line fitted to all training rows, scored by subgroup of the test rows."""
    rows = cohort(spark, sf_dir)
    line = statistics.ols_line(rows.where("split = 'train'"), "lab_a", "lab_b").first()
    test = rows.where("split = 'test' AND lab_a IS NOT NULL").withColumn("guess", F.col("lab_a") * line["slope"] + line["intercept"])
    return rounded(statistics.regression_scores(test, "lab_b", "guess", ["study_group"]).select("study_group", "r2", "n"), 6)


@query(
    "linear_attribution",
    COHORT + ", f AS (SELECT regr_slope(lab_b, lab_a) AS m, avg(lab_a) AS a FROM cohort WHERE split = 'train') SELECT study_group, round_even(avg(abs(m * (lab_a - a))), 4) AS mean_abs_shap FROM cohort, f GROUP BY study_group"
)
def linear_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohort(spark, sf_dir)
    fit = rows.where("split = 'train'").agg(F.regr_slope("lab_b", "lab_a").alias("m"), F.avg("lab_a").alias("a")).first()
    return rounded(rows.groupBy("study_group").agg(F.avg(F.abs(fit["m"] * (F.col("lab_a") - fit["a"]))).alias("mean_abs_shap")), 4)


@query(
    "delta_vs_baseline",
    "WITH m AS (SELECT o_orderpriority AS scenario, o_orderstatus AS study_group, avg(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT a.scenario, a.study_group, round_even(a.v - b.v, 5) AS delta FROM m a JOIN m b ON a.study_group = b.study_group AND b.scenario = '1-URGENT'"
)
def delta_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("scenario"), F.col("o_orderstatus").alias("study_group")
    ).agg(F.avg("o_totalprice").alias("v"))
    base = m.where("scenario = '1-URGENT'").select("study_group", F.col("v").alias("b"))
    return m.join(base, "study_group").select("scenario", "study_group", F.bround(F.col("v") - F.col("b"), 5).alias("delta"))


@query(
    "adjusted_rand",
    """WITH c AS (SELECT c_mktsegment AS a, c_nationkey % 5 AS b, count(*) AS n FROM customer GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2e0) AS s FROM c), r AS (SELECT sum(m * (m - 1) / 2e0) AS s FROM (SELECT sum(n) AS m FROM c GROUP BY a)),
l AS (SELECT sum(m * (m - 1) / 2e0) AS s FROM (SELECT sum(n) AS m FROM c GROUP BY b)), t AS (SELECT sum(n) * (sum(n) - 1) / 2e0 AS s FROM c)
SELECT round_even((x.s - r.s * l.s / t.s) / ((r.s + l.s) / 2 - r.s * l.s / t.s), 9) AS ari FROM x, r, l, t""",
)
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.adjusted_rand(cohort(spark, sf_dir).withColumn("other", F.col("nation") % 5), "study_group", "other"))


@query(
    "corr_matrix",
    COHORT + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round_even(corr({a}, {b}), 9) AS r FROM cohort" for i,
        a in enumerate(("balance", "lab_a", "lab_b", "lab_u")) for b in ("balance", "lab_a", "lab_b", "lab_u")[i + 1 :]
    )
)
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.correlations(cohort(spark, sf_dir), ["balance", "lab_a", "lab_b", "lab_u"]))


@query(
    "zscore_outliers",
    COHORT
    + """, z AS (SELECT id, (lab_a - avg(lab_a) OVER ()) / stddev_pop(lab_a) OVER () AS lab_a_z, (lab_u - avg(lab_u) OVER ()) / stddev_pop(lab_u) OVER () AS lab_u_z FROM cohort)
SELECT id, round_even(lab_a_z, 6) AS lab_a_z, round_even(lab_u_z, 6) AS lab_u_z, concat_ws(';', CASE WHEN abs(lab_a_z) > 1.5 THEN 'lab_a_z' END, CASE WHEN abs(lab_u_z) > 1.5 THEN 'lab_u_z' END) AS trigger_features FROM z WHERE abs(lab_a_z) > 1.5 OR abs(lab_u_z) > 1.5""",
)
def zscore_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = prep.standardise(cohort(spark, sf_dir), ["lab_a", "lab_u"])
    return rounded(statistics.outliers(z, "id", ["lab_a_z", "lab_u_z"], limit=1.5), 6)


_D = "WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT a.id AS i, b.id AS j, a.label AS la, b.label AS lb, list_distance(a.x, b.x) AS d FROM e a JOIN e b ON a.id <> b.id) "


@query(
    "silhouette",
    _D + ", m AS (SELECT i, la, lb, avg(d) AS d FROM p GROUP BY ALL), s AS (SELECT i, la, max(d) FILTER (la = lb) AS a, min(d) FILTER (la <> lb) AS b FROM m GROUP BY ALL) SELECT la::BIGINT AS cluster, count(*) AS n, round_even(avg(coalesce((b - a) / greatest(a, b), 0)), 9) AS silhouette FROM s GROUP BY la",
)
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = pairs.silhouette(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return rounded(each.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("silhouette").alias("silhouette")))


@query(
    "avg_linkage",
    _D
    + """, w AS (SELECT la, avg(d) AS d FROM p WHERE la = lb GROUP BY la), b AS (SELECT la, lb, avg(d) AS d FROM p WHERE la < lb GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM e GROUP BY label)
SELECT b.la::BIGINT AS cluster_a, b.lb::BIGINT AS cluster_b, x.n AS n_a, y.n AS n_b, round_even(u.d, 9) AS intra_dist_a, round_even(v.d, 9) AS intra_dist_b, round_even(b.d, 9) AS avg_linkage_distance, round_even(b.d / ((u.d + v.d) / 2), 9) AS separation_ratio
FROM b JOIN w u ON u.la = b.la JOIN w v ON v.la = b.lb JOIN n x ON x.label = b.la JOIN n y ON y.label = b.lb""",
)
def avg_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.linkage(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"))


_K = _D + ", k AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM p), g AS (SELECT least(i, j) AS a, greatest(i, j) AS b, max(d) AS d FROM k WHERE r <= 5 GROUP BY ALL) "


@query("knn_graph", _K + "SELECT a, b, round_even(d, 9) AS d, round_even(exp(-d * d / (2 * (SELECT median(d) * median(d) FROM g))), 9) AS w FROM g")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.affinity(pairs.neighbour_graph(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5)))


@query(
    "connected_components",
    _D
    + """, g AS (SELECT i AS a, j AS b FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM p) WHERE r <= 1), h AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
f AS (WITH RECURSIVE t(id, c) AS (SELECT id, id FROM e UNION SELECT t.id, h.b FROM t JOIN h ON h.a = t.c) SELECT id, min(c) AS component FROM t GROUP BY id) SELECT id, component FROM f""",
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    edges = pairs.neighbour_graph(vectors, "vec_id", "embedding", 1)
    return pairs.components(vectors.select(F.col("vec_id").alias("id")), edges)
