"""Queries of relational preparation: customers are participants, their orders laboratory values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.functions.numeric import half_even, ratio
from tidewater.operators import prep, statistics
from tidewater.plans.registry import query, rounded, table
from tidewater.sources import io

URGENT = "1-URGENT"


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a participant: id, group, split, and laboratory values, some unknown."""
    o = table(spark, sf_dir, "orders")
    urgent = F.col("o_orderpriority") == URGENT
    labs = o.groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("lab_a"), F.max("o_totalprice").alias("lab_b"), F.avg(F.when(urgent, F.col("o_totalprice"))).alias("lab_u"), F.count_if(urgent).alias("n_urgent")
    )
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("study_group"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance")
    )
    joined = c.join(labs, c.id == labs.o_custkey, "left").drop("o_custkey")
    return joined.withColumn("split", prep.split_of(F.col("id"))).withColumn(
        "qc", F.when(F.col("n_urgent") > 0, F.least(F.col("n_urgent") * 35.0, F.lit(100.0)))
    )


COHORT = f"""WITH cohort AS (SELECT c_custkey AS id, c_mktsegment AS study_group, c_nationkey AS nation, c_acctbal AS balance, n_orders, lab_a, lab_b, lab_u, n_urgent,
CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN n_urgent > 0 THEN least(n_urgent * 35e0, 100e0) END AS qc
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS lab_a, max(o_totalprice) AS lab_b, avg(o_totalprice) FILTER (o_orderpriority = '{URGENT}') AS lab_u,
count(*) FILTER (o_orderpriority = '{URGENT}') AS n_urgent FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey) """


@query(
    "cohort_table",
    COHORT + "SELECT id, study_group, nation, balance, n_orders, round_even(lab_a, 6) AS lab_a, lab_b, round_even(lab_u, 6) AS lab_u, n_urgent, split, qc FROM cohort"
)
def cohort_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cohort(spark, sf_dir), 6)


@query("qc_gate_keep_null", COHORT + "SELECT id, qc FROM cohort WHERE qc IS NULL OR qc >= 70")
def qc_gate_keep_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.quality_gate(cohort(spark, sf_dir), "qc").select("id", "qc")


@query("qc_gate_strict", COHORT + "SELECT id, qc FROM cohort WHERE qc >= 70")
def qc_gate_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.quality_gate(cohort(spark, sf_dir), "qc", keep_unknown=False).select("id", "qc")


@query("excluded_rows", COHORT + "SELECT id, qc FROM cohort WHERE qc IS NULL OR qc < 70")
def excluded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohort(spark, sf_dir)
    return prep.excluded(rows, prep.quality_gate(rows, "qc", keep_unknown=False), "id").select("id", "qc")


@query(
    "median_impute_by_split",
    COHORT + "SELECT id, split, round_even(coalesce(lab_u, median(lab_u) OVER (PARTITION BY split)), 6) AS lab_u, round_even(coalesce(qc, median(qc) OVER (PARTITION BY split)), 6) AS qc FROM cohort"
)
def median_impute_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prep.impute_by_group(cohort(spark, sf_dir), "split", ["lab_u", "qc"]).select("id", "split", "lab_u", "qc"), 6)


@query(
    "bmi_bins",
    """SELECT p_partkey AS id, p_size / 1e0 AS bmi, CASE WHEN p_size < 18.5 THEN 'underweight' WHEN p_size < 25 THEN 'healthy' WHEN p_size < 30 THEN 'overweight' ELSE 'obese' END AS weight_class,
CASE WHEN p_size / 5e0 < 5.7 THEN 'normal' WHEN p_size / 5e0 < 6.5 THEN 'prediabetes' ELSE 'diabetes' END AS hba1c_class FROM part""",
)
def bmi_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bmi = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), bmi.alias("bmi"), prep.bmi_class(bmi).alias("weight_class"),
        prep.hba1c_class(bmi / 5.0).alias("hba1c_class")
    )


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "dummy_encode",
    "SELECT c_custkey AS id, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS study_group_{s}" for s in SEGMENTS[1:]) + " FROM customer"
)
def dummy_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prep.dummies(cohort(spark, sf_dir), "study_group", SEGMENTS)
    return rows.select("id", *[f"study_group_{s}" for s in SEGMENTS[1:]])


@query(
    "one_hot_collapse",
    "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_returnflag = 'N' THEN 'N' WHEN l_returnflag = 'R' THEN 'R' ELSE 'N' END AS race FROM lineitem"
)
def one_hot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        *[(F.col("l_returnflag") == c).cast("int").alias(f"race_{c}") for c in "NR"]
    )
    return prep.collapse_one_hot(flags, "race_", "race").select("id", "line", "race")


@query(
    "safe_ratio",
    COHORT + "SELECT id, round_even(lab_b / nullif(balance, 0), 6) AS lab_ratio, round_even(100e0 * n_urgent / nullif(n_orders, 0), 6) AS urgent_pct FROM cohort"
)
def safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        cohort(spark, sf_dir).select(
            "id", ratio(F.col("lab_b"), F.col("balance")).alias("lab_ratio"),
            ratio(100.0 * F.col("n_urgent"), F.col("n_orders")).alias("urgent_pct")
        ),
        6
    )


@query(
    "strata_keys",
    COHORT + "SELECT id, coalesce(nation::VARCHAR, 'nan') || '_' || study_group AS strata_nation, coalesce(split, 'nan') || '_' || study_group AS strata_split FROM cohort"
)
def strata_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.strata(cohort(spark, sf_dir), "study_group", nation="nation", split="split").select("id", "strata_nation", "strata_split")


@query(
    "category_merge",
    COHORT + "SELECT id, CASE WHEN study_group IN ('BUILDING', 'FURNITURE') THEN 'Other' ELSE study_group END AS merged, CASE split WHEN 'train' THEN 'learn' ELSE split END AS part, (study_group = 'MACHINERY')::INT AS target FROM cohort",
)
def category_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = prep.merge_categories(F.col("study_group"), ["BUILDING", "FURNITURE"], "Other")
    return cohort(spark, sf_dir).select(
        "id", merged.alias("merged"), prep.renamed_values(F.col("split"), {"train": "learn"}).alias("part"),
        (F.col("study_group") == "MACHINERY").cast("int").alias("target")
    )


@query("row_minimum", COHORT + "SELECT id, least(lab_a, lab_u) AS lowest, round_even(ln(1 + lab_b), 6) AS log_lab FROM cohort")
def row_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir).select("id", F.least("lab_a", "lab_u").alias("lowest"), half_even(F.log1p("lab_b")).alias("log_lab"))


@query(
    "zscore_columns",
    COHORT + "SELECT id, round_even((balance - avg(balance) OVER ()) / stddev_pop(balance) OVER (), 6) AS balance_z, round_even((lab_u - avg(lab_u) OVER ()) / stddev_pop(lab_u) OVER (), 6) AS lab_u_z, round_even((lab_b - avg(lab_b) OVER ()) / stddev_samp(lab_b) OVER (), 6) AS lab_b_s FROM cohort",
)
def zscore_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = prep.standardise(cohort(spark, sf_dir), ["balance", "lab_u"])
    return rounded(prep.standardise(z, ["lab_b"], population=False, suffix="_s").select("id", "balance_z", "lab_u_z", "lab_b_s"), 6)


@query(
    "train_quantile_label",
    COHORT + "SELECT id, split, (lab_b >= (SELECT quantile_cont(lab_b, 0.9) FROM cohort WHERE split = 'train'))::INT AS label FROM cohort"
)
def train_quantile_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.quantile_label(cohort(spark, sf_dir), "lab_b", 0.9, F.col("split") == "train").select("id", "split", "label")


@query(
    "feature_merge",
    COHORT + "SELECT id, study_group, n, round_even(value, 9) AS lab_a FROM cohort LEFT JOIN (SELECT user_id, count(*) AS n, avg(value) AS value FROM events GROUP BY user_id) ON user_id = id"
)
def feature_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.avg("value").alias("lab_a"))
    return rounded(prep.merge_features(cohort(spark, sf_dir), features, "id").select("id", "study_group", "n", "lab_a"))


@query(
    "assignment_join_integrity",
    "SELECT o_orderkey AS id, o_custkey AS participant, c_mktsegment AS study_group FROM orders JOIN customer ON c_custkey = o_custkey"
)
def assignment_join_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("participant"))
    groups = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("participant"), F.col("c_mktsegment").alias("study_group"))
    return prep.join_assignments(orders, groups, "participant").select("id", "participant", "study_group")


@query(
    "elapsed_slice",
    "SELECT event_id, round_even((epoch_us(ts) - u0) / 86400e6, 6) AS elapsed_days FROM (SELECT event_id, ts, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS u0 FROM events) WHERE (epoch_us(ts) - u0) / 86400e6 >= 1 AND (epoch_us(ts) - u0) / 86400e6 < 3",
)
def elapsed_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prep.elapsed_days(table(spark, sf_dir, "events"), "user_id", "ts", 1, 3).select("event_id", "elapsed_days"), 6)


@query(
    "overnight_readings",
    "SELECT event_id, hour(ts) + minute(ts) / 60e0 AS hour_of_day, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE hour(ts) < 6 AND event_type IN ('click', 'error')"
)
def overnight_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.functions.numeric import hour_of_day

    rows = table(spark, sf_dir, "events").where((F.hour("ts") < 6) & F.col("event_type").isin("click", "error"))
    return rows.select("event_id", hour_of_day(F.col("ts")).alias("hour_of_day"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query(
    "group_profile",
    COHORT + "SELECT study_group, split, count(*) AS n, round_even(avg(lab_a), 6) AS lab_a, round_even(avg(balance), 6) AS balance, round_even(median(lab_b), 6) AS median_b, round_even(quantile_cont(lab_b, 0.75) - quantile_cont(lab_b, 0.25), 6) AS iqr_b FROM cohort GROUP BY study_group, split"
)
def group_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("lab_b", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = cohort(spark, sf_dir).groupBy("study_group", "split").agg(
        F.count("*").alias("n"), F.avg("lab_a").alias("lab_a"), F.avg("balance").alias("balance"), p[1].alias("median_b"),
        (p[2] - p[0]).alias("iqr_b")
    )
    return rounded(rows, 6)


@query(
    "modal_group_share",
    "WITH c AS (SELECT c_nationkey AS nation, c_mktsegment AS g, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY n DESC, g) AS i, sum(n) OVER (PARTITION BY nation) AS t FROM c) SELECT nation, g AS modal, round_even(100e0 * n / t, 6) AS modal_pct, t::BIGINT AS n FROM r WHERE i = 1",
)
def modal_group_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.modal_share(cohort(spark, sf_dir), "nation", "study_group"), 6)


@query(
    "crosstab",
    "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag"
)
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return wide.na.fill(0)


@query(
    "scenario_pivot",
    "SELECT o_orderpriority AS scenario, " + ", ".join(
        f"round_even(avg(o_totalprice) FILTER (o_orderstatus = '{s}'), 6) AS {s}" for s in "FOP"
    ) + " FROM orders GROUP BY o_orderpriority"
)
def scenario_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        table(spark, sf_dir, "orders").groupBy(
            F.col("o_orderpriority").alias("scenario")
        ).pivot("o_orderstatus", list("FOP")).agg(F.avg("o_totalprice")),
        6
    )


@query(
    "hour_profile",
    "SELECT hour, count(value) AS n, round_even(avg(value), 6) AS mean, round_even(avg(CASE WHEN value < 70 THEN 100e0 WHEN value >= 70 THEN 0e0 END), 6) AS low_pct FROM (SELECT unnest(range(24))::INT AS hour) LEFT JOIN (SELECT hour(ts)::INT AS hour, value FROM events WHERE event_type = 'click') USING (hour) GROUP BY hour",
)
def hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'")
    means = clicks.groupBy(F.hour("ts").alias("hour")).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.avg(F.when(F.col("value") < 70, 100.0).otherwise(0.0)).alias("low_pct")
    )
    return rounded(hours.join(means, "hour", "left").na.fill(0, ["n"]), 6)


@query(
    "distinct_counts",
    "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT ts::DATE) AS days, count(*) AS n FROM events GROUP BY event_type"
)
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"), F.count("*").alias("n")
    )


@query("value_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.value_counts(table(spark, sf_dir, "part"), "p_type")


@query(
    "descriptive_summary",
    COHORT + "SELECT study_group, count(balance) AS n, round_even(avg(balance), 6) AS mean, round_even(stddev_samp(balance), 6) AS sd, min(balance) AS low, round_even(quantile_cont(balance, 0.25), 6) AS q1, round_even(median(balance), 6) AS q2, round_even(quantile_cont(balance, 0.75), 6) AS q3, max(balance) AS high FROM cohort GROUP BY study_group"
)
def descriptive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("balance", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = cohort(spark, sf_dir).groupBy("study_group").agg(
        F.count("balance").alias("n"), F.avg("balance").alias("mean"), F.stddev_samp("balance").alias("sd"), F.min("balance").alias("low"), q[0].alias("q1"), q[1].alias("q2"), q[2].alias("q3"), F.max("balance").alias("high")
    )
    return rounded(rows, 6)


@query(
    "best_and_worst",
    "SELECT o_custkey AS participant, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS worst FROM orders GROUP BY o_custkey"
)
def best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.struct("o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("participant")).agg(
        F.max_by("o_orderkey", by).alias("best"), F.min_by("o_orderkey", by).alias("worst")
    )


@query(
    "top_values",
    "SELECT id, price FROM (SELECT o_orderkey AS id, o_totalprice AS price FROM orders) ORDER BY abs(price - 200000) DESC, id LIMIT 10"
)
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")
    ).orderBy(F.abs(F.col("price") - 200000).desc(), "id").limit(10)


@query("union_distinct", "SELECT nation FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY nation")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return customers.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))).dropDuplicates(["nation"])


@query("category_order", "SELECT c_custkey AS id, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END AS place FROM customer")
def category_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = spark.createDataFrame([("MACHINERY", 0), ("BUILDING", 1)], "study_group string, place int")
    rows = cohort(spark, sf_dir).select("id", "study_group").join(order, "study_group", "left")
    return rows.select("id", F.coalesce("place", F.lit(2)).alias("place"))


@query(
    "cluster_target_score",
    COHORT
    + """, m AS (SELECT nation, avg(balance) AS a, avg(lab_a) AS b FROM cohort GROUP BY nation),
z AS (SELECT nation, coalesce((a - avg(a) OVER ()) / nullif(stddev_pop(a) OVER (), 0), 0) + coalesce((b - avg(b) OVER ()) / nullif(stddev_pop(b) OVER (), 0), 0) AS score FROM m)
SELECT nation, round_even(score, 6) AS score, row_number() OVER (ORDER BY score, nation) - 1 AS canonical FROM z""",
)
def cluster_target_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    means = cohort(spark, sf_dir).groupBy("nation").agg(F.avg("balance").alias("a"), F.avg("lab_a").alias("b"))
    z = prep.standardise(means, ["a", "b"]).withColumn("score", F.coalesce("a_z", F.lit(0.0)) + F.coalesce("b_z", F.lit(0.0)))
    # One row a cluster: the window without a key orders that table only.
    return rounded(z.select("nation", "score", (F.row_number().over(Window.orderBy("score", "nation")) - 1).cast("long").alias("canonical")), 6)
