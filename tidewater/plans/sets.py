"""Queries of feature sets and scenarios: lists made from column names, and what the cohort has of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.operators import glucose, prep, selection, series
from tidewater.plans.cohort import COHORT, cohort
from tidewater.plans.registry import ORACLES, query, rounded, table
from tidewater.plans.series import RAW, USERS

COLUMNS = [
    "id", "study_group", "age", "bmi", "race_a", "race_b", "sex_f", "avg_daily_steps", "import_glucose", "import_insulin",
    "import_c_peptide", "import_hdl", "mage", "modd"
]
#: The cohort under the names that feature sets are made from: columns of the cohort, as SQL.
NAMED = {
    "age": "n_orders", "bmi": "lab_a / 1e4", "race_a": "nation % 2", "race_b": "1 - nation % 2", "sex_f": "id % 2", "avg_daily_steps": "n_urgent",
    "import_glucose": "lab_b", "import_insulin": "lab_u", "import_c_peptide": "qc", "import_hdl": "balance", "mage": "lab_b - lab_a", "modd": "lab_a - lab_u",
}


def _listed(spark: SparkSession, sf_dir: str, stages: dict[str, list[str]]) -> DataFrame:
    """The features of every set in order, with how many participants have them and their mean: one
    aggregation over the cohort, whatever the sets."""
    rows = cohort(spark, sf_dir).select(*[F.expr(e.replace("1e4", "1e4D")).cast("double").alias(c) for c, e in NAMED.items()])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.count(c).alias("n_known"), F.avg(c).alias("mean")) for c in NAMED])
    found = rows.agg(cells.alias("cells")).select(F.inline("cells"))
    listed = spark.createDataFrame([(s, i, c) for s, names in stages.items() for i, c in enumerate(names)], "stage string, place int, feature string")
    return rounded(listed.join(F.broadcast(found), "feature", "left"), 6)


def _values(**stages: str) -> str:
    rows = ", ".join(f"('{s.lstrip('_')}', {i}, '{c}')" for s, names in stages.items() for i, c in enumerate(names.split()))
    named = ", ".join(f"({e})::DOUBLE AS {c}" for c, e in NAMED.items())
    return (
        COHORT + f", n AS (SELECT {named} FROM cohort), u AS (UNPIVOT INCLUDE NULLS n ON {', '.join(NAMED)} INTO NAME feature VALUE v), "
        f"f AS (SELECT feature, count(v) AS n_known, round_even(avg(v), 6) AS mean FROM u GROUP BY feature) "
        f"SELECT stage, place, t.feature, n_known, mean FROM (VALUES {rows}) AS t(stage, place, feature) LEFT JOIN f ON f.feature = t.feature"
    ).replace("UNPIVOT INCLUDE NULLS n ON", "UNPIVOT n ON")


_BASE = "age race_a race_b sex_f"
_THREE = f"{_BASE} bmi avg_daily_steps"
_FOUR = f"{_THREE} import_hdl"


@query(
    "ladder",
    _values(
        _1=_BASE, _2=f"{_BASE} bmi", _3=_THREE, _4=_FOUR, _5a=f"{_FOUR} mage modd", _5b=f"{_FOUR} import_glucose",
        _6a=f"{_THREE} mage modd", _6b=f"{_THREE} import_glucose"
    )
)
def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir, selection.ladder(COLUMNS, exclude_c_peptide=True, sensor=("mage", "modd")))


_MINIMAL = "age bmi race_a race_b sex_f"


@query(
    "minimal_scenarios",
    _values(
        _1_no_glucose=_MINIMAL, _2_sensed=f"{_MINIMAL} mage modd", _3_labs=f"{_MINIMAL} import_glucose",
        _4_both=f"{_MINIMAL} mage modd import_glucose"
    )
)
def minimal_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir, selection.minimal(COLUMNS, ["mage", "modd"], ["import_glucose"]))


@query("glucose_scenarios", _values(_1_no_glucose="age", _2_sensed="age mage", _3_labs="age import_glucose", _4_both="age mage import_glucose"))
def glucose_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir, selection.glucose_scenarios(["age"], ["mage"], ["import_glucose"]))


@query(
    "one_added_scenarios",
    _values(
        _1_base="age", _2_add_import_c_peptide="age import_c_peptide", _3_add_mage="age mage",
        _4_add_import_c_peptide_mage="age import_c_peptide mage"
    )
)
def one_added_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir, selection.one_added(["age"], ["import_c_peptide", "mage"], ["import_c_peptide", "mage"]))


@query("one_added_without", _values(_1_base="age", _3_add_mage="age mage"))
def one_added_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenarios without C-peptide: what is left equal to the one before goes."""
    return _listed(
        spark, sf_dir,
        selection.without(selection.one_added(["age"], ["import_c_peptide", "mage"], ["import_c_peptide", "mage"]), "import_c_peptide")
    )


@query(
    "excluded_features",
    _values(
        all_but="age bmi race_a race_b sex_f avg_daily_steps import_insulin import_hdl",
        usable="age bmi race_a race_b sex_f avg_daily_steps import_glucose import_insulin import_c_peptide import_hdl mage modd"
    )
)
def excluded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    admin = ["id", "study_group", "split"]
    lists = {
        "all_but": selection.all_but(COLUMNS, admin, "import_glucose", ["import_c_peptide", "mage", "modd"]),
        "usable": prep.usable_features(COLUMNS, admin, "split")
    }
    return _listed(spark, sf_dir, lists)


FAMILIES = (
    "cgm_central", "cgm_percentiles", "cgm_moments", "cgm_time_in_range", "cgm_gmi_jindex", "cgm_mvalue", "cgm_risk_lbgi_hbgi",
    "cgm_gri", "cgm_circadian_windows"
)


def _lists_sql() -> str:
    """Of every feature of these families: whether it is curated, and how many users have it."""
    parts = []
    for family in FAMILIES:
        sql = ORACLES[family]
        parts.append(f"SELECT feature, value FROM (UNPIVOT (SELECT * EXCLUDE (series) FROM ({sql})) ON COLUMNS(*) INTO NAME feature VALUE value)")
    curated = ", ".join(f"'{c}'" for c in CURATED_LIST.split())
    return f"SELECT feature, feature IN ({curated}) AS curated, count(*) AS n_known FROM ({' UNION ALL '.join(parts)}) GROUP BY feature"


# The curated panel as published, beside the library's own.
CURATED_LIST = (
    "between_day_sd cosinor_acrophase_h cosinor_amplitude dawn_rise dfa_alpha kurtosis mag_per_hour mean_hyper_dur_min mean_hypo_dur_min min_glucose n_hyper_events nocturnal_hypo_pct sample_entropy skewness "
    "spectral_circadian_frac spectral_dominant_period_h spectral_entropy tbr_lt54_pct tbr_lt70_pct tir_70_180_pct"
)


@query("feature_lists", _lists_sql())
def feature_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which features of the raw families are curated, and for how many users they are known."""
    families = {n: c for f in FAMILIES for n, c in RAW[f][0]().items()}
    rows = glucose.per_series(series.readings(table(spark, sf_dir, "events"), USERS), USERS, families)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.lit(c in selection.CURATED).alias("curated"), F.count(c).alias("n_known")
            ) for c in families if c in selection.FEATURES
        ]
    )
    return rows.agg(cells.alias("cells")).select(F.inline("cells")).where("n_known > 0")


PLAIN = {
    "a_g_ratio": ("A/G ratio", "lab_a"), "a_g_ratio_2": ("a g-Ratio", "lab_b"), "column": ("%", "qc"),
    "pulse_vsorres_heart_rate_bpm": ("pulse_vsorres, Heart Rate (bpm)", "balance")
}


@query(
    "plain_names",
    COHORT + " UNION ALL ".join(
        f"SELECT '{n}' AS name, '{old}' AS old, count({c}) AS n_known, round_even(avg({c}), 6) AS mean FROM cohort" for n,
        (old, c) in PLAIN.items()
    )
)
def plain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort under awkward names, read by plain ones."""
    rows = cohort(spark, sf_dir).select(*[F.col(c).cast("double").alias(old) for old, c in PLAIN.values()])
    plain, names = prep.snake_case(rows)
    cells = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(old).alias("old"), F.count(n).alias("n_known"), F.avg(n).alias("mean")) for n, old in names.items()]
    )
    return rounded(plain.agg(cells.alias("cells")).select(F.inline("cells")), 6)


@query(
    "renamed_values",
    "SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'house' WHEN 'MACHINERY' THEN 'plant' ELSE c_mktsegment END AS study_group FROM customer"
)
def renamed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.plans.registry import table

    named = prep.renamed_values(F.col("c_mktsegment"), {"BUILDING": "house", "MACHINERY": "plant"})
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), named.alias("study_group"))


@query(
    "log_panel",
    COHORT + "SELECT id, n_orders::DOUBLE AS age, round_even(lab_a, 6) AS bmi, round_even(ln(1 + lab_b), 6) AS import_insulin, round_even(ln(1 + lab_u), 6) AS import_c_peptide, round_even(qc, 6) AS import_hba1c FROM cohort WHERE n_orders IS NOT NULL AND lab_a IS NOT NULL AND lab_b IS NOT NULL AND lab_u IS NOT NULL AND qc IS NOT NULL"
)
def log_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"n_orders": "age", "lab_a": "bmi", "lab_b": "import_insulin", "lab_u": "import_c_peptide", "qc": "import_hba1c"}
    rows = cohort(spark, sf_dir).select("id", *[F.col(a).cast("double").alias(b) for a, b in names.items()])
    return rounded(selection.panel(rows, "five"), 6)


@query(
    "constant_features",
    COHORT + "SELECT c AS feature FROM (SELECT stddev_samp(lab_a) AS a, stddev_samp(0 * lab_a) AS b, stddev_samp(lab_u) FILTER (id < 0) AS d FROM cohort), (VALUES ('lab_a'), ('flat'), ('unknown')) AS t(c) WHERE coalesce(CASE c WHEN 'lab_a' THEN a WHEN 'flat' THEN b ELSE d END, 0) = 0"
)
def constant_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohort(spark, sf_dir).withColumns({"flat": F.col("lab_a") * 0, "unknown": F.when(F.col("id") < 0, F.col("lab_u"))})
    return spark.createDataFrame([(c,) for c in selection.constant_columns(rows, ["lab_a", "flat", "unknown"])], "feature string")


@query(
    "zscore_sample",
    COHORT + "SELECT id, round_even((lab_a - avg(lab_a) OVER ()) / stddev_samp(lab_a) OVER (), 6) AS lab_a_z, round_even((qc - avg(qc) OVER ()) / stddev_samp(qc) OVER (), 6) AS qc_z FROM cohort"
)
def zscore_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prep.standardise(cohort(spark, sf_dir), ["lab_a", "qc"], population=False).select("id", "lab_a_z", "qc_z"), 6)


@query(
    "split_per_stratum",
    COHORT + "SELECT id, study_group, CASE WHEN row_number() OVER (PARTITION BY study_group ORDER BY substr(md5('7|' || id), 1, 13)) <= floor(count(*) OVER (PARTITION BY study_group) * 0.2e0 + 0.5) THEN 'test' ELSE 'train' END AS split FROM cohort",
)
def split_per_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.split_by_stratum(cohort(spark, sf_dir).select("id", "study_group"), "id", "study_group", 0.2, 7)


@query(
    "joined_labelings",
    COHORT + "SELECT id, nation, split AS split_base, CASE WHEN lab_b > 300000 THEN 'high' WHEN lab_b IS NOT NULL THEN 'low' END AS split_sensor FROM cohort WHERE lab_b IS NOT NULL",
)
def joined_labelings(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = cohort(spark, sf_dir).select("id", "nation", "split")
    other = cohort(spark, sf_dir).where("lab_b IS NOT NULL").select("id", F.when(F.col("lab_b") > 300000, "high").otherwise("low").alias("split"))
    return prep.join_suffixed(base, other, "id", ("_base", "_sensor"))


@query(
    "variance_inflation",
    COHORT + """, r AS (SELECT corr(lab_a, lab_b) AS ab, corr(lab_a, balance) AS ac, corr(lab_b, balance) AS bc FROM cohort), d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r)
SELECT 'lab_a' AS feature, round_even((1 - bc * bc) / det, 6) AS vif FROM d UNION ALL SELECT 'lab_b', round_even((1 - ac * ac) / det, 6) FROM d UNION ALL SELECT 'balance', round_even((1 - ab * ab) / det, 6) FROM d""",
)
def variance_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["lab_a", "lab_b", "balance"]
    found = selection.variance_inflation(selection.correlation_matrix(cohort(spark, sf_dir), names))
    return rounded(spark.createDataFrame([(n, float(v)) for n, v in zip(names, found)], "feature string, vif double"), 6)


@query("greedy_select", COHORT + """, r AS (SELECT abs(corr(lab_a, lab_b)) AS ab, abs(corr(lab_a, balance)) AS ac, abs(corr(lab_b, balance)) AS bc, corr(lab_a, lab_b) AS sab, corr(lab_a, balance) AS sac, corr(lab_b, balance) AS sbc FROM cohort WHERE split = 'train')
SELECT 'lab_a' AS feature, true AS kept, NULL AS reason, NULL::DOUBLE AS value FROM r UNION ALL SELECT 'twice', false, 'lab_a', 1e0 FROM r
UNION ALL SELECT 'lab_b', ab <= 0.8, CASE WHEN ab > 0.8 THEN 'lab_a' END, CASE WHEN ab > 0.8 THEN round_even(ab, 6) END FROM r
UNION ALL SELECT 'balance', greatest(ac, CASE WHEN ab <= 0.8 THEN bc ELSE 0 END) <= 0.8, NULL, NULL FROM r""")
def greedy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that repeats another one in twice its size goes; what correlates little stays."""
    rows = cohort(spark, sf_dir).where("split = 'train'").withColumn("twice", F.col("lab_a") * 2)
    found = selection.greedy(rows, ["lab_a", "twice", "lab_b", "balance"])
    listed = [(c, True, None, None) for c in found.kept] + [(c, False, why, None if x != x else x) for c, why, x in found.dropped]
    return rounded(spark.createDataFrame(listed, "feature string, kept boolean, reason string, value double"), 6)
