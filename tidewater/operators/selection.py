"""Feature sets: collinearity selection over a correlation matrix, and ladders of scenarios.

Correlations are one aggregation over all rows; what is collected is a matrix of features, never
rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidewater.operators.glucose import ORDER
from tidewater.operators.statistics import correlations

#: All features but those of coverage.
FEATURES = tuple(c for c in ORDER if not c.startswith("qc_"))
# The curated panel.
CURATED = (
    "between_day_sd", "cosinor_acrophase_h", "cosinor_amplitude", "dawn_rise", "dfa_alpha", "kurtosis", "mag_per_hour", "mean_hyper_dur_min", "mean_hypo_dur_min", "min_glucose",
    "n_hyper_events", "nocturnal_hypo_pct", "sample_entropy", "skewness", "spectral_circadian_frac", "spectral_dominant_period_h", "spectral_entropy", "tbr_lt54_pct", "tbr_lt70_pct", "tir_70_180_pct",
)
# The order in which features are preferred; those that are not named come last, in
# the catalogue's order.
PREFERRED = (
    "tir_70_180_pct", "tbr_lt70_pct", "tbr_lt54_pct", "tar_gt180_pct", "tar_gt250_pct", "tight_70_140_pct", "mean_glucose", "cv_pct", "mage", "modd", "between_day_sd", "mag_per_hour", "conga6", "lbgi", "hbgi",
    "sample_entropy", "dfa_alpha", "autocorr_lag1", "spectral_circadian_frac", "spectral_dominant_period_h", "spectral_entropy", "cosinor_amplitude", "cosinor_acrophase_h",
    "n_hypo_events", "n_hyper_events", "mean_hypo_dur_min", "mean_hyper_dur_min", "roc_sd", "pct_rapid_rise", "pct_rapid_fall", "hyper_auc_per_day", "hypo_auc_per_day", "dawn_rise", "nocturnal_hypo_pct", "overnight_mean",
    "iqr_glucose", "skewness", "kurtosis", "min_glucose",
)
PRIORITY = PREFERRED + tuple(c for c in FEATURES if c not in PREFERRED)


def constant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose SD is 0 or unknown."""
    row = df.agg(*[F.stddev_samp(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if not row[f"s{i}"]]


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    out = np.eye(len(columns))
    at = {c: i for i, c in enumerate(columns)}
    if len(columns) > 1:
        for r in correlations(df, list(columns)).collect():
            out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = np.nan if r["r"] is None else r["r"]
    return out


def variance_inflation(matrix: np.ndarray) -> np.ndarray:
    """Diagonal of the inverse correlation matrix; infinite where it is singular."""
    try:
        v = np.diag(np.linalg.inv(matrix)).copy()
    except np.linalg.LinAlgError:
        return np.full(len(matrix), np.inf)
    v[v < 1 - 1e-6] = np.inf
    return v


@dataclass
class Selection:
    kept: list[str]
    dropped: list[tuple[str, str, float]] = field(default_factory=list)


def greedy(df: DataFrame, priority: Sequence[str], limit: float = 0.8, vif_limit: float = 10.0) -> Selection:
    """In order of priority keep a column unless it correlates beyond the limit with a kept one;
    then, while the worst variance inflation is beyond its limit, drop that column (of ties, the
    one of least priority)."""
    flat = constant_columns(df, priority)
    columns = [c for c in priority if c not in flat]
    result = Selection([], [(c, "constant", float("nan")) for c in flat])
    if not columns:
        return result
    signed = correlation_matrix(df, columns)
    r = np.abs(signed)
    kept: list[int] = []
    for i, c in enumerate(columns):
        worst = max(kept, key=lambda j: r[i, j], default=None)
        if worst is not None and r[i, worst] > limit:
            result.dropped.append((c, columns[worst], float(r[i, worst])))
        else:
            kept.append(i)
    while len(kept) > 1:
        v = variance_inflation(signed[np.ix_(kept, kept)])
        if not v.max() > vif_limit:
            break
        drop = max(i for i, x in zip(kept, v) if x == v.max())
        result.dropped.append((columns[drop], "inflation", float(v.max())))
        kept.remove(drop)
    result.kept = [columns[i] for i in kept]
    return result


def backward_vif(df: DataFrame, columns: Sequence[str], limit: float = 10.0) -> Selection:
    """The older rule: drop the worst variance inflation until all are within the limit."""
    names = [c for c in columns if c not in constant_columns(df, columns)]
    matrix, result = correlation_matrix(df, names), Selection(list(names))
    while len(result.kept) > 1:
        at = [names.index(c) for c in result.kept]
        v = variance_inflation(matrix[np.ix_(at, at)])
        if v.max() <= limit:
            break
        worst = result.kept[int(v.argmax())]
        result.dropped.append((worst, "inflation", float(v.max())))
        result.kept.remove(worst)
    return result


#: Panels for clustering: names by role; those in log are taken as log(1 + x).
PANELS = {
    "five": {"columns": ("age", "bmi", "import_insulin", "import_c_peptide", "import_hba1c"), "log": ("import_insulin", "import_c_peptide")},
    "five_by_group": {
        "columns": ("age", "bmi", "import_insulin", "import_c_peptide", "import_hba1c"),
        "log": ("import_insulin", "import_c_peptide", "import_hba1c")
    },
    "nine": {
        "columns": (
            "age", "bmi", "import_insulin", "import_c_peptide", "import_creatinine", "uacr", "import_triglycerides", "import_hdl",
            "import_crp"
        ),
        "log": ("import_insulin", "import_c_peptide", "import_creatinine", "uacr", "import_triglycerides", "import_crp"),
    },
}


def panel(df: DataFrame, name: str) -> DataFrame:
    """Rows with all of a panel's values, logged where it says so."""
    chosen = PANELS[name]
    rows = df.na.drop(subset=list(chosen["columns"]))
    return rows.withColumns({c: F.log1p(c) for c in chosen["log"]})


def prefixed(columns: Sequence[str], *prefixes: str) -> list[str]:
    return [c for c in columns if c.startswith(prefixes)]


def ladder(
    columns: Sequence[str], *, demographics: Sequence[str] = ("age",), bmi: str = "bmi", wearables: Sequence[str] = ("avg_daily_steps", "avg_sleep_minutes"), glucose: str = "import_glucose", insulin: str = "import_insulin",
    c_peptide: str = "import_c_peptide", excluded: Sequence[str] = (), exclude_c_peptide: bool = False, target: str | None = None, sensor: Sequence[str] = FEATURES, without_labs: bool = True,
) -> dict[str, list[str]]:
    """Cumulative scenarios 1, 2, 3, 4, 5a, 5b and, without laboratory values, 6a and 6b."""
    held = set(columns)
    base = [c for c in demographics if c in held] + prefixed(columns, "race_", "sex_")
    out = set(excluded) | {glucose, insulin} | ({c_peptide} if exclude_c_peptide else set()) | ({target} if target else set())
    labs = [c for c in prefixed(columns, "import_") if c not in out]
    sensed, sugar = [c for c in sensor if c in held], [c for c in (glucose,) if c in held and c != target]
    two = base + [c for c in (bmi,) if c in held]
    three = two + [c for c in wearables if c in held]
    four = three + labs
    stages = {"1": base, "2": two, "3": three, "4": four, "5a": four + sensed, "5b": four + sugar}
    return stages | ({"6a": three + sensed, "6b": three + sugar} if without_labs else {})


def minimal(columns: Sequence[str], sensed: Sequence[str], labs: Sequence[str]) -> dict[str, list[str]]:
    """The four glucose scenarios over age, BMI, sex and race only."""
    held = set(columns)
    return glucose_scenarios([c for c in ("age", "bmi") if c in held] + prefixed(columns, "sex_", "race_"), sensed, labs)


def glucose_scenarios(base: Sequence[str], sensed: Sequence[str], labs: Sequence[str]) -> dict[str, list[str]]:
    """Base, with sensed values, with laboratory glucose, with both."""
    return {"1_no_glucose": list(base), "2_sensed": [*base, *sensed], "3_labs": [*base, *labs], "4_both": [*base, *sensed, *labs]}


def one_added(base: Sequence[str], added: Sequence[str], combined: Sequence[str] = ()) -> dict[str, list[str]]:
    """The base, the base with each of `added`, and with all of `combined`."""
    stages = {"1_base": list(base)} | {f"{i}_add_{c}": [*base, c] for i, c in enumerate(added, 2)}
    return stages | ({f"{len(stages) + 1}_add_{'_'.join(combined)}": [*base, *combined]} if combined else {})


def without(stages: dict[str, list[str]], *dropped: str) -> dict[str, list[str]]:
    """Scenarios without some columns; those that are left empty, or equal to the one before, go."""
    out: dict[str, list[str]] = {}
    for name, columns in stages.items():
        left = [c for c in columns if c not in dropped]
        if left and left != next(reversed(out.values()), None):
            out[name] = left
    return out


def all_but(columns: Sequence[str], admin: Sequence[str], target: str, drop: Sequence[str]) -> list[str]:
    """Everything but identifiers, the target and a list of exclusions."""
    return [c for c in columns if c not in {*admin, target, *drop}]
