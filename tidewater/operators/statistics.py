"""Tests and metrics from counts: values are pre-aggregated before anything is ordered, and running
sums over distinct values (or score thresholds) are taken in PARTS ranges of values side by side, so
that no group or pair is ordered in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.functions.arrays import lowess, md5_start
from tidewater.functions.numeric import ratio
from tidewater.functions.tails import bonferroni, chi2_p, normal_p, spearman_p
from tidewater.sources.shared import shared_dir


#: Ranges of values that are ordered side by side.
PARTS = 64
#: Keys whose weights in all resamples are drawn at once.
DRAWN = 16_384
# Bounds of the Poisson distribution of mean 1.
BOUNDS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def modal_share(df: DataFrame, by: str, category: str) -> DataFrame:
    """The commonest category of each group (ties: the first by name) and its share in per cent."""
    counts = value_counts(df, by, category)
    top = F.min(F.struct((-F.col("n")).alias("neg"), F.col(category)))
    return counts.groupBy(by).agg(top[category].alias("modal"), (100.0 * F.max("n") / F.sum("n")).alias("modal_pct"), F.sum("n").alias("n"))


def once(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def running(counts: DataFrame, by: list[str], value: str, *names: str) -> DataFrame:
    """The rows (one for each value of a group) with `below_<name>`: sums over the lesser values of
    their group. Cut points split a group's values into ranges; a range's own running sums are added
    to the totals of the ranges before it, of which a group has PARTS at most."""
    quantiles = [i / PARTS for i in range(1, PARTS)]
    spread = counts.groupBy(*by).agg(F.percentile_approx(value, quantiles, 1000).alias("_cuts"))
    if by:
        rows = counts.join(spread, by)
    else:
        cuts = spread.first()["_cuts"] or []
        rows = counts.withColumn("_cuts", F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>"))
    rows = rows.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    total = rows.groupBy(*by, "_range").agg(*[F.sum(n).alias(f"_t_{n}") for n in names])
    ranges = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(ranges), F.lit(0)).alias(f"_b_{n}") for n in names])
    own = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(before, [*by, "_range"])
    return out.select(*counts.columns, *[(F.col(f"_b_{n}") + F.coalesce(F.sum(n).over(own), F.lit(0))).alias(f"below_{n}") for n in names])


def average_ranks(df: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """Rows with the average rank of their value in their group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranks = running(counts, by, value, "_n").select(*by, value, (F.col("below__n") + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(ranks, [*by, value])


def pairwise_u(df: DataFrame, group: str, value: str) -> DataFrame:
    """For each pair of groups: sizes, U of the first, tie-corrected z, area under the ROC curve of
    the second group as positive, p and its Bonferroni bound."""
    counts = df.where(
        F.col(value).isNotNull() & F.col(group).isNotNull()
    ).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    names = [r["g"] for r in df.select(F.col(group).alias("g")).where("g IS NOT NULL").distinct().orderBy("g").collect()]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        pairs = [(None, None)]
    listed = F.array(*[F.struct(F.lit(a).alias("group_1"), F.lit(b).alias("group_2")) for a, b in pairs])
    each = counts.select("*", F.explode(listed).alias("pair")).where("g = pair.group_1 OR g = pair.group_2")
    merged = each.groupBy("pair", "v").agg(
        F.sum(F.when(F.expr("g = pair.group_1"), F.col("n")).otherwise(0)).alias("n1"),
        F.sum(F.when(F.expr("g = pair.group_2"), F.col("n")).otherwise(0)).alias("n2")
    )
    placed = running(merged, ["pair"], "v", "n2").withColumn(
        "u", F.col("n1") * (F.col("below_n2") + F.col("n2") / 2.0)
    ).withColumn("t", F.col("n1") + F.col("n2"))
    out = placed.groupBy("pair").agg(
        F.sum("n1").alias("n_1"), F.sum("n2").alias("n_2"), F.sum("u").alias("u_statistic"), F.sum(
            F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")
        ).alias("ties")
    )
    n, both = F.col("n_1") + F.col("n_2"), F.col("n_1") * F.col("n_2").cast("double")
    sigma = F.sqrt(both / 12 * (n + 1 - ratio(F.col("ties"), n * (n - 1.0))))
    z = ratio(F.greatest(F.abs(F.col("u_statistic") - both / 2) - 0.5, F.lit(0.0)), sigma)
    return out.select(
        "pair.group_1", "pair.group_2", "n_1", "n_2", "u_statistic", z.alias("z"), (1 - ratio(F.col("u_statistic"), both)).alias("auroc"), normal_p(z).alias("p_value"), bonferroni(normal_p(z), len(pairs)).alias("p_value_bonferroni"),
    )


def one_vs_rest_u(df: DataFrame, level: str, value: str, at_least: int = 15) -> DataFrame:
    """Each level with enough rows against all others: size, U and z."""
    known = df.where(F.col(level).isNotNull() & F.col(value).isNotNull())
    ranks = average_ranks(known, value, [])
    whole = known.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("t")).agg(
        F.sum("t").alias("n"), F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("ties")
    ).first()
    n, ties = whole["n"] or 0, whole["ties"] or 0.0
    out = ranks.groupBy(F.col(level).alias("level")).agg(
        F.count("*").alias("n_level"), F.sum("rank").alias("r")
    ).where(F.col("n_level") >= at_least).where(F.col("n_level") < n)
    k = F.col("n_level").cast("double")
    u = F.col("r") - k * (k + 1) / 2
    sigma = F.sqrt(k * (n - k) / 12 * (n + 1 - ties / max(1.0, n * (n - 1.0))))
    z = ratio(F.greatest(F.abs(u - k * (n - k) / 2) - 0.5, F.lit(0.0)), sigma)
    return out.select("level", "n_level", u.alias("u_statistic"), z.alias("z"), normal_p(z).alias("p_value"))


def outcome_comparison(df: DataFrame, by: list[str], value: str, label: str) -> DataFrame:
    """Both classes of a 0/1 label, for every group: sizes, quartiles, U of class 1, tie-corrected z,
    area under the ROC curve, p and its Bonferroni bound over the groups that hold both classes.
    Quartiles interpolate between the two nearest rows. Ranks, ties and quartiles all come from one
    table of counts by value, so no group is ordered or gathered in one task."""
    known = df.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    yes = F.col(label) > 0
    counts = once(known.groupBy(*by, F.col(value).alias("v")).agg(F.count_if(yes).alias("k1"), F.count_if(~yes).alias("k0")))
    sizes = counts.groupBy(*by).agg(F.sum("k1").alias("n_1"), F.sum("k0").alias("n_0"))
    placed = running(counts, by, "v", "k1", "k0").join(sizes, by)
    cells, named = [], {}
    for c in ("1", "0"):
        for name, share in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
            place = F.greatest(share * (F.col(f"n_{c}") - 1), F.lit(0.0))
            for end, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
                here = (F.col(f"below_k{c}") <= at) & (at < F.col(f"below_k{c}") + F.col(f"k{c}"))
                cells.append(F.max(F.when(here, F.col("v"))).alias(f"_{name}_{c}_{end}"))
            low, high = F.col(f"_{name}_{c}_lo"), F.col(f"_{name}_{c}_hi")
            named[f"{name}_{c}"] = low + (high - low) * (place - F.floor(place))
    t = (F.col("k1") + F.col("k0")).cast("double")
    out = placed.groupBy(*by, "n_1", "n_0").agg(
        F.sum(F.col("k1") * (F.col("below_k0") + F.col("k0") / 2.0)).alias("u"), F.sum(t * t * t - t).alias("ties"), *cells
    )
    n, both = (F.col("n_1") + F.col("n_0")).cast("double"), F.col("n_1") * F.col("n_0").cast("double")
    sigma = F.sqrt(both / 12 * (n + 1 - ratio(F.col("ties"), n * (n - 1))))
    z = ratio(F.greatest(F.abs(F.col("u") - both / 2) - 0.5, F.lit(0.0)), sigma)
    tests = sizes.where("n_1 > 0 AND n_0 > 0").count()
    u = F.when(both > 0, F.col("u"))
    tested = out.select(
        *by, "n_1", "n_0", *[c.alias(k) for k, c in named.items()], u.alias("u_statistic"), z.alias("z"),
        ratio(u, both).alias("auroc")
    )
    p = tested.withColumn("p_value", normal_p(F.col("z")))
    return p.withColumn("p_value_bonferroni", F.when(F.col("p_value").isNotNull(), bonferroni(F.col("p_value"), tests)))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: H, corrected for ties, its degrees of freedom and p."""
    known = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    sums = average_ranks(known, value, []).groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
    ties = known.groupBy(value).agg(F.count("*").cast("double").alias("t")).agg(
        F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties")
    ).first()["ties"] or 0.0
    n = F.sum("n").cast("double")
    h = 12 / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("n")) - 3 * (n + 1)
    one = sums.agg((h / (1 - ties / (n * n * n - n))).alias("h"), (F.count("*") - 1).alias("dof"), n.cast("long").alias("n"))
    return one.withColumn("p_value", chi2_p("h", "dof"))


def chi_square(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """One row: the statistic (continuity-corrected at one degree of freedom), degrees and p."""
    cells = value_counts(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b).withColumnRenamed("n", "o")
    row = cells.groupBy(a).agg(F.sum("o").alias("row"))
    col = cells.groupBy(b).agg(F.sum("o").alias("col"))
    total = cells.agg(F.sum("o").alias("n")).first()["n"] or 0
    # All cells, also empty ones: tables of categories, not of rows.
    full = row.join(col, F.lit(True)).join(cells, [a, b], "left").withColumn(
        "e", F.col("row") * F.col("col") / float(max(1, total))
    ).na.fill({"o": 0})
    dof = (F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)
    plain, shifted = F.abs(F.col("o") - F.col("e")), F.greatest(F.abs(F.col("o") - F.col("e")) - 0.5, F.lit(0.0))
    one = full.agg(F.sum(plain * plain / F.col("e")).alias("plain"), F.sum(shifted * shifted / F.col("e")).alias("shifted"), dof.alias("dof"))
    return one.select(
        F.when((F.col("dof") == 1) & F.lit(yates), F.col("shifted")).otherwise(F.col("plain")).alias("chi2"), "dof"
    ).withColumn("p_value", chi2_p("chi2", "dof"))


def _rank_correlation(pairs: DataFrame, by: list[str]) -> DataFrame:
    """rho and n of rows (by, x, y): ranks of both come from one table of counts by value pair, and
    average ranks have the mean (n + 1) / 2."""
    met = once(pairs.groupBy(*by, "x", "y").agg(F.count("*").alias("k")))
    for v in ("x", "y"):
        counts = met.groupBy(*by, v).agg(F.sum("k").alias("_n"))
        met = met.join(running(counts, by, v, "_n").select(*by, v, (F.col("below__n") + (F.col("_n") + 1) / 2.0).alias(f"r{v}")), [*by, v])
    sizes = met.groupBy(*by).agg(
        F.sum("k").alias("n"),
        *[
            F.sum(F.col("k") * f).alias(c) for c,
            f in (
                ("sx", F.col("rx")), ("sy", F.col("ry")), ("xx", F.col("rx") * F.col("rx")), ("yy", F.col("ry") * F.col("ry")),
                ("xy", F.col("rx") * F.col("ry"))
            )
        ]
    )
    spread = lambda a, b, c: F.col(a) - F.col(b) * F.col(c) / F.col("n")
    rho = ratio(spread("xy", "sx", "sy"), F.sqrt(spread("xx", "sx", "sx") * spread("yy", "sy", "sy")))
    return sizes.select(*by, rho.alias("rho"), "n").withColumn("p_value", spearman_p("rho", "n"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: correlation of average ranks, n and p."""
    return _rank_correlation(
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")),
        []
    )


def spearman_table(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Each feature's rank correlation with the target, by absolute value, with Bonferroni p."""
    long = df.where(F.col(target).isNotNull()).select(
        F.col(target).alias("y"),
        F.expr("stack({}, {}) AS (feature, x)".format(len(features), ", ".join(f"'{c}', cast(`{c}` AS double)" for c in features)))
    ).where("x IS NOT NULL")
    out = _rank_correlation(long.select("feature", "x", F.col("y").cast("double").alias("y")), ["feature"])
    return out.withColumn("p_value_bonferroni", bonferroni(F.col("p_value"), len(features))).orderBy(F.abs("rho").desc(), "feature")


def thresholds(df: DataFrame, label: str, score: str) -> DataFrame:
    """Cumulative true and false positives at each distinct score, from the highest."""
    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.sum((F.col(label) > 0).cast("long")).alias("p"), F.sum((F.col(label) <= 0).cast("long")).alias("q")
    )
    whole = counts.agg(F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    pos, neg = F.lit(whole["p"] or 0).cast("long"), F.lit(whole["q"] or 0).cast("long")
    return running(counts, [], "threshold", "p", "q").select(
        "threshold", "p", (pos - F.col("below_p")).alias("tp"), (neg - F.col("below_q")).alias("fp"), pos.alias("pos"),
        neg.alias("neg")
    )


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    return thresholds(df, label, score).select(
        "threshold", ratio(F.col("tp"), F.col("pos")).alias("tpr"), ratio(F.col("fp"), F.col("neg")).alias("fpr")
    )


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Step-wise: precision at each threshold times the recall it adds."""
    t = thresholds(df, label, score)
    return t.agg(
        F.sum(F.col("tp") / (F.col("tp") + F.col("fp")) * ratio(F.col("p"), F.col("pos"))).alias("average_precision"),
        F.max("pos").alias("n_positive"), (F.max("pos") + F.max("neg")).alias("n")
    )


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def rates(df: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Sensitivity, specificity and accuracy; null for a class without rows."""
    yes, hit = F.col(label) > 0, F.col(predicted) > 0
    return df.groupBy(*(by or [])).agg(
        ratio(F.count_if(yes & hit), F.count_if(yes)).alias("sensitivity"), ratio(
            F.count_if(~yes & ~hit), F.count_if(~yes)
        ).alias("specificity"), F.avg((yes == hit).cast("double")).alias("accuracy"), F.count("*").alias("n")
    )


def regression_scores(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    error = F.col(actual) - F.col(predicted)
    return df.groupBy(*(by or [])).agg(
        (1 - ratio(F.avg(error * error), F.var_pop(actual))).alias("r2"), F.avg(error * error).alias("mse"),
        F.count("*").alias("n")
    )


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labelings beyond chance, from their contingency table."""
    two = lambda c: c * (c - 1) / 2.0
    cells = value_counts(df, a, b)
    rows, cols = cells.groupBy(a).agg(F.sum("n").alias("m")), cells.groupBy(b).agg(F.sum("n").alias("m"))
    total = lambda t, c: t.agg(F.sum(two(F.col(c))).alias("s"), F.sum(c).alias("n")).first()
    x, y = total(rows, "m"), total(cols, "m")
    n = float(x["n"] or 0)
    chance = (x["s"] or 0) * (y["s"] or 0) / max(1.0, n * (n - 1) / 2)
    top = ((x["s"] or 0) + (y["s"] or 0)) / 2 - chance
    return cells.agg((F.when(F.lit(top == 0), 1.0).otherwise((F.sum(two(F.col("n"))) - chance) / (top or 1.0))).alias("ari"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations of all pairs of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(listed))


def outliers(df: DataFrame, key: str, z: list[str], limit: float = 4.0) -> DataFrame:
    """Rows with a standardised value beyond the limit, and which ones."""
    beyond = F.filter(F.array(*[F.when(F.abs(F.col(c)) > limit, F.lit(c)) for c in z]), lambda x: x.isNotNull())
    return df.select(key, *z, F.array_join(beyond, ";").alias("trigger_features")).where("trigger_features <> ''")


def ols_line(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def smoothed(df: DataFrame, by: str, key: str, x: str, y: str, share: float = 0.5) -> DataFrame:
    """LOWESS of each group, in one task, whose memory grows with the group's points, and whose time with
    the square of its different values of x."""
    kinds = dict(df.dtypes)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([x, key])
        return pd.DataFrame({by: part[by], key: part[key], x: part[x], "smooth": lowess(part[x].to_numpy(float), part[y].to_numpy(float), share)})

    rows = df.select(by, key, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).na.drop()
    return rows.groupBy(by).applyInPandas(solve, f"{by} {kinds[by]}, {key} {kinds[key]}, {x} double, smooth double")


def formula_against_model(df: DataFrame, formula: Column, actual: str, predicted: str) -> DataFrame:
    """One row: R2 and mean squared error of a fixed formula and of a model, and the rank correlation
    of each with the truth, over the rows that have all three."""
    rows = df.withColumn("_f", formula).where(F.col("_f").isNotNull() & F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    rows = once(rows.select(F.col(actual).alias("_t"), "_f", F.col(predicted).alias("_m")))
    cells, spread = [], F.var_pop("_t")
    for name, c in (("formula", "_f"), ("model", "_m")):
        error = (F.col("_t") - F.col(c)) * (F.col("_t") - F.col(c))
        cells += [(1 - ratio(F.avg(error), spread)).alias(f"{name}_r2"), F.avg(error).alias(f"{name}_mse")]
    rho = {f"{n}_rho": F.lit(spearman(rows, "_t", c).first()["rho"]).cast("double") for n, c in (("formula", "_f"), ("model", "_m"))}
    return rows.agg(*cells).withColumns(rho)


def thresholded(df: DataFrame, score: str, cut: float, name: str = "predicted") -> DataFrame:
    """A class from a continuous score; the score itself ranks for the area under the ROC curve."""
    return df.withColumn(name, (F.col(score) >= cut).cast("int"))


def bootstrap(
    df: DataFrame, key: str, metric: dict[str, Column], resamples: int = 1000, seed: int = 0, by: list[str] | None = None,
    at_least: int = 1
) -> DataFrame:
    """Percentile intervals of aggregate metrics over Poisson resamples, unknown if fewer than
    `at_least` resamples give a value: each row's weight in each
    resample is drawn from a hash of its key, so resamples need no shuffle of rows and reruns
    agree; weights enter as repeats, and aggregates are combined in the scan."""
    text = F.concat_ws("|", F.lit(seed).cast("string"), F.col("resample").cast("string"), F.col(key).cast("string"))
    u = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)
    weight = sum(((u > b).cast("int") for b in BOUNDS), F.lit(0))
    drawn = df.withColumn(
        "resample", F.explode(F.sequence(F.lit(1), F.lit(resamples)))
    ).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), weight)))
    each = drawn.groupBy(*(by or []), "resample").agg(*[c.alias(n) for n, c in metric.items()])
    return _ends(each, list(metric), by, at_least)


def _ends(each: DataFrame, names: list[str], by: list[str] | None, at_least: int) -> DataFrame:
    cells = []
    for n in names:
        enough = F.count(n) >= at_least
        cells += [
            F.when(enough, f).alias(f"{n}_{end}") for end,
            f in (("lo", F.percentile(n, 0.025)), ("hi", F.percentile(n, 0.975)), ("se", F.stddev_samp(n)))
        ] + [F.count(n).alias(f"{n}_valid")]
    return each.groupBy(*(by or [])).agg(*cells)


def _draws(keys: Sequence[str | None], resamples: int, seed: int) -> np.ndarray:
    """The weights (keys, resamples) that `bootstrap` draws."""
    out = np.empty((len(keys), resamples), np.uint8)
    ends = [b"" if k is None else b"|" + k.encode() for k in keys]
    sizes, bounds = np.array([len(e) for e in ends]), np.array(BOUNDS) * (1 << 52)
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        tail = np.frombuffer(b"".join([ends[i] for i in mine.tolist()]), np.uint8).reshape(len(mine), size)
        heads = [f"{seed}|{r + 1}".encode() for r in range(resamples)]
        for width in sorted({len(h) for h in heads}):
            same, step = [r for r in range(resamples) if len(heads[r]) == width], max(1, DRAWN // len(mine))
            for i in range(0, len(same), step):
                these = same[i : i + step]
                head = np.frombuffer(b"".join([heads[r] for r in these]), np.uint8).reshape(len(these), width)
                text = np.concatenate((np.repeat(head, len(mine), 0), np.tile(tail, (len(these), 1))), 1)
                out[np.ix_(mine, these)] = np.searchsorted(bounds, md5_start(text), "left").reshape(len(these), len(mine)).T
    return out


def bootstrap_means(
    df: DataFrame, key: str, values: dict[str, str], resamples: int = 1000, seed: int = 0, by: list[str] | None = None, at_least: int = 1
) -> DataFrame:
    """`bootstrap` of means of columns (name: column), with the same draws, from weighted sums: no row is
    copied, a task adds up its rows' weights times values in all resamples, and only those sums are
    shuffled. Rows are dealt to all cores, as a row costs as many hashes as there are resamples."""
    by, names = by or [], list(values)
    rows = df.select(*by, F.col(key).cast("string").alias("_key"), *[F.col(c).cast("double").alias(n) for n, c in values.items()])
    context = df.sparkSession.sparkContext
    rows = rows.repartition(4 * context.defaultParallelism, F.col("_key"))
    kinds, m = {f.name: f.dataType.simpleString() for f in rows.schema.fields}, len(names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(by))]
            groups: dict[tuple, int] = {}
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(*columns)] if by else [groups.setdefault((), 0)] * batch.num_rows, int)
            x = np.stack([batch.column(len(by) + 1 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(m)], 1)
            known = np.stack([~np.asarray(batch.column(len(by) + 1 + i).is_null()) for i in range(m)], 1)
            x = np.concatenate((known, np.where(known, x, 0.0)), 1)
            keys = batch.column(len(by)).to_pylist()
            for i in range(0, len(keys), DRAWN):
                w, part, own = _draws(keys[i : i + DRAWN], resamples, seed), x[i : i + DRAWN], group[i : i + DRAWN]
                # NaN and infinities count only where they are drawn.
                plain = np.isfinite(part).all(1)
                for name, g in groups.items():
                    mine = plain & (own == g)
                    total[name] = total.get(name, 0) + w[mine].T.astype(float) @ part[mine]
                for j in np.flatnonzero(~plain).tolist():
                    name = next(n for n, g in groups.items() if g == own[j])
                    drawn = w[j] > 0
                    total[name][drawn] += w[j][drawn, None] * part[j]
        for name, t in total.items():
            head = [pa.array([v] * resamples, batch.schema.field(i).type) for i, v in enumerate(name)]
            body = [pa.array(t[:, i]) for i in range(2 * m)]
            yield pa.RecordBatch.from_arrays(
                [*head, pa.array(np.arange(1, resamples + 1, dtype=np.int32)), *body],
                [*by, "resample", *[f"_n{i}" for i in range(m)], *[f"_s{i}" for i in range(m)]]
            )

    sums = [f"_n{i} double" for i in range(m)] + [f"_s{i} double" for i in range(m)]
    each = rows.mapInArrow(summed, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "resample int", *sums])).groupBy(*by, "resample").agg(
        *[F.try_divide(F.sum(f"_s{i}"), F.sum(f"_n{i}")).alias(n) for i, n in enumerate(names)]
    )
    return _ends(each, names, by, at_least)
