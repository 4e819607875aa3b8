"""P-values, combination, false-discovery control and set metrics, on tables of test results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.special import binomial_sf, chi2_tail, student_sf
from .ranks import Ordered

#: Budgets of the two resampling axes; the weights follow from them.
B_LABEL, B_ORDER = 1500, 2000


def monte_carlo_p(exceed: Column, count: Column | int) -> Column:
    """(1 + exceedances) / (replicates + 1)."""
    return (1 + exceed) / (1.0 + (F.lit(count) if isinstance(count, int) else count))


def fisher_combined(p: str, q: str) -> Column:
    """Fisher's combination of two p-values: chi-square with 4 degrees of freedom, in closed form."""
    half = -(F.log(F.greatest(F.col(p), F.lit(1e-300))) + F.log(F.greatest(F.col(q), F.lit(1e-300))))
    return F.exp(-half) * (1 + half)


def intersection_union(p: str, q: str) -> Column:
    return F.greatest(p, q)


def weights(b_label: int = B_LABEL, b_order: int = B_ORDER) -> tuple[float, float]:
    """(order weight, label weight): shares of the replicates that each axis tests with."""
    label = b_label / (b_label + b_order / 2)
    return 1 - label, label


def combined_statistic(p_order: str, p_label: str, w_order: float, w_label: float) -> Column:
    ln = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-300)))
    return -2 * (w_order * ln(p_order) + w_label * ln(p_label))


def log_p_correlation(df: DataFrame, p_order: str, p_label: str) -> DataFrame:
    """(m, rho): correlation of -ln p; 0 with fewer than three rows or a constant side."""
    x, y = (-F.log(F.greatest(F.col(c), F.lit(1e-300))) for c in (p_order, p_label))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))  # null for a constant side
    return df.agg(F.count(F.lit(1)).alias("m"), r.alias("r")).select("m", F.when((F.col("m") < 3) | F.col("r").isNull() | F.isnan("r"), 0.0).otherwise(F.col("r")).alias("rho"))


def moment_match(rho: float, w_order: float, w_label: float) -> tuple[float, float]:
    """Scale c and degrees of freedom f of the weighted statistic under correlation rho."""
    r = min(1.0, max(-0.5, rho))
    # fixed values: the published approximation of the covariance of -2 ln p
    cov = r * (3.25 + 0.75 * r) if r >= 0 else r * (3.27 + 0.71 * r)
    mean = 2 * (w_order + w_label)
    var = max(4 * (w_order**2 + w_label**2) + 2 * w_order * w_label * cov, 1e-12)
    return var / (2 * mean), 2 * mean**2 / var


def analytic_p(df: DataFrame, statistic: str, c: float, f: float) -> DataFrame:
    """Adds p_conj: the upper chi-square tail of statistic / c with f degrees of freedom."""
    return df.withColumn("p_conj", chi2_tail(F.col(statistic) / F.lit(c), F.lit(f)))


# ---- false discovery rate ------------------------------------------------------------------------------


def step_up(df: DataFrame, p: str, ids: list[str], alpha: float = 0.05, dependent: bool = False) -> DataFrame:
    """Adds rank, threshold and reject: Benjamini-Hochberg, or Benjamini-Yekutieli if ``dependent``."""
    placed = Ordered(df, p, *ids)
    m = placed.count
    harmonic = sum(1 / i for i in range(1, m + 1)) if dependent else 1.0
    out = placed.rows.drop("part").withColumn("threshold", F.col("rank") * F.lit(alpha) / F.lit(max(m, 1) * harmonic))
    last = out.agg(F.max(F.when(F.col(p) <= F.col("threshold"), F.col("rank")))).first()[0]
    return out.withColumn("reject", F.col("rank") <= F.lit(last or 0))


def q_values(df: DataFrame, p: str, ids: list[str], pi0: float = 1.0) -> DataFrame:
    """Adds q: the running minimum, from the largest p down, of pi0 m p / rank, at most 1."""
    placed = Ordered(df, p, *ids)
    fdp = F.lit(pi0) * F.lit(placed.count) * F.col(p) / F.col("rank")
    return placed.with_least_from(fdp, "q").rows.drop("part").withColumn("q", F.least(F.lit(1.0), "q"))


def per_pattern_fdr(tested: DataFrame, ids: list[str], alpha: float = 0.05, pi0: float | None = None) -> DataFrame:
    """False discoveries of a permutation test, each pattern against its own null: adds sigma (of the null's absolute
    values), d (the difference over sigma and the median sigma), rank, false (expected false discoveries), q, significant.

    ``tested``: delta, p_two, null_mean, null_std, null.  ``pi0``: the share of true nulls, else estimated.
    """
    square = F.col("null_std") * F.col("null_std") + F.col("null_mean") * F.col("null_mean")
    mean = F.aggregate("null", F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size("null")
    rows = tested.withColumn("sigma", F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))).drop("null")
    placed = Ordered(rows, "p_two", *ids)
    own = placed.rows
    if pi0 is None:
        pi0 = pi0_bootstrap(own, "p_two").first()["pi0"]
    middle = own.agg(F.median("sigma")).first()[0]
    placed.rows = own.withColumn("false", F.lit(float(pi0)) * F.lit(placed.count) * F.col("p_two"))
    out = placed.with_least_from(F.col("false") / F.col("rank"), "q").rows.drop("part").withColumn("q", F.least(F.lit(1.0), "q"))
    cut = out.agg(F.max(F.when(F.col("q") <= alpha, F.col("p_two")))).first()[0]
    out = out.withColumn("d", F.try_divide(F.abs("delta"), F.col("sigma") + F.lit(middle))).withColumn("pi0", F.lit(float(pi0)))
    return out.withColumn("significant", F.col("p_two") <= F.lit(-1.0 if cut is None else cut))


def pi0_range(df: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, m, lam, pi0, low, high): the share of true nulls of several columns of p-values, and the middle 95 % of its
    estimates over the grid."""
    grid = [round(0.05 * i, 2) for i in range(1, 18)]
    out = None
    for p in axes:
        p_values = df.where(F.col(p).isNotNull())
        counts = p_values.agg(F.count(F.lit(1)).alias("m"), *[F.count_if(F.col(p) > x).cast("double").alias(f"w{i}") for i, x in enumerate(grid)])
        share = F.array(*[F.least(F.lit(1.0), F.try_divide(F.col(f"w{i}"), F.col("m") * (1 - x))) for i, x in enumerate(grid)])
        spread = counts.select(F.explode(share).alias("v")).agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))
        row = pi0_bootstrap(p_values, p).crossJoin(F.broadcast(spread)).select(F.lit(p).alias("axis"), "m", "lam", "pi0", "low", "high")
        out = row if out is None else out.unionByName(row)
    return out


def _grid(spark: SparkSession, values: list[float]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "j int, lam double"))


def pi0_bootstrap(df: DataFrame, p: str) -> DataFrame:
    """(m, lam, pi0): the share of true nulls at the grid point of least estimated squared error."""
    spark = df.sparkSession
    m = df.count()
    if m == 0:
        return spark.createDataFrame([(0, 0.5, 1.0)], "m long, lam double, pi0 double")
    grid = _grid(spark, [round(0.05 * i, 2) for i in range(1, 18)])
    w = df.crossJoin(grid).groupBy("j", "lam").agg(F.count_if(F.col(p) > F.col("lam")).cast("double").alias("w"))
    w = w.withColumn("pi0", F.least(F.lit(1.0), F.col("w") / (m * (1 - F.col("lam")))))
    low = w.crossJoin(F.broadcast(w.agg(F.percentile("pi0", 0.1).alias("floor"))))
    mse = F.col("w") / (float(m) * m * F.pow(1 - F.col("lam"), 2)) * (1 - F.col("w") / m) + F.pow(F.col("pi0") - F.col("floor"), 2)
    return low.withColumn("mse", F.round(mse, 15)).orderBy("mse", "j").limit(1).select(F.lit(m).cast("long").alias("m"), "lam", "pi0")


def pi0_adaptive(df: DataFrame, p: str, q: float, largest: float = 0.8) -> DataFrame:
    """(m, lam, pi0): the first grid point at which estimate plus variance stops falling."""
    spark = df.sparkSession
    out = "m long, lam double, pi0 double"
    m, above = df.agg(F.count(F.lit(1)), F.count_if(F.col(p) > q)).first()
    if m == 0:
        return spark.createDataFrame([(0, q, 1.0)], out)
    if above == 0:
        return spark.createDataFrame([(m, q, 0.0)], out)
    step = max((largest - q) / 50, 1 / m)
    lams = []
    while (v := q + step * (len(lams) + 1)) <= largest + 1e-12:
        lams.append(v)
    lams = lams if len(lams) >= 2 else [min(0.5, largest)]
    w = df.crossJoin(_grid(spark, lams)).groupBy("j", "lam").agg(F.count_if(F.col(p) > F.col("lam")).cast("double").alias("w"))
    scale = m * (1 - F.col("lam"))
    w = w.withColumn("pi0", F.least(F.lit(1.0), F.col("w") / scale))
    variance = F.greatest(F.lit(0.0), F.col("pi0") * (1 - (1 - F.col("lam")) * F.col("pi0")) / scale)
    w = w.withColumn("psi", F.round(F.col("pi0") + variance, 12))
    w = w.withColumn("next", F.lead("psi").over(Window.orderBy("j")))
    stop = F.col("next").isNull() | (F.col("next") >= F.col("psi"))
    return w.where(stop).orderBy("j").limit(1).select(F.lit(m).cast("long").alias("m"), "lam", "pi0")


def taxonomy(significant: str = "significant", p_order: str = "p_struct", p_label: str = "p_disc", alpha: float = 0.05) -> Column:
    """Four-way category of a tested pattern."""
    order, label = F.col(p_order) <= alpha, F.col(p_label) <= alpha
    return (
        F.when(~F.col(significant), F.when(order, "structural_only").otherwise("none"))
        .when(order & label, "both").when(label, "discriminative_only").when(order, "structural_only").otherwise("both")
    )


def classifier_metrics(n_sat0: str = "n_sat0", n_sat1: str = "n_sat1", n_app0: str = "n_app0", n_app1: str = "n_app1") -> list[Column]:
    """A pattern as a classifier for class 1 among the cases it applies to."""
    e = 1e-10
    tp, fp = F.col(n_sat1).cast("double"), F.col(n_sat0).cast("double")
    fn, tn = F.col(n_app1) - tp, F.col(n_app0) - fp
    precision, recall, spec = tp / (tp + fp + e), tp / (tp + fn + e), tn / (tn + fp + e)
    return [
        precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall + e)).alias("f1"),
        ((tp + tn) / (tp + tn + fp + fn + e)).alias("accuracy"), ((recall + spec) / 2).alias("balanced_accuracy"), spec.alias("specificity"),
        ((tp * tn - fp * fn) / F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) + e)).alias("mcc"), ((recall + spec) / 2).alias("auroc"),
    ]


# ---- set metrics ---------------------------------------------------------------------------------------


def _sides(a: DataFrame, b: DataFrame, ids: list[str], by: list[str]) -> DataFrame:
    """Each key with whether it is in a and in b (null-safe by way of a group)."""
    rows = a.select(*by, *ids, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*by, *ids, F.lit(0).alias("x"), F.lit(1).alias("y")))
    return rows.groupBy(*by, *ids).agg(F.max("x").alias("x"), F.max("y").alias("y"))


def jaccard(a: DataFrame, b: DataFrame, ids: list[str], by: list[str] = ()) -> DataFrame:
    """(n_a, n_b, shared, gained, lost, jaccard) of two result sets; two empty sets are equal."""
    by = list(by)
    s = _sides(a, b, ids, by)
    out = s.groupBy(*by).agg(
        F.coalesce(F.sum("x"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("y"), F.lit(0)).alias("n_b"), F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("shared"),
    )
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return out.withColumn("gained", F.col("n_b") - F.col("shared")).withColumn("lost", F.col("n_a") - F.col("shared")).withColumn(
        "jaccard", F.when(union == 0, 1.0).otherwise(F.try_divide(F.col("shared").cast("double"), union))
    )


def reference_metrics(reference: DataFrame, found: DataFrame, ids: list[str], least: int = 10, by: list[str] = ()) -> DataFrame:
    """Agreement of a found set with a reference: counts, FDR, precision, recall, F1; undefined ones are null."""
    j = jaccard(reference, found, ids, by)
    tp, fp, fn = F.col("shared").cast("double"), F.col("gained").cast("double"), F.col("lost").cast("double")
    ratio = lambda n, d: F.try_divide(n, d)
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return j.select(
        *by, F.col("shared").alias("tp"), F.col("gained").alias("fp"), F.col("lost").alias("fn"), "jaccard",
        ratio(fp, tp + fp).alias("fdr_ref"), precision.alias("precision"), recall.alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, F.col("n_a").cast("double")).alias("fp_burden"), ratio(fn, F.col("n_a").cast("double")).alias("fn_burden"),
        (F.col("n_b") >= least).alias("reliable"),
    )


def empirical_error_rates(nulls: DataFrame, observed: int, m: int, by: list[str] = ()) -> DataFrame:
    """From null replicate counts v: mean, false-discovery, per-comparison and family-wise error rates."""
    return nulls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("b_null"), F.avg("v").alias("e_v"),
        (F.avg("v") / max(1, observed)).alias("fdr_emp"), (F.avg("v") / max(1, m)).alias("pcer_emp"), F.avg((F.col("v") > 0).cast("double")).alias("fwer_emp"),
        F.stddev_pop("v").alias("v_std"), F.max("v").alias("v_max"), F.count_if(F.col("v") == 0).alias("v_zero"),
    )


def vacuity(prevalence: DataFrame, n0: int, n1: int, share: float = 0.05) -> Column:
    """Patterns that apply to fewer than ``share`` of the cases of a class."""
    return (F.col("n_app0") < share * n0) | (F.col("n_app1") < share * n1)


def vacuity_rates(prevalence: DataFrame, n0: int, n1: int, family: Column, share: float = 0.05) -> DataFrame:
    """(family, n, n_vacuous, rate): how many patterns apply to too few cases of a class."""
    return prevalence.withColumn("family", family).groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(vacuity(prevalence, n0, n1, share)).alias("n_vacuous")
    ).withColumn("rate", F.col("n_vacuous") / F.col("n"))


def inflection(rows: DataFrame, key: str, level: str, low: str, threshold: float = 0.80) -> DataFrame:
    """(key, inflection): the first level whose interval's lower end is below the threshold."""
    return rows.groupBy(key).agg(F.min(F.when(F.col(low) < threshold, F.col(level))).alias("inflection"))


def augmentation_targets(rows: DataFrame, low: str, high: str, centre: float = 0.80, half: float = 0.10) -> DataFrame:
    """Cells whose interval meets the band around the threshold: they get more replicates."""
    return rows.where((F.col(low) <= centre + half) & (F.col(high) >= centre - half))


def harmonic(m: int) -> float:
    return math.fsum(1 / i for i in range(1, m + 1))


def control_tests(counts: list[int], observed: int, alpha: float = 0.05) -> dict[str, float]:
    """One-sided tests of error control from null counts of replicates: a t test of the mean false share, an
    exact binomial test of the share of replicates with any discovery."""
    n, any_hit = len(counts), sum(c > 0 for c in counts)
    shares = [c / max(1, observed) for c in counts]
    mean = math.fsum(shares) / n
    var = math.fsum((s - mean) ** 2 for s in shares) / max(1, n - 1)
    p_mean = student_sf((mean - alpha) / math.sqrt(var / n), n - 1) if var > 0 else float(mean <= alpha)
    return {"fdr_emp": mean, "fdr_p": p_mean, "fwer_emp": any_hit / n, "fwer_p": binomial_sf(any_hit, n, alpha)}
