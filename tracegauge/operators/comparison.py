"""Comparison methods: difference threshold with calibration, Fisher score, chi-square, pooled-null sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_critical
from .ranks import Ordered
from .significance import step_up

#: Threshold grid of the calibration: 0.0001 to 0.9 in steps of 0.0001.
GRID_STEP, GRID_SIZE, TAU_LEAST = 0.0001, 9000, 0.01


def differs(tau: Column | float, least: float = TAU_LEAST) -> Column:
    """|conf1 - conf0| >= tau, where either confidence is interesting."""
    return (F.abs(F.col("conf1") - F.col("conf0")) >= (F.lit(tau) if isinstance(tau, float) else tau)) & ((F.col("conf0") >= least) | (F.col("conf1") >= least))


def threshold_decision(conf: DataFrame, tau: float, least: float = TAU_LEAST) -> DataFrame:
    return conf.where(differs(float(tau), least)).withColumn("delta_conf", F.abs(F.col("conf1") - F.col("conf0")))


def ranked_differences(conf: DataFrame) -> DataFrame:
    """Adds place: by falling difference, then by the larger confidence, then by name."""
    order = [F.desc(F.abs(F.col("conf1") - F.col("conf0"))), F.desc(F.greatest("conf0", "conf1")), "ctype", "a", F.asc_nulls_first("b")]
    return Ordered(conf, *order).rows.drop("part").withColumnRenamed("rank", "place")


def discovery_curve(conf: DataFrame, least: float = TAU_LEAST, step: float = GRID_STEP, size: int = GRID_SIZE) -> DataFrame:
    """(tau, r_obs) on the grid: a histogram and a running sum, not grid x patterns."""
    d = F.abs(F.col("conf1") - F.col("conf0"))
    level = F.least(F.floor(F.round(d / step, 6)), F.lit(size)).cast("int")
    hist = conf.where((F.col("conf0") >= least) | (F.col("conf1") >= least)).select(level.alias("k")).where("k >= 1").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    grid = conf.sparkSession.range(1, size + 1).select(F.col("id").cast("int").alias("k"))
    up = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(F.broadcast(hist), "k", "left").select(F.round(F.col("k") * step, 6).alias("tau"), F.sum(F.coalesce("n", F.lit(0))).over(up).alias("r_obs"))


def calibrate_threshold(conf: DataFrame, target: int, least: float = TAU_LEAST, step: float = GRID_STEP, size: int = GRID_SIZE) -> DataFrame:
    """(tau, r_obs, overshoot, pathology): the tightest threshold that keeps ``target`` discoveries."""
    curve = discovery_curve(conf, least, step, size)
    ok = F.col("r_obs") >= target
    out = curve.agg(
        F.max_by(F.struct("tau", "r_obs"), F.when(ok, F.col("tau"))).alias("best"), F.min_by(F.struct("tau", "r_obs"), "tau").alias("first"), F.max("tau").alias("last"),
    )
    pick = F.coalesce("best", "first")
    return out.select(
        pick["tau"].alias("tau"), pick["r_obs"].alias("r_obs"), (pick["r_obs"] - target).alias("overshoot"),
        F.when(F.col("best").isNull(), "under_discovery_capped").when(F.col("best.tau") == F.col("last"), "over_discovery").otherwise("normal").alias("pathology"),
    )


def threshold_scan(conf: DataFrame, taus: list[float], leasts: list[float]) -> DataFrame:
    """Discoveries by threshold (rows) and interest bound (columns)."""
    spark = conf.sparkSession
    grid = F.broadcast(spark.createDataFrame([(t, m) for t in taus for m in leasts], "tau double, least double"))
    d = F.abs(F.col("conf1") - F.col("conf0"))
    on = (d >= F.col("tau")) & ((F.col("conf0") >= F.col("least")) | (F.col("conf1") >= F.col("least")))
    cells = conf.crossJoin(grid).groupBy("tau", "least").agg(F.count_if(on).alias("n"))
    return cells.groupBy("tau").pivot("least", leasts).agg(F.first("n"))


def fisher_score(eps: float = 1e-12) -> Column:
    """Squared difference of two proportions over their summed variances, with the degenerate cases settled."""
    num = F.pow(F.col("conf1") - F.col("conf0"), 2)
    part = lambda k: F.when(F.col(f"n_app{k}") > 0, F.col(f"conf{k}") * (1 - F.col(f"conf{k}")) / F.greatest(F.col(f"n_app{k}"), F.lit(1))).otherwise(0.0)
    den = part(0) + part(1)
    return F.when(den > eps, num / den).when(num <= eps, 0.0).otherwise(num / eps)


def fisher_decision(conf: DataFrame, alpha: float = 0.05, top: int | None = None) -> DataFrame:
    """Patterns at or above the chi-square cut (or the ``top`` highest)."""
    out = conf.withColumn("score", fisher_score()).withColumn("cut", F.lit(chi2_critical(alpha)))
    return out.orderBy(F.desc("score"), "ctype", "a", "b").limit(top) if top else out.where(F.col("score") >= F.col("cut"))


def contingency_test(prev: DataFrame, alpha: float = 0.05, small: int = 5) -> DataFrame:
    """Yates chi-square of satisfied x class, with step-up rejection and a flag for small expected cells."""
    a, b = F.col("n_sat1").cast("double"), (F.col("n_app1") - F.col("n_sat1")).cast("double")
    c, d = F.col("n_sat0").cast("double"), (F.col("n_app0") - F.col("n_sat0")).cast("double")
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    x = F.when(margins > 0, n * F.pow(F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2), 2) / F.greatest(margins, F.lit(1.0))).otherwise(0.0)
    expected = F.least((a + b) * (a + c), (a + b) * (b + d), (c + d) * (a + c), (c + d) * (b + d)) / F.greatest(n, F.lit(1.0))
    out = prev.withColumn("chi2", x).withColumn("small_cells", expected < small)
    return step_up(_with_tail(out), "p", ["ctype", "a", "b"], alpha)


def _with_tail(df: DataFrame) -> DataFrame:
    from ..functions.special import chi2_tail

    return df.withColumn("p", F.when(F.col("chi2") <= 0, 1.0).otherwise(chi2_tail(F.col("chi2"), F.lit(1.0))))


def pooled_null_sweep(observed: DataFrame, null: DataFrame, count: int, alpha: float = 0.05, pi0: float = 1.0) -> DataFrame:
    """(tau, r, fdp): the least threshold on |statistic| whose pooled-null false-discovery share is at most alpha.

    observed(delta) per pattern, null(stat) over all patterns and replicates.  Both are counted down from the
    largest value by running sums over distinct values.
    """
    o = observed.select(F.round(F.abs("delta"), 12).alias("t"), F.lit(1).alias("o"), F.lit(0).alias("z"))
    z = null.select(F.round(F.abs("stat"), 12).alias("t"), F.lit(0).alias("o"), F.lit(1).alias("z"))
    levels = o.union(z).groupBy("t").agg(F.sum("o").alias("o"), F.sum("z").alias("z"))
    swept = Ordered(levels, F.desc("t")).with_sum(F.col("o"), "r").with_sum(F.col("z"), "v").rows
    swept = swept.withColumn("v", F.col("v") / F.lit(float(count))).where("o > 0")
    fdp = F.lit(pi0) * F.col("v") / F.greatest(F.col("r"), F.lit(1))
    return swept.withColumn("fdp", F.least(F.lit(1.0), fdp)).where(F.col("fdp") <= alpha).orderBy("t").limit(1).select(F.col("t").alias("tau"), "r", "fdp")


def inflation(observed_null: DataFrame) -> DataFrame:
    """(spec, pattern_sd, pooled_sd, inflation): how far the pooled null is from each pattern's own."""
    pooled = observed_null.agg(F.stddev_pop("stat").alias("pooled_sd"))
    return observed_null.groupBy("ctype", "a", "b").agg(F.stddev_pop("stat").alias("pattern_sd")).crossJoin(F.broadcast(pooled)).withColumn(
        "inflation", F.try_divide("pooled_sd", "pattern_sd"))


def pooled_inflation(tested: DataFrame, null: DataFrame, count: int, tau: float, pi0: float = 1.0) -> DataFrame:
    """(tau, pooled, own, factor): false discoveries expected at |delta| >= tau by the pooled null of all patterns, and by
    each discovered pattern's own null beyond its own difference; and how many times the former is the latter."""
    at = null.where(F.abs("stat") >= tau).agg(F.count(F.lit(1)).alias("n"))
    own = tested.where(F.abs("delta") >= tau).agg(F.coalesce(F.sum("exceed_two"), F.lit(0)).alias("k"))
    pooled, single = F.lit(pi0) * F.col("n") / F.lit(float(count)), F.lit(pi0) * F.col("k") / F.lit(float(count))
    return at.crossJoin(F.broadcast(own)).select(F.lit(tau).alias("tau"), pooled.alias("pooled"), single.alias("own"), (pooled / F.greatest(single, F.lit(1e-15))).alias("factor"))


def pooled_null_report(tested: DataFrame, null: DataFrame, count: int, tau: float, family: Column, alpha: float = 0.05, pi0: float = 1.0) -> DataFrame:
    """One row: why a pooled null fails here.  The ratio of the largest to the smallest mean spread of a family's nulls, the
    inflation at ``tau``, and how many patterns the pooled sweep still finds."""
    spread = null_spread_by_family(null, family).agg((F.max("mean") / F.greatest(F.min("mean"), F.lit(1e-15))).alias("spread_ratio"))
    sweep = pooled_null_sweep(tested, null.select("stat"), count, alpha, pi0).agg(F.coalesce(F.max("r"), F.lit(0)).cast("long").alias("pooled_found"))
    return pooled_inflation(tested, null, count, tau, pi0).crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(sweep))


def null_spread_by_family(null: DataFrame, family: Column) -> DataFrame:
    """Mean, deviation, extremes, median and number of the patterns' null deviations, by template family."""
    per = null.groupBy("ctype", "a", "b").agg(F.stddev_pop(F.abs("stat")).alias("sd")).withColumn("family", family)
    return per.groupBy("family").agg(
        F.avg("sd").alias("mean"), F.stddev_pop("sd").alias("std"), F.min("sd").alias("min"), F.max("sd").alias("max"), F.median("sd").alias("median"), F.count(F.lit(1)).alias("n"),
    )
