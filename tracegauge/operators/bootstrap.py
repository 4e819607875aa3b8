"""Bootstrap intervals of means whose draws are hashes, so that they don't depend on partitions or retries and SQL can
check them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_cdf, normal_ppf
from .resampling import uniform

#: Digits to which means are compared.
DIGITS = 12


def resampled_means(df: DataFrame, by: list[str], value: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(by, values, mean, draw, resampled): ``draws`` means of as many values, drawn with replacement, as the group has.

    A group is a set of replicates of one study, held as an array in order of value; the draws of few groups are dealt over
    all cores.
    """
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    groups = kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("values"))  # one value a replicate
    groups = groups.withColumn("n", F.size("values"))
    total = F.aggregate("values", F.lit(0.0), lambda acc, v: acc + v)
    rows = groups.select("*", F.round(total / F.col("n"), DIGITS).alias("mean"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism, *by, "draw")
    at = lambda i: F.floor(uniform(seed, *by, "draw", i) * F.col("n")).cast("int")
    drawn = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda acc, i: acc + F.get("values", at(i)))
    return rows.select(*by, "values", "mean", "draw", F.round(drawn / F.col("n"), DIGITS).alias("resampled"))


def _accelerated(below: Column, acceleration: Column, z: float, draws: int) -> Column:
    """The share of resampled means below an accelerated end; one row a group."""

    def shares(below: pd.Series, a: pd.Series) -> pd.Series:
        out = []
        for b, c in zip(below, a):
            z0 = normal_ppf(min(max(b, 1 / (draws + 1)), draws / (draws + 1)))
            out.append(normal_cdf(z0 + (z0 + z) / (1 - c * (z0 + z))))
        return pd.Series(out, dtype=float)

    return F.pandas_udf(shares, "double")(below, acceleration)


def intervals(df: DataFrame, by: list[str], value: str, level: float = 0.95, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(by, n, mean, pct_low, pct_high, below, acceleration, bca_low, bca_high) of each group's mean.

    Percentile ends, and bias-corrected accelerated ends by the share of resampled means ``below`` the mean and the
    acceleration of the jackknife; both are linear between neighbours.  A group of equal values has no width; its
    acceleration is 0 / 0 and shown as NaN, its ends take it as 0.  Nulls and NaN are left out; a group without values has
    no row.
    """
    tails = ((1 - level) / 2, (1 + level) / 2)
    means = resampled_means(df, by, value, draws, seed)
    size = lambda p: F.aggregate("values", F.lit(0.0), lambda acc, v: acc + F.pow(v - F.col("mean"), p))
    rows = means.groupBy(*by).agg(
        F.first("values").alias("values"), F.first("mean").alias("mean"), F.array_sort(F.collect_list("resampled")).alias("boot"),  # ``draws`` values
        F.avg((F.col("resampled") < F.col("mean")).cast("double")).alias("below"),
    )
    spread = size(2)
    rows = rows.withColumn("acceleration", F.round(F.when(spread > 1e-18, size(3) / (6 * F.pow(spread, 1.5))).otherwise(math.nan), DIGITS))

    def end(share: Column) -> Column:
        place = share * (draws - 1)
        low = F.floor(place).cast("int")
        first, second = F.get("boot", low), F.get("boot", F.least(low + 1, F.lit(draws - 1)))
        return first + (second - first) * (place - low)

    ends = [end(F.lit(t)).alias(name) for t, name in zip(tails, ("pct_low", "pct_high"))]
    shares = [_accelerated(F.col("below"), F.nanvl("acceleration", F.lit(0.0)), normal_ppf(t), draws).alias(name) for t, name in zip(tails, ("_low", "_high"))]
    rows = rows.select("*", *shares)
    return rows.select(*by, F.size("values").alias("n"), "mean", *ends, "below", "acceleration", end(F.col("_low")).alias("bca_low"), end(F.col("_high")).alias("bca_high"))
