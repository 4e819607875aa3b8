"""Hash-drawn bootstrap intervals against the same draws in numpy."""

import hashlib
import math

import numpy as np

from tracegauge.functions import special
from tracegauge.operators import bootstrap


def means(key, values, draws):
    x = sorted(values)
    at = lambda d, i: int(int(hashlib.md5(f"42|{key}|{d}|{i}".encode()).hexdigest()[:8], 16) / 4294967296 * len(x))
    return np.array([sum(x[at(d, i)] for i in range(len(x))) / len(x) for d in range(draws)])


def test_intervals_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"skewed": list(map(float, rng.poisson(2, 40) ** 2)), "small": [0.25, 0.75], "even": [3.0] * 5, "one": [7.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("small", None), ("small", math.nan), ("none", None)]
    got = {r["k"]: r for r in bootstrap.intervals(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", draws=400).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        r, boot, x = got[k], means(k, values, 400), np.array(values)
        below = (boot < x.mean() - 1e-12).mean()
        assert (r["n"], r["below"]) == (len(values), below) and math.isclose(r["mean"], x.mean())
        assert np.allclose([r["pct_low"], r["pct_high"]], np.percentile(boot, [2.5, 97.5]), atol=1e-9)
        d = x.mean() - x
        a = -(d**3).sum() / (6 * (d**2).sum() ** 1.5) if d.any() else 0.0
        z0 = special.normal_ppf(min(max(below, 1 / 401), 400 / 401))
        share = [special.normal_cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in map(special.normal_ppf, (0.025, 0.975))]
        assert np.allclose([r["bca_low"], r["bca_high"]], [np.percentile(boot, 100 * p) for p in share], atol=1e-8)


def test_same_on_any_partitioning(spark):
    df = spark.range(30).selectExpr("'g' as k", "cast(pow(id % 7, 2) as double) as v")
    one, many = (bootstrap.intervals(df.repartition(n), ["k"], "v", draws=100).first() for n in (1, 7))
    assert one == many and one["pct_low"] < one["mean"] < one["pct_high"]
    assert bootstrap.intervals(df.limit(0), ["k"], "v", draws=100).count() == 0


def test_acceleration_without_spread_is_undefined(spark):
    """As SQL's 0 / 0; the ends are there all the same."""
    df = spark.createDataFrame([("even", 0.0)] * 10 + [("one", 7.0), ("two", 1.0), ("two", 3.0)], "k string, v double")
    got = {r["k"]: r for r in bootstrap.intervals(df, ["k"], "v", draws=50).collect()}
    assert math.isnan(got["even"]["acceleration"]) and math.isnan(got["one"]["acceleration"]) and got["two"]["acceleration"] == 0.0
    assert (got["even"]["bca_low"], got["even"]["bca_high"], got["one"]["bca_low"], got["one"]["bca_high"]) == (0.0, 0.0, 7.0, 7.0)
