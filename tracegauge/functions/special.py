"""Special functions without SciPy: gamma and beta tails, normal quantiles (numpy, vectorised)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    front = np.exp(-x + a * np.log(np.maximum(x, 1e-300)) - _lgamma(np.maximum(a, 1e-300)))
    low = (x > 0) & (x < a + 1)
    if low.any():
        aa, xx = a[low], x[low]
        term = 1 / aa
        total, n = term.copy(), aa.copy()
        for _ in range(1000):
            n = n + 1
            term = term * xx / n
            total = total + term
            if np.all(np.abs(term) < 1e-16 * np.abs(total)):
                break
        out[low] = 1 - total * front[low]
    high = x >= a + 1
    if high.any():
        aa, xx = a[high], x[high]
        b = xx + 1 - aa
        c, d = np.full(aa.shape, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 1000):
            an = -i * (i - aa)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        out[high] = front[high] * h
    return np.clip(out, 0, 1)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def chi2_sf(x, df):
    return gamma_q(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def student_sf(t: float, df: float) -> float:
    p = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return p if t >= 0 else 1 - p


def binomial_sf(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else beta_i(k, n - k + 1, p)


normal_cdf = NormalDist().cdf
normal_ppf = NormalDist().inv_cdf


def chi2_tail(x, df):
    """Upper tail of chi-square with real degrees of freedom, as a column."""

    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(chi2_sf(x.to_numpy(float), df.to_numpy(float)))

    return F.pandas_udf(tail, "double")(x, df)


def chi2_critical(alpha: float) -> float:
    """Critical value for one degree of freedom."""
    return normal_ppf(1 - alpha / 2) ** 2


def bca(values, statistic=np.mean, level: float = 0.95, draws: int = 2000, seed: int = 42, interpolate: bool = True) -> tuple[float, float]:
    """Bias-corrected accelerated bootstrap interval; a constant sample gives its value twice.

    interpolate: ends by linear percentiles (else by clipped index).
    """
    x = np.asarray(values, float)
    if len(x) == 0:
        return math.nan, math.nan
    seen = float(statistic(x))
    if len(x) == 1 or np.all(x == x[0]):
        return seen, seen
    rng = np.random.default_rng(seed)
    boot = np.sort([statistic(s) for s in x[rng.integers(0, len(x), (draws, len(x)))]])
    below = np.clip((boot < seen).mean(), 1 / (draws + 1), draws / (draws + 1))
    z0 = normal_ppf(below)
    if statistic is np.mean:
        jack = (x.sum() - x) / (len(x) - 1)
    else:
        jack = np.array([statistic(np.delete(x, i)) for i in range(len(x))])
    d = jack.mean() - jack
    a = (d**3).sum() / (6 * max((d**2).sum(), 1e-300) ** 1.5)
    ends = []
    for q in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + normal_ppf(q)
        p = normal_cdf(z0 + z / (1 - a * z))
        ends.append(float(np.percentile(boot, 100 * p)) if interpolate else float(boot[min(draws - 1, max(0, int(p * draws)))]))
    return ends[0], ends[1]


def percentile_interval(values, level: float = 0.95, draws: int = 1000, seed: int = 42) -> tuple[float, float]:
    x = np.asarray(values, float)
    if len(x) == 0:
        return math.nan, math.nan
    rng = np.random.default_rng(seed)
    boot = x[rng.integers(0, len(x), (draws, len(x)))].mean(1)
    return float(np.percentile(boot, 50 * (1 - level))), float(np.percentile(boot, 50 * (1 + level)))
