"""Evaluation drivers: error rates under a double null, noise grids, perturbation families.

A method is a condition on a pattern's confidences and counts in the two classes: what it discovers are the patterns that
meet it.  All cells of a study, and the log as it is, are evaluated in one job, keyed by the cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special, templates as tp
from ..operators import bootstrap, cells, comparison, resampling, significance
from ..shared import shared_folder

KEYS = ["ctype", "a", "b"]
EPS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5)
RHO = (0.0, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0)
LEVELS = (0.02, 0.05, 0.1, 0.2, 0.3)


def threshold_method(tau: float = 0.02) -> Column:
    return comparison.differs(tau)


def fisher_method(alpha: float = 0.05) -> Column:
    return comparison.fisher_score() >= special.chi2_critical(alpha)


def discoveries(traces: DataFrame, cands: DataFrame, change, methods: dict[str, Column]) -> DataFrame:
    """(cell, method, pattern) over all cells, written to shared storage."""
    conf = cells.confidences(traces, cands, change)
    named = F.array_compact(F.array(*[F.when(hit, F.lit(m)) for m, hit in methods.items()]))
    found = conf.select("cell", *KEYS, F.explode(named).alias("method"))
    folder = shared_folder(traces.sparkSession, "discoveries")
    found.write.parquet(folder)
    return traces.sparkSession.read.schema(found.schema).parquet(folder)


def agreement(found: DataFrame, clean: int, methods: dict[str, Column], families: DataFrame | None = None) -> DataFrame:
    """(cell, method, agreement with the cell ``clean``) of the cells before it, also of those without a discovery.

    families: (template_family), to compare the patterns of each family by themselves.
    """
    spark = found.sparkSession
    keys = spark.range(clean).select(F.col("id").cast("int").alias("cell")).crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in methods], "method string")))
    by = ["cell", "method"]
    if families is not None:
        keys, by = keys.crossJoin(F.broadcast(families)), [*by, "template_family"]  # as many as templates at most
        found = found.withColumn("template_family", tp.family())
    reference = keys.join(found.where(F.col("cell") == clean).drop("cell"), by[1:])
    met = significance.reference_metrics(reference, found.where(F.col("cell") < clean), KEYS, by=by)
    # a cell in which neither side has anything: two empty sets are equal
    zero = {"tp": 0, "fp": 0, "fn": 0, "jaccard": 1.0, "reliable": False}
    return keys.join(met, by, "left").na.fill(zero)


def _with_names(rows: DataFrame, named: list[tuple], schema: str) -> DataFrame:
    """Adds what a cell stands for."""
    names = rows.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(named)], "cell int, " + schema)
    return names.join(rows, "cell").drop("cell")


def error_rates(traces: DataFrame, cands: DataFrame, count: int, seed: int = 42, tau: float = 0.02, alpha: float = 0.05) -> DataFrame:
    """(method, r_obs, b_null, e_v, fdr_emp, ..., bca_low, bca_high) of the threshold and the Fisher method."""
    methods = {"threshold": threshold_method(tau), "fisher": fisher_method(alpha)}
    v = null_counts(traces, cands, methods, count, seed).cache()
    observed = {r["method"]: r["v"] for r in v.where(F.col("rep") == count).collect()}
    null, m = v.where(F.col("rep") < count), cands.count()
    rates = None
    for name in methods:
        part = significance.empirical_error_rates(null.where(F.col("method") == name), observed[name], m, ["method"]).withColumn("r_obs", F.lit(observed[name]))
        part = part.withColumn("controls", F.col("fdr_emp") <= alpha)
        rates = part if rates is None else rates.unionByName(part)
    ends = bootstrap.intervals(null, ["method"], "v", draws=2000).select("method", "bca_low", "bca_high")
    return rates.join(ends, "method").withColumn("fdr_low", F.col("bca_low") / F.greatest("r_obs", F.lit(1))).withColumn("fdr_high", F.col("bca_high") / F.greatest("r_obs", F.lit(1)))


def null_counts(traces: DataFrame, cands: DataFrame, methods: dict[str, Column], count: int, seed: int = 42) -> DataFrame:
    """(rep, method, v): discoveries on double-null logs, and, as replicate ``count``, on the log as it is."""
    found = discoveries(traces, cands, cells.Together(cells.DoubleNull(traces, count, seed), cells.Unchanged()), methods)
    spark = traces.sparkSession
    keys = spark.range(count + 1).select(F.col("id").cast("int").alias("cell")).crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in methods], "method string")))
    seen = found.groupBy("cell", "method").agg(F.count(F.lit(1)).alias("v"))
    return keys.join(seen, ["cell", "method"], "left").na.fill(0).withColumnRenamed("cell", "rep")


def noise_grid(traces: DataFrame, cands: DataFrame, methods: dict[str, Column], eps=EPS, rho=RHO, seed: int = 42) -> DataFrame:
    """(eps, rho, method, agreement with the clean result).  Order noise is drawn once for each rho: label noise leaves
    traces alone."""
    grid = cells.NoiseGrid(eps, rho, seed)
    found = discoveries(traces, cands, cells.Together(grid, cells.Unchanged()), methods)
    return _with_names(agreement(found, grid.cells, methods), [(float(e), float(r)) for r in rho for e in eps], "eps double, rho double")


def perturbation_study(traces: DataFrame, cands: DataFrame, methods: dict[str, Column], families=tuple(resampling.PERTURBATIONS), levels=LEVELS, repeats: int = 10, seed: int = 42, first: int = 0, by_family: bool = False) -> DataFrame:
    """(family, eps, rep, method, agreement metrics) against the clean result; repeats are numbered from ``first``.

    by_family: for each template family by itself (``template_family``).
    """
    order = list(resampling.PERTURBATIONS)
    named = [(name, float(e), rep) for name in families for e in levels for rep in range(first, first + repeats)]
    return _studied(traces, cands, methods, [(*x, seed + 100_000 * (order.index(x[0]) + 1) + round(1e4 * x[1]) + 7919 * x[2]) for x in named], by_family)


def _studied(traces: DataFrame, cands: DataFrame, methods: dict[str, Column], what: list[tuple], by_family: bool = False) -> DataFrame:
    change = cells.Perturbations(traces, [(name, e, s) for name, e, _, s in what])
    found = discoveries(traces, cands, cells.Together(change, cells.Unchanged()), methods)
    families = cands.select(tp.family().alias("template_family")).distinct() if by_family else None
    return _with_names(agreement(found, change.cells, methods, families), [x[:3] for x in what], "family string, eps double, rep int")


def summarise(study: DataFrame) -> DataFrame:
    """(family, eps, method, and template_family if there, mean and interval of the Jaccard index, mean FDR) over repeats."""
    keys = [c for c in ("family", "eps", "method", "template_family") if c in study.columns]
    ends = bootstrap.intervals(study, keys, "jaccard").select(*keys, "pct_low", "pct_high")
    means = study.groupBy(*keys).agg(F.avg("jaccard").alias("jaccard"), F.avg("fdr_ref").alias("fdr_ref"), F.count(F.lit(1)).alias("n"))
    return means.join(ends, keys)


def adaptive_study(traces: DataFrame, cands: DataFrame, methods: dict[str, Column], first: int = 3, more: int = 7, **options) -> DataFrame:
    """A first round of repeats, then more, in one job, for cells whose interval meets the band around 0.80."""
    start = perturbation_study(traces, cands, methods, repeats=first, **options).cache()
    targets = significance.augmentation_targets(summarise(start), "pct_low", "pct_high").select("family", "eps").distinct().orderBy("family", "eps").collect()  # cells
    if not targets:
        return start
    order, seed = list(resampling.PERTURBATIONS), options.get("seed", 42)
    named = [(r["family"], r["eps"], rep) for r in targets for rep in range(first, first + more)]
    extra = _studied(traces, cands, methods, [(*x, seed + 100_000 * (order.index(x[0]) + 1) + round(1e4 * x[1]) + 7919 * x[2]) for x in named])
    return start.unionByName(extra)


def family_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard index by template family."""
    add = lambda d: d.withColumn("family", tp.family())
    return significance.jaccard(add(a), add(b), KEYS, ["family"])
