"""Deterministic resampling and perturbation of logs, by hash order.

A draw is the order of md5(seed | replicate | ids), so it is the same on every engine, on every partitioning
and when a task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[F.lit(str(p)) if not isinstance(p, (str, Column)) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def uniform(*parts) -> Column:
    """In [0, 1): the first 32 bits of a draw."""
    return F.conv(F.substring(draw(*parts), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def replicates(df: DataFrame, count: int, first: int = 0) -> DataFrame:
    """Each row once for each replicate number; ``count`` rows are broadcast."""
    reps = df.sparkSession.range(first, first + count).select(F.col("id").cast("int").alias("rep"))
    return df.crossJoin(F.broadcast(reps))


def permuted_labels(cases: DataFrame, count: int, seed: int = 42, keys: list[str] = ()) -> DataFrame:
    """(keys, rep, case_id, label): in every replicate as many positive cases as observed, drawn by rank.

    A replicate is ranked in 4096 parts, by the first digits of its draws; the part in which the last positive case lies is
    found from their sizes, so that no task puts a whole replicate in order.  Keys are never null; an outcome of null counts as
    negative, and a case that is there twice is drawn twice.
    """
    log = [*keys, "rep"]
    rows = replicates(cases.select(*keys, "case_id", "outcome"), count).withColumn("_h", draw(seed, *keys, "rep", "case_id"))
    rows = rows.withColumn("_part", F.substring("_h", 1, 3))
    sizes = rows.groupBy(*log, "_part").agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("positive"))
    whole = Window.partitionBy(*log)
    upto = F.sum("n").over(whole.orderBy("_part"))
    left = F.sum("positive").over(whole) - (upto - F.col("n"))
    cut = sizes.select(*log, "_part", left.alias("left"), "n").where("left > 0 and left <= n").select(*log, F.col("_part").alias("_cut"), "left")
    rank = F.row_number().over(Window.partitionBy(*log, "_part").orderBy("_h", "case_id"))
    label = (F.col("_part") < F.col("_cut")) | ((F.col("_part") == F.col("_cut")) & (F.col("_rank") <= F.col("left")))
    placed = rows.withColumn("_rank", rank).join(cut, log, "left")  # a row for each replicate
    return placed.select(*log, "case_id", F.coalesce(label, F.lit(False)).cast("int").alias("label"))


def permuted_traces(traces: DataFrame, count: int, seed: int = 42, keys: list[str] = ()) -> DataFrame:
    """(keys, rep, case_id, outcome, trace): every trace with its events in drawn order; no shuffle."""
    return _in_drawn_order(replicates(traces.select(*keys, "case_id", "outcome", "trace"), count), seed, keys)


def _in_drawn_order(rows: DataFrame, seed: int, keys: list[str] = ()) -> DataFrame:
    head = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("rep").cast("string"), F.col("case_id"))
    order = F.array_sort(F.transform("trace", lambda e, i: F.struct(F.md5(F.concat_ws("|", head, i.cast("string"))).alias("h"), i.alias("i"), e.alias("e"))))
    return rows.select(*keys, "rep", "case_id", "outcome", F.transform(order, lambda s: s["e"]).alias("trace"))


def double_null(traces: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """(rep, case_id, outcome, trace): labels permuted, then every trace permuted."""
    labels = permuted_labels(traces, count, seed).withColumnRenamed("label", "outcome")
    # a trace moves once, not once for each replicate
    return _in_drawn_order(labels.join(traces.select("case_id", "trace"), "case_id"), seed + 1)


def label_noise(traces: DataFrame, eps: float, seed: int = 42) -> DataFrame:
    """Flip each case's outcome with probability eps; traces stay, so their holds can be reused."""
    return traces.withColumn("outcome", F.when(uniform(seed, "case_id") < eps, 1 - F.col("outcome")).otherwise(F.col("outcome")).cast("int"))


def order_noise(traces: DataFrame, rho: float, seed: int = 42) -> DataFrame:
    """Swap round(rho (n - 1)) drawn adjacent pairs one after another, from the left."""
    n = F.size("trace")
    k = F.bround(F.lit(rho) * (n - 1), 0).cast("int")
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(draw(seed, "case_id", i).alias("h"), i.alias("i"))))
    chosen = F.array_sort(F.transform(F.slice(drawn, 1, k), lambda s: s["i"]))

    def swap(t, i):
        return F.concat(F.slice(t, 1, i), F.slice(t, i + 2, 1), F.slice(t, i + 1, 1), F.slice(t, i + 3, F.size(t)))

    swapped = F.aggregate(chosen, F.col("trace"), swap)
    return traces.withColumn("trace", F.when((n >= 2) & (k >= 1), swapped).otherwise(F.col("trace")))


def joint_noise(traces: DataFrame, eps: float, rho: float, seed: int = 42) -> DataFrame:
    return order_noise(label_noise(traces, eps, seed), rho, seed + 1)


def random_swap(traces: DataFrame, eps: float, seed: int = 42) -> DataFrame:
    """With probability eps, swap two drawn positions of a trace."""
    n = F.size("trace")
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(draw(seed + 1, "case_id", i).alias("h"), i.alias("i"))))
    p, q = F.element_at(drawn, 1)["i"], F.element_at(drawn, 2)["i"]
    other = F.transform("trace", lambda e, i: F.when(i == p, F.element_at("trace", q + 1)).when(i == q, F.element_at("trace", p + 1)).otherwise(e))
    return traces.withColumn("trace", F.when((n >= 2) & (uniform(seed, "case_id") < eps), other).otherwise(F.col("trace")))


#: Half of the band around an expected cut, in standard deviations.
BAND = 6.0


def _chosen(traces: DataFrame, eps: float, seed: int) -> DataFrame:
    """``picked``: max(1, round(n eps)) drawn cases.  Draws are uniform, so the cut lies in a narrow band around eps;
    only cases in it are sorted, about sqrt(n) of them (all of them, should the cut lie outside the band)."""
    rows = traces.withColumn("_h", draw(seed, "case_id")).withColumn("_u", F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") / F.lit(4294967296.0))
    n = rows.count()
    k, half = max(1, round(n * eps)), BAND * (eps * (1 - eps) / max(n, 1)) ** 0.5 + 1e-6
    for low, high in ((eps - half, eps + half), (-1.0, 2.0)):
        below, near = rows.agg(F.count_if(F.col("_u") < low), F.count_if((F.col("_u") >= low) & (F.col("_u") <= high))).first()
        if 0 <= k - below <= near or n < k:
            break
    cut = rows.where((F.col("_u") >= low) & (F.col("_u") <= high)).orderBy("_h", "case_id").limit(max(0, k - below)).select("case_id", F.lit(True).alias("_in"))
    picked = (F.col("_u") < low) | F.coalesce("_in", F.lit(False))
    return rows.join(cut, "case_id", "left").withColumn("picked", picked).drop("_h", "_u", "_in")


def flip_exactly(traces: DataFrame, eps: float, seed: int = 42) -> DataFrame:
    out = _chosen(traces, eps, seed)
    return out.withColumn("outcome", F.when(F.col("picked"), 1 - F.col("outcome")).otherwise(F.col("outcome")).cast("int")).drop("picked")


def truncate(traces: DataFrame, eps: float, seed: int = 42) -> DataFrame:
    """Cut max(1, round(n eps)) drawn traces to their first max(1, ceil((1 - eps) L)) events."""
    keep = F.greatest(F.lit(1), F.ceil(F.round(F.lit(1.0 - eps) * F.size("trace"), 9)).cast("int"))
    out = _chosen(traces, eps, seed)
    return out.withColumn("trace", F.when(F.col("picked"), F.slice("trace", 1, keep)).otherwise(F.col("trace"))).drop("picked")


#: Perturbation families by name.
PERTURBATIONS = {"order": random_swap, "labels": flip_exactly, "truncation": truncate}
#: Those that leave the traces alone: holds of the clean log serve for them.
LABELS_ONLY = ("labels",)
