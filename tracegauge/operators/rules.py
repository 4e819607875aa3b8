"""Splits, trees, rules and greedy coverage as keyed jobs: all constraints, or all replicates of a log, go in one pass.

Features are long (keys, case_id, feature, value), absent values being 0.  A split is searched on class histograms of a
feature's values, so that what is put in order within a group are at most twice ``bins`` rows, however many cases it has.
Trees grow by levels; nodes are numbered from 1, the children of n being 2 n and 2 n + 1, so that a leaf's number tells
its path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_folder
from .ranks import Ordered

#: Bins of a feature's values on either side of 0; a feature of no more distinct values is split exactly.
BINS = 256
#: Digits to which gains and scores are compared; equal ones go by name.
DIGITS = 9


def stored(df: DataFrame, kind: str) -> DataFrame:
    folder = shared_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def binned(features: DataFrame, bins: int = BINS) -> DataFrame:
    """``features`` without zeros, NaN and nulls, and ``bin``: the place of a value among its feature's edges.

    Edges part the distinct values of a sign into ``bins`` runs of equal length; positive and negative values share none.
    """
    held = features.where("value is not null and not isnan(value) and value <> 0")
    places = Ordered(held.select("feature", "value").distinct(), "feature", "value").rows
    side = ["feature", F.signum("value").alias("side")]
    extent = places.groupBy(*side).agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    run = F.floor((F.col("rank") - F.col("first")) * F.lit(bins).cast("long") / F.col("n"))
    edges = places.withColumn("side", F.signum("value")).join(extent, ["feature", "side"]).groupBy("feature", "side", run.alias("run")).agg(F.min("value").alias("edge"))
    lists = edges.groupBy("feature").agg(F.array_sort(F.collect_list("edge")).alias("edges"))  # twice ``bins`` at most
    return held.join(lists, "feature").withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("value")))).drop("edges")


def _impurity(n0, n1):
    """Gini impurity times the number of cases."""
    return F.coalesce(F.try_divide(2.0 * n0 * n1, n0 + n1), F.lit(0.0))


def best_splits(members: DataFrame, features: DataFrame, by: list[str], on: list[str] = ("case_id",)) -> DataFrame:
    """(by, feature, threshold, gain, n0, n1): of each group of cases the split of most gain in Gini impurity.

    members: (by, on, outcome), a case once in a group; features: binned, joined to members by ``on``.  A threshold lies
    midway between neighbouring values of the group.  Ties go to the least feature, then the least threshold; a group of
    one class, or of equal values, has no row.
    """
    by, on = list(by), list(on)
    count = lambda k: F.count_if(F.col("outcome") == k)
    totals = members.groupBy(*by).agg(count(0).alias("n0"), count(1).alias("n1")).where("n0 > 0 and n1 > 0")
    joined = members.join(features.select(*on, "feature", "value", "bin"), on)
    return _best(joined, totals, by)


def _best(joined: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """The splits of most gain, from (by, outcome, feature, value, bin) and each group's size by class."""
    count = lambda k: F.count_if(F.col("outcome") == k)
    hist = joined.groupBy(*by, "feature", "bin").agg(count(0).alias("c0"), count(1).alias("c1"), F.min("value").alias("low"), F.max("value").alias("high"))
    return best_of(hist, totals, by)


def best_of(hist: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """The splits of most gain, from class histograms (by, feature, bin, c0, c1, low, high) of the values other than 0."""
    rest = hist.groupBy(*by, "feature").agg(F.sum("c0").alias("s0"), F.sum("c1").alias("s1")).join(totals, by)
    zero = rest.where("s0 + s1 < n0 + n1").select(*by, "feature", F.lit(None).cast("int").alias("bin"), (F.col("n0") - F.col("s0")).alias("c0"), (F.col("n1") - F.col("s1")).alias("c1"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    w = Window.partitionBy(*by, "feature").orderBy("low")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    cuts = hist.unionByName(zero).select(*by, "feature", F.sum("c0").over(upto).alias("l0"), F.sum("c1").over(upto).alias("l1"), "high", F.lead("low").over(w).alias("next"))
    cuts = cuts.where("next is not null").join(totals, by)
    n0, n1, l0, l1 = (F.col(c) for c in ("n0", "n1", "l0", "l1"))
    gain = F.round((_impurity(n0, n1) - _impurity(l0, l1) - _impurity(n0 - l0, n1 - l1)) / (n0 + n1), DIGITS)
    best = cuts.groupBy(*by).agg(F.min(F.struct((-gain).alias("loss"), "feature", ((F.col("high") + F.col("next")) / 2).alias("threshold"), "n0", "n1")).alias("s"))
    return best.where("s.loss < 0").select(*by, "s.feature", "s.threshold", (-F.col("s.loss")).alias("gain"), "s.n0", "s.n1")


# ---- trees and their rules ----------------------------------------------------------------------------------


def grow(cases: DataFrame, features: DataFrame, by: list[str] = (), depth: int = 5, bins: int = BINS) -> DataFrame:
    """(by, node, n0, n1, feature, threshold): one decision tree for each key, all of them a level a job.

    cases: (by, case_id, outcome); features: (by, case_id, feature, value).  Leaves have no feature.  A case's features are
    brought together once; after that, what is shuffled at a level are class histograms, and a case finds its node from the
    splits, which are broadcast (2 ** depth for each key at most).
    """
    by = list(by)
    on, group = [*by, "case_id"], [*by, "node"]
    own = binned(features.select(*on, "feature", "value"), bins).groupBy(*on).agg(F.collect_list(F.struct("feature", "value", "bin")).alias("held"))
    members = cases.select(*on, "outcome").join(own, on, "left").select(*by, "outcome", "held", F.lit(1).cast("long").alias("node"))
    members = stored(members, "members")
    count = lambda k: F.count_if(F.col("outcome") == k)
    nodes = None
    for level in range(depth + 1):
        size = stored(members.groupBy(*group).agg(count(0).alias("n0"), count(1).alias("n1")), "sizes")
        if level == depth:
            found = size.withColumn("feature", F.lit(None).cast("string")).withColumn("threshold", F.lit(None).cast("double"))
        else:
            rows = members.select(*group, "outcome", F.explode("held").alias("h")).select(*group, "outcome", "h.*")
            best = stored(_best(rows, size.where("n0 > 0 and n1 > 0"), group).select(*group, "feature", "threshold"), "splits")
            found = size.join(best, group, "left")
        nodes = found if nodes is None else nodes.unionByName(found)
        if level == depth or best.isEmpty():
            break
        value = F.coalesce(F.get(F.filter("held", lambda h: h["feature"] == F.col("feature")), F.lit(0))["value"], F.lit(0.0))
        moved = members.join(F.broadcast(best), group)
        members = moved.select(*by, "outcome", "held", (2 * F.col("node") + (value > F.col("threshold")).cast("long")).alias("node"))
    return stored(nodes.select(*by, "node", "n0", "n1", "feature", "threshold"), "tree")


def model_nodes(model, names: list[str]) -> DataFrame:
    """The nodes of a fitted decision tree, in the form of :func:`grow`, from the table that the model is saved as."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    folder = shared_folder(spark, "model")
    model.write().save(folder)
    saved = spark.read.parquet(f"{folder}/data").select(
        "id", "leftChild", "rightChild", F.get("impurityStats", F.lit(0)).cast("long").alias("n0"), F.get("impurityStats", F.lit(1)).cast("long").alias("n1"),
        F.when(F.col("leftChild") >= 0, F.get(F.lit(names), F.col("split.featureIndex"))).alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    ).cache()
    here = saved.where("id = 0").withColumn("node", F.lit(1).cast("long"))
    out = here
    for _ in range(model.depth):
        child = here.where("leftChild >= 0").select(F.explode(F.array(F.struct(F.col("leftChild").alias("id"), (2 * F.col("node")).alias("node")), F.struct(F.col("rightChild").alias("id"), (2 * F.col("node") + 1).alias("node")))).alias("c"))
        here = saved.join(child.select("c.*"), "id")
        out = out.unionByName(here)
    nodes = stored(out.select("node", "n0", "n1", "feature", "threshold"), "tree")
    saved.unpersist()
    return nodes


def rules(nodes: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, leaf, rule, length, support, precision, conditions) of every leaf with more positive than negative cases.

    ``conditions`` go from the root down; support counts the cases learnt from that reach the leaf.  A tree of a single
    leaf has the empty rule.
    """
    by = list(by)
    leaves = nodes.where("feature is null and n1 > n0").select(*by, F.col("node").alias("leaf"), "n0", "n1")
    depth = F.length(F.bin("leaf")) - 1
    steps = leaves.select(*by, "leaf", F.explode(F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))).alias("up"))
    steps = steps.select(*by, "leaf", "up", F.expr("shiftright(leaf, up)").alias("node"), (F.expr("shiftright(leaf, up - 1)") % 2 == 1).alias("above"))
    met = steps.join(nodes.select(*by, "node", "feature", "threshold"), [*by, "node"])
    paths = met.groupBy(*by, "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("place"), "feature", "above", "threshold"))).alias("p"))  # a leaf's depth
    conditions = F.transform(F.coalesce("p", F.array().cast("array<struct<place:int,feature:string,above:boolean,threshold:double>>")), lambda s: F.struct(s["feature"].alias("feature"), s["above"].alias("above"), s["threshold"].alias("threshold")))
    text = F.array_join(F.transform("conditions", lambda s: F.concat_ws(" ", s["feature"], F.when(s["above"], ">").otherwise("<="), F.round(s["threshold"], 6).cast("string"))), " AND ")
    out = leaves.join(paths, [*by, "leaf"], "left").withColumn("conditions", conditions)
    return out.select(*by, "leaf", text.alias("rule"), F.size("conditions").alias("length"), (F.col("n0") + F.col("n1")).alias("support"), (F.col("n1") / (F.col("n0") + F.col("n1"))).alias("precision"), "conditions")


def rule_features(found: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, feature): what the rules speak of."""
    return found.select(*by, F.explode("conditions").alias("c")).select(*by, F.col("c.feature").alias("feature")).distinct()


# ---- greedy coverage ----------------------------------------------------------------------------------------


def covering(cover: DataFrame, scores: DataFrame, threshold: int, by: list[str] = ()) -> DataFrame:
    """(by, feature, score): what a greedy walk in order of score (then name, both falling) accepts, where a feature is
    accepted if it covers a unit that fewer than ``threshold`` accepted features cover.

    cover: (by, unit, feature), distinct; scores: (by, feature, score).  Nothing is walked: a feature is accepted for
    certain where a unit has fewer than ``threshold`` earlier ones that may yet be accepted, and rejected for certain where all
    of its units have as many that are.  Each round settles at least the first one open of every key.
    """
    by = list(by)
    rows = cover.join(scores.select(*by, "feature", F.round("score", DIGITS).alias("score")), [*by, "feature"])
    rows = stored(rows.select(*by, "unit", "feature", "score", F.lit(False).alias("taken")), "coverage")
    before = Window.partitionBy(*by, "unit").orderBy(F.desc("score"), F.desc("feature")).rowsBetween(Window.unboundedPreceding, -1)
    while not rows.where("not taken").isEmpty():
        seen = rows.withColumn("sure", F.count_if("taken").over(before)).withColumn("may", F.count(F.lit(1)).over(before))
        settled = seen.groupBy(*by, "feature").agg((F.bool_or("taken") | (F.min("may") < threshold)).alias("take"), (F.min("sure") < threshold).alias("open"))
        kept = rows.drop("taken").join(settled, [*by, "feature"]).where("take or open")
        rows = stored(kept.select(*by, "unit", "feature", "score", F.col("take").alias("taken")), "coverage")
    return rows.select(*by, "feature", "score").distinct()
