"""Feature mining, encoding, selection and classifiers over traces."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import shared_folder
from . import measures, rules
from .resampling import draw

REPEATS = T.MapType(T.StringType(), T.IntegerType())
#: Decision-tree depths tried (Spark's trees go to 30).
DEPTHS = (5, 10, 15, 20, 25, 30)
#: Folds whose trees are fitted at a time; a level of a tree is a small job.
TOGETHER = 10
#: Cases of a task of such a job: each task adds up all nodes of a level, so that few cases are no work for many tasks.
FITTED_CASES = 20_000


def activity_counts(traces: DataFrame) -> DataFrame:
    """(case_id, outcome, feature, value) for every activity of a trace."""
    return traces.select("case_id", "outcome", F.explode("trace").alias("feature")).groupBy("case_id", "outcome", "feature").agg(F.count(F.lit(1)).cast("double").alias("value"))


def ngrams(k: int) -> Column:
    """All runs of k activities, as arrays."""
    n = F.size("trace")
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.slice("trace", i, k))).otherwise(F.array().cast("array<array<string>>"))


def _tandem(trace) -> dict[str, int]:
    """Immediate repetitions of a block, counted left to right; a hit skips one block length."""
    t, found = list(trace), {}
    for size in range(1, len(t) // 2 + 1):
        i = 0
        while i + 2 * size <= len(t):
            if t[i : i + size] == t[i + size : i + 2 * size]:
                key = "\x1f".join(t[i : i + size])
                found[key] = found.get(key, 0) + 1
                i += size
            else:
                i += 1
    return found


def _maximal(trace) -> dict[str, int]:
    """Runs that occur twice or more and lie in no longer such run."""
    t, kept, inside = tuple(trace), {}, set()
    for size in range(len(t) - 1, 0, -1):
        seen: dict[tuple, int] = {}
        for i in range(len(t) - size + 1):
            seen[t[i : i + size]] = seen.get(t[i : i + size], 0) + 1
        found = {run: n for run, n in seen.items() if n >= 2 and run not in inside}
        kept |= found
        # a run lies in a longer one if it is one of the two that are shorter by an end, or lies in those
        inside |= {part for run, n in seen.items() if n >= 2 for part in (run[1:], run[:-1])}
    return {"\x1f".join(k): n for k, n in kept.items()}


@F.pandas_udf(REPEATS)
def tandem_repeats(trace: pd.Series) -> pd.Series:
    return trace.map(_tandem)


@F.pandas_udf(REPEATS)
def maximal_repeats(trace: pd.Series) -> pd.Series:
    return trace.map(_maximal)


def sequential_patterns(traces: DataFrame, kinds: tuple[str, ...] = ("tr", "tra", "mr", "mra")) -> DataFrame:
    """(case_id, outcome, feature, value): repeats (tr, mr) and their alphabets (tra, mra) with counts.

    Repeats are found once for each distinct trace.
    """
    seqs = traces.select("trace").distinct()
    found = seqs.select("trace", F.explode(F.array(
        F.struct(F.lit("tr").alias("kind"), tandem_repeats("trace").alias("m")), F.struct(F.lit("mr").alias("kind"), maximal_repeats("trace").alias("m")))).alias("s"))
    runs = found.select("trace", "s.kind", F.explode("s.m").alias("run", "n"))
    letters = F.array_join(F.array_sort(F.array_distinct(F.split("run", "\x1f"))), ",")
    both = runs.select("trace", "kind", F.array_join(F.split("run", "\x1f"), ">").alias("p"), "n").union(
        runs.select("trace", F.concat("kind", F.lit("a")), letters, "n")).where(F.col("kind").isin(*kinds))
    both = both.groupBy("trace", F.concat_ws(":", "kind", "p").alias("feature")).agg(F.sum("n").cast("double").alias("value"))
    return traces.select("case_id", "outcome", "trace").join(both, "trace").select("case_id", "outcome", "feature", "value")


def discriminative(features: DataFrame, traces: DataFrame, theta: float) -> DataFrame:
    """Features frequent (in at least ceil(theta n) cases) in exactly one class: (feature, c0, c1)."""
    n = {r["outcome"]: r["n"] for r in traces.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    need = [math.ceil(theta * n.get(k, 0)) for k in (0, 1)]
    c = features.where("value <> 0").groupBy("feature").agg(F.count_if(F.col("outcome") == 0).alias("c0"), F.count_if(F.col("outcome") == 1).alias("c1"))
    return c.where((F.col("c0") >= need[0]) != (F.col("c1") >= need[1]))


def data_features(events: DataFrame, case: str, ts: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(case_id, feature, value): first, last, least, most and mean of numbers, counts of categories (one-hot
    names ``feature==value``), trace length and duration in seconds.  Rows stay aligned by case id."""
    rows = events.where(F.col(case).isNotNull())
    stats = []
    for c in numeric:
        v = F.expr(f"try_cast({c} as double)")
        key = F.when(v.isNotNull(), F.col(ts))
        stats += [F.min_by(v, key).alias(f"{c}_first"), F.max_by(v, key).alias(f"{c}_last"), F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max"), F.avg(v).alias(f"{c}_avg")]
    stats += [F.count(F.lit(1)).cast("double").alias("length"), ((F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6).alias("duration")]
    wide = rows.groupBy(F.col(case).cast("string").alias("case_id")).agg(*stats)
    names = [x for x in wide.columns if x != "case_id"]
    long = wide.unpivot(["case_id"], names, "feature", "value").where("value is not null")
    for c in categorical:
        part = rows.where(F.col(c).isNotNull()).groupBy(F.col(case).cast("string").alias("case_id"), F.concat(F.lit(f"{c}=="), F.col(c).cast("string")).alias("feature"))
        long = long.unionByName(part.agg(F.count(F.lit(1)).cast("double").alias("value")))
    return long


def frequent_itemsets(traces: DataFrame, theta: float) -> DataFrame:
    """(items, n): frequent single activities and pairs, each at least in ceil(theta n) cases (1 at least)."""
    need = max(1, math.ceil(theta * traces.count()))
    acts = traces.select("case_id", F.array_sort(F.array_distinct("trace")).alias("s"))
    one = acts.select(F.explode("s").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need).select(F.array("x").alias("items"), "n")
    two = acts.select("s", F.explode("s").alias("x")).select("x", F.explode("s").alias("y")).where("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    return one.union(two.where(F.col("n") >= need).select(F.array("x", "y"), "n"))


def template_features(traces: DataFrame, cands: DataFrame, theta: float = 0.0) -> DataFrame:
    """(ctype, a, b, source): candidates satisfied in enough cases of the positive class, else of the other.

    A candidate that the positive class has but does not satisfy often enough is not tried in the other.
    """
    from ..sources.event_log import variants

    s = measures.pattern_sums(variants(traces), cands, "trace", ["n0", "n1"])
    n0, n1 = traces.agg(F.count_if(F.col("outcome") == 0), F.count_if(F.col("outcome") == 1)).first()
    need0, need1 = max(1, math.ceil(theta * (n0 or 0))), max(1, math.ceil(theta * (n1 or 0)))
    first = F.col("n1_app") > 0
    return s.withColumn("source", F.when(F.col("n1_sat") >= need1, "positive").when(~first & (F.col("n0_sat") >= need0), "negative")).where("source is not null").select("ctype", "a", "b", "source")


def constraint_name() -> Column:
    return F.concat(F.col("ctype"), F.lit("("), F.concat_ws(", ", "a", "b"), F.lit(")"))


def three_way(traces: DataFrame, cands: DataFrame, counts: bool = False) -> DataFrame:
    """(case_id, outcome, feature, value): -1 violated, +1 satisfied, 0 (absent) vacuous."""
    h = measures.holds(traces, cands, ["case_id", "outcome"])
    return h.select("case_id", "outcome", constraint_name().alias("feature"), F.when(F.col("sat") == 1, 1.0).otherwise(-1.0).alias("value"))


def coverage_unit() -> Column:
    """What decides which constraints apply to a trace, and so which cover it: the activities that it has."""
    return F.md5(F.to_json(F.array_sort(F.array_distinct("trace"))))


def constraint_features(traces: DataFrame, cands: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, case_id, outcome, unit, feature, value): :func:`three_way` with the units of coverage; no shuffle."""
    keep = [*by, "case_id", "outcome", "unit"]
    h = measures.holds(traces.withColumn("unit", coverage_unit()), cands, keep)
    return h.select(*keep, constraint_name().alias("feature"), F.when(F.col("sat") == 1, 1.0).otherwise(-1.0).alias("value"))


def sign_counts(features: DataFrame, traces: DataFrame, chosen: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """(n_plus, n_minus): features (of ``chosen``, by ``by``) whose mean is larger, and smaller, in positive cases, the absent
    values being 0."""
    n0, n1 = traces.agg(F.count_if(F.col("outcome") == 0), F.count_if(F.col("outcome") == 1)).first()
    rows = features if chosen is None else features.join(chosen, "feature", "left_semi")
    mean = lambda k, n: F.sum(F.when(F.col("outcome") == k, F.col("value")).otherwise(0.0)) / max(n or 0, 1)
    means = rows.groupBy(*by, "feature").agg(F.round(mean(1, n1) - mean(0, n0), 12).alias("d"))
    return means.groupBy(*by).agg(F.count_if(F.col("d") > 0).alias("n_plus"), F.count_if(F.col("d") < 0).alias("n_minus"))


def fisher_scores(features: DataFrame, traces: DataFrame, eps: float = 1e-12, by: list[str] = ()) -> DataFrame:
    """(by, feature, score): generalised Fisher scores from sums, the absent values being 0.  All logs of ``by`` have as many
    cases of either class as ``traces``."""
    n0, n1 = traces.agg(F.count_if(F.col("outcome") == 0), F.count_if(F.col("outcome") == 1)).first()
    on = lambda k, v: F.sum(F.when(F.col("outcome") == k, v).otherwise(0.0))
    v = F.col("value")
    s = features.groupBy(*by, "feature").agg(on(0, v).alias("s0"), on(1, v).alias("s1"), on(0, v * v).alias("q0"), on(1, v * v).alias("q1"))
    return scores_of_sums(s, n0, n1, eps, by)


def scores_of_sums(s: DataFrame, n0: int | None, n1: int | None, eps: float = 1e-12, by: list[str] = ()) -> DataFrame:
    """(by, feature, score): generalised Fisher scores from each feature's sums of values (s0, s1) and squares (q0, q1) by class."""
    n0, n1 = float(n0 or 0), float(n1 or 0)
    m0, m1 = F.col("s0") / max(n0, 1), F.col("s1") / max(n1, 1)
    mean = (F.col("s0") + F.col("s1")) / max(n0 + n1, 1)
    num = n1 * F.pow(m1 - mean, 2) + n0 * F.pow(m0 - mean, 2)
    den = n1 * F.greatest(F.lit(0.0), F.col("q1") / max(n1, 1) - m1 * m1) + n0 * F.greatest(F.lit(0.0), F.col("q0") / max(n0, 1) - m0 * m0)
    return s.select(*by, "feature", F.when(den > eps, num / den).when(num <= eps, 0.0).otherwise(num / eps).alias("score"))


def covering_features(features: DataFrame, traces: DataFrame, threshold: int = 20, by: list[str] = ()) -> DataFrame:
    """(by, feature, score): greedy selection in order of score: a feature enters if it covers a case covered less than
    ``threshold`` times.  Cases that the same features cover have one counter.

    features: (by, case_id, outcome, feature, value), and ``unit`` where cases of one unit are known to be covered by the same
    features; without it each case is its own unit.
    """
    unit = "unit" if "unit" in features.columns else "case_id"
    cover = features.where("value <> 0").select(*by, F.col(unit).alias("unit"), "feature").distinct()
    return rules.covering(cover, fisher_scores(features, traces, by=by), threshold, by)


def select_by_coverage(features: DataFrame, traces: DataFrame, threshold: int = 20) -> list[str]:
    """The names that :func:`covering_features` accepts, best first."""
    if "unit" not in features.columns:
        features = features.join(traces.select("case_id", F.md5(F.to_json("trace")).alias("unit")), "case_id")
    chosen = covering_features(features, traces, threshold)
    return [r["feature"] for r in chosen.orderBy(F.desc("score"), F.desc("feature")).collect()]  # names


def folds(traces: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """Stratified folds: hash rank within the class, modulo k.

    A class is ranked in parts by the first digits of the hash, whose offsets are broadcast.
    """
    from pyspark.sql import Window

    rows = traces.select("case_id", "outcome", draw(seed, "case_id").alias("_h")).withColumn("_part", F.substring("_h", 1, 3))
    before = Window.partitionBy("outcome").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("outcome", "_part").agg(F.count(F.lit(1)).alias("n")).select("outcome", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("outcome", "_part").orderBy("_h", "case_id"))
    placed = rows.withColumn("_within", within).join(F.broadcast(offsets), ["outcome", "_part"])  # at most 16 ** 3 rows a class
    return placed.select("case_id", "outcome", ((F.col("_offset") + F.col("_within") - 1) % k).cast("int").alias("fold"))


def assemble(features: DataFrame, cases: DataFrame, names: list[str]) -> DataFrame:
    """(cases, features vector) of the named features, absent ones 0."""
    from pyspark.ml.functions import array_to_vector

    place = F.broadcast(features.sparkSession.createDataFrame(list(enumerate(names)), "i int, feature string"))
    held = features.join(place, "feature").groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(max(0, len(names) - 1))), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    empty = F.transform(F.sequence(F.lit(0), F.lit(max(0, len(names) - 1))), lambda i: F.lit(0.0))
    return cases.join(held, "case_id", "left").select(*cases.columns, array_to_vector(F.when(F.col("m").isNull(), empty).otherwise(dense)).alias("features"))


def classification_metrics(predicted: DataFrame, score: str = "score", label: str = "outcome", by: list[str] = ()) -> DataFrame:
    """Precision, recall, F1, accuracy and AUC (by rank sums) from (label, prediction, score)."""
    from pyspark.sql import Window

    y, p = F.col(label) == 1, F.col("prediction") == 1
    # by score first: what is put in order are distinct scores, not cases
    levels = predicted.groupBy(*by, score).agg(
        F.count_if(y & p).cast("double").alias("tp"), F.count_if(~y & p).cast("double").alias("fp"), F.count_if(y & ~p).cast("double").alias("fn"), F.count_if(~y & ~p).cast("double").alias("tn"),
    )
    each = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    before = F.coalesce(F.sum(each).over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    levels = levels.withColumn("rs", (F.col("tp") + F.col("fn")) * (before + (each + 1) / 2))
    a = levels.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "rs")])
    z = lambda n, d: F.coalesce(F.try_divide(n, d), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n1, n0 = tp + fn, fp + tn
    return a.select(
        *by, z(tp, tp + fp).alias("precision"), z(tp, n1).alias("recall"), z(2 * tp, 2 * tp + fp + fn).alias("f1"), z(tp + tn, n1 + n0).alias("accuracy"),
        F.coalesce(F.try_divide(F.col("rs") - n1 * (n1 + 1) / 2, n1 * n0), F.lit(0.5)).alias("auc"),
    )


def cross_validate(features: DataFrame, traces: DataFrame, names: list[str], k: int = 10, depths=DEPTHS, leak_free: bool = True, seed: int = 42) -> DataFrame:
    """Fold-averaged metrics of a decision tree; the depth is picked on a part of the training folds (or, if not
    ``leak_free``, on the test fold itself)."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.classification import DecisionTreeClassifier

    data = assemble(features, folds(traces, k, seed), names).withColumn("label", F.col("outcome").cast("double"))
    # in order, as Spark takes a tree's bins from a sample of rows by place where there are over 10,000
    data = data.repartition(max(1, -(-traces.count() // FITTED_CASES)), "case_id").sortWithinPartitions("case_id").cache()
    data.count()  # before folds read it side by side

    def one(fold: int) -> DataFrame:
        train, test = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        inner = train.where(F.col("fold") == (fold + 1) % k) if leak_free else test
        learn = train.where(F.col("fold") != (fold + 1) % k) if leak_free and k > 2 else train
        best = (-1.0, depths[0])
        if len(depths) > 1:
            model = DecisionTreeClassifier(maxDepth=max(depths), seed=seed).fit(learn)
            f1 = {r["depth"]: r["f1"] for r in classification_metrics(_cut(model, inner, depths), by=["depth"]).collect()}
            for depth in depths:
                best = best if best[0] >= f1.get(depth, -1.0) else (f1[depth], depth)
        model = DecisionTreeClassifier(maxDepth=best[1], seed=seed).fit(train)
        return _scored(model, test).withColumn("fold", F.lit(fold))

    scored = None
    with ThreadPool(min(k, TOGETHER)) as pool:
        for part in pool.map(inheritable_thread_target(data.sparkSession)(one), range(k)):
            scored = part if scored is None else scored.unionByName(part)
    per = classification_metrics(scored, by=["fold"])
    return per.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "accuracy", "auc")])


def _scored(model, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).select("outcome", "prediction", vector_to_array("probability")[1].alias("score"))


def _cut(model, df: DataFrame, depths) -> DataFrame:
    """(depth, outcome, prediction, score): what the fitted tree predicts when it is cut at each of ``depths``.

    A tree grown to a smaller depth is the top of a deeper one, so one fit serves for all depths.  The nodes go to the
    tasks, as a fitted model's do.
    """
    from pyspark.ml.functions import vector_to_array

    folder = shared_folder(df.sparkSession, "model")
    model.write().save(folder)
    split = F.get("split.leftCategoriesOrThreshold", F.lit(0))
    nodes = df.sparkSession.read.parquet(f"{folder}/data").select("id", "prediction", "leftChild", "rightChild", "split.featureIndex", split.alias("threshold")).toPandas().sort_values("id")
    said, left, right, feature, threshold = (nodes[c].to_numpy() for c in ("prediction", "leftChild", "rightChild", "featureIndex", "threshold"))

    def walk(batches):
        for pdf in batches:
            x, at, rows = np.stack(pdf["x"]) if len(pdf) else np.zeros((0, 1)), np.zeros(len(pdf), np.int64), np.arange(len(pdf))
            for depth in range(max(depths) + 1):
                if depth in depths:
                    yield pd.DataFrame({"depth": depth, "outcome": pdf["outcome"], "prediction": said[at], "score": said[at]})
                inner = left[at] >= 0
                to = np.where(x[rows, np.maximum(feature[at], 0)] <= threshold[at], left[at], right[at])
                at = np.where(inner, to, at)

    return df.select("outcome", vector_to_array("features").alias("x")).mapInPandas(walk, "depth int, outcome int, prediction double, score double")


def tree_rules(model, names: list[str]) -> DataFrame:
    """(leaf, rule, length, support, precision, conditions) of every leaf of a fitted tree that predicts the positive class."""
    return rules.rules(rules.model_nodes(model, names))


def mined_rules(features: DataFrame, traces: DataFrame, threshold: int = 20, depth: int = DEPTHS[0]) -> DataFrame:
    """The rules of the final model: features chosen by coverage, then one tree on all cases."""
    features = rules.stored(features, "features")  # for scores, coverage and the tree
    chosen = select_by_coverage(features, traces, threshold)
    held = features.where(F.col("feature").isin(chosen))
    return rules.rules(rules.grow(traces, held, depth=depth))


def null_mining_counts(traces: DataFrame, cands: DataFrame, count: int, threshold: int = 20, depth: int = DEPTHS[0], seed: int = 42) -> DataFrame:
    """(rep, selected, in_rules): features that coverage selects, and those in the rules of a tree on them, on ``count``
    double-null logs; replicate ``count`` is the log as it is.  The pool of constraints is the same for all.

    All replicates are one job a step: scores, rounds of selection and levels of trees are keyed by the replicate.  Which constraints hold in
    which cases is kept as bits (:mod:`signs`); constraints cover a case by its activities, which are those of the log in every replicate.
    """
    from . import signs

    spark, traces = traces.sparkSession, traces.select("case_id", "outcome", "trace")
    found = signs.ordered(cands)  # candidates
    names = [f"{t}({', '.join(x for x in (a, b) if x is not None)})" for t, a, b in found]
    bits = signs.null_bits(traces, found, count, seed)
    first = signs.class_sums(bits, len(found), signs.Nodes(count + 1, depth), 0)
    n0, n1 = traces.agg(F.count_if(F.col("outcome") == 0), F.count_if(F.col("outcome") == 1)).first()
    of_class = lambda k: [(2.0 * F.col(f"sat{k}") - F.col(f"app{k}")).alias(f"s{k}"), F.col(f"app{k}").cast("double").alias(f"q{k}")]
    sums = first.where("f >= 0 and app0 + app1 > 0").select("rep", F.element_at(F.lit(names), F.col("f") + 1).alias("feature"), *of_class(0), *of_class(1))
    units = traces.select(F.array_sort(F.array_distinct("trace")).alias("trace"), coverage_unit().alias("unit")).dropDuplicates(["unit"])
    cover = constraint_features(units.select("trace", F.col("unit").alias("case_id"), F.lit(0).alias("outcome")), cands).select("unit", "feature").distinct()
    reps = spark.range(count + 1).select(F.col("id").cast("int").alias("rep"))
    chosen = rules.covering(cover.crossJoin(F.broadcast(reps)), scores_of_sums(sums, n0, n1, by=["rep"]), threshold, ["rep"])
    place = spark.createDataFrame(list(enumerate(names)), "f int, feature string")
    chosen = rules.stored(chosen.join(F.broadcast(place), "feature").select("rep", "f"), "chosen")
    nodes = signs.grow(bits, first, names, chosen, count + 1, depth)
    spoken = rules.rule_features(rules.rules(nodes, ["rep"]), ["rep"])
    size = lambda d, name: d.groupBy("rep").agg(F.count(F.lit(1)).alias(name))
    out = reps.join(size(chosen, "selected"), "rep", "left").join(size(spoken, "in_rules"), "rep", "left")
    return out.select("rep", F.coalesce("selected", F.lit(0)).alias("selected"), F.coalesce("in_rules", F.lit(0)).alias("in_rules"))


def sequential_rules(x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 10, conditions: int = 4, least: int = 2) -> list[tuple[str, int]]:
    """A small separate-and-conquer rule learner (FOIL gain) on a dense matrix of selected features."""
    left, rules = np.ones(len(y), bool), []
    for _ in range(rounds):
        on, rule = left.copy(), []
        for _ in range(conditions):
            p0, n0 = (y[on] == 1).sum(), (y[on] == 0).sum()
            if n0 == 0 or p0 == 0:
                break
            best = (1e-9, None)
            for j in range(x.shape[1]):
                for cut in np.unique(x[on, j])[:-1]:
                    for above in (True, False):
                        sub = on & ((x[:, j] > cut) == above)
                        p, n = (y[sub] == 1).sum(), (y[sub] == 0).sum()
                        if p >= least and (gain := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > best[0]:
                            best = (gain, (j, float(cut), above))
            if best[1] is None:
                break
            j, cut, above = best[1]
            rule.append(f"{names[j]} {'>' if above else '<='} {cut:g}")
            on &= (x[:, j] > cut) == above
        if not rule or (y[on] == 1).sum() < least or (y[on] == 1).mean() < 0.5:
            break
        rules.append((" AND ".join(rule), len(rule)))
        left &= ~on
        if not (y[left] == 1).any():
            break
    return rules


def root_condition(features: DataFrame, cases: DataFrame, names: list[str]) -> tuple[str, float] | None:
    """(feature, threshold) of the best single split of the cases by the named features."""
    members = cases.select(F.lit(0).alias("group"), "case_id", "outcome")
    best = rules.best_splits(members, rules.binned(features.where(F.col("feature").isin(names))), ["group"]).first()
    return best and (best["feature"], best["threshold"])


def data_conditions(traces: DataFrame, cands: DataFrame, data: DataFrame, least: int = 4, coded: DataFrame | None = None) -> DataFrame:
    """(ctype, a, b, feature, threshold, gain): the data condition ``feature <= threshold`` of each constraint, for all of
    them in one pass.  ``coded``: the holds of the candidates, where they are written already.

    It is the best single split by outcome of the cases that satisfy the constraint; constraints that fewer than ``least``
    cases satisfy, or those of one class only, or no feature parts, have none and no row.
    """
    if coded is None:
        data = rules.stored(data.select("case_id", "feature", "value"), "data")
        coded = rules.stored(measures.holds(traces, cands, ["case_id", "outcome"]), "holds")
    members = coded.where("sat = 1").select("ctype", "a", F.coalesce("b", F.lit("")).alias("b"), "case_id", "outcome")
    best = rules.best_splits(members, rules.binned(data), ["ctype", "a", "b"]).where(F.col("n0") + F.col("n1") >= least)
    return best.select("ctype", "a", F.nullif("b", F.lit("")).alias("b"), "feature", "threshold", "gain")


#: Single encodings; "h" is all repeats plus constraints; compounds join names by "+".
PARTS = ("ia", "mr", "tr", "mra", "tra", "template", "h", "data", "conditional")


def encodings() -> list[str]:
    """The standard encodings: every part, each of them with data, and the hybrid with conditional constraints."""
    return [*PARTS, *[f"data+{p}" for p in PARTS if p != "data"], "h+conditional", "h+data+conditional"]


def conditional_templates(traces: DataFrame, cands: DataFrame, data: DataFrame) -> DataFrame:
    """(case_id, outcome, feature, value): every constraint under its data condition, outside which it counts as vacuous.

    A constraint without a condition holds as it is.
    """
    coded = rules.stored(measures.holds(traces, cands, ["case_id", "outcome"]), "holds")
    data = rules.stored(data.select("case_id", "feature", "value"), "data")
    found = rules.stored(data_conditions(traces, cands, data, coded=coded), "conditions")
    named = coded.withColumn("name", constraint_name()).withColumn("b", F.coalesce("b", F.lit("")))
    found = found.select("ctype", "a", F.coalesce("b", F.lit("")).alias("b"), F.col("feature").alias("by"), "threshold")
    on = data.select("case_id", F.col("feature").alias("by"), F.col("value").alias("at"))
    rows = named.join(found, ["ctype", "a", "b"], "left").join(on, ["case_id", "by"], "left")
    rows = rows.where(F.col("by").isNull() | (F.coalesce(F.nanvl("at", F.lit(0.0)), F.lit(0.0)) <= F.col("threshold")))
    condition = F.when(F.col("by").isNull(), "any").otherwise(F.concat_ws(" <= ", "by", F.round("threshold", 6).cast("string")))
    return rows.select("case_id", "outcome", F.concat_ws(" if ", "name", condition).alias("feature"), F.when(F.col("sat") == 1, 1.0).otherwise(-1.0).alias("value"))


def encode(traces: DataFrame, encoding: str, cands: DataFrame, theta: float = 0.1, data: DataFrame | None = None) -> DataFrame:
    """(case_id, outcome, feature, value) of an encoding such as "h+data+conditional"; absent values are 0.

    ``data``: the cases' data features (case_id, feature, value), for the parts that use them.
    """
    parts = {p.strip() for p in encoding.lower().split("+")}
    if unknown := parts - set(PARTS):
        raise ValueError(f"unknown encoding {sorted(unknown)}")
    blocks = []
    if "ia" in parts:
        blocks.append(activity_counts(traces).withColumn("feature", F.concat(F.lit("ia:"), F.col("feature"))))
    kinds = tuple(k for k in ("tr", "tra", "mr", "mra") if k in parts or "h" in parts)
    if kinds:
        seq = sequential_patterns(traces, kinds)
        blocks.append(seq.join(F.broadcast(discriminative(seq, traces, theta).select("feature")), "feature"))
    if parts & {"template", "h"}:
        blocks.append(three_way(traces, template_features(traces, cands).select("ctype", "a", "b")))
    if "data" in parts or "conditional" in parts:
        if data is None:
            raise ValueError("data features are needed")
        held = data.join(traces.select("case_id", "outcome"), "case_id").select("case_id", "outcome", "feature", "value")
        if "data" in parts:
            blocks.append(held)
        if "conditional" in parts:
            blocks.append(conditional_templates(traces, cands, data))
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b.select(*out.columns))
    return out.where("value <> 0 and not isnan(value)").select("case_id", "outcome", "feature", "value")
