"""Splits, trees, rules and greedy coverage against brute force."""

import random

import pytest

from tracegauge.operators import measures, mining, resampling, rules
from tracegauge.operators.statistics import alphabet


def gini(c):
    n = sum(c)
    return 2 * c[0] * c[1] / n if n else 0.0


def split(cases):
    """Best (gain, feature, threshold) of [(outcome, {feature: value})] by trying every cut."""
    n, total, best = len(cases), [sum(o == k for o, _ in cases) for k in (0, 1)], None
    for f in sorted({f for _, v in cases for f in v}):
        values = sorted({v.get(f, 0.0) for _, v in cases})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            left = [sum(o == k and v.get(f, 0.0) <= cut for o, v in cases) for k in (0, 1)]
            gain = round((gini(total) - gini(left) - gini([total[0] - left[0], total[1] - left[1]])) / n, 9)
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, f, cut)
    return best


def tree(cases, depth, node=1):
    best = split(cases) if depth and len({o for o, _ in cases}) == 2 else None
    size = [sum(o == k for o, _ in cases) for k in (0, 1)]
    if best is None:
        return {node: (*size, None, None)}
    side = lambda above: [c for c in cases if (c[1].get(best[1], 0.0) > best[2]) == above]
    return {node: (*size, best[1], best[2])} | tree(side(False), depth - 1, 2 * node) | tree(side(True), depth - 1, 2 * node + 1)


def sample(seed, n=60):
    r = random.Random(seed)
    draw = lambda: {f: r.choice([-2.5, -1.0, 1.0, 2.0, r.random()]) for f in "pqr" if r.random() < 0.7}
    return [(r.randint(0, 1), draw()) for _ in range(n)]


def frames(spark, logs):
    cases = [(k, f"c{i}", o) for k, log in logs.items() for i, (o, _) in enumerate(log)]
    values = [(k, f"c{i}", f, v) for k, log in logs.items() for i, (_, d) in enumerate(log) for f, v in d.items()]
    return spark.createDataFrame(cases, "rep int, case_id string, outcome int"), spark.createDataFrame(values, "rep int, case_id string, feature string, value double")


def test_trees_of_all_keys_equal_single_ones(spark):
    logs = {k: sample(k) for k in range(3)} | {3: [(1, {"p": 1.0})] * 5, 4: [(i % 2, {}) for i in range(6)]}
    nodes = rules.grow(*frames(spark, logs), ["rep"], 3)
    got = {(r["rep"], r["node"]): (r["n0"], r["n1"], r["feature"], r["threshold"]) for r in nodes.collect()}
    assert got == {(k, n): v for k, log in logs.items() for n, v in tree(log, 3).items()}
    found = rules.rules(nodes, ["rep"]).collect()
    for r in found:
        met = [o for o, v in logs[r["rep"]] if all((v.get(c["feature"], 0.0) > c["threshold"]) == c["above"] for c in r["conditions"])]
        assert (r["support"], r["precision"], r["length"]) == (len(met), sum(met) / len(met), len(r["conditions"]))
        assert r["rule"].count(" AND ") == max(0, r["length"] - 1)
    assert {(r["rep"], r["rule"]) for r in found if r["length"] == 0} == {(3, "")}
    assert {r["feature"] for r in rules.rule_features(rules.rules(nodes, ["rep"]), ["rep"]).where("rep = 0").collect()} == {c["feature"] for r in found if r["rep"] == 0 for c in r["conditions"]}


def test_nan_null_and_empty(spark):
    cases, values = frames(spark, {0: [(i % 2, {"p": float("nan"), "q": float(i % 2)}) for i in range(8)]})
    values = values.unionByName(spark.createDataFrame([(0, "c1", "z", None)], values.schema))
    assert {(r["node"], r["feature"], r["threshold"]) for r in rules.grow(cases, values, ["rep"], 2).collect()} == {(1, "q", 0.5), (2, None, None), (3, None, None)}
    assert rules.grow(cases.limit(0), values.limit(0), ["rep"], 2).count() == 0


def test_bins_of_many_values(spark):
    values = [(0, f"c{i}", "p", float(i - 500)) for i in range(1001)]
    df = spark.createDataFrame(values, "rep int, case_id string, feature string, value double")
    rows = rules.binned(df, 10).collect()
    assert len(rows) == 1000  # zero has no row
    assert all((r["bin"] <= 10) == (r["value"] < 0) for r in rows) and len({r["bin"] for r in rows}) == 20
    order = [r["bin"] for r in sorted(rows, key=lambda r: r["value"])]
    assert order == sorted(order) and max(order.count(b) for b in set(order)) == 50


def test_model_nodes_are_the_models(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    logs = {0: [(o, {f: float(round(v)) for f, v in d.items()}) for o, d in sample(9, 80)]}
    cases, values = frames(spark, logs)
    data = mining.assemble(values.drop("rep"), cases.drop("rep"), ["p", "q", "r"]).selectExpr("*", "double(outcome) as label")
    model = DecisionTreeClassifier(maxDepth=4, seed=1).fit(data)
    found = mining.tree_rules(model, ["p", "q", "r"]).collect()
    assert len(found) == model.toDebugString.count("Predict: 1.0")
    predicted = {r["case_id"]: r["prediction"] for r in model.transform(data).collect()}
    for i, (_, v) in enumerate(logs[0]):
        meets = [r for r in found if all((v.get(c["feature"], 0.0) > c["threshold"]) == c["above"] for c in r["conditions"])]
        assert len(meets) == predicted[f"c{i}"]
    assert sum(r["support"] for r in found) == sum(predicted.values())


@pytest.mark.parametrize("threshold", [1, 3, 20])
def test_covering_equals_the_greedy_walk(spark, threshold):
    r = random.Random(threshold)
    cover = sorted({(k, f"u{r.randrange(12)}", f"f{r.randrange(40):02d}") for k in (0, 1) for _ in range(260)})
    scores = {(k, f): r.choice([0.1, 0.2, 0.3, r.random()]) for k, _, f in cover}
    want = set()
    for k in (0, 1):
        held = {}
        for f in sorted({f for key, _, f in cover if key == k}, key=lambda f: (round(scores[k, f], 9), f), reverse=True):
            units = [u for key, u, g in cover if (key, g) == (k, f)]
            if any(held.get(u, 0) < threshold for u in units):
                want.add((k, f))
                for u in units:
                    held[u] = held.get(u, 0) + 1
    got = rules.covering(spark.createDataFrame(cover, "rep int, unit string, feature string"), spark.createDataFrame([(*k, v) for k, v in scores.items()], "rep int, feature string, score double"), threshold, ["rep"])
    assert {(x["rep"], x["feature"]) for x in got.collect()} == want


def small_log(spark, n=40):
    r = random.Random(5)
    rows = [(f"c{i}", i % 2, [r.choice("abc") for _ in range(r.randint(1, 6))]) for i in range(n)]
    return spark.createDataFrame(rows, "case_id string, outcome int, trace array<string>")


def test_data_conditions_and_conditional_templates(spark):
    t = small_log(spark)
    cands = measures.candidates(alphabet(t))
    r = random.Random(6)
    values = {f"c{i}": {f: v for f in ("x", "y") if (v := r.choice([0.0, 1.0, r.random()]))} for i in range(40)}
    data = spark.createDataFrame([(c, f, v) for c, d in values.items() for f, v in d.items()], "case_id string, feature string, value double")
    held = measures.holds(t, cands, ["case_id", "outcome"]).collect()
    want = {}
    for key in {(h["ctype"], h["a"], h["b"]) for h in held}:
        cases = [(h["outcome"], values[h["case_id"]]) for h in held if (h["ctype"], h["a"], h["b"]) == key and h["sat"] == 1]
        if len(cases) >= 4 and len({o for o, _ in cases}) == 2 and (best := split(cases)):
            want[key] = (best[1], best[2], best[0])
    got = {(x["ctype"], x["a"], x["b"]): (x["feature"], x["threshold"], x["gain"]) for x in mining.data_conditions(t, cands, data).collect()}
    assert got == want and len(want) > 10
    name = lambda k: f"{k[0]}({', '.join(x for x in k[1:] if x)})"
    kept = sorted((h["case_id"], name(k), 1.0 if h["sat"] == 1 else -1.0) for h in held for k in [(h["ctype"], h["a"], h["b"])] if k not in want or values[h["case_id"]].get(want[k][0], 0.0) <= want[k][1])
    rows = mining.conditional_templates(t, cands, data).collect()
    assert sorted((x["case_id"], x["feature"].split(" if ")[0], x["value"]) for x in rows) == kept
    assert {x["feature"].split(" if ")[1] == "any" for x in rows if x["feature"].split(" if ")[0] in {name(k) for k in want}} == {False}


def test_null_mining_counts_are_those_of_single_logs(spark):
    t = small_log(spark)
    cands = measures.candidates(alphabet(t))
    got = {x["rep"]: (x["selected"], x["in_rules"]) for x in mining.null_mining_counts(t, cands, 2, 2, 2).collect()}
    null = resampling.double_null(t, 2)
    for rep, log in [(0, null.where("rep = 0").drop("rep")), (1, null.where("rep = 1").drop("rep")), (2, t)]:
        log = spark.createDataFrame(log.collect(), t.schema)
        coded = mining.three_way(log, cands)
        names = mining.select_by_coverage(coded, log, 2)
        values = {}
        for x in coded.where(coded.feature.isin(names)).collect():
            values.setdefault(x["case_id"], {})[x["feature"]] = x["value"]
        grown = tree([(x["outcome"], values.get(x["case_id"], {})) for x in log.collect()], 2)
        spoken = set()
        for node, (n0, n1, feature, _) in grown.items():
            while feature is None and n1 > n0 and node > 1:
                node //= 2
                spoken.add(grown[node][2])
        assert got[rep] == (len(names), len(spoken))


def test_constraints_cover_by_the_activities_of_a_trace(spark):
    """What is accepted is what a walk over traces accepts, with one unit for each set of activities."""
    t = small_log(spark)
    cands = measures.candidates(alphabet(t))
    held = mining.constraint_features(t, cands)
    per_unit = held.select("case_id", "unit", "feature").distinct().groupBy("case_id", "unit").agg({"feature": "count"})
    assert per_unit.select("unit").distinct().count() == len({frozenset(r["trace"]) for r in t.collect()})
    for threshold in (1, 2, 5):
        assert mining.select_by_coverage(held, t, threshold) == mining.select_by_coverage(mining.three_way(t, cands), t, threshold)


def test_cut_tree_predicts_as_one_of_that_depth(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    rng = random.Random(5)
    rows = [(f"c{i}", rng.randint(0, 1), f, float(rng.randint(0, 9))) for i in range(400) for f in ("a", "b")]
    f = spark.createDataFrame(rows, "case_id string, outcome int, feature string, value double")
    cases = f.groupBy("case_id").agg({"outcome": "first"}).withColumnRenamed("first(outcome)", "outcome")
    data = mining.assemble(f, cases, ["a", "b"]).selectExpr("*", "cast(outcome as double) as label")
    data = spark.createDataFrame(data.orderBy("case_id").collect(), data.schema).coalesce(1)
    deep = DecisionTreeClassifier(maxDepth=8, seed=1).fit(data)
    got = mining._cut(deep, data, (1, 3, 5, 8)).collect()
    for depth in (1, 3, 5, 8):
        want = [r["prediction"] for r in DecisionTreeClassifier(maxDepth=depth, seed=1).fit(data).transform(data).collect()]
        assert [r["prediction"] for r in got if r["depth"] == depth] == want
