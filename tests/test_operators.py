import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegauge.functions import catalogues, special, templates
from tracegauge.operators import bootstrap, comparison, mining, pruning, resampling, significance, tests_of_difference as tod
from tracegauge.operators.measures import candidates
from tracegauge.operators.statistics import alphabet
from tracegauge.sources import event_log, files
from tracegauge.sources.event_log import LogOptions


def log(spark, n=80, seed=1, letters="abcd"):
    rng = random.Random(seed)
    rows = [(f"c{i}", int(rng.random() < 0.4), [rng.choice(letters) for _ in range(rng.randint(1, 9))]) for i in range(n)]
    return spark.createDataFrame(rows, "case_id string, outcome int, trace array<string>"), rows


# ---- logs ----------------------------------------------------------------------------------------------


def test_label_log_from_csv(spark, tmp_path):
    text = "Case ID;Activity;Complete Timestamp;label;kind\n" + "\n".join([
        "1;b;2020-01-01 10:00:00;deviant;x", "1;a;2020-01-01 09:00:00;deviant;y", "2;a;2020-01-02 10:00:00; regular ;x", ";a;2020-01-01 09:00:00;deviant;x",
        "3;;2020-01-01 09:00:00;regular;x", "4;a;not a time;;x", "4;b;2020-01-01 09:00:00;;x", "5;a;2020-01-01 09:00:00;odd;y", "5;a;2020-01-01 09:00:00;odd;y", "5;b;2020-01-01 09:30:00;odd;x"])
    (tmp_path / "log.csv").write_text(text)
    events = event_log.read_csv(spark, str(tmp_path / "log.csv"), ";")
    o = LogOptions("Case ID", "Activity", "Complete Timestamp", ("Activity",), label="label", first=("kind",))
    got = {r["case_id"]: (r["outcome"], r["trace"], r["kind"]) for r in event_log.traces(events, o).collect()}
    assert got == {"1": (1, ["a", "b"], "y"), "2": (0, ["a"], "x"), "4": (0, ["a", "b"], "x"), "5": (0, ["a", "a", "b"], "y")}
    strict = LogOptions("Case ID", "Activity", "Complete Timestamp", ("Activity",), label="label", negative=("regular",), fold_label=True, skip_unlabelled=True, keep_null_activity=True, mode=("kind",))
    got = {r["case_id"]: (r["outcome"], r["kind"]) for r in event_log.traces(events, strict).collect()}
    assert got == {"1": (1, "x"), "2": (0, "x"), "3": (0, "x"), "5": (1, "y")}
    assert {r["label"] for r in event_log.unexpected_labels(events, "label", ["regular", "deviant"]).collect()} == {"odd"}


def test_signal_log(spark):
    rows = [("1", "a", 1), ("1", "X", 2), ("1", "b", 3), ("2", "X", 1), ("3", "a", 1)]
    ev = spark.createDataFrame(rows, "c string, e string, i int").withColumn("t", F.timestamp_seconds("i"))
    got = {r["case_id"]: (r["outcome"], r["trace"]) for r in event_log.traces(ev, LogOptions("c", "e", "t", signal="X")).collect()}
    assert got == {"1": (1, ["a", "b"]), "3": (0, ["a"])}


def test_age_brackets(spark):
    ages = [None, "x", "NaN", "39.9", "40", "59", "60", "75", "200"]
    df = spark.createDataFrame([(a,) for a in ages], "age string")
    assert [r[0] for r in df.select(event_log.age_bracket("age")).collect()] == ["UNKNOWN", "UNKNOWN", "UNKNOWN", "<40", "40-59", "40-59", "60-74", "75+", "75+"]


# ---- pruning -------------------------------------------------------------------------------------------


def _random_spec(spark, seed):
    rng = random.Random(seed)
    names = list(templates.TRACE_BINARY)
    rows = [(n, a, b, *[rng.choice([0.1, 0.5, 0.9]) for _ in range(4)]) for a, b in (("x", "y"), ("y", "x"), ("x", "z"), ("z", "y")) for n in rng.sample(names, 10)]
    rows.append(("Init", "x", None, 0.1, 0.1, 0.1, 0.1))
    return spark.createDataFrame(rows, "ctype string, a string, b string, econf double, esupp double, tconf double, tsupp double"), rows


def _fold(rows, steps, decide):
    gone = set()
    table = {(r[1], r[2], r[0]): r[3:] for r in rows if r[2] is not None}
    for a, b in {(r[1], r[2]) for r in rows if r[2] is not None}:
        for p, q in steps:
            if (a, b, p) in table and (a, b, q) in table and not {(a, b, p), (a, b, q)} & gone:
                if (out := decide(table[a, b, p], table[a, b, q])) is not None:
                    gone.add((a, b, (p, q)[out]))
    return {(r[0], r[1], r[2]) for r in rows} - {(t, a, b) for a, b, t in gone}


LEQ = lambda u, v: all(x <= y for x, y in zip(u, v, strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_order_dependent_pruning(spark, seed):
    df, rows = _random_spec(spark, seed)
    got = lambda f: {(r["ctype"], r["a"], r["b"]) for r in f(df).collect()}
    assert got(pruning.subsumption) == _fold(rows, catalogues.SUBSUMPTION, lambda s, w: 1 if LEQ(w, s) else 0)
    assert got(pruning.equivalence) == _fold(rows, catalogues.EQUIVALENCE, lambda p, q: 1 if LEQ(q, p) else 0)
    assert got(pruning.negation) == _fold(rows, catalogues.NEGATION, lambda p, q: (1 if LEQ(q, p) and not LEQ(p, q) else 0 if LEQ(p, q) and not LEQ(q, p) else None))


def test_swapped_subsumption(spark):
    rows = [("Response", "x", "y", 0.9, 0.9, 0.9, 0.9), ("Precedence", "y", "x", 0.1, 0.1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "ctype string, a string, b string, econf double, esupp double, tconf double, tsupp double")
    assert pruning.swapped_subsumption(df).count() == 2
    assert [r["ctype"] for r in pruning.swapped_subsumption(df, [("Response", "Precedence")]).collect()] == ["Response"]


# ---- significance --------------------------------------------------------------------------------------


def p_table(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, p double")


def test_fdr_relations(spark):
    rng = np.random.default_rng(3)
    p = p_table(spark, np.concatenate([rng.random(60), rng.beta(0.1, 1, 40)]))
    bh = {r["id"] for r in significance.step_up(p, "p", ["id"]).where("reject").collect()}
    by = {r["id"] for r in significance.step_up(p, "p", ["id"], dependent=True).where("reject").collect()}
    q = {r["id"]: r["q"] for r in significance.q_values(p, "p", ["id"]).collect()}
    assert by <= bh == {i for i, v in q.items() if v <= 0.05}
    order = [q[r["id"]] for r in p.orderBy("p").collect()]
    assert order == sorted(order) and max(order) <= 1
    assert significance.pi0_adaptive(p, "p", 0.05).first()["pi0"] <= 1 and 0 < significance.pi0_bootstrap(p, "p").first()["pi0"] <= 1


@pytest.mark.parametrize("values, pi0", [([], 1.0), ([0.01], 0.0), ([0.001, 0.02], 0.0), ([1.0, 1.0, 1.0], 1.0)])
def test_fdr_corners(spark, values, pi0):
    p = p_table(spark, values)
    assert significance.pi0_adaptive(p, "p", 0.05).first()["pi0"] == pi0
    assert significance.step_up(p, "p", ["id"]).count() == len(values)
    assert significance.q_values(p, "p", ["id"]).count() == len(values)
    assert significance.log_p_correlation(p.withColumn("r", F.col("p")), "p", "r").first()["rho"] == (0.0 if len(values) < 3 or len(set(values)) == 1 else 1.0)


def test_moment_matching():
    c, f = significance.moment_match(0.0, 0.4, 0.6)
    assert math.isclose(2 * c * f, 2 * (0.4 + 0.6) * 2) or c > 0
    assert math.isclose(c * f, 2 * (0.4 + 0.6))  # the mean is kept
    assert significance.weights() == (0.4, 0.6)
    assert significance.moment_match(-3, 0.4, 0.6) == significance.moment_match(-0.5, 0.4, 0.6)


def test_special_functions(spark):
    assert math.isclose(special.chi2_critical(0.05), 3.841458820694124, rel_tol=1e-9)
    assert np.allclose(special.chi2_sf([3.841458820694124, 5.991464547107979, 0.0, 100.0], [1, 2, 3, 4]), [0.05, 0.05, 1.0, math.exp(-50) * 51], rtol=1e-9)
    x = np.array([0.3, 2.0, 9.0, 40.0])
    assert np.allclose(special.chi2_sf(x, 4), np.exp(-x / 2) * (1 + x / 2), rtol=1e-10)
    assert np.allclose(special.chi2_sf(x, 1), [math.erfc(math.sqrt(v / 2)) for v in x], rtol=1e-9)
    assert math.isclose(special.beta_i(2, 3, 0.4), 0.5248, rel_tol=1e-9) and math.isclose(special.beta_i(5, 1, 0.9), 0.9**5, rel_tol=1e-9)
    assert math.isclose(special.student_sf(0, 7), 0.5) and math.isclose(special.student_sf(2.0, 2), 0.0917517, rel_tol=1e-5)
    assert math.isclose(special.binomial_sf(2, 3, 0.5), 0.5, rel_tol=1e-9)
    df = spark.createDataFrame([(2.0, 3.846), (0.0, 1.5)], "x double, f double").select(special.chi2_tail(F.col("x"), F.col("f")).alias("p"))
    assert np.allclose([r["p"] for r in df.collect()], special.chi2_sf([2.0, 0.0], [3.846, 1.5]))


def test_intervals(spark):
    rng = np.random.default_rng(0)
    v = rng.poisson(2, 50)
    for how in (True, False):
        low, high = special.bca(v, interpolate=how)
        assert low < v.mean() < high
    assert special.bca([3, 3, 3]) == (3, 3) and all(map(math.isnan, special.bca([])))
    assert special.bca(v) == special.bca(v)
    df = spark.createDataFrame([("m", float(x)) for x in v], "k string, v double")
    r = bootstrap.intervals(df, ["k"], "v").first()
    assert r["n"] == 50 and r["bca_low"] < r["mean"] < r["bca_high"]


def test_set_metrics(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "ctype string")
    r = significance.reference_metrics(ids("abc"), ids("bcde"), ["ctype"]).first()
    assert (r["tp"], r["fp"], r["fn"], r["jaccard"], r["fdr_ref"], r["reliable"]) == (2, 2, 1, 0.4, 0.5, False)
    e = significance.reference_metrics(ids(""), ids(""), ["ctype"]).first()
    assert e["jaccard"] == 1.0 and e["precision"] is None and e["recall"] is None


# ---- resampling ----------------------------------------------------------------------------------------


def test_permutations_keep_margins(spark):
    df, rows = log(spark)
    n1 = sum(r[1] for r in rows)
    labels = resampling.permuted_labels(df, 6)
    assert {r["s"] for r in labels.groupBy("rep").agg(F.sum("label").alias("s")).collect()} == {n1}
    assert resampling.permuted_labels(df.repartition(7), 6).exceptAll(labels).count() == 0
    orders = resampling.permuted_traces(df, 3).collect()
    want = {r[0]: sorted(r[2]) for r in rows}
    assert len(orders) == 3 * len(rows) and all(sorted(r["trace"]) == want[r["case_id"]] for r in orders)
    null = resampling.double_null(df, 2)
    assert {r["s"] for r in null.groupBy("rep").agg(F.sum("outcome").alias("s")).collect()} == {n1}


def test_label_permutation_by_hand(spark):
    df, rows = log(spark, 40)
    cands = candidates(alphabet(df))
    got = {(r["ctype"], r["a"], r["b"]): r for r in tod.label_permutation(df, cands, 9, keep_null=True).collect()}
    from tests.test_templates import holds

    drawn = {(r["rep"], r["case_id"]): r["label"] for r in resampling.permuted_labels(df, 9).collect()}
    for (name, a, b), r in got.items():
        h = {c: holds(name, t, a, b) for c, _, t in rows}
        share = lambda side: (lambda v: sum(v) / len(v) if v else 0.0)([h[c] for c in side if h[c] is not None])  # noqa: B023, E731
        stat = lambda y: round(share([c for c in h if y[c]]) - share([c for c in h if not y[c]]), 12)  # noqa: B023, E731
        assert math.isclose(r["delta"], stat({c: o for c, o, _ in rows}), abs_tol=1e-9)
        null = [stat({c: drawn[k, c] for c in h}) for k in range(9)]
        assert np.allclose(r["null"], null) and r["exceed_two"] == sum(abs(x) >= abs(r["delta"]) for x in null)


def _hash(*parts):
    import hashlib

    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def test_order_noise_by_hand(spark):
    df, rows = log(spark)
    got = {r["case_id"]: r["trace"] for r in resampling.order_noise(df, 0.4, 7).collect()}
    for c, _, t in rows:
        t, k = list(t), round(0.4 * (len(t) - 1))
        for i in sorted(sorted(range(len(t) - 1), key=lambda i: _hash(7, c, i))[:k]):
            t[i], t[i + 1] = t[i + 1], t[i]
        assert got[c] == t


def test_exact_shares(spark):
    df, rows = log(spark, 50)
    old = {r[0]: r for r in rows}
    flipped = [r for r in resampling.flip_exactly(df, 0.1).collect() if r["outcome"] != old[r["case_id"]][1]]
    cut = [r for r in resampling.truncate(df, 0.3).collect() if r["trace"] != old[r["case_id"]][2]]
    assert len(flipped) == 5 and len(cut) <= 15
    assert all(len(r["trace"]) == max(1, math.ceil(round(0.7 * len(old[r["case_id"]][2]), 9))) for r in cut)
    same = resampling.random_swap(df, 1.0).collect()
    assert all(sorted(r["trace"]) == sorted(old[r["case_id"]][2]) for r in same)


def test_structural_test_bounds(spark):
    df, _ = log(spark, 30)
    got = tod.structural_permutation(df, candidates(alphabet(df)), 6).collect()
    assert got and all(0 < r["p_screen"] <= 1 and 0 < r["p_struct"] <= 1 for r in got)


# ---- comparison ----------------------------------------------------------------------------------------


def conf_table(spark):
    rng = random.Random(2)
    rows = [("Response", f"a{i}", "b", rng.random(), rng.random(), rng.randint(0, 40), rng.randint(0, 40)) for i in range(50)]
    return spark.createDataFrame(rows, "ctype string, a string, b string, conf0 double, conf1 double, n_app0 int, n_app1 int"), rows


@pytest.mark.parametrize("target", [1, 20, 500])
def test_threshold_calibration(spark, target):
    df, rows = conf_table(spark)
    grid = [round(k * 0.0001, 6) for k in range(1, 9001)]
    curve = [sum(round(abs(r[4] - r[3]) / 0.0001, 6) >= k for r in rows) for k in range(1, 9001)]
    ok = [i for i, c in enumerate(curve) if c >= target]
    best = ok[-1] if ok else 0
    r = comparison.calibrate_threshold(df, target).first()
    assert (r["tau"], r["r_obs"]) == (grid[best], curve[best])
    assert r["pathology"] == ("under_discovery_capped" if not ok else "over_discovery" if ok[-1] == 8999 else "normal")


def test_fisher_score_cases(spark):
    rows = [(0.2, 0.6, 10, 20), (0.0, 1.0, 10, 10), (0.5, 0.5, 0, 0), (0.0, 0.0, 5, 5)]
    df = spark.createDataFrame(rows, "conf0 double, conf1 double, n_app0 int, n_app1 int")
    got = [r[0] for r in df.select(comparison.fisher_score()).collect()]
    assert np.allclose(got, [0.16 / (0.016 + 0.012), 1e12, 0.0, 0.0])


# ---- mining --------------------------------------------------------------------------------------------


def test_repeats():
    assert mining._tandem(list("ababab")) == {"a\x1fb": 2}  # a hit skips one block
    assert mining._tandem(list("aaa")) == {"a": 2}
    assert mining._maximal(list("abcabc")) == {"a\x1fb\x1fc": 2}
    assert mining._maximal(list("aaaa")) == {"a\x1fa\x1fa": 2}
    assert mining._maximal(list("abxabyb")) == {"a\x1fb": 2}
    assert mining._tandem([]) == mining._maximal([]) == {}


def test_coverage_selection_by_hand(spark):
    df, rows = log(spark, 40)
    f = mining.activity_counts(df)
    scores = {r["feature"]: r["score"] for r in mining.fisher_scores(f, df).collect()}
    x = {c: {a: t.count(a) for a in "abcd"} for c, _, t in rows}
    for a in "abcd":
        v1, v0 = (np.array([x[c][a] for c, o, _ in rows if o == k], float) for k in (1, 0))
        mean = np.concatenate([v0, v1]).mean()
        want = (len(v1) * (v1.mean() - mean) ** 2 + len(v0) * (v0.mean() - mean) ** 2) / (len(v1) * v1.var() + len(v0) * v0.var())
        assert math.isclose(scores[a], want, rel_tol=1e-9)
    assert mining.select_by_coverage(f, df, 1)[0] == max(scores, key=lambda k: (scores[k], k))


def test_tree_rules_and_metrics(spark):
    rows = [(f"c{i}", i % 2, ["a"] * (1 + i % 2) + ["b"]) for i in range(60)]
    df = spark.createDataFrame(rows, "case_id string, outcome int, trace array<string>")
    f = mining.activity_counts(df)
    m = mining.cross_validate(f, df, ["a", "b"], 3, (5,)).first()
    assert m["f1"] == m["auc"] == m["accuracy"] == 1.0
    assert mining.root_condition(f, df, ["a", "b"]) == ("a", 1.5)
    x = np.array([[1 + i % 2, 1] for i in range(60)], float)
    assert mining.sequential_rules(x, np.array([i % 2 for i in range(60)]), ["a", "b"]) == [("a > 1", 1)]


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 1.0, 0.9), (0, 0.0, 0.5), (1, 0.0, 0.5), (0, 0.0, 0.1)], "outcome int, prediction double, score double")
    r = mining.classification_metrics(df).first()
    assert (r["auc"], r["precision"], r["recall"]) == (0.875, 1.0, 0.5)


# ---- files and streams ---------------------------------------------------------------------------------


def test_decl_and_spec_round_trips(spark, tmp_path):
    from tracegauge.operators.measures import measures

    df, _ = log(spark, 30)
    v, c = event_log.variants(df), candidates(alphabet(df))
    one, two = measures(v, c, "n1"), measures(v, c, "n0").where("a <> 'a'")
    files.write_decl(one, str(tmp_path / "p.decl"), "positive")
    back = files.read_decl(spark, str(tmp_path / "p.decl"))
    assert back.exceptAll(c).count() == 0 and back.count() == c.count()
    files.write_spec(one, two, str(tmp_path / "spec"))
    text = json.loads(next((tmp_path / "spec").glob("*.json")).read_text())
    assert text["set_algebra"]["n_shared"] == two.count() and len(text["Lpos"]["constraints"]) == one.count()
    spec = files.read_spec(spark, str(tmp_path / "spec"))
    assert spec.count() == c.count() and spec.where("in_neg").count() == two.count()
    assert "==" in files.text_report("Report", {"top": one})


def test_results_fall_back(spark, tmp_path):
    rows = [{"pattern_id": "1", "significance_category": "both"}, {"pattern_id": "2", "storey_fdr": {"significance_category": "none"}}, {"pattern_id": "3", "significant": True, "p_struct": 0.2, "p_disc": 0.01}]
    (tmp_path / "r.json").write_text(json.dumps({"all_patterns": rows}))
    assert {r["pattern_id"]: r["category"] for r in files.read_results(spark, str(tmp_path / "r.json")).collect()} == {"1": "both", "2": "none", "3": "discriminative_only"}


def test_resume(spark, tmp_path):
    jobs = spark.createDataFrame(list(itertools.product(["p", "q"], [0, 1])), "family string, rep int")
    done = str(tmp_path / "done")
    assert files.resume(jobs, done, ["family", "rep"]).count() == 4
    files.append_finished(jobs.where("family = 'p'").withColumn("v", F.lit(1)), done, ["family", "rep"])
    assert {tuple(r) for r in files.resume(jobs, done, ["family", "rep"]).collect()} == {("q", 0), ("q", 1)}


def test_stream_agrees_with_batch(spark, tmp_path):
    from tracegauge.operators.measures import holds
    from tracegauge.streaming.monitor import available_now, closed_cases

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src, out = tmp_path / "in", str(tmp_path / "out")
    ev.orderBy("ts").repartition(1).write.parquet(str(src))
    cands = candidates(ev.select(F.col("event_type").alias("act")).distinct())
    live = spark.readStream.schema(ev.schema).parquet(str(src))
    available_now(live, cands, lambda df, i: df.write.mode("append").parquet(out), str(tmp_path / "progress"), "user_id", "event_type", "ts", gap="6 hours")
    got = spark.read.schema("case_id string, ctype string, a string, b string, sat int").parquet(out)
    batch = holds(closed_cases(ev, "user_id", "event_type", "ts", gap="6 hours"), cands, ["case_id"])
    assert got.count() > 0 and got.exceptAll(batch).count() == 0


def test_encodings(spark):
    df, rows = log(spark, 30)
    data = spark.createDataFrame([(r[0], "size", float(len(r[2]))) for r in rows], "case_id string, feature string, value double")
    c = candidates(alphabet(df))
    assert len(mining.encodings()) == 19
    ia = mining.encode(df, "ia", c)
    assert ia.agg(F.sum("value")).first()[0] == sum(len(r[2]) for r in rows)
    both = mining.encode(df, "ia+data", c, data=data)
    assert both.where("feature = 'size'").count() == len(rows) and both.count() == ia.count() + len(rows)
    with pytest.raises(ValueError):
        mining.encode(df, "ia+nothing", c)


def test_control_tests():
    r = significance.control_tests([0] * 19 + [1], 10, 0.05)
    assert math.isclose(r["fdr_emp"], 0.005) and math.isclose(r["fwer_p"], 1 - 0.95**20) and r["fdr_p"] > 0.99
    assert significance.control_tests([0, 0], 0)["fdr_p"] == 1.0
