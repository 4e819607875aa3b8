"""Registered queries that do the whole job: on a log with planted effects, where a cut budget can't tell them."""

import datetime
import inspect

import duckdb
import pytest

from tracegauge.operators import mining, significance
from tracegauge.operators.automata import prune_entailed
from tracegauge.plans import catalog, experiments
from tracegauge.plans.logs import CHECKS, ENABLED_SQL, USER_DAYS


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Forty user days: those with an error view before they click, the others the other way round."""
    rows, start = [], datetime.datetime(2024, 1, 1)
    for day in range(40):
        for i, act in enumerate(["view", "click", "error"] if day % 2 else ["click", "view"]):
            rows.append((3 * day + i, start + datetime.timedelta(days=day, hours=i), 1, act, 1.0))
    folder = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_full_protocol_finds_planted_order(spark, planted):
    found = {(r["ctype"], r["a"], r["b"]): r for r in catalog.queries()["full_protocol"](spark, planted).collect()}
    r = found["Response", "view", "click"]
    assert r["significant"] and r["dominant"] == 1 and r["category"] != "none"
    assert found["Response", "click", "view"]["significant"] and found["Response", "click", "view"]["dominant"] == 0


_NULL_LOGS = f"""{USER_DAYS.replace("tr as", "own as")}, r as (select rep, case_id, row_number() over (partition by rep order by md5('42|' || rep || '|' || case_id), case_id) as k, sum(outcome) over (partition by rep) as n1 from own, range(200) as g(rep)),
e as (select rep, case_id, unnest(t) as act, unnest(range(len(t))) as i from own, range(200) as g(rep)),
tr as (select r.rep || '#' || r.case_id as case_id, any_value((k <= n1)::int) as outcome, list(act order by md5('43|' || rep || '|' || case_id || '|' || i), i) as t from e join r using (rep, case_id) group by r.rep, r.case_id)"""


def _discoveries(con, logs: str, rep: str) -> dict:
    conf = lambda k: f"coalesce(sum((sat and outcome = {k})::int) / nullif(sum((app and outcome = {k})::int), 0)::double, 0)"
    return dict(con.execute(f"""with {logs}, {CHECKS}, c as (select {rep} as rep, ctype, a, b, {conf(0)} as c0, {conf(1)} as c1 from chk where ctype in {ENABLED_SQL} group by all having sum(app::int) > 0)
        select rep, count(*) from c where abs(c1 - c0) >= 0.02 and greatest(c0, c1) >= 0.01 group by 1""").fetchall())


def test_error_control_by_brute_force(spark, planted):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{planted}/events.parquet/*.parquet'")
    observed = _discoveries(con, USER_DAYS, "0")[0]
    null = _discoveries(con, _NULL_LOGS, "split_part(case_id, '#', 1)::int")
    want = significance.control_tests([null.get(k, 0) for k in range(200)], observed, 0.05)
    assert observed not in (0, 56) and want["fdr_emp"] > 0
    got = catalog.queries()["error_control_tests"](spark, planted).first().asDict()
    assert got == pytest.approx(want, abs=1e-8)


class _Called(Exception):
    pass


@pytest.mark.parametrize("module, operator, name, want", [
    (experiments, "noise_grid", "noise_grid", {"eps": experiments.EPS, "rho": experiments.RHO}),
    (experiments, "perturbation_study", "perturbation_study", {"levels": experiments.LEVELS, "repeats": 10}),
    (experiments, "error_rates", "null_error_rates", {"count": 200}),
    (mining, "cross_validate", "tree_cross_validation", {"k": 10, "depths": mining.DEPTHS}),
    (catalog.tests_of_difference, "structural_permutation", "structural_permutation_test", {"count": 2000}),
])
def test_queries_take_whole_budgets(spark, planted, monkeypatch, module, operator, name, want):
    signature = inspect.signature(getattr(module, operator))

    def stop(*args, **named):
        given = signature.bind(*args, **named)
        given.apply_defaults()
        raise _Called({k: given.arguments[k] for k in want}, given.arguments.get("methods"))

    monkeypatch.setattr(module, operator, stop)
    source = "/root/testdata/sf0.001" if name == "structural_permutation_test" else planted
    with pytest.raises(_Called) as called:
        catalog.queries()[name](spark, source)
    assert called.value.args[0] == want
    if operator == "noise_grid":
        assert set(called.value.args[1]) == {"threshold", "fisher"}


def test_noise_grid_has_every_cell(spark, planted):
    traces = catalog.logs.user_days(spark, planted)
    cells = experiments.noise_grid(traces, catalog._cands(traces), {"threshold": experiments.threshold_method()}, (0.0, 0.5), (0.0,)).orderBy("eps").collect()
    assert [(r["eps"], r["rho"], r["method"]) for r in cells] == [(0.0, 0.0, "threshold"), (0.5, 0.0, "threshold")] and cells[0]["jaccard"] == 1.0


def test_pruning_takes_every_neighbour():
    far = [("Precedence", "a", f"x{i}") for i in range(13)]
    spec = [*far, ("Response", "a", "b"), ("Response", "b", "c"), ("Response", "a", "c")]
    assert prune_entailed(spec) == spec[:-1]
    apart = [("Response", f"p{i}", f"q{i}") for i in range(500)]
    assert prune_entailed([*apart, *spec[13:]]) == [*apart, *spec[13:15]]


def test_mined_specification_is_pruned(spark):
    source = "/root/testdata/sf0.001"
    mined = {tuple(r) for r in catalog._two_specs(spark, source)[0].collect()}
    kept = {tuple(r) for r in catalog.queries()["entailment_pruning"](spark, source).collect()}
    assert kept < mined
    assert kept and len(prune_entailed(sorted(kept, key=str))) == len(kept)


def _adaptive_log(spark):
    from tracegauge.sources.event_log import LogOptions, traces

    rows = [(f"c{i}", act, datetime.datetime(2024, 1, 1, j), "deviant" if i % 3 else "regular") for i in range(30) for j, act in enumerate("abcab"[i % 4 :] if i % 2 else "cba")]
    return traces(spark.createDataFrame(rows, "case_id string, activity string, timestamp timestamp, label string"), LogOptions(label="label"))


def test_cells_equal_column_expressions(spark):
    """Every change of a cell against the resampling expression that defines it."""
    from tracegauge.operators import cells, resampling

    t = _adaptive_log(spark)
    rows = [(r["case_id"], r["outcome"], list(r["trace"])) for r in t.collect()]
    got = lambda change: {(c, i): (y, x) for i, o, tr in rows for c, y, x in change.of(i, o, tr)}
    want = lambda logs: {(c, r["case_id"]): (r["outcome"], list(r["trace"])) for c, d in enumerate(logs) for r in d.collect()}
    grid = cells.NoiseGrid((0.0, 0.4), (0.3, 1.0), 7)
    logs = [resampling.label_noise(resampling.order_noise(t, r, 7 + 1000 * i), e, 7 + j) for i, r in enumerate((0.3, 1.0)) for j, e in enumerate((0.0, 0.4))]
    assert got(grid) == want(logs)
    what = [(f, e, 100 * k + 3) for k, (f, e) in enumerate((f, e) for f in resampling.PERTURBATIONS for e in (0.1, 0.6, 1.0))]
    assert got(cells.Perturbations(t, what)) == want([resampling.PERTURBATIONS[f](t, e, s) for f, e, s in what])
    null = want([resampling.double_null(t, 3, 5).where(f"rep = {i}") for i in range(3)])
    assert got(cells.DoubleNull(t, 3, 5)) == null


def test_labels_of_one_class(spark):
    from tracegauge.operators import replicates

    cases = spark.createDataFrame([(f"c{i}",) for i in range(9)], "case_id string")
    for n1 in (0, 9):
        labels = replicates.Labels(["1|0|", "1|1|"], replicates.label_cuts(cases, ["1|0|", "1|1|"], 9, n1))
        assert {tuple(labels.of(f"c{i}", 0, 2)) for i in range(9)} == {(n1 // 9, n1 // 9)}


def test_adaptive_study_adds_repeats(spark):
    t = _adaptive_log(spark)
    out = experiments.adaptive_study(t, catalog._cands(t), {"threshold": experiments.threshold_method()}, first=2, more=2, levels=(0.1,), families=("labels", "order"))
    counts = {(r["family"], r["n"]) for r in out.groupBy("family").count().withColumnRenamed("count", "n").collect()}
    assert counts <= {("labels", 2), ("labels", 4), ("order", 2), ("order", 4)} and len(counts) == 2
    assert out.select("family", "eps", "rep").distinct().count() == out.count()


def test_stream_batches_overwrite_themselves(spark, tmp_path):
    from tracegauge.streaming.monitor import batch_sink

    sink, rows = batch_sink(str(tmp_path / "out")), spark.createDataFrame([("c", "Init", "a", None, 1)], "case_id string, ctype string, a string, b string, sat int")
    for number in (0, 1, 1):
        sink(rows, number)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
