"""What a task does for its cases, and how often a log is built, doesn't grow with cells or uses."""

import numpy as np
import pytest

from tracegauge.operators import cells, replicates
from tracegauge.plans import catalog, logs


class Stored(Exception):
    pass


@pytest.mark.parametrize("name", ["null_error_rates", "error_control_tests", "null_counts_of_methods", "perturbation_study", "structural_permutation_test",
                                  "null_counts_of_permutation_tests", "calibration_on_noisy_log", "specification_agreement", "data_conditions", "mined_rules", "composite_encoding"])
def test_log_is_written_once(spark, monkeypatch, name):
    def stop(log):
        raise Stored

    monkeypatch.setattr(logs, "stored", stop)
    with pytest.raises(Stored):
        catalog.queries()[name](spark, "/root/testdata/sf0.001")


def test_stored_log_is_the_log(spark):
    log = logs.user_days(spark, "/root/testdata/sf0.001").select("case_id", "outcome", "trace")
    held = logs.stored(log)
    assert sorted(held.collect()) == sorted(log.collect())
    assert "Aggregate" not in held._jdf.queryExecution().toString()


def test_null_logs_hash_many_cases_at_once(monkeypatch):
    calls, own = [], replicates.Heads.first64
    monkeypatch.setattr(replicates.Heads, "first64", lambda self, tails: calls.append(len(tails)) or own(self, tails))
    change = cells.DoubleNull.__new__(cells.DoubleNull)
    change.cells, change.seed, change.orders = 5, 42, []
    change.labels = replicates.Labels([f"42|{r}|" for r in range(5)], [(b"\x80" + 15 * b"\0", "")] * 5)
    both = cells.Together(change, cells.Unchanged())
    parts = list(both.many([f"c{i}" for i in range(90)], np.arange(90) % 2, [("a", "b", "a")] * 90))
    assert len(calls) == 2 and sum(at.size for _, _, at, _ in parts) == 90 * 6


def test_traces_of_a_multiset_are_evaluated_together(monkeypatch):
    made, own = [], replicates.Trace
    monkeypatch.setattr(replicates, "Trace", lambda *a: made.append(a) or own(*a))
    held = replicates.Products(2, ["Response", "Succession"], ["Init"])
    traces = [("a", "b", "b"), ("b", "a", "b"), ("b", "b", "a")]
    assert not list(held.add(traces, np.array([0, 1, 2, 2]), np.array([0, 0, 0, 1])))
    rows = [r for b in held.rows() for r in b.to_pylist()]
    assert len(made) == 1
    found = {(r["ctype"], r["a"], r["b"]): np.frombuffer(r["sums"], np.int64).tolist() for r in rows}
    assert found["Init", "a", None] == [0, 0, 1, 0] and found["*", None, None] == [3, 1, 0, 0]
    assert found["Response", "a", "b"] == [0, 0, 2, 0]


def test_cases_of_perturbed_labels_are_hashed_as_arrays(monkeypatch):
    def never(text):
        raise AssertionError(text)

    change = cells.Perturbations.__new__(cells.Perturbations)
    change.what, change.cells, change.heads, change.exact = [("labels", 0.5, 1), ("truncation", 0.5, 2)], 2, ["1|", "2|"], [0, 1]
    change.labels = replicates.Labels(change.heads, [(b"\x80" + 15 * b"\0", "")] * 2)
    monkeypatch.setattr(cells, "md5", never)
    (_, distinct, at, y), = change.many([f"c{i}" for i in range(400)], np.zeros(400, np.int64), [("a", "b", "a", "b")] * 400)
    assert distinct == [("a", "b", "a", "b"), ("a", "b")] and 100 < y[:, 0].sum() < 300 and 100 < at[:, 1].sum() < 300
