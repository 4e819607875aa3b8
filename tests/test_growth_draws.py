"""Draws of labels and orders are made once, as arrays, and are those of hashlib."""

import hashlib

import numpy as np
import pytest

from tracegauge.operators import cells, hashes, measures, replicates
from tracegauge.operators.statistics import alphabet
from tracegauge.plans import catalog

FAMILIES = [("order", 0.5, 7), ("labels", 0.1, 8), ("truncation", 0.3, 9), ("labels", 0.4, 10)]


def _never(*args, **options):
    raise AssertionError(args)


@pytest.fixture
def log(spark):
    return spark.createDataFrame([(f"c|{i}", i % 3 % 2, ["a", "b", "c"][: 1 + i % 3]) for i in range(900)], "case_id string, outcome int, trace array<string>")


def _columns(change):
    rows = change.log.collect()
    ids, outcomes, traces = [r["case_id"] for r in rows], np.array([r["outcome"] for r in rows]), [tuple(r["trace"]) for r in rows]
    return ids, outcomes, traces, [bytes(r["under"]) for r in rows], [r["near"] for r in rows]


def _counted(parts):
    out = {}
    for first, distinct, at, y in parts:
        for case, outcomes in zip(at.tolist(), y.tolist(), strict=True):
            for cell, (t, label) in enumerate(zip(case, outcomes, strict=True), first):
                key = (cell, label, distinct[t])
                out[key] = out.get(key, 0) + 1
    return out


def test_label_draws_are_the_cuts(log):
    heads, wanted = ["8|", "9|x|", "10|"], [90, 450, 1]
    found = replicates.label_draws(log, heads, 900, wanted)
    for head, k, cut in zip(heads, wanted, found[1] if found else [], strict=True):
        drawn = sorted((hashlib.md5(f"{head}c|{i}".encode()).digest(), f"c|{i}") for i in range(900))
        assert cut == drawn[k - 1] == replicates.label_cuts(log, [head], 900, k)[0]
    assert found[0].count() == 900 and replicates.label_draws(log, heads, 900, [90, 900, 1]) is None


@pytest.mark.parametrize("kind", ["perturbations", "null"])
def test_labels_are_drawn_once(log, monkeypatch, kind):
    """All levels in one pass over the log, whose draws tasks don't make again."""
    monkeypatch.setattr(replicates, "label_cuts", _never)
    change = cells.Perturbations(log, FAMILIES) if kind == "perturbations" else cells.DoubleNull(log, 5, 42)
    ids, outcomes, traces, under, near = _columns(change)
    want = _counted(change.many(ids, outcomes, traces))
    drawn = change.labels.drawn(ids, under, near)
    monkeypatch.setattr(replicates.Labels, "many", _never)
    assert _counted(change.many(ids, outcomes, traces, drawn)) == want and sum(want.values()) == 900 * change.cells


def test_draws_outside_their_band_are_cut_as_before(log, monkeypatch):
    want = cells.Perturbations(log, FAMILIES).labels.cuts
    monkeypatch.setattr(replicates, "label_draws", lambda *args: None)
    change = cells.Perturbations(log, FAMILIES)
    assert change.log is None and change.labels.cuts == want


def test_swapped_places_are_drawn_as_arrays(monkeypatch):
    change = cells.Perturbations.__new__(cells.Perturbations)
    change.what, change.cells, change.heads, change.exact = FAMILIES[:1], 1, ["7|"], []
    ids, traces = [f"c|{i}" for i in range(400)], [("a", "b", "c", "a")[: 1 + i % 4] for i in range(400)]
    monkeypatch.setattr(cells, "md5", _never)
    (_, distinct, at, _), = change.many(ids, np.zeros(400, np.int64), traces)
    digest = lambda text: hashlib.md5(text.encode()).hexdigest()
    for c, trace, t in zip(ids, traces, at[:, 0].tolist(), strict=True):
        want = list(trace)
        if int(digest(f"7|{c}")[:8], 16) / 2**32 < 0.5 and len(trace) > 1:
            p, q = sorted(range(len(trace)), key=lambda i: digest(f"8|{c}|{i}"))[:2]
            want[p], want[q] = trace[q], trace[p]
        assert distinct[t] == tuple(want)


def test_orders_of_one_activity_are_not_drawn(monkeypatch):
    calls, own = [], replicates.Heads.first64
    monkeypatch.setattr(replicates.Heads, "first64", lambda self, tails: calls.append(len(tails)) or own(self, tails))
    change = cells.DoubleNull.__new__(cells.DoubleNull)
    change.cells, change.seed, change.orders = 5, 42, []
    change.labels = replicates.Labels([f"42|{r}|" for r in range(5)], [(b"\x80" + 15 * b"\0", "")] * 5)
    got = _counted(change.many([f"c{i}" for i in range(90)], np.arange(90) % 2, [("a", "a"), ("a",), ("b",) * 40] * 30))
    assert sum(calls) == 90 and {t for _, _, t in got} == {("a", "a"), ("a",), ("b",) * 40}


def test_words_behind_the_texts_are_not_arrays(monkeypatch):
    arrays, own = [], hashes._first64
    monkeypatch.setattr(hashes, "_first64", lambda words, n: arrays.append(sum(isinstance(w, np.ndarray) for w in words)) or own(words, n))
    heads, tails = [f"{r}|".encode() for r in range(120)], [f"case{i % 7:03d}".encode() for i in range(50)] + [b"x" * 30] * 50
    got = hashes.Heads(heads).first64(tails)
    assert got.tolist() == [[int.from_bytes(hashlib.md5(h + t).digest()[:8], "big") for h in heads] for t in tails]
    assert arrays == [4, 10]  # the words of the longest text of either length, and one of lengths in bits


def test_candidates_need_no_places(spark):
    log = spark.createDataFrame([("1", 0, ["a", None, "b", "a"]), ("2", 1, []), ("3", 1, ["c"])], "case_id string, outcome int, trace array<string>")
    got = catalog._cands(log)
    assert sorted(got.collect(), key=str) == sorted(measures.candidates(alphabet(log)).collect(), key=str)
    assert "named_struct" not in got._jdf.queryExecution().optimizedPlan().toString()
