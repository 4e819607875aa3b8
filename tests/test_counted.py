"""Null labels and orders drawn as counts: their numbers add up, they have the law of single draws, and cases of a multiset are one row."""

import random

import numpy as np
import pytest

from tracegauge.operators import counted, measures
from tracegauge.operators.statistics import alphabet
from tracegauge.plans import protocol


def test_parts_and_groups_share_all_positive_cases():
    sizes, positive = [5, 0, 70, 1, 24], np.full((3, 4), 30)
    shares = counted.Shares(sizes)
    own = np.stack([shares.of(i, positive, "seed", 7) for i in range(5)])
    assert (own.sum(0) == 30).all() and (own.max((1, 2)) <= sizes).all()
    assert (own[2] == counted.Shares(sizes).of(2, positive, "seed", 7)).all() and not (own[2] == shares.of(2, positive, "seed", 8)).all()
    assert (np.sum(list(counted.split(counted.generator(1), sizes, positive)), 0) == 30).all()
    one = counted.Shares([100])
    assert (one.of(0, positive) == 30).all()


def test_counts_have_the_law_of_single_draws():
    g, n = counted.generator("law"), 40_000
    positive = np.stack([np.full(n, 8), np.full(n, 5), np.full(n, 9)], 1)
    labels, orders = counted.group_counts(g, 20, positive, 4, 3)
    assert labels.shape == (4, n, 3) and orders.shape == (4, n, 2, 3)
    assert (labels.sum(0) == positive).all() and (orders.sum(0) == np.array([11, 9])[:, None]).all()
    assert (labels[:, :, 2] == orders[:, :, 1, 0]).all() and (labels <= orders[:, :, :, 0].sum(2)[:, :, None]).all()
    # orders: 9 of 20 in 4 places alike; a label: places of 20 / 4 cases get 8 of 20 as if drawn from all cases at once
    assert orders[0, :, 1, 2].mean() == pytest.approx(9 / 4, abs=0.03) and orders[0, :, 1, 2].var() == pytest.approx(9 * 3 / 16, abs=0.05)
    assert labels[1, :, 0].mean() == pytest.approx(2, abs=0.03) and labels[1, :, 0].var() == pytest.approx(8 * 3 / 16, abs=0.05)
    left = np.full((n // 20, 2), 4)
    drawn, codes = counted.case_draws(g, 6, 6, left, np.array([0, 1, 1]), 2)
    assert (drawn.sum(0) == 4).all() and (left == 0).all() and drawn[5].mean() == pytest.approx(4 / 6, abs=0.03)
    assert codes.shape == (6, n // 20, 2, 3) and (codes.sum(3) == 2).all() and (codes[..., 0] == 0).mean() == pytest.approx(1 / 3, abs=0.02)


def small_log(spark, n):
    r = random.Random(1)
    rows = [(f"c{i}", int(r.random() < 0.35), list("aabbccdd") if i % 40 == 0 else [r.choice("abcd") for _ in range(r.choice([1, 2, 2, 3, 4]))]) for i in range(n)]
    return spark.createDataFrame(rows, "case_id string, outcome int, trace array<string>")


def test_cases_of_a_multiset_are_one_row(spark):
    t = spark.createDataFrame([(f"c{i}", i % 2, ["b", "a"] if i % 3 else ["a", "b"]) for i in range(300)], "case_id string, outcome int, trace array<string>")
    assert [tuple(r) for r in counted.leaves(t).collect()] == [(["a", "b"], 0, 300)]
    many = spark.createDataFrame([(f"c{i}", 0, list("aabbccddee")) for i in range(4_500)], "case_id string, outcome int, trace array<string>")
    assert sorted((r["slice"], r["cases"]) for r in counted.leaves(many).collect()) == [(0, 2000), (1, 2000), (2, 500)]


def test_calibration_has_the_law_of_hashed_draws(spark, monkeypatch):
    t = small_log(spark, 400)
    cands = measures.candidates(alphabet(t), ("Response", "Succession", "NotResponse"))
    b = protocol.Budget(outer=120, inner_label=15, inner_order=15)
    hashed = protocol.null_statistics(t, cands, b, 0.4, 0.6).toPandas()

    def never(*args):
        raise AssertionError("cases are hashed")

    monkeypatch.setattr(protocol, "hashed", never)
    got = protocol.null_statistics(t, cands, b, 0.4, 0.6, counted=True).toPandas()
    order = list(got.columns[:4])
    again = protocol.null_statistics(t.repartition(3), cands, b, 0.4, 0.6, counted=True).toPandas()
    assert got.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    assert len(got) == len(hashed)
    for c in ("p_label", "p_order", "t"):
        one, two = (d.groupby(["ctype", "a", d["b"].fillna("")])[c].agg(["mean", "var"]) for d in (hashed, got))
        z = (one["mean"] - two["mean"]) / np.sqrt((one["var"] + two["var"]) / b.outer)
        assert z.abs().max() < 4.5 and abs(z.mean()) < 1 and 0.6 < np.sqrt((z**2).mean()) < 1.5
