"""Constraints of null logs as bits, against the holds of single logs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegauge.functions import templates as tp
from tracegauge.operators import measures, mining, resampling, signs
from tracegauge.operators.statistics import alphabet

SCHEMA = "case_id string, outcome int, trace array<string>"


def log(spark, n):
    r = random.Random(n)
    rows = [(f"c{i}", int(r.random() < 0.4), [r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.choice([1, 2, 5, 62, 63, 70]))]) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_class_sums_are_those_of_single_logs(spark):
    t = log(spark, 60)
    cands = measures.candidates(alphabet(t), tp.BINARY)
    found = signs.ordered(cands)
    assert {c[0] for c in found} == {*tp.TRACE_BINARY, *tp.UNARY}
    bits = signs.null_bits(t, found, 3, 42)
    got = {(r["rep"], r["f"]): tuple(r)[3:] for r in signs.class_sums(bits, len(found), signs.Nodes(4, 1), 0).collect()}
    logs = resampling.double_null(t, 3).unionByName(t.select(F.lit(3).alias("rep"), "case_id", "outcome", "trace"))
    held = measures.holds(logs.localCheckpoint(), cands, ["rep", "case_id", "outcome"])
    count = lambda k, s: F.count_if((F.col("outcome") == k) & (F.col("sat") >= s))
    want = {tuple(r)[:4]: tuple(r)[4:] for r in held.groupBy("rep", "ctype", "a", "b").agg(count(0, 0), count(1, 0), count(0, 1), count(1, 1)).collect()}
    assert {k: got[k[0], found.index(k[1:])] for k in want} == want
    assert not any(any(got[rep, f]) for rep in range(4) for f, c in enumerate(found) if (rep, *c) not in want)
    positive = t.where("outcome = 1").count()
    assert [got[rep, -1][:2] for rep in range(4)] == [(60 - positive, positive)] * 4


def test_nodes_follow_signs():
    nodes = signs.Nodes(2, 2)
    nodes.feature[1, 1], nodes.threshold[1, 1] = 0, 0.0
    nodes.feature[1, 3], nodes.threshold[1, 3] = 2, -0.5
    sat, app = np.array([[0, 0, 0], [1, 0, 0], [1, 0, 1]], np.uint8), np.array([1, 0, 1], np.uint8)
    assert nodes.of(1, sat, app, 1).tolist() == [2, 3, 3] and nodes.of(1, sat, app, 2).tolist() == [0, 6, 7]
    assert nodes.of(1, sat, np.array([1, 0, 0], np.uint8) & 1, 2).tolist()[:2] == [0, 7] and nodes.of(0, sat, app, 1).tolist() == [0, 0, 0]


class _Called(Exception):
    pass


def test_constraints_of_null_logs_are_no_rows(spark, monkeypatch):
    """Rows of constraints are made for sets of activities, not for the cases of every null log."""
    t = log(spark, 60)

    def stop(traces, *args, **named):
        raise _Called(traces.count())

    monkeypatch.setattr(mining, "constraint_features", stop)
    with pytest.raises(_Called) as called:
        mining.null_mining_counts(t, measures.candidates(alphabet(t)), 3, 2, 2)
    assert called.value.args[0] == len({frozenset(r["trace"]) for r in t.collect()})
