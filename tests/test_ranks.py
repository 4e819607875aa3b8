"""Ranks, running sums and running minima over many partitions against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracegauge.operators import significance
from tracegauge.operators.ranks import Ordered


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    return [(i, r.choice([0.1, 0.2, round(r.random(), 3), None]), r.randrange(-5, 5)) for i in range(700)]


def _table(spark, rows):
    return spark.createDataFrame(rows, "id int, p double, v int").repartition(13)


@pytest.fixture
def many_parts(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_ranks_sums_and_minima(spark, rows, many_parts):
    placed = Ordered(_table(spark, rows), F.asc_nulls_first("p"), "id").with_sum(F.col("v"), "total").with_least_from(F.col("v") + 0.5, "least")
    want, total = [], 0
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    for i, (k, _, v) in enumerate(order):
        total += v
        want.append((k, i + 1, total, min(x[2] for x in order[i:]) + 0.5))
    assert placed.rows.select("part").distinct().count() > 3 and placed.count == len(rows)
    assert sorted((r["id"], r["rank"], r["total"], r["least"]) for r in placed.rows.collect()) == sorted(want)


def test_step_up_and_q_values(spark, rows, many_parts):
    tested = [(k, p / 20 if k % 3 else p, v) for k, p, v in rows if p is not None]
    df, order = _table(spark, tested), sorted(tested, key=lambda r: (r[1], r[0]))
    m = len(order)
    last = max((i + 1 for i, r in enumerate(order) if r[1] <= (i + 1) * 0.05 / m), default=0)
    assert 0 < last < m
    assert {r["id"] for r in significance.step_up(df, "p", ["id"]).where("reject").collect()} == {r[0] for r in order[:last]}
    q = {r["id"]: r["q"] for r in significance.q_values(df, "p", ["id"], 0.7).collect()}
    assert q == pytest.approx({r[0]: min(1.0, min(0.7 * m * x[1] / (j + 1) for j, x in enumerate(order) if j >= i)) for i, r in enumerate(order)})


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id int, p double")
    assert significance.step_up(empty, "p", ["id"]).count() == 0 and significance.q_values(empty, "p", ["id"]).count() == 0


@pytest.mark.parametrize("outcomes", [[0] * 9, [1] * 9, [1, 0, None] * 40, []])
def test_permuted_labels_by_parts(spark, outcomes):
    from tracegauge.operators import resampling

    rows = [("k", f"c{i // 2}" if i < 4 else f"c{i}", o) for i, o in enumerate(outcomes)]  # two cases are there twice
    got = resampling.permuted_labels(spark.createDataFrame(rows, "key string, case_id string, outcome int"), 3, 7, ["key"]).collect()
    assert len(got) == 3 * len(outcomes)
    for rep in range(3):
        drawn = sorted((hashlib.md5(f"7|k|{rep}|{c}".encode()).hexdigest(), c) for _, c, _ in rows)
        want = sorted((c, int(i < sum(o or 0 for o in outcomes))) for i, (_, c) in enumerate(drawn))
        assert sorted((r["case_id"], r["label"]) for r in got if r["rep"] == rep) == want
