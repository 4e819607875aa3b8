"""Steps that several parts of a query share are taken once."""

import pytest

from tracegauge.operators import measures, mining
from tracegauge.plans import catalog, logs


@pytest.fixture
def counted(monkeypatch):
    calls = []
    for name in ("pattern_sums", "holds"):
        own = getattr(measures, name)
        monkeypatch.setattr(measures, name, lambda *a, _own=own, _name=name, **k: calls.append(_name) or _own(*a, **k))
    return calls


def test_both_classes_in_one_pass(spark, counted):
    pos, neg = catalog._two_specs(spark, "/root/testdata/sf0.001")
    assert counted == ["pattern_sums"] and pos.count() and neg.count()
    assert "Generate" not in pos._jdf.queryExecution().toString()


def test_holds_of_conditional_constraints_are_taken_once(spark, counted):
    t = logs.users(spark, "/root/testdata/sf0.001")
    rows = mining.conditional_templates(t, catalog._cands(t), catalog._user_data(spark, "/root/testdata/sf0.001"))
    assert counted == ["holds"] and not rows.isEmpty()
    assert "Generate" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_features_of_rules_are_encoded_once(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(v):
        seen.add(1)
        return v

    t = spark.createDataFrame([(f"c{i}", i % 2, ["a", "b"]) for i in range(40)], "case_id string, outcome int, trace array<string>")
    features = spark.createDataFrame([(f"c{i}", i % 2, "f", float(1 + i % 2)) for i in range(40)], "case_id string, outcome int, feature string, value double")
    assert mining.mined_rules(features.withColumn("value", value.asNondeterministic()("value")), t).count()
    assert seen.value == 40
