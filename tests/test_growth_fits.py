"""Trees of folds are fitted by as many tasks as their cases ask for."""

import random

from tracegauge.operators import mining


def test_few_cases_are_fitted_by_one_task(spark, monkeypatch):
    from pyspark.ml.classification import DecisionTreeClassifier

    r, seen, own = random.Random(4), [], DecisionTreeClassifier.fit
    log = [(f"c{i}", i % 2, [r.choice("abc") for _ in range(r.randint(1, 6))]) for i in range(60)]
    t = spark.createDataFrame(log, "case_id string, outcome int, trace array<string>")
    monkeypatch.setattr(DecisionTreeClassifier, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or own(self, df))
    whole = mining.cross_validate(mining.activity_counts(t), t, ["a", "b", "c"], k=2, depths=(1, 2)).collect()
    assert seen == [1] * 4
    monkeypatch.setattr(mining, "FITTED_CASES", 20)
    assert mining.cross_validate(mining.activity_counts(t), t, ["a", "b", "c"], k=2, depths=(1, 2)).collect() == whole and seen[4:] == [3] * 4
