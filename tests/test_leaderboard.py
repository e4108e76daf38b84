"""The leaderboard's scores are found once, and its folds are fitted side by side with the same results."""

import threading
import time

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler

from adsentry.operators import models as M


def table(spark, n=300):
    x = np.random.default_rng(8).standard_normal((n, 2))
    return spark.createDataFrame([(i, int(a + b > 0.3), float(a), float(b)) for i, (a, b) in enumerate(x)], "doc_id long, label int, a double, b double")


def test_scores_are_read_not_found_again(spark):
    found = M.leaderboard(table(spark), ["a", "b"], "doc_id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "probability" not in plan
    rows = found.collect()
    assert len(rows) == 5 and {r.n for r in rows} == {300} and [r.auc for r in rows] == sorted((r.auc for r in rows), reverse=True)


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(table(spark)).select("doc_id", "label", "features")
    rows = M.stratified_folds(rows, "doc_id", 3).localCheckpoint()
    running, most, lock, fit = [0], [0], threading.Lock(), LogisticRegression.fit

    def counted(self, *given):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.5)
        try:
            return fit(self, *given)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(LogisticRegression, "fit", counted)
    got = {r.doc_id: r.score for r in M.out_of_fold(LogisticRegression(), rows, 3).collect()}
    assert 1 < most[0] <= M.AT_ONCE
    monkeypatch.setattr(M, "AT_ONCE", 1)
    assert got == {r.doc_id: r.score for r in M.out_of_fold(LogisticRegression(), rows, 3).collect()} and len(got) == 300
