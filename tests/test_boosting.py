from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor

from tablewright.operators import boosting as B
from tablewright.operators import models as M
from tablewright.plans import prediction as P

TREES = {"maxIter": 4, "maxDepth": 4, "stepSize": 0.3, "seed": 1}


@pytest.fixture(scope="module")
def ready(spark):
    """Three features: few values, over 32 values with ties, and a rare flag; every row twice."""
    rng = np.random.default_rng(3)
    n = 1500
    x = pd.DataFrame({"a": rng.integers(0, 6, n), "b": np.round(rng.normal(size=n), 1), "c": (rng.random(n) < 0.003).astype(float)})
    x["y"] = 2.0 * x.a + np.where(x.b > 0.3, 5, 0) + 9 * x.c + rng.normal(size=n)
    x["kind"] = np.digitize(x.y, [4, 10]).astype(float)
    rows = spark.createDataFrame(pd.concat([x, x]))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)


@pytest.mark.parametrize("estimator", [GBTRegressor, GBTClassifier, OneVsRest])
def test_grouped_rows_give_the_same_trees(ready, monkeypatch, estimator):
    if estimator is GBTRegressor:
        trees, rows = GBTRegressor(**TREES), ready.withColumnRenamed("y", "label")
    elif estimator is GBTClassifier:
        trees, rows = GBTClassifier(**TREES), ready.selectExpr("features", "double(kind > 1) AS label")
    else:
        trees, rows = OneVsRest(classifier=GBTClassifier(**TREES)), ready.withColumnRenamed("kind", "label")
    rows = rows.select("features", "label").cache()
    whole = B.fit(trees, rows, 3000)
    monkeypatch.setattr(B, "DIRECT_ROWS", 0)
    grouped = B.fit(trees, rows, 3000)
    assert isinstance(grouped, B.BinnedModel) and not isinstance(whole, B.BinnedModel)
    column = "prediction" if estimator is GBTRegressor else "rawPrediction"
    one, two = (np.array([np.ravel(r[0]) for r in m.transform(rows).select(column).collect()]) for m in (whole, grouped))
    assert np.allclose(one, two) and len(np.unique(one)) > 10


def test_borders():
    assert B.borders(np.array([3.0, 1, 1, 2, np.nan])).tolist() == [1.5, 2.5]
    assert B.borders(np.array([7.0, 7])).tolist() == []
    assert B.borders(np.arange(8.0), bins=4).tolist() == [1.5, 3.5, 5.5]
    assert B.borders(np.array([-np.inf, np.inf])).tolist() == []


@pytest.mark.parametrize("target", ["y", "kind"])
def test_large_tables_are_learned_by_groups(spark, monkeypatch, target):
    """6 kinds of rows, however many: the trees read at most 6 of each class."""
    monkeypatch.setattr(M, "MIDDLE_ROWS", 20)
    monkeypatch.setattr(M, "SMALL_ROWS", 10)
    monkeypatch.setattr(M, "BOOSTING", TREES)
    monkeypatch.setattr(B, "DIRECT_ROWS", 1000)
    read, fit = [], Estimator.fit

    def watched(self, dataset, *args):
        if isinstance(self, (GBTClassifier, GBTRegressor)):
            read.append(dataset.count())
        return fit(self, dataset, *args)

    monkeypatch.setattr(Estimator, "fit", watched)
    rows = spark.range(3000).selectExpr("id % 3 AS a", "string(id % 2) AS b", "double(id % 6) + 1 AS y", "string(id % 6 > 2) AS kind", "timestamp_seconds(id) AS at")
    other = "kind" if target == "y" else "y"
    task = "regression" if target == "y" else "classification"
    predictor, scored = P.fit_predict(rows.drop(other), target, task)
    metrics = P.evaluate(predictor, scored)
    assert read and max(read) <= 6
    score = metrics.first()["r2"] if target == "y" else metrics.filter("class = 'accuracy'").first()["f1"]
    assert score > 0.6
