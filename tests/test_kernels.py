"""The radial basis classifier and its probabilities."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablewright.operators import kernels as K
from tablewright.operators import models as M
from tablewright.plans import prediction as P


@pytest.fixture(scope="module")
def rings(spark):
    rng = np.random.default_rng(4)
    n = 500
    angle, far = rng.uniform(0, 2 * np.pi, n), rng.random(n) < 0.5
    radius = np.where(far, 3.0, 1.0) + rng.normal(scale=0.25, size=n)
    return spark.createDataFrame(pd.DataFrame({"x": radius * np.cos(angle), "y": radius * np.sin(angle), "ring": np.where(far, "outer", "inner")}))


def test_features_meet_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    w, p = K.draw(5, 0.3, 20_000)
    z = np.sqrt(2 / 20_000) * np.cos(x @ w + p)
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert abs(z @ z.T - want).max() < 0.05


def test_gamma_follows_the_spread(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 4)) * [1, 5, 0.1, 2] + [0, 3, 9, -4]
    df = spark.createDataFrame([(Vectors.dense(r),) for r in m], ["v"])
    assert K.scale_gamma(df, "v") == pytest.approx(1 / (4 * m.var()))
    assert K.scale_gamma(spark.createDataFrame([(Vectors.dense([2.0, 2.0]),)] * 3, ["v"]), "v") == 1.0


def test_features_are_repeatable_and_take_sparse_vectors(spark):
    df = spark.createDataFrame([(Vectors.sparse(3, {1: 2.0}),), (Vectors.dense([0.0, 2.0, 0.0]),)], ["v"])
    got = [r[0] for r in K.fourier_features(df, "v", gamma=1.0, features=8).transform(df).select(vector_to_array("v")).collect()]
    assert got[0] == got[1] and len(got[0]) == 8


def test_two_rings_are_learned(rings):
    predictor, scored = P.fit_predict(rings, "ring", "classification")
    accuracy = {r["class"]: r["f1"] for r in P.evaluate(predictor, scored).collect()}["accuracy"]
    assert accuracy > 0.97
    linear = {r["class"]: r["f1"] for r in P.evaluate(*P.fit_predict(rings, "ring", "classification", kernel="linear")).collect()}["accuracy"]
    assert linear < 0.8


def test_probabilities_add_up_and_name_the_classes(rings):
    predictor, _ = P.fit_predict(rings, "ring", "classification")
    rows = P.probabilities(predictor, rings).collect()
    assert all(sum(p["probability"] for p in r["probabilities"]) == pytest.approx(1) for r in rows)
    assert np.mean([r["probabilities"][0]["class"] == r["ring"] for r in rows]) > 0.97
    assert {p["class"] for p in rows[0]["probabilities"]} == {"inner", "outer"}
    with pytest.raises(ValueError, match="only a classifier"):
        P.probabilities(P.fit_predict(rings.drop("ring"), "y", "regression")[0], rings)


def test_calibration_by_hand_counts(spark):
    """Scores whose true chance is known: in each band, the mean probability is the share of the class."""
    rng = np.random.default_rng(7)
    score = rng.normal(scale=2, size=6000)
    label = (rng.random(6000) < 1 / (1 + np.exp(-(0.8 * score - 0.5)))).astype(float)
    rows = spark.createDataFrame(pd.DataFrame({"s": score, "label": label})).select(array_to_vector(F.array(-F.col("s"), "s")).alias("raw"), "label")
    fitted = K.platt(rows, 2)
    a, b = fitted.lines[1]
    assert a == pytest.approx(0.8, abs=0.08) and b == pytest.approx(-0.5, abs=0.1)
    got = rows.select(fitted.probabilities(F.col("raw"))[1].alias("p"), "label").toPandas()
    for lo in np.arange(0, 1, 0.2):
        band = got[(got.p >= lo) & (got.p < lo + 0.2)]
        assert band.p.mean() == pytest.approx(band.label.mean(), abs=0.05)


def test_many_classes_have_probabilities(spark):
    rng = np.random.default_rng(9)
    kind = rng.integers(0, 3, 240)
    df = spark.createDataFrame(pd.DataFrame({"x": kind * 4.0 + rng.normal(size=240), "kind": [["a", "b", "c"][k] for k in kind]}))
    predictor, _ = P.fit_predict(df, "kind", "classification")
    rows = P.probabilities(predictor, df).collect()
    assert np.mean([r["probabilities"][0]["class"] == r["kind"] for r in rows]) > 0.9
    assert all(len(r["probabilities"]) == 3 and sum(p["probability"] for p in r["probabilities"]) == pytest.approx(1) for r in rows)


def test_the_caller_names_the_model(rings):
    assert [M.tier_rows(50_000, m) for m in (None, "small", "middle", "large")] == [50_000, 1_000, 10_000, 50_000]
    assert [M.tier_rows(5, m) for m in (None, "small", "middle", "large")] == [5, 5, 1_001, 10_001]
    predictor, _ = P.fit_predict(rings.drop("ring"), "x", "regression", model="small")
    assert type(predictor.model).__name__ == "LinearRegressionModel"
    for wrong in ({"model": "huge"}, {"kernel": "cubic"}):
        with pytest.raises(ValueError, match="unknown"):
            P.fit_predict(rings, "ring", "classification", **wrong)
