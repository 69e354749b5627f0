from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.operators import features as X
from tablewright.operators import models as M
from tablewright.operators.evaluation import eval_classification, eval_regression
from tablewright.plans import prediction as P


def test_label_codes_follow_sorted_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("b",), (None,)], "t string")
    assert [r["label"] for r in X.label_encode(df, "t").orderBy("t").collect()] == [None, 0, 1, 1, 2]


def test_numeric_targets_stay(spark):
    df = spark.createDataFrame([(7,), (3,)], "t int")
    assert [r["label"] for r in X.label_encode(df, "t").collect()] == [7, 3]


def test_feature_types(spark, tables):
    kinds = X.feature_types(tables("events"))
    assert kinds == X.FeatureTypes(["event_id", "user_id", "value"], ["event_type", "props"], ["ts"])


def test_median_and_scale_forms(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    filled = X.impute_median(df, ["x"])
    assert [r["x"] for r in filled.collect()][-1] == 2.5
    scaled = [r["x"] for r in X.standard_scale(df.dropna(), ["x"]).collect()]
    assert scaled[0] == pytest.approx(-1.5 / np.std([1, 2, 3, 4]))
    constant = spark.createDataFrame([(5,), (5,)], "x int")
    assert [r["x"] for r in X.standard_scale(constant, ["x"]).collect()] == [0.0, 0.0]


def test_median_of_nothing_is_an_error(spark):
    with pytest.raises(ValueError, match="no median"):
        X.impute_median(spark.createDataFrame([(None,)], "x double"), ["x"])


def test_one_hot_rows_and_unseen_categories(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert [tuple(r) for r in X.one_hot(df, ["c"]).collect()] == [(1, 0), (0, 1), (0, 0)]
    unseen = X.one_hot(spark.createDataFrame([("z",)], "c string"), ["c"], {"c": ["a", "b"]})
    assert tuple(unseen.first()) == (0, 0)


def test_feature_vector(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, None), (2.0, "it's")], "x double, c string")
    fitted = X.fit_features(train)
    rows = spark.createDataFrame([(2.0, "b"), (None, None), (2.0, "unseen")], "x double, c string")
    got = [r[0] for r in fitted.transform(rows).select(vector_to_array("features")).collect()]
    # categories in order: a, b, it's, missing
    assert got == [[0, 0, 1, 0, 0], [0, 0, 0, 0, 1], [0, 0, 0, 0, 0]]


def test_features_need_a_number_or_a_text(spark):
    with pytest.raises(ValueError, match="no numeric or text"):
        X.fit_features(spark.createDataFrame([(True,)], "f boolean"))


@pytest.mark.parametrize(
    ("rows", "classifier", "regressor"),
    [
        (1000, "LinearSVC", "LinearRegression"),
        (1001, "RandomForestClassifier", "RandomForestRegressor"),
        (10000, "RandomForestClassifier", "RandomForestRegressor"),
        (10001, "GBTClassifier", "GBTRegressor"),
    ],
)
def test_tiers(spark, rows, classifier, regressor):
    assert type(M.select_model("classification", rows)).__name__ == classifier
    assert type(M.select_model("regression", rows)).__name__ == regressor


def test_many_classes_are_split_one_against_the_rest(spark):
    assert type(M.select_model("classification", 10, 3)).__name__ == "OneVsRest"
    assert type(M.select_model("classification", 5000, 3)).__name__ == "RandomForestClassifier"


def test_unknown_task(spark):
    with pytest.raises(ValueError, match="unknown task"):
        M.select_model("clustering", 10)


def test_split_is_disjoint_complete_and_repeatable(tables):
    lines = tables("lineitem")
    train, test = M.train_test_split(lines)
    assert train.count() + test.count() == lines.count()
    assert train.intersect(test).isEmpty()
    again = M.train_test_split(lines.repartition(5))[1]
    assert test.exceptAll(again).isEmpty() and again.exceptAll(test).isEmpty()
    assert test.count() == math.ceil(0.2 * lines.count())


def test_classification_report_by_hand(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] * 1 + [("b", "b")] * 2 + [("b", "a")] * 2 + [("c", "a")] * 2
    got = {r["class"]: r for r in eval_classification(spark.createDataFrame(rows, "label string, prediction string")).collect()}
    assert got["a"]["precision"] == pytest.approx(3 / 7) and got["a"]["recall"] == 0.75
    assert got["b"]["f1"] == pytest.approx(2 * (2 / 3) * 0.5 / (2 / 3 + 0.5))
    assert (got["c"]["precision"], got["c"]["recall"], got["c"]["f1"], got["c"]["support"]) == (0, 0, 0, 2)
    assert got["accuracy"]["f1"] == 0.5
    assert got["macro avg"]["recall"] == pytest.approx((0.75 + 0.5 + 0) / 3)
    assert got["weighted avg"]["recall"] == pytest.approx((0.75 * 4 + 0.5 * 4) / 10)


def test_regression_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0)], "label double, prediction double")
    r = eval_regression(df).first()
    assert (r["mae"], r["mse"], r["r2"], r["n"]) == pytest.approx((1.0, 5 / 3, 1 - 5 / 8, 3))
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "label double, prediction double")
    assert eval_regression(flat).first()["r2"] is None


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(size=n)
    c = rng.choice(["u", "v"], n)
    y = 3 * x + np.where(c == "u", 10.0, 0.0)
    kind = np.where(y > 8, "high", np.where(y > 2, "mid", "low"))
    return spark.createDataFrame(pd.DataFrame({"x": x, "c": c, "y": y, "kind": kind}))


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


def test_regression_end_to_end(spark, learnable):
    done = P.prediction(learnable.drop("kind"), "y", "regression", lines(spark, "1.0,u", " 0 ,v", ",unseen"))
    assert done.mapping is None
    assert done.metrics.first()["r2"] > 0.99
    got = done.predictions.collect()
    assert [r["rounded"] for r in got[:2]] == [13, 0]
    assert all(r["rounded"] == np.round(r["raw"]) for r in got)


def test_columns_that_are_no_features_have_no_field(spark, learnable):
    table = learnable.select(F.array("x").alias("xs"), "x", F.lit(True).alias("flag"), "c", "y")
    predictor, _ = P.fit_predict(table, "y", "regression")
    got = P.predict_rows(predictor, lines(spark, "1.0,u")).first()
    assert (got["rounded"], got["error"]) == (13, None)


def test_classification_end_to_end(spark, learnable):
    table = learnable.drop("y").filter("kind <> 'mid'")
    done = P.prediction(table, "kind", "classification", lines(spark, "2.0,u", "-2.0,v"))
    assert [r["decoded"] for r in done.predictions.collect()] == ["high", "low"]
    assert [tuple(r) for r in done.mapping.collect()] == [("high", 0), ("low", 1)]
    scores = {r["class"]: r["f1"] for r in done.metrics.collect()}
    assert scores["accuracy"] > 0.85 and {"high", "low", "macro avg", "weighted avg"} <= scores.keys()


@pytest.mark.parametrize("tier", ["middle", "large"])
def test_larger_tiers(spark, learnable, monkeypatch, tier):
    monkeypatch.setattr(M, "SMALL_ROWS", 10)
    monkeypatch.setattr(M, "MIDDLE_ROWS", 10_000 if tier == "middle" else 20)
    monkeypatch.setattr(M, "FOREST", {"numTrees": 5, "maxDepth": 5, "seed": 1})
    monkeypatch.setattr(M, "BOOSTING", {"maxIter": 3, "maxDepth": 3, "stepSize": 0.3, "seed": 1})
    predictor, scored = P.fit_predict(learnable.drop("y"), "kind", "classification")
    scores = {r["class"]: r["f1"] for r in P.evaluate(predictor, scored).collect()}
    assert {"high", "mid", "low"} <= scores.keys() and scores["accuracy"] > 0.7
    predictor, scored = P.fit_predict(learnable.drop("kind"), "y", "regression")
    assert P.evaluate(predictor, scored).first()["r2"] > 0.5


def test_numeric_classes_keep_their_names(spark):
    df = spark.range(200).select(F.col("id").alias("x"), F.when(F.col("id") < 100, 7).otherwise(42).alias("t"))
    done = P.prediction(df, "t", "classification", lines(spark, "0", "199"))
    assert [r["decoded"] for r in done.predictions.collect()] == [7, 42]


def test_features_may_have_the_names_a_model_uses(spark, learnable):
    table = learnable.select(F.col("x").alias("label"), F.col("c").alias("features"), F.col("y").alias("raw.y"))
    predictor, scored = P.fit_predict(table, "raw.y", "regression")
    assert P.evaluate(predictor, scored).first()["r2"] > 0.99
    assert predictor.score(table).columns == ["label", "features", "raw.y", "prediction"]
    with pytest.raises(ValueError, match="already have"):
        predictor.score(table.withColumnRenamed("raw.y", "prediction"))


def test_text_target_of_a_regression_is_encoded(spark, learnable):
    predictor, scored = P.fit_predict(learnable.drop("y"), "kind", "regression")
    assert P.evaluate(predictor, scored).first()["n"] == scored.count()
    assert P.label_mapping(predictor).count() == 3


def test_half_is_rounded_to_even(spark):
    values = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in values.select(F.bround("x", 0).cast("bigint")).collect()] == [0, 2, 2, 0]


def test_bad_input_is_refused(spark, learnable):
    predictor, _ = P.fit_predict(learnable.drop("kind"), "y", "regression")
    got = P.predict_rows(predictor, lines(spark, "1,u,extra", "abc,u", None, "1.0,u")).collect()
    assert [r["raw"] is None for r in got] == [True, True, True, False]
    assert "expected 2 fields" in got[0]["error"] and "expected 2 fields" in got[2]["error"]
    assert got[1]["error"] == "x: not a number: abc" and got[3]["error"] is None
    with pytest.raises(ValueError, match="unknown task"):
        P.fit_predict(learnable, "y", "clustering")
    with pytest.raises(ValueError, match="classes"):
        P.fit_predict(learnable.withColumn("y", F.lit(1)), "y", "classification")
    with pytest.raises(ValueError, match="missing values"):
        P.fit_predict(learnable.withColumn("y", F.nullif("y", "y")), "y", "regression")
    with pytest.raises(ValueError, match="unknown column"):
        X.split_xy(learnable, "nope")


def test_regression_metrics_predict_each_row_once(spark):
    rows = [(1.0, 2.0), (2.0, None), (None, 3.0), (3.0, float("nan")), (float("nan"), 1.0), (4.0, 4.5), (5.5, 5.0)]
    same = F.arrow_udf(lambda x: x, "double")
    pairs = spark.createDataFrame(rows, "label double, prediction double").withColumn("prediction", same("prediction"))
    found = eval_regression(pairs)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    r = found.first()
    assert (r.n, round(r.mae, 6), r.mse, round(r.r2, 6)) == (3, 0.666667, 0.5, 0.857143)
