"""Categories whose index is joined: same vectors as the listed ones, hot values, many values, plans."""

from __future__ import annotations

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.operators import categories as C
from tablewright.operators import features as X
from tablewright.plans import prediction as P


def rows(spark, n=400):
    data = [(float(i % 7) if i % 5 else None, "hot" if i % 3 else f"it's {i % 40}", [None, "a b", "b", "é"][i % 4], i) for i in range(n)]
    return spark.createDataFrame(data, "x double, `a.1` string, b string, id long")


def dense(df, out):
    return {r["id"]: list(r["v"]) for r in df.select("id", vector_to_array(out).alias("v")).collect()}


def test_joined_features_equal_the_listed_ones(spark, monkeypatch):
    train = rows(spark).filter("id < 300")
    tested = rows(spark).unionByName(spark.createDataFrame([(2.0, "unseen", None, 1000)], train.schema))
    listed = X.fit_features(train, "v").transform(tested)
    monkeypatch.setattr(X, "MODEL_CATEGORIES", 2)
    fitted = X.fit_features(train, "v")
    assert isinstance(fitted.stages[-1], C.JoinedCategories)
    joined = fitted.transform(tested)
    assert dense(listed, "v") == dense(joined, "v") and joined.count() == 401
    monkeypatch.setattr(fitted.stages[-1], "listed_values", 1)
    assert dense(fitted.transform(tested), "v") == dense(listed, "v")


def test_an_empty_text_is_a_category(spark):
    df = spark.createDataFrame([(1, ""), (2, "a"), (3, None), (4, "")], "id long, t string")
    got = dense(X.fit_features(df.drop("id"), "v").transform(df), "v")
    assert got == {1: [1, 0, 0], 2: [0, 1, 0], 3: [0, 0, 1], 4: [1, 0, 0]}


def test_long_texts_are_not_held_by_the_driver(spark, monkeypatch):
    monkeypatch.setattr(X, "MODEL_CATEGORY_BYTES", 1000)
    df = spark.createDataFrame([(i, "x" * 2000 + str(i % 3)) for i in range(6)], "id long, t string")
    fitted = X.fit_features(df.drop("id"), "v")
    assert isinstance(fitted.stages[-1], C.JoinedCategories)
    assert dense(fitted.transform(df), "v") == {i: [float(i % 3 == k) for k in range(3)] for i in range(6)}


def test_hot_values_are_broadcast_and_the_rest_shuffled(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_SHARE", 10)
    df = rows(spark)
    fitted = C.fit_categories(df, "a.1")
    values = sorted({r[0] for r in df.select("`a.1`").collect()})
    assert fitted.size == len(values)
    assert {(r["code"], r["hot"]) for r in fitted.codes.collect()} == {(i, v == "hot") for i, v in enumerate(values)}
    unseen = spark.createDataFrame([(1.0, "new", "b", 5000), (1.0, None, "b", 5001)], df.schema)
    coded = C.with_category_code(df.unionByName(unseen), "a.1", fitted, "code", listed_values=1)
    got = coded.collect()
    assert coded.columns == [*df.columns, "code"] and len(got) == 402
    assert all(r["code"] == (values.index(r["a.1"]) if r["id"] < 5000 else None) for r in got)
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 1
    physical = coded._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in physical and "Cartesian" not in physical and "NestedLoop" not in physical


def test_no_rows_and_only_nulls(spark):
    empty = spark.createDataFrame([], "id long, t string")
    assert C.encode_categories(empty, ["t"], "v").count() == 0
    nulls = spark.createDataFrame([(1, None), (2, None)], "id long, t string")
    assert dense(C.encode_categories(nulls, ["t"], "v"), "v") == {1: [], 2: []}
    both = spark.createDataFrame([(1, "b", "x"), (2, "a", None), (2, "a", None)], "id long, t string, categories string")
    got = C.encode_categories(both, ["t", "categories"], "v").select("id", vector_to_array("v").alias("v")).collect()
    assert sorted((r["id"], list(r["v"])) for r in got) == [(1, [0, 1, 1]), (2, [1, 0, 0]), (2, [1, 0, 0])]
    with pytest.raises(ValueError, match="at most"):
        C.sparse_vector([], 2**31)


def test_a_million_categories(spark):
    df = spark.range(1_000_000).select("id", F.format_string("%07d", "id").alias("t"), (F.col("id") % 10).cast("double").alias("x"))
    fitted = X.fit_features(df.drop("id"), "v")
    # Exactly as many places as values, and each value at its own.
    parts = fitted.transform(df).select("id", C.sparse_parts(F.col("v")).alias("p"))
    wrong = parts.filter((F.col("p.size") != 1_000_001) | (F.element_at("p.indices", -1) != F.col("id") + 1) | (F.element_at("p.values", -1) != 1.0))
    assert parts.count() == 1_000_000 and wrong.count() == 0


def test_a_model_learns_from_joined_categories(spark, monkeypatch):
    monkeypatch.setattr(X, "MODEL_CATEGORIES", 3)
    df = spark.range(600).select((F.col("id") % 3).alias("n"), F.concat(F.lit("k"), (F.col("id") % 8).cast("string")).alias("k"), ((F.col("id") % 8) * 10.0).alias("y"))
    predictor, scored = P.fit_predict(df, "y", "regression", model="small")
    assert scored.filter(F.abs(F.col("prediction") - F.col("label")) > 0.5).count() == 0
    lines = spark.createDataFrame([("1,k3",), ("1,",), ("2,unseen",)], "line string")
    got = P.predict_rows(predictor, lines).collect()
    assert got[0]["rounded"] == 30 and all(r["raw"] is not None for r in got)
