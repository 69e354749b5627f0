"""Exact quantiles against pandas, on both sides of the size limit."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions import quantiles as Q
from tablewright.functions.ranking import sorted_codes
from tablewright.operators.cleaning import fit_outliers

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]


def shapes() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    hot = rng.normal(size=3000)
    hot[:1000] = 0.25  # one value holds a third of the rows
    return {
        "normal": rng.normal(size=3001),
        "hot": hot,
        "heavy": rng.pareto(0.3, size=2500),
        "few": rng.integers(0, 3, size=2000).astype(float),
        "constant": np.full(1500, 7.5),
        "negative": -np.arange(2000.0),
        "infinite": np.concatenate([rng.normal(size=1500), [np.inf] * 40, [-np.inf] * 40]),
        "tiny": np.array([3.0]),
    }


@pytest.mark.parametrize("limit", [10_000, 20])
@pytest.mark.parametrize("name", list(shapes()))
def test_matches_pandas(spark, name, limit):
    x = shapes()[name]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(4)
    got = Q.exact_quantiles(df, {"x": PROBABILITIES}, direct_rows=limit)["x"]
    at = np.sort(x)
    for p, value in zip(PROBABILITIES, got, strict=True):
        position = (len(x) - 1) * p
        low, high = at[int(np.floor(position))], at[int(np.ceil(position))]
        if np.isfinite(low) and np.isfinite(high):
            assert value == pytest.approx(low + (high - low) * (position - np.floor(position)), rel=1e-9, abs=1e-12)
        elif low == high:
            assert value == low


def test_missing_values_do_not_count(spark):
    rows = [(float(i),) for i in range(200)] + [(None,)] * 50 + [(float("nan"),)] * 50
    df = spark.createDataFrame(rows, "x double")
    for limit in (10_000, 10):
        assert Q.exact_quantiles(df, {"x": [0.5]}, direct_rows=limit)["x"] == [99.5]


def test_empty_column_has_no_quantile(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert Q.exact_quantiles(df, {"x": [0.25, 0.5]})["x"] == [None, None]


def test_whole_numbers_and_names_with_dots(spark):
    df = spark.range(1001).select(F.col("id").alias("a.b"), (F.col("id") % 10).cast("int").alias("Unnamed: 4"))
    got = Q.exact_quantiles(df, {"a.b": [0.25], "Unnamed: 4": [0.5]}, direct_rows=15)
    assert got == {"a.b": [250.0], "Unnamed: 4": [4.0]}


def test_wrong_guesses_cost_a_round_but_no_correctness(spark):
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"))
    guesses = [Q.Guess("x", 0.5, 4000.0, 4100.0), Q.Guess("x", 0.25, -5.0, -4.0)]
    counts = df.agg(*[F.expr(f"count_if({t})") for g in guesses for t in g.tests()]).first()
    counted = [(g, counts[4 * i : 4 * i + 4]) for i, g in enumerate(guesses)]
    got = Q.exact_quantiles(df, {"x": [0.25, 0.5]}, {"x": 5000}, direct_rows=50, counted=counted)
    assert got["x"] == [1249.75, 2499.5]


@pytest.mark.parametrize(("listed", "broadcast", "p"), [(50, 0, 0.5), (5, 100_000, 0.3), (5, 2, 0.5), (5, 2, 0.3)])
def test_groups_with_a_hot_one(spark, monkeypatch, listed, broadcast, p):
    monkeypatch.setattr(Q, "LISTED_GROUPS", listed)
    monkeypatch.setattr(Q, "BROADCAST_GROUPS", broadcast)
    monkeypatch.setattr(Q, "HOT_GROUPS", 10)  # only the hot group has over a tenth of the rows
    rng = np.random.default_rng(3)
    groups = np.where(rng.random(6000) < 0.4, "hot", rng.integers(0, 30, 6000).astype(str))
    values = np.where(rng.random(6000) < 0.3, 1.5, np.round(rng.exponential(10, 6000), 1))
    pdf = pd.DataFrame({"g": groups, "y": values})
    df = spark.createDataFrame(pdf).repartition(4)
    got = {r["g"]: r["quantile"] for r in Q.exact_group_quantile(df, "g", "y", p, direct_rows=60).collect()}
    want = pdf.groupby("g").y.quantile(p).to_dict()
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_sorted_codes_listed_or_ranged(spark):
    df = spark.range(3000).select((F.col("id") * 7 % 3000).alias("k"))
    for listed in (10_000, 100):
        codes = sorted_codes(df, "k", listed_values=listed).orderBy("category").collect()
        assert [r["code"] for r in codes] == list(range(3000))
        assert [r["category"] for r in codes] == list(range(3000))


def test_outliers_by_search_equal_outliers_directly(spark, monkeypatch):
    from tablewright.operators import cleaning

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.exponential(3, 4000), "b": rng.integers(0, 9, 4000), "c": rng.standard_t(2, 4000)})
    df = spark.createDataFrame(pdf).repartition(3)
    direct = fit_outliers(df)
    monkeypatch.setattr(cleaning, "DIRECT_ROWS", 100)
    monkeypatch.setattr(Q, "DIRECT_ROWS", 100)
    searched = fit_outliers(df)
    assert searched.rows_after == direct.rows_after
    for s, d in zip(searched.bounds, direct.bounds, strict=True):
        assert (s.column, s.rows) == (d.column, d.rows)
        assert (s.q1, s.q3) == pytest.approx((d.q1, d.q3))
