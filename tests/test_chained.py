"""Outlier bounds of all columns found together equal those found one after the other."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pytest

from tablewright.functions import chained
from tablewright.operators import cleaning as C


def plain(pdf):
    """(rows before, q1, q3) of each column, and the rows left."""
    out = []
    for c in pdf.columns:
        v = pdf[c].dropna()
        if v.nunique() < 2:
            out.append((len(pdf), None, None))
            continue
        q1, q3 = v.quantile(0.25), v.quantile(0.75)
        out.append((len(pdf), q1, q3))
        pdf = pdf[(pdf[c] >= q1 - 1.5 * (q3 - q1)) & (pdf[c] <= q3 + 1.5 * (q3 - q1))]
    return out, len(pdf)


def table(n, seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"skewed": rng.exponential(3, n), "days": rng.integers(0, 9, n), "tails": rng.standard_t(2, n)})
    pdf["mostly zero"] = np.where(rng.random(n) < 0.9, 0, rng.integers(1, 50, n))
    pdf["x.1"] = np.where(rng.random(n) < 0.05, np.nan, pdf["skewed"] * pdf["tails"])
    pdf["one"] = 7
    pdf["ids"] = rng.permutation(n).astype("int64") ** 2
    return pdf


def checked(found, pdf):
    want, left = plain(pdf)
    assert found[1] == left
    for got, (rows, q1, q3) in zip(found[0], want, strict=True):
        assert got.rows == rows
        assert (got.q1, got.q3) == (q1, q3) if q1 is None else (got.q1, got.q3) == pytest.approx((q1, q3), rel=1e-12)


@pytest.mark.parametrize("held", [500, 10_000, 1_000_000])
def test_bounds_found_together(spark, monkeypatch, held):
    monkeypatch.setattr(chained, "HELD_VALUES", held * 7)
    pdf = table(60_000, 3)
    df = spark.createDataFrame(pdf).repartition(3).cache()
    found = chained.chained_quartiles(df, {c: c in ("days", "mostly zero", "one", "ids") for c in pdf.columns}, len(pdf), 1.5)
    if held >= 10_000:
        assert found is not None
    if found is not None:
        checked(found, pdf)
    fitted = C.fit_outliers(df)
    checked((fitted.bounds, fitted.rows_after), pdf)
    assert fitted.apply(df).count() == fitted.rows_after


def test_a_wrong_guess_is_found(spark, monkeypatch):
    pdf = table(30_000, 4)
    df = spark.createDataFrame(pdf).cache()
    monkeypatch.setattr(chained, "HELD_VALUES", 7 * 3_000)
    guessed = chained._guessed

    def shifted(states, sample, weight, factor):
        out = guessed(states, sample, weight, factor)
        return [s if s.constant else chained.replace(s, bands=tuple((b, b + 0.001) for _, b in s.bands)) for s in out]

    monkeypatch.setattr(chained, "_guessed", shifted)
    assert chained.chained_quartiles(df, dict.fromkeys(pdf.columns, False), len(pdf), 1.5) is None
    fitted = C.fit_outliers(df)
    checked((fitted.bounds, fitted.rows_after), pdf)


def test_a_column_that_earlier_ones_make_constant(spark, monkeypatch):
    n = 30_000
    rng = np.random.default_rng(6)
    a = np.where(np.arange(n) < 100, 1e6, rng.normal(size=n))
    pdf = pd.DataFrame({"a": a, "b": np.where(a > 1e5, 5, 2), "c": rng.integers(0, 100, n)})
    monkeypatch.setattr(chained, "HELD_VALUES", 3 * 9_000)
    fitted = C.fit_outliers(spark.createDataFrame(pdf))
    checked((fitted.bounds, fitted.rows_after), pdf)
    infinite = spark.createDataFrame([(float("inf"),), (1.0,)], "x double")
    assert chained.chained_quartiles(infinite, {"x": False}, 2, 1.5) is None


def test_jobs_do_not_grow_with_the_columns_that_remove_rows(spark, monkeypatch):
    def jobs(removing):
        rng = np.random.default_rng(9)
        pdf = pd.DataFrame({f"c{i}": rng.standard_t(2, 30_000) if i < removing else rng.random(30_000) for i in range(6)})
        df = spark.createDataFrame(pdf).cache()
        df.count()
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "fit")
        fitted = C.fit_outliers(df, rows=30_000)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        checked((fitted.bounds, fitted.rows_after), pdf)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    monkeypatch.setattr(chained, "HELD_VALUES", 6 * 12_000)
    few, many = jobs(1), jobs(6)
    assert abs(many - few) <= 2
