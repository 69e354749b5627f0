from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tablewright.functions import gram
from tablewright.operators import findings as G


def test_correlations_match_pandas_with_gaps(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(300, 4)), columns=list("abcd"))
    pdf["b"] += pdf["a"]
    pdf.loc[::7, "c"] = np.nan
    pdf.loc[::5, "d"] = np.nan
    pdf["k"] = 3.0
    want = pdf.corr()
    got = G.correlations(spark.createDataFrame(pdf)).collect()
    assert len(got) == 10
    for r in got:
        theirs = want.loc[r["x"], r["y"]]
        assert (r["r"] is None and np.isnan(theirs)) or r["r"] == pytest.approx(theirs)
    strengths = [abs(r["r"]) for r in got if r["r"] is not None]
    assert strengths == sorted(strengths, reverse=True)


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(60, 20)), columns=[f"c{i}" for i in range(20)])
    want = pdf.corr()
    got = G.correlations(spark.createDataFrame(pdf)).collect()
    assert len(got) == 190
    assert all(r["r"] == pytest.approx(want.loc[r["x"], r["y"]]) for r in got)


def _jobs(spark, work):
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_correlations_of_300_columns_in_as_many_jobs_as_of_30(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 300)) + 1e6
    x[:, 1] += 2 * x[:, 0]
    x[rng.random(x.shape) < 0.1] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(300)])
    spark.createDataFrame(pdf).repartition(3).write.parquet(f"{tmp_path}/wide")
    df = spark.read.parquet(f"{tmp_path}/wide")
    got = {}
    many = _jobs(spark, lambda: got.update({(r["x"], r["y"]): r["r"] for r in G.correlations(df).collect()}))
    few = _jobs(spark, lambda: G.correlations(df.select(*df.columns[:30])).collect())
    assert many <= few + 1
    want = pdf.corr().to_numpy()
    assert len(got) == 300 * 299 // 2
    for (a, b), r in got.items():
        assert r == pytest.approx(want[int(a[1:]), int(b[1:])], abs=1e-9)


def test_correlations_in_panels(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(40, 23)), columns=[f"a.{i}" for i in range(23)])
    want = pdf.corr()
    monkeypatch.setattr(gram, "SCAN_COLUMNS", 8)
    got = {(r["x"], r["y"]): r["r"] for r in G.correlations(spark.createDataFrame(pdf)).collect()}
    assert len(got) == 23 * 22 // 2
    assert all(r == pytest.approx(want.loc[a, b]) for (a, b), r in got.items())


def test_correlations_of_odd_columns_among_many(spark):
    """Constant, empty, infinite and huge columns, pairs that never meet, and pairs that meet where one is constant."""
    rng = np.random.default_rng(7)
    n = 60
    pdf = pd.DataFrame(rng.normal(size=(n, 9)), columns=[f"c{i}" for i in range(9)])
    half = np.arange(n) < n // 2
    pdf["one"], pdf["none"] = 1.0, np.nan
    pdf["inf"] = np.where(np.arange(n) == 3, np.inf, pdf["c0"])
    pdf["huge"] = pdf["c0"] * 1e200
    pdf["left"], pdf["right"] = np.where(half, pdf["c1"], np.nan), np.where(half, np.nan, pdf["c2"])
    pdf["flat"] = np.where(half, 7.1, pdf["c3"])
    pdf["far"] = np.where(half, 1e9 + pdf["c4"], -1e9)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.to_numpy()]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns))
    got = {(r["x"], r["y"]): r["r"] for r in G.correlations(df).collect()}
    assert len(got) == 17 * 16 // 2
    assert got["c0", "huge"] == pytest.approx(1.0)
    assert got["left", "right"] is None and got["left", "flat"] is None
    assert got["left", "far"] == pytest.approx(np.corrcoef(pdf["c1"][half], pdf["far"][half])[0, 1], abs=1e-6)
    for odd in ("one", "none", "inf"):
        assert all(r is None for pair, r in got.items() if odd in pair)
    empty = G.correlations(df.limit(0)).collect()
    assert len(empty) == 17 * 16 // 2 and all(r["r"] is None for r in empty)


def test_correlations_need_two_columns(spark):
    with pytest.raises(ValueError, match="two numeric"):
        G.correlations(spark.range(3))


def test_distribution(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (3.0,)], "x double")
    r = G.distribution(df, "x").first()
    assert (r["median"], r["direction"]) == (2.5, "right")
    assert r["skewness"] == pytest.approx(1.0182, abs=1e-4)
    flat = G.distribution(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x").first()
    assert flat["skewness"] is None and flat["direction"] is None
    none = G.distribution(spark.createDataFrame([(None,)], "x double"), "x").first()
    assert none["n"] == 0 and none["median"] is None


def test_group_profile(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("a", None), ("b", None), (None, 5.0)], "g string, y double"
    )
    got = {r["g"]: tuple(r)[1:] for r in G.group_profile(df, "g", "y").collect()}
    assert got == {"a": (3, 0.75, 2.0, 2.0), "b": (1, 0.25, None, None)}


def test_trend(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 5.0), (3, 7.0), (None, 1.0)], "x int, y double")
    r = G.trend(df, "x", "y").first()
    assert (r["slope"], r["intercept"], r["r2"], r["n"]) == pytest.approx((2.0, 1.0, 1.0, 3))
    flat = G.trend(spark.createDataFrame([(1, 3.0), (1, 5.0)], "x int, y double"), "x", "y").first()
    assert flat["slope"] is None and flat["n"] == 2
