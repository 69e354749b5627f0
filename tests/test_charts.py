from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions import quantiles as Q
from tablewright.operators import charts as C
from tablewright.plans.charting import ChartSpec, charts, check_chart, write_charts


def test_sample_is_exact_and_repeatable(tables):
    lines = tables("lineitem")
    for key in (None, ["l_orderkey", "l_linenumber"]):
        a = C.sample_rows(lines, 100, key=key)
        assert a.count() == 100
        assert a.exceptAll(C.sample_rows(lines, 100, key=key)).isEmpty()
        assert a.exceptAll(lines).isEmpty()
    assert C.sample_rows(lines, 10**6).count() == lines.count()


def test_keyed_sample_does_not_depend_on_partitions(tables):
    lines = tables("lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    one = C.sample_rows(lines, 50, key=keys)
    other = C.sample_rows(lines.repartition(7), 50, key=keys)
    assert one.exceptAll(other).isEmpty()


def test_sample_of_copies_is_not_all_or_nothing(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).alias("copy"))
    share = C.sample_rows(df, 300).filter("copy").count() / 300
    assert 0.2 < share < 0.47


def test_scatter_needs_enough_rows(spark, tables):
    assert C.scatter(tables("events"), "user_id", "value").count() == 50
    with pytest.raises(ValueError, match="needs 50 rows"):
        C.scatter(spark.range(49).withColumn("y", F.col("id")), "id", "y")


def test_bars(spark):
    df = spark.createDataFrame(
        [("b", 1.0), ("a", 3.0), ("b", 2.0), ("a", None), ("c", None), (None, 9.0)], "x string, y double"
    )
    assert [tuple(r) for r in C.bar_count(df, "x").collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert [tuple(r) for r in C.bar_mean(df, "x", "y").collect()] == [("a", 3.0), ("b", 1.5)]
    assert C.bar_count(df, "x", 1).count() == 1


@pytest.mark.parametrize("limit", [10_000, 30])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_histogram_matches_numpy(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(Q, "DIRECT_ROWS", limit)
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=997), rng.exponential(size=500), np.round(rng.uniform(0, 5, 300))][seed]
    counts, edges = np.histogram(x, "auto")
    got = {r["bin"]: r for r in C.histogram(spark.createDataFrame(pd.DataFrame({"x": x})), "x").collect()}
    assert {b: r["n"] for b, r in got.items()} == {i: n for i, n in enumerate(counts) if n}
    assert all(r["left"] == pytest.approx(edges[b]) for b, r in got.items())
    assert sum(r["n"] for r in got.values()) == len(x)


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert [tuple(r) for r in C.histogram(df, "x").collect()] == [(0, 1.5, 2.5, 5)]
    with pytest.raises(ValueError, match="no spread"):
        C.kde(df, "x")


def test_density_matches_the_formula_and_reach_loses_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.01, 400), [100.0, 250.0]])
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = C.kde(df, "x").orderBy("point").toPandas()
    assert got.density.to_numpy() == pytest.approx(want, rel=1e-9, abs=1e-300)
    # A bandwidth far below the grid's step: most rows meet few grid points.
    narrow = C.summarize(df, "x")
    tight = C.Summary(narrow.values, narrow.n, narrow.low, narrow.high, 0.01, narrow.q1, narrow.median, narrow.q3)
    h = 0.01 * len(x) ** -0.2
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    got = C.kde(df, "x", summary=tight).orderBy("point").toPandas()
    assert len(got) == 200
    assert got.density.to_numpy() == pytest.approx(want, rel=1e-6, abs=1e-300)


def test_pie(spark, tables):
    got = C.pie_share(tables("part"), "p_type").collect()
    assert sum(r["percent"] for r in got) == pytest.approx(100, abs=0.5)
    with pytest.raises(ValueError, match="not suitable"):
        C.pie_share(tables("part"), "p_size")


def test_box(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 10)] + [(100.0,), (-90.0,)], "x double")
    box = C.box_stats(df, "x").first()
    assert (box["whisker_low"], box["whisker_high"], box["fliers"]) == (1.0, 9.0, 2)
    assert sorted(r["x"] for r in C.box_fliers(df, "x").collect()) == [-90.0, 100.0]


def test_crosstab_fills_zeros_from_either_side(spark, monkeypatch):
    df = spark.createDataFrame([("a", "p"), ("a", "p"), ("b", "q"), (None, "p"), ("c", None)], "x string, y string")
    want = [("a", "p", 2), ("a", "q", 0), ("b", "p", 0), ("b", "q", 1)]
    assert sorted(map(tuple, C.crosstab(df, "x", "y").collect())) == want
    assert sorted(map(tuple, C.crosstab_wide(df, "x", "y").collect())) == [("a", 2, 0), ("b", 0, 1)]
    wide = spark.createDataFrame([("a", str(i)) for i in range(5)] + [("b", "0")], "x string, y string")
    monkeypatch.setattr(C, "DENSE_LABELS", 3)
    assert C.crosstab(wide, "x", "y").count() == 10
    with pytest.raises(ValueError, match="too many labels"):
        C.crosstab_wide(wide, "x", "y")
    with pytest.raises(ValueError, match="too many labels"):
        C.crosstab(wide.select("y", F.col("y").alias("x")), "x", "y")


def test_corr_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (None, 5)], "x double, y int")
    got = {(r["row"], r["column"]): r["r"] for r in C.corr_pair(df, "x", "y").collect()}
    assert got == {("x", "x"): 1.0, ("x", "y"): None, ("y", "x"): None, ("y", "y"): None}


def test_line_and_area(spark):
    df = spark.createDataFrame([(2, 1.0), (1, 3.0), (1, 5.0), (3, None)], "x int, y double")
    line = C.line_series(df, "x", "y").collect()
    assert [(r["x"], r["mean_y"], r["n"]) for r in line] == [(1.0, 4.0, 2), (2.0, 1.0, 1)]
    assert line[0]["high"] == pytest.approx(4 + 1.96 * math.sqrt(2) / math.sqrt(2))
    assert line[1]["low"] is None
    assert [tuple(r) for r in C.area_series(df, "x", "y").collect()] == [(1.0, 3.0), (1.0, 5.0), (2.0, 1.0)]


def test_bootstrap_band_is_that_of_resampled_rows(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(240), "x": np.arange(240) % 3, "y": rng.gamma(2.0, size=240)})
    df = spark.createDataFrame(pdf)
    line = C.line_series(df, "x", "y", "bootstrap", "id").collect()
    again = C.line_series(df.repartition(7), "x", "y", "bootstrap", "id").collect()
    for r, s in zip(line, again, strict=True):
        y = pdf.loc[pdf["x"] == r["x"], "y"].to_numpy()
        means = rng.choice(y, (4000, len(y))).mean(axis=1)
        low, high = np.percentile(means, [2.5, 97.5])
        assert r["mean_y"] == pytest.approx(y.mean()) and r["n"] == 80
        assert abs(r["low"] - low) < 0.2 * (high - low) and abs(r["high"] - high) < 0.2 * (high - low)
        assert (r["low"], r["high"]) == pytest.approx((s["low"], s["high"]))


def test_bootstrap_weights_are_those_of_a_poisson_variable(spark):
    """All values are 1 but one that is 0, so a mean tells how often that row counts."""
    steps = [int(s, 16) / 16**8 for s in C.poisson_steps()]
    assert steps[:4] == pytest.approx([0.367879, 0.735759, 0.919699, 0.981012], abs=1e-6)
    df = spark.range(400).select("id", F.lit(1).alias("x"), (F.col("id") > 0).cast("double").alias("y"))
    means = C.bootstrap_means(df, "x", "y", "id", replicates=201).toPandas()
    assert sorted(means["replicate"]) == list(range(201))
    assert 0.25 < (means["mean_y"] == 1).mean() < 0.5


def test_bootstrap_refuses_what_it_cannot_do(spark, tables):
    with pytest.raises(ValueError, match="key"):
        C.line_series(tables("part"), "p_size", "p_retailprice", "bootstrap")
    with pytest.raises(ValueError, match="unknown band"):
        C.line_series(tables("part"), "p_size", "p_retailprice", "wide")
    df = spark.createDataFrame([(None, 1, 2.0), (1, None, 3.0), (2, 1, None)], "id int, x int, y double")
    assert [(r["x"], r["n"]) for r in C.line_series(df, "x", "y", "bootstrap", "id").collect()] == [(1.0, 1)]
    assert C.line_series(df.limit(0), "x", "y", "bootstrap", "id").count() == 0


def test_large_sample_is_found_by_counting(tables, monkeypatch):
    lines, keys = tables("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    sorted_one = C.sample_rows(lines, 200, key=keys)
    monkeypatch.setattr(C, "SORTED_ROWS", 10)
    counted = C.sample_rows(lines, 200, key=keys)
    assert counted.count() == 200 and counted.exceptAll(sorted_one).isEmpty()
    assert C.sample_rows(lines, 10**7, key=keys).count() == lines.count()


@pytest.mark.parametrize(
    ("spec", "reason"),
    [
        (("value", None, "Pie Chart"), "not suitable"),
        (("event_type", None, "Box Plot"), "numeric"),
        (("value", None, "Scatter Plot"), "needs a y axis"),
        (("value", "event_type", "Heatmap"), "two text or two numeric"),
        (("value", "event_type", "Line Chart"), "two numeric"),
        (("value", "event_type", "Bar Chart"), "numeric y axis"),
        (("ts", None, "Bar Chart"), "needs a y axis"),
        (("ts", None, "Histogram"), "numeric or text"),
        (("nope", None, "Histogram"), "unknown column"),
        (("value", "nope", "Bar Chart"), "unknown column"),
        (("value", None, "Radar"), "unknown chart type"),
    ],
)
def test_charts_that_cannot_be_made(tables, spec, reason):
    assert reason in check_chart(tables("events").schema, ChartSpec(*spec))


def test_every_chart_type_has_data(spark, tables):
    specs = [
        ("user_id", "value", "Scatter Plot"),
        ("event_type", None, "Bar Chart"),
        ("user_id", "value", "Bar Chart"),
        ("value", None, "Bar Chart"),
        ("value", None, "Histogram"),
        ("event_type", None, "Histogram"),
        ("event_type", None, "Pie Chart"),
        ("value", None, "Box Plot"),
        ("event_type", "props", "Heatmap"),
        ("user_id", "value", "Heatmap"),
        ("user_id", "value", "Line Chart"),
        ("user_id", "value", "Area Chart"),
        ("value", "value", "Heatmap"),
    ]
    for chart in charts(tables("events"), [ChartSpec(*s) for s in specs]):
        assert chart.status == "done", chart
        assert all(not d.isEmpty() for d in chart.data.values()), chart


def test_one_failure_does_not_stop_the_rest(spark, tmp_path):
    df = spark.range(10).select("id", F.lit(1.0).alias("one"), F.lit("a").alias("s"))
    specs = [ChartSpec("id", "one", "Scatter Plot"), ChartSpec("one", None, "Bar Chart"), ChartSpec("s", None, "Pie Chart")]
    got = write_charts(df, specs, str(tmp_path)).collect()
    assert [(r["status"], r["part"], r["rows"]) for r in got] == [
        ("failed", None, None),
        ("failed", None, None),
        ("done", "shares", 1),
    ]
    assert spark.read.parquet(got[2]["path"]).first()["percent"] == 100.0
