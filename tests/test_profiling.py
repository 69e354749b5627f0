from __future__ import annotations

import pandas as pd
import pytest

from tablewright.operators import profiling as P
from tablewright.plans.insight import insight_inputs


@pytest.fixture
def small(spark):
    rows = [(1, 1.0, "b", True), (2, 2.0, "a", True), (3, 3.0, "b", False), (4, 4.0, None, None)]
    return spark.createDataFrame(rows, "k int, x double, s string, f boolean")


def test_describe_matches_pandas(spark, tables):
    pdf = tables("lineitem").toPandas()
    want = pdf.describe()
    got = P.describe_numeric(tables("lineitem")).toPandas().set_index("column")
    for ours, theirs in {"count": "count", "mean": "mean", "std": "std", "min": "min", "q25": "25%", "q50": "50%",
                         "q75": "75%", "max": "max"}.items():
        for c in got.index:
            assert got.loc[c, ours] == pytest.approx(want.loc[theirs, c]), (c, ours)


def test_describe_all_has_categories_and_numbers(small):
    got = {r["column"]: r for r in P.describe_all(small).collect()}
    assert (got["s"]["count"], got["s"]["unique"], got["s"]["top"], got["s"]["freq"]) == (3, 2, "b", 2)
    assert (got["f"]["unique"], got["f"]["top"]) == (2, "true")
    assert (got["x"]["q25"], got["x"]["q50"], got["x"]["q75"]) == (1.75, 2.5, 3.25)
    assert got["x"]["top"] is None and got["s"]["mean"] is None


def test_describe_only_counts_nested_columns(spark):
    df = spark.createDataFrame([([1],), (None,)], "a array<int>")
    assert P.describe_all(df).collect()[0]["count"] == 1


def test_describe_numeric_without_numbers_describes_all(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "s string")
    assert P.describe_numeric(df).collect()[0]["top"] == "a"


def test_describe_empty_table(spark):
    got = P.describe_all(spark.createDataFrame([], "x double, s string")).collect()
    assert [r["count"] for r in got] == [0, 0]


def test_long_form_has_only_what_exists(small):
    stats = {(r["column"], r["stat"]) for r in P.describe_long(small).collect()}
    assert ("s", "top") in stats and ("x", "q50") in stats
    assert ("x", "top") not in stats and ("s", "mean") not in stats


@pytest.mark.parametrize(
    ("question", "columns"),
    [
        ("Describe the data", "mean"),
        ("some STATISTICS of the columns", "mean"),
        ("what fields are there", "name"),
        ("columns and shape", "name"),
        ("its size", "rows"),
        ("sample please", "k"),
    ],
)
def test_profile_dispatch(small, question, columns):
    assert columns in P.profile(small, question, key="k").columns


def test_profile_unknown_question(small):
    with pytest.raises(ValueError, match="cannot answer"):
        P.profile(small, "how are you")


def test_sample_text(small):
    lines = [r["line"] for r in P.sample_text(small, "k", 2).collect()]
    assert lines == [
        "column1 = {'k': 1, 'x': 1.0, 's': b, 'f': true},",
        "column2 = {'k': 2, 'x': 2.0, 's': a, 'f': true},",
    ]


def test_head_follows_the_key(small):
    assert [r["k"] for r in P.head(small, "k", 2).collect()] == [1, 2]


def test_insight_inputs(small):
    sections = pd.Series([r["section"] for r in insight_inputs(small, "k").collect()]).value_counts()
    assert sections["sample"] == 4 and sections["columns"] == 4 and sections["statistics"] > 10


def test_awkward_names(spark):
    df = spark.createDataFrame([(1.0, "a", 2), (2.0, "a", 3)], "`x.1` double, `Unnamed: 4` string, `a``b` int")
    got = {r["column"]: r for r in P.describe_all(df).collect()}
    assert got["x.1"]["q50"] == 1.5 and got["Unnamed: 4"]["top"] == "a" and got["a`b"]["max"] == 3.0
