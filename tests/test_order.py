from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tablewright.functions import order as O
from tablewright.operators import models as M


def _plain(values, k):
    return sorted(values)[:k]


@pytest.mark.parametrize("listed", [0, 5, 10_000])
def test_cut_is_where_the_first_k_end(spark, monkeypatch, listed):
    monkeypatch.setattr(O, "LISTED", listed)
    df = spark.range(700).select((F.col("id") % 90).alias("id"))
    digests = df.select(O.digest([F.col("id")], 42).alias("h"))
    plain = sorted(hashlib.md5(f"{i % 90}|42".encode()).hexdigest()[:15] for i in range(700))
    for k in (1, 8, 350, 700):
        cut = O.find_cut(digests, k)
        at = plain[k - 1]
        assert (cut.at, cut.below, cut.equal) == (at, plain.index(at), plain.count(at))
    with pytest.raises(ValueError, match="fewer"):
        O.find_cut(digests, 701)


def test_exact_parts_where_many_rows_are_alike(spark, monkeypatch):
    """A third of all rows are copies of one row; others share a key but not the rest."""
    monkeypatch.setattr(O, "_COPIES", 7)
    i = F.col("id")
    df = spark.range(300).select(
        F.when(i < 100, -1).otherwise(i % 20).alias("k"), F.when(i < 100, 0).otherwise(i).alias("v"), F.lit(None).cast("int").alias("copies")
    )
    rows = sorted(map(str, df.collect()))
    for k in range(0, 301, 20):
        first, rest = O.first_rows(df, k, ["k"], 42)
        a, b = first.collect(), rest.collect()
        assert len(a) == k and sorted(map(str, a + b)) == rows
        again, _ = O.first_rows(df.repartition(5), k, ["k"], 42)
        assert sorted(map(str, again.collect())) == sorted(map(str, a))


def test_split_is_exact_for_any_number_of_rows(spark):
    for n in (0, 1, 4, 5, 6, 99):
        train, test = M.train_test_split(spark.range(n))
        assert test.count() == math.ceil(0.2 * n) and train.count() == n - math.ceil(0.2 * n)


def test_rows_with_nulls_nested_values_and_clashing_names(spark):
    df = spark.createDataFrame([(None, [1, None], {"a": 1}), (None, [1, None], {"a": 1}), (3, None, {})] * 3, "h int, p array<int>, n map<string,int>")
    first, rest = O.first_rows(df, 4, ["h"], 1)
    assert first.count() == 4 and rest.count() == 5
    assert first.columns == df.columns


@pytest.mark.parametrize("keys", [["a"], ["a", "b b"]])
@pytest.mark.parametrize("k", [0, 1, 7, 20, 33, 40])
def test_kept_columns_are_the_same_rows_without_their_digests(spark, keys, k):
    rows = spark.createDataFrame([(i % 5, f"x{i % 10}", None if i % 4 else float(i)) for i in range(40)], "a int, `b b` string, c double")
    kept = O.first_rows(rows, k, keys, 42, ["b b", "c"])
    for part, whole in zip(kept, O.first_rows(rows, k, keys, 42), strict=True):
        assert part.columns == ["b b", "c"]
        assert sorted(map(repr, part.collect())) == sorted(map(repr, whole.select("b b", "c").collect()))
        assert "md5" not in part._jdf.queryExecution().optimizedPlan().toString()
