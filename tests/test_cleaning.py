from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import cleaning as C
from tablewright.plans.preprocess import clean_file, fit_cleaning, preprocess


def values(df, column="x"):
    return [r[column] for r in df.collect()]


def test_empty_columns_go(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (2, None, float("nan"))], "a int, b string, c double")
    assert C.drop_empty_columns(df).columns == ["a"]


def test_mean_makes_whole_numbers_double(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (None, 3)], "x bigint, full bigint")
    out = C.impute_mean(df)
    assert out.dtypes == [("x", "double"), ("full", "bigint")]
    assert values(out) == [1.0, 2.0, 1.5]


def test_mean_ignores_nan(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "x double")
    assert values(C.impute_mean(df)) == [1.0, 3.0, 2.0, 2.0]


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "x string")
    assert values(C.impute_mode(df))[-1] == "a"


def test_mode_of_booleans(spark):
    df = spark.createDataFrame([(True,), (True,), (False,), (None,)], "x boolean")
    out = C.impute_mode(df)
    assert out.dtypes == [("x", "boolean")]
    assert values(out)[-1] is True


def test_mode_of_long_texts_by_digest(spark):
    a, b = "a" * 500, "b" * 500
    df = spark.createDataFrame([(b,), (b,), (a,), (a,), ("c" * 500,), (None,)], "x string")
    assert C.count_missing(df).long == ["x"]
    assert values(C.impute_mode(df))[-1] == a
    plain, digested = C.most_frequent(df, ["x"]), C.most_frequent(df, ["x"], ["x"])
    assert plain.collect() == digested.collect()


def test_digests_when_nothing_repeats(spark):
    df = spark.createDataFrame([(c * 300,) for c in "zyx"], "x string")
    assert C.most_frequent(df, ["x"], ["x"]).collect() == [("x", 3, "x" * 300, 1)]


def test_other_types_are_skipped_and_reported(spark):
    df = spark.createDataFrame(
        [(1, "a", None, [1]), (None, None, None, None)], "n int, s string, e string, arr array<int>"
    )
    report = {r["column"]: (r["missing"], r["action"]) for r in C.impute_report(df).collect()}
    assert report == {"n": (1, "mean"), "s": (1, "mode"), "e": (2, "drop"), "arr": (1, "skip")}
    assert preprocess(df).columns == ["n", "s", "arr"]


def test_zero_spread_removes_everything_off_the_quartiles(spark):
    df = spark.createDataFrame([(0,)] * 7 + [(9,)], "x bigint")
    assert values(C.remove_outliers(df)) == [0] * 7


def test_constant_column_is_untouched(spark):
    df = spark.createDataFrame([(5,)] * 4, "x bigint")
    assert C.remove_outliers(df).count() == 4
    assert C.fit_outliers(df).bounds == [C.Bounds("x", 4)]


def test_later_columns_see_only_the_survivors(spark):
    pdf = pd.DataFrame({"a": [1, 2, 3, 4, 100, 2, 3, 1], "b": [1.0, 2.0, 3.0, 2.0, 500.0, 1.0, 9.0, 2.5]})
    want = pdf
    for c in ("a", "b"):
        q1, q3 = want[c].quantile(0.25), want[c].quantile(0.75)
        want = want[(want[c] >= q1 - 1.5 * (q3 - q1)) & (want[c] <= q3 + 1.5 * (q3 - q1))]
    got = C.remove_outliers(spark.createDataFrame(pdf))
    assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None))
    report = C.outlier_report(spark.createDataFrame(pdf)).collect()
    assert [(r["rows_before"], r["rows_after"]) for r in report] == [(8, 7), (7, len(want))]


def test_booleans_and_texts_have_no_outliers(spark):
    df = spark.createDataFrame([(True, "a")] * 9 + [(False, "b")], "f boolean, s string")
    assert C.remove_outliers(df).count() == 10


def test_bounds_on_whole_numbers_reach_the_scan(spark, tables, capsys):
    C.remove_outliers(tables("documents").select("n_chars")).explain()
    plan = capsys.readouterr().out
    assert "LessThanOrEqual(n_chars" in plan
    assert "Exchange" not in plan


def test_flags(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(1000.0,), (None,), (float("nan"),)], "x double")
    flags = values(C.flag_outliers(df), "x_outlier")
    assert flags == [False] * 20 + [True, None, None]


def test_empty_inputs_are_errors(spark):
    with pytest.raises(ValueError, match="dataset is empty"):
        preprocess(spark.createDataFrame([], "a int"))
    with pytest.raises(ValueError, match="all columns are empty"):
        preprocess(spark.createDataFrame([(None,)], "a string"))
    with pytest.raises(ValueError, match="not a DataFrame"):
        C.require_nonempty([1, 2])


def test_outliers_that_remove_every_row_are_an_error(spark):
    # Both quartiles are infinite, so the bounds are undefined and no row lies inside.
    df = spark.createDataFrame([(float("inf"),)] * 7 + [(1.0,)], "x double")
    with pytest.raises(ValueError, match="left no rows"):
        preprocess(df)


def test_cleaning_applies_to_another_table(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "b"), (None, None)], "x double, s string")
    other = spark.createDataFrame([(None, "z"), (99.0, None)], "x double, s string")
    assert fit_cleaning(df).apply(other).collect() == [(2.0, "z")]


def test_cleaning_applies_to_a_stream(spark, sf, tmp_path):
    """What is learned from a table is a projection and filters, so a stream can use it."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    fitted = fit_cleaning(events)
    source = tmp_path / "in"
    events.write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    done = (
        fitted.apply(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    done.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(fitted.apply(events)).isEmpty()
    assert spark.read.parquet(str(tmp_path / "out")).count() == fitted.outliers.rows_after


def test_clean_file(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("id,v,c,flag,empty\n1,1.5,x,True,\n2,,x,True,\n3,2.5,,,\n4,2.0,y,False,\n")
    for fmt in ("parquet", "csv"):
        out = clean_file(spark, str(source), str(tmp_path / fmt), fmt)
        rows = [tuple(r) for r in out.orderBy("id").select("id", "v", "c").collect()]
        assert rows == [(1, 1.5, "x"), (2, 2.0, "x"), (3, 2.5, "x"), (4, 2.0, "y")]
        # Text with gaps on the first read; a CSV is typed anew when it is read back.
        assert dict(out.dtypes)["flag"] == ("string" if fmt == "parquet" else "boolean")


def test_fitting_many_columns(spark):
    df = spark.range(50).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(150)])
    missing = C.count_missing(df)
    assert len(missing.known) == 150 and set(missing.known.values()) == {50}
