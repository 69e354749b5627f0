"""CSV cases: encodings, headers, record shapes and types."""

from __future__ import annotations

import pytest

from tablewright.sources.csv import detect_encoding, header_names, infer_types, scan_csv
from tablewright.sources.sink import write_clean


def put(folder, content, name="in.csv", encoding="utf-8"):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode(encoding))
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_na_tokens_become_nulls_of_a_double_column(spark, tmp_path):
    df = scan_csv(spark, put(tmp_path, "a,b\n1,x\nNA,y\nn/a,None\nNone,z\n,w\n"))
    assert df.dtypes == [("a", "double"), ("b", "string")]
    assert [r[0] for r in rows(df)] == [1.0, None, None, None, None]
    assert [r[1] for r in rows(df)] == ["x", "y", None, "z", "w"]


def test_whole_numbers_are_long_only_without_gaps(spark, tmp_path):
    df = scan_csv(spark, put(tmp_path, "a,b,c,d\n 7 ,1,9223372036854775808,3d\n+5,2,1,4\n"))
    assert df.dtypes == [("a", "bigint"), ("b", "bigint"), ("c", "double"), ("d", "string")]
    assert [r[0] for r in rows(df)] == [7, 5]


def test_reals(spark, tmp_path):
    df = scan_csv(spark, put(tmp_path, "a,b,c\n1e3,Infinity,1.\n.5,-inf,2.5E-3\n"))
    assert df.dtypes == [("a", "double"), ("b", "double"), ("c", "double")]
    assert rows(df) == [(1000.0, float("inf"), 1.0), (0.5, float("-inf"), 0.0025)]


def test_booleans_only_without_gaps_and_in_three_spellings(spark, tmp_path):
    df = scan_csv(spark, put(tmp_path, "a,b,c,d\nTrue,True,yes,TRUE\nfalse,False,t,true\nFALSE,,1,False\n"))
    assert df.dtypes == [("a", "boolean"), ("b", "string"), ("c", "string"), ("d", "boolean")]
    assert [r[0] for r in rows(df)] == [True, False, False]
    assert [r[1] for r in rows(df)] == ["True", "False", None]


def test_dates_stay_text(spark, tmp_path):
    df = scan_csv(spark, put(tmp_path, "d\n2024-01-01\n"))
    assert df.dtypes == [("d", "string")]


def test_blank_and_repeated_headers(spark, tmp_path):
    df = scan_csv(spark, put(tmp_path, "x,a,x,b,,x\n1,2,3,4,5,6\n"))
    assert df.columns == ["x", "a", "x.1", "b", "Unnamed: 4", "x.2"]
    assert rows(df) == [(1, 2, 3, 4, 5, 6)]


def test_header_names_avoid_a_name_that_exists():
    assert header_names(["x", "x", "x.1", None]) == ["x", "x.2", "x.1", "Unnamed: 3"]


def test_quoted_fields_with_newlines_quotes_and_backslashes(spark, tmp_path):
    df = scan_csv(spark, put(tmp_path, 'a,b\n"x\ny",1\n"say ""hi""",2\n"back\\",3\n'))
    assert rows(df) == [("x\ny", 1), ('say "hi"', 2), ("back\\", 3)]


@pytest.mark.parametrize("long_row", ["1,2,3", "1,2,", '"p,q",2,3', "1,2,3,4"])
def test_long_rows_are_an_error(spark, tmp_path, long_row):
    with pytest.raises(ValueError, match="more than 2 fields"):
        scan_csv(spark, put(tmp_path, f"a,b\n1,2\n{long_row}\n"))


def test_short_rows_are_filled_with_nulls(spark, tmp_path):
    df = scan_csv(spark, put(tmp_path, 'a,b\n1,2\n3\n"x,y"\n'))
    assert rows(df) == [("1", 2.0), ("3", None), ("x,y", None)]


@pytest.mark.parametrize(
    ("content", "encoding"),
    [
        ("a,b\ncafé,1\n".encode("latin1"), "ISO-8859-1"),
        ("a,b\ncafé,1\n".encode("cp1252"), "ISO-8859-1"),
        ("a,b\ncafé,1\n".encode(), "UTF-8"),
        ("﻿a,b\ncafé,1\n".encode(), "UTF-8"),
        ("a,b\ncafé,1\n".encode("utf-16"), "UTF-16"),
        (b"\xfe\xff" + "a,b\ncafé,1\n".encode("utf-16-be"), "UTF-16"),
        ("a,b\ncafé,1\n".encode("utf-32"), "UTF-32"),
    ],
)
def test_encodings(spark, tmp_path, content, encoding):
    path = put(tmp_path, content)
    assert [r["encoding"] for r in detect_encoding(spark, path).collect()] == [encoding]
    df = scan_csv(spark, path)
    assert df.columns == ["a", "b"]
    assert rows(df) == [("café", 1)]


def test_windows_1252(spark, tmp_path):
    path = put(tmp_path, "preis €,b\n€5 “ok” – été,1\n", encoding="cp1252")
    assert [r["encoding"] for r in detect_encoding(spark, path).collect()] == ["windows-1252"]
    df = scan_csv(spark, path)
    assert df.columns == ["preis €", "b"]
    assert rows(df) == [("€5 “ok” – été", 1)]


def test_ascii_files_go_with_any_encoding_of_ascii(spark, tmp_path):
    put(tmp_path, "a,b\nplain,1\n", "one.csv")
    put(tmp_path, "a,b\ncafé,2\n", "two.csv", "latin1")
    assert sorted(rows(scan_csv(spark, str(tmp_path)))) == [("café", 2), ("plain", 1)]
    put(tmp_path, "a,b\n€,3\n", "three.csv", "cp1252")
    assert sorted(rows(scan_csv(spark, str(tmp_path)))) == [("café", 2), ("plain", 1), ("€", 3)]


def test_files_of_different_encodings_are_refused(spark, tmp_path):
    put(tmp_path, "a\ncafé\n", "one.csv")
    put(tmp_path, "a\ncafé\n", "two.csv", "latin1")
    with pytest.raises(ValueError, match="differ in encoding"):
        scan_csv(spark, str(tmp_path))


def test_many_files_share_one_header(spark, tmp_path):
    put(tmp_path, "a,b\n1,x\n", "one.csv")
    put(tmp_path, "a,b\n2,y\n", "two.csv")
    assert sorted(rows(scan_csv(spark, str(tmp_path)))) == [(1, "x"), (2, "y")]


def test_files_of_different_headers_are_refused(spark, tmp_path):
    put(tmp_path, "a,b\n1,x\n", "one.csv")
    put(tmp_path, "b,a\n2,y\n", "two.csv")
    with pytest.raises(ValueError, match="different headers"):
        scan_csv(spark, str(tmp_path))


def test_missing_and_empty_files(spark, tmp_path):
    with pytest.raises(ValueError, match="no files"):
        scan_csv(spark, str(tmp_path / "nothing.csv"))
    with pytest.raises(ValueError, match="empty"):
        scan_csv(spark, put(tmp_path, ""))


def test_infer_types_leaves_typed_columns_alone(spark):
    df = spark.createDataFrame([("1", 2, True), ("2", 3, False)], "a string, b int, c boolean")
    assert infer_types(df).dtypes == [("a", "bigint"), ("b", "int"), ("c", "boolean")]


def test_more_columns_than_one_job_takes(spark):
    df = spark.range(3).selectExpr(*[f"CAST(id + {i} AS STRING) AS c{i}" for i in range(130)])
    assert set(dict(infer_types(df).dtypes).values()) == {"bigint"}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip(spark, tmp_path, fmt):
    texts = [('a "b", c', 1), ("  spaced ", 2), ("two\nlines", 3), ("back\\slash", 4)]
    df = spark.createDataFrame(texts, "t string, n bigint")
    path = str(tmp_path / "out")
    write_clean(df, path, fmt)
    back = scan_csv(spark, path) if fmt == "csv" else spark.read.parquet(path)
    assert sorted(rows(back)) == sorted(texts)


def test_sink_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown format"):
        write_clean(spark.range(1), str(tmp_path / "x"), "xlsx")
    nested = spark.range(1).selectExpr("array(id) AS a")
    with pytest.raises(OSError, match="could not save"):
        write_clean(nested, str(tmp_path / "y"), "csv")
