"""Records that span lines: the same rows wherever the files are cut."""

from __future__ import annotations

import csv
import random

import pytest

from tablewright.sources.csv import scan_csv
from tablewright.sources.records import open_splits, quoted_after, read_records


@pytest.fixture
def cut_at(spark):
    """Splits of so many bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield cut
    for k, v in old.items():
        spark.conf.set(k, v)


ODD = 'a,b\r\n"one\n\ntwo, ""three""\r\n",1\r\n5" pipe,2\r\n\r\n"x"y\n"z,3"\n,4\n"",5\n"""\n""\n",6\né“,7\n"\n\n\n\n",8'


def test_state_after_a_line():
    cases = {b"a,b": (False, True), b'"a': (True, False), b'a"b': (False, False), b'5" pipe': (False, False), b'",': (True, False), b'"a","b': (True, True), b'x","y': (True, True), b'x",y': (False, False), b'"a""': (True, False), b'""': (False, True), b'a"",': (False, True)}
    assert {k: (quoted_after(k, False), quoted_after(k, True)) for k in cases} == cases


@pytest.mark.parametrize("size", [1, 40, 10_000])
def test_cut_anywhere(spark, tmp_path, cut_at, size):
    (tmp_path / "in.csv").write_bytes(ODD.encode())
    cut_at(size)
    df = scan_csv(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() >= min(len(ODD) // size, 4)
    # What follows a closing quote makes the field a bare one to Spark's parser, with its quotes.
    want = [('one\n\ntwo, "three"\r\n', 1), ('5" pipe', 2), ('"x"y', None), ("z,3", None), (None, 4), (None, 5), ('"\n"\n', 6), ("é“", 7), ("\n\n\n\n", 8)]
    got = [(r["a"], r["b"] and int(r["b"])) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("encoding", ["latin1", "cp1252", "utf-8-sig"])
def test_random_tables_in_many_files(spark, tmp_path, cut_at, encoding):
    rng = random.Random(5)
    pieces = ["x", "é", '"', "\n", ",", "\r\n", " ", "word", "€" if encoding != "latin1" else "ü", "12"]
    rows = [(str(i), "".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) + "!") for i in range(18)]
    for k in range(3):
        with open(tmp_path / f"{k}.csv", "w", encoding=encoding, newline="") as f:
            csv.writer(f).writerows([("id", "te\nxt"), *rows[6 * k : 6 * k + 6]])
    cut_at(37)
    df = scan_csv(spark, str(tmp_path))
    assert df.columns == ["id", "te\nxt"]
    assert sorted((str(r[0]), r[1]) for r in df.collect()) == sorted(rows)


def test_only_the_splits_inside_a_field_are_told(spark, tmp_path, cut_at):
    (tmp_path / "in.csv").write_bytes(b'a\n"' + b"x\n" * 50 + b'"\n' + b"y\n" * 50)
    cut_at(10)
    opened = sorted(r["block"] for r in open_splits(spark, str(tmp_path)).collect())
    assert opened == list(range(10, 101, 10))
    got = [r["record"] for r in read_records(spark, str(tmp_path), "UTF-8").filter("not first").collect()]
    assert sorted(got) == sorted(['"' + "x\n" * 50 + '"', *["y"] * 50])


def test_a_quote_that_is_never_closed_takes_the_rest(spark, tmp_path, cut_at):
    (tmp_path / "in.csv").write_bytes(b'a,b\n1,2\n3,"x\n4,5\n')
    cut_at(3)
    got = sorted(r["record"] for r in read_records(spark, str(tmp_path), "UTF-8").collect())
    assert got == ["1,2", '3,"x\n4,5', "a,b"]


def test_long_records_that_span_lines_are_an_error(spark, tmp_path):
    (tmp_path / "in.csv").write_text('a,b\n"x\ny",1,2\n')
    with pytest.raises(ValueError, match="more than 2 fields"):
        scan_csv(spark, str(tmp_path))


def test_headers_that_span_lines_must_agree(spark, tmp_path):
    (tmp_path / "1.csv").write_text('"a\nb",c\n1,2\n')
    (tmp_path / "2.csv").write_text('"a\nx",c\n1,2\n')
    with pytest.raises(ValueError, match="different headers"):
        scan_csv(spark, str(tmp_path))
