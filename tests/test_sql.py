from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException

from tablewright.operators.sql import limit_rows, register, sql_select


@pytest.fixture
def db(spark):
    register(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, s string"))
    spark.range(3).createOrReplaceTempView("other")
    return spark


@pytest.mark.parametrize(
    ("query", "rows"),
    [
        ("SELECT * FROM db", 3),
        ("select id from DB where s is not null;", 2),
        ("WITH t AS (SELECT id FROM db) SELECT * FROM t JOIN db d ON t.id = d.id -- done", 3),
        ("SELECT id FROM db WHERE id IN (SELECT max(id) FROM db)", 1),
        ("SELECT id FROM db UNION ALL SELECT id FROM db", 6),
        ("SELECT transform(array(id), x -> x + 1) AS xs FROM db", 3),
        ("SELECT 1 AS one", 1),
        ("WITH " + ", ".join(f"t{i} AS (SELECT id FROM db)" for i in range(40)) + " SELECT * FROM t30 JOIN t39 USING (id)", 3),
        ("SELECT id, x FROM db LATERAL VIEW explode(array(1, 2)) v AS x", 6),
    ],
)
def test_selects_run(db, query, rows):
    assert sql_select(db, query).count() == rows


def test_order_is_kept(db):
    assert [r[0] for r in sql_select(db, "SELECT id FROM db ORDER BY id DESC").collect()] == [3, 2, 1]


@pytest.mark.parametrize(
    "query",
    [
        "DROP VIEW db",
        "INSERT INTO db VALUES (4, 'd')",
        "CREATE TABLE t AS SELECT * FROM db",
        "FROM db INSERT INTO other SELECT id",
        "SELECT * FROM other",
        "SELECT * FROM db WHERE id IN (SELECT id FROM other)",
        "WITH other AS (SELECT * FROM other) SELECT * FROM other",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`",
        "SELECT reflect('java.lang.Math', 'abs', id) FROM db",
        "SELECT `java_method`('java.lang.Math', 'abs', id) FROM db",
        "SELECT TRANSFORM(id) USING 'cat' AS (z) FROM db",
        "SELECT count(*) FROM range(5)",
        "SELECT 1) a, (SELECT 2",
        "",
    ],
)
def test_anything_else_is_refused(db, query):
    with pytest.raises((ValueError, AnalysisException)):
        sql_select(db, query).collect()
    assert db.table("db").count() == 3


def test_view_over_a_view(db):
    register(db.table("other").filter("id > 0"))
    assert sql_select(db, "SELECT * FROM db").count() == 2


def test_limit(db):
    register(db.range(500))
    assert limit_rows(sql_select(db, "SELECT * FROM db")).count() == 100
