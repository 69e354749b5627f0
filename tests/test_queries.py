"""Every registered query against its SQL, and the shape of the plans."""

from __future__ import annotations

import importlib
import re

import pytest

duckdb = pytest.importorskip("duckdb")
entry_point = importlib.import_module("__spark_entry__")

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
# Boosting trains for minutes at its real settings; tests/test_models.py covers its path.
SLOW = {"model_large_classifier", "model_large_regressor", "model_middle_classifier", "model_middle_regressor"}
TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    yield con
    con.close()


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([r[i] for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_matches_sql(spark, duck, sf, name):
    df = entry_point.queries()[name](spark, sf)
    answer = duck.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in answer.description}
    assert sorted(df.columns) == sorted(names)
    assert dict(df.dtypes) == types
    assert normal(df.columns, df.collect()) == normal(names, answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) - set(entry_point.oracle_sql()) - SLOW))
def test_runs_without_sql(spark, sf, name):
    assert not entry_point.queries()[name](spark, sf).isEmpty()


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name",
    "crosstab kde histogram bar_mean correlations group_profile describe_long_documents eval_classification "
    "sql_subquery sql_self_join preprocess label_encode assemble".split(),
)
def test_no_cross_product(spark, sf, capsys, name):
    entry_point.queries()[name](spark, sf).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan
    assert "Cross" not in plan


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("histogram", {"value"}),
        ("bar_count", {"p_brand"}),
        ("bar_mean", {"user_id", "value"}),
        ("crosstab_counts", {"o_orderpriority", "o_orderstatus"}),
        ("line_series", {"p_size", "p_retailprice"}),
        ("corr_pair", {"l_quantity", "l_extendedprice"}),
        ("box_stats", {"n_chars"}),
        ("scatter", {"event_id", "user_id", "value"}),
    ],
)
def test_scans_read_only_what_is_used(spark, sf, capsys, name, columns):
    entry_point.queries()[name](spark, sf).explain()
    plan = capsys.readouterr().out
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas
    for schema in schemas:
        assert {c.split(":")[0] for c in schema.split(",")} <= columns
