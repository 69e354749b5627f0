"""Statistics, columns, shape and first rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import profiling as P
from tablewright.plans.insight import insight_inputs as insight_plan
from tablewright.plans.preprocess import preprocess

from . import query, rounded, table

MEASURES = ["mean", "std", "min", "q25", "q50", "q75", "max"]


def _numeric(position: int, column: str, source: str) -> str:
    return f"""SELECT {position} AS position, '{column}' AS "column", count({column}) AS count,
        NULL::BIGINT AS "unique", NULL::VARCHAR AS top, NULL::BIGINT AS freq,
        round(avg({column}), 4) AS mean, round(stddev_samp({column}), 4) AS std,
        round(min({column})::DOUBLE, 4) AS min, round(quantile_cont({column}, 0.25), 4) AS q25,
        round(quantile_cont({column}, 0.5), 4) AS q50, round(quantile_cont({column}, 0.75), 4) AS q75,
        round(max({column})::DOUBLE, 4) AS max FROM {source}"""


def _category(position: int, column: str, source: str) -> str:
    return f"""SELECT {position}, '{column}', sum(n)::BIGINT, count(*), arg_min(v, (-n, v)), max(n),
        NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE
        FROM (SELECT {column} AS v, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY {column})"""


EVENTS = " UNION ALL ".join(
    [
        _numeric(0, "event_id", "events"),
        _numeric(1, "user_id", "events"),
        _category(2, "event_type", "events"),
        _numeric(3, "value", "events"),
        _category(4, "props", "events"),
    ]
)


@query(EVENTS)
def describe_all_events(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    return P.describe_all(events).withColumns({c: rounded(c, 4) for c in MEASURES})


LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    f"""SELECT position, "column", count, mean, std, min, q25, q50, q75, max
        FROM ({" UNION ALL ".join(_numeric(i, c, "lineitem") for i, c in enumerate(LINES))})"""
)
def describe_numeric_lineitem(spark, sf):
    return P.describe_numeric(table(spark, sf, "lineitem")).withColumns({c: rounded(c, 4) for c in MEASURES})


LONG = """WITH w AS ({wide}), d AS (SELECT "column", count::DOUBLE AS count, "unique"::DOUBLE AS "unique",
              freq::DOUBLE AS freq, mean, std, min, q25, q50, q75, max FROM w)
       SELECT "column", stat, value, NULL::VARCHAR AS text
       FROM (UNPIVOT d ON count, "unique", freq, mean, std, min, q25, q50, q75, max INTO NAME stat VALUE value)
       UNION ALL SELECT "column", 'top', NULL, top FROM w WHERE top IS NOT NULL"""
DOCUMENTS = " UNION ALL ".join(
    [
        _numeric(0, "doc_id", "documents"),
        _category(1, "text", "documents"),
        _category(2, "lang", "documents"),
        _category(3, "source", "documents"),
        _numeric(4, "n_chars", "documents"),
    ]
)


@query(LONG.format(wide=DOCUMENTS))
def describe_long_documents(spark, sf):
    return P.describe_long(table(spark, sf, "documents")).withColumn("value", rounded("value", 4))


@query(
    """SELECT * FROM (VALUES (0, 'event_id'), (1, 'ts'), (2, 'user_id'), (3, 'event_type'), (4, 'value'), (5, 'props'))
       AS t(position, name)"""
)
def columns_clean(spark, sf):
    gaps = table(spark, sf, "events").withColumn("nothing", F.lit(None).cast("double"))
    return P.columns(preprocess(gaps))


@query("SELECT count(*) AS rows, 11 AS columns FROM lineitem")
def shape(spark, sf):
    return P.shape(table(spark, sf, "lineitem"))


@query("SELECT * FROM part ORDER BY p_partkey LIMIT 5")
def head(spark, sf):
    return P.head(table(spark, sf, "part"), "p_partkey")


SAMPLE = """SELECT row_number() OVER (ORDER BY c_custkey)::INTEGER AS position,
        'column' || row_number() OVER (ORDER BY c_custkey) || ' = {''c_custkey'': ' || c_custkey || ', ''c_name'': '
        || c_name || ', ''c_nationkey'': ' || c_nationkey || ', ''c_acctbal'': ' || c_acctbal
        || ', ''c_mktsegment'': ' || c_mktsegment || '},' AS line
    FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)"""


@query(SAMPLE)
def sample_text(spark, sf):
    return P.sample_text(table(spark, sf, "customer"), "c_custkey")


@query(
    f"""SELECT position, "column", count, mean, std, min, q25, q50, q75, max
        FROM ({_numeric(0, "s_suppkey", "supplier")} UNION ALL {_numeric(1, "s_nationkey", "supplier")}
              UNION ALL {_numeric(2, "s_acctbal", "supplier")})"""
)
def profile_describe(spark, sf):
    found = P.profile(table(spark, sf, "supplier"), "Please describe the statistics")
    return found.withColumns({c: rounded(c, 4) for c in MEASURES})


@query("SELECT count(*) AS rows, 6 AS columns FROM orders")
def profile_shape(spark, sf):
    return P.profile(table(spark, sf, "orders"), "What is its size?")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def profile_sample(spark, sf):
    return P.profile(table(spark, sf, "orders"), "show a sample", key="o_orderkey")


CUSTOMERS = " UNION ALL ".join(
    [
        _numeric(0, "c_custkey", "customer"),
        _category(1, "c_name", "customer"),
        _numeric(2, "c_nationkey", "customer"),
        _numeric(3, "c_acctbal", "customer"),
        _category(4, "c_mktsegment", "customer"),
    ]
)


@query(
    f"""SELECT 'sample' AS section, position, NULL::VARCHAR AS item, NULL::DOUBLE AS value, line AS text FROM ({SAMPLE})
        UNION ALL SELECT 'columns', position, name, NULL, NULL
          FROM (VALUES (0, 'c_custkey'), (1, 'c_name'), (2, 'c_nationkey'), (3, 'c_acctbal'), (4, 'c_mktsegment'))
          AS t(position, name)
        UNION ALL SELECT 'statistics', NULL, "column" || '.' || stat, value, text FROM ({LONG.format(wide=CUSTOMERS)})"""
)
def insight_inputs(spark, sf):
    return insight_plan(table(spark, sf, "customer"), "c_custkey").withColumn("value", rounded("value", 4))
