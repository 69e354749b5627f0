"""Empty columns, imputation, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import cleaning as C
from tablewright.plans.preprocess import preprocess as preprocess_plan

from . import outlier_steps, query, rounded, table

GAPS = """SELECT event_id, ts, user_id, nullif(event_type, 'click') AS event_type,
                 CASE WHEN value >= 20 THEN value END AS value, props FROM events"""


def _events_with_gaps(spark, sf):
    return table(spark, sf, "events").withColumns(
        {
            "event_type": F.nullif("event_type", F.lit("click")),
            "value": F.when(F.col("value") >= 20, F.col("value")),
            "nothing": F.lit(None).cast("double"),
        }
    )


@query(GAPS)
def drop_empty_columns(spark, sf):
    return C.drop_empty_columns(_events_with_gaps(spark, sf))


@query(
    """SELECT l_orderkey, l_linenumber AS line,
              round(coalesce(nullif(l_linenumber, 3)::DOUBLE, (SELECT avg(nullif(l_linenumber, 3)) FROM lineitem)), 6)
                AS filled,
              l_quantity FROM lineitem"""
)
def impute_mean(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").alias("line"),
        F.nullif("l_linenumber", F.lit(3)).alias("filled"),
        "l_quantity",
    )
    return C.impute_mean(lines).withColumn("filled", rounded("filled"))


@query(
    """SELECT o_orderkey, o_orderstatus,
              coalesce(nullif(o_orderpriority, '5-LOW'),
                       (SELECT o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'
                        GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority
       FROM orders"""
)
def impute_mode(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority")
    )
    return C.impute_mode(orders)


@query(
    f"""WITH gaps AS ({GAPS}), n AS (SELECT count(*) - count(event_type) AS types, count(*) - count(value) AS values_,
                 count(*) FILTER (event_type IS NULL) AS dates, count(*) AS rows_ FROM gaps)
        SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS position,
               unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props', 'nothing']) AS "column",
               unnest([0, dates, 0, types, values_, 0, rows_]) AS missing,
               unnest(['none', 'skip', 'none', 'mode', 'mean', 'none', 'drop']) AS action FROM n"""
)
def impute_report(spark, sf):
    events = _events_with_gaps(spark, sf)
    return C.impute_report(events.withColumn("ts", F.when(F.col("event_type").isNotNull(), F.col("ts"))))


@query(
    """SELECT 'value' AS "column", round(a, 6) AS q1, round(b, 6) AS q3,
              round(a - 1.5 * (b - a), 6) AS lower, round(b + 1.5 * (b - a), 6) AS upper
       FROM (SELECT quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b FROM events)"""
)
def iqr_bounds(spark, sf):
    b = C.iqr_bounds(table(spark, sf, "events"), "value")
    row = spark.createDataFrame(
        [(b.column, b.q1, b.q3, b.lower, b.upper)],
        "column string, q1 double, q3 double, lower double, upper double",
    )
    return row.select("column", *[rounded(c).alias(c) for c in ("q1", "q3", "lower", "upper")])


@query(f"""WITH {outlier_steps("events", ["event_id", "user_id", "value"])} SELECT * FROM step3""")
def remove_outliers_events(spark, sf):
    return C.remove_outliers(table(spark, sf, "events"))


@query(f"""WITH {outlier_steps("documents", ["doc_id", "n_chars"])} SELECT * FROM step2""")
def remove_outliers_documents(spark, sf):
    return C.remove_outliers(table(spark, sf, "documents"))


@query(
    f"""WITH {outlier_steps("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                         "l_extendedprice", "l_discount", "l_tax"])}
        SELECT l_orderkey, l_linenumber, l_extendedprice FROM step8"""
)
def remove_outliers_lineitem(spark, sf):
    return C.remove_outliers(table(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    f"""WITH {outlier_steps("events", ["event_id", "user_id", "value"])},
        n AS (SELECT (SELECT count(*) FROM events) n0, (SELECT count(*) FROM step1) n1,
                     (SELECT count(*) FROM step2) n2, (SELECT count(*) FROM step3) n3),
        r AS (SELECT 0 AS position, 'event_id' AS "column", q1.a, q1.b, n0 AS rows_before, n1 AS rows_after FROM q1, n
              UNION ALL SELECT 1, 'user_id', q2.a, q2.b, n1, n2 FROM q2, n
              UNION ALL SELECT 2, 'value', q3.a, q3.b, n2, n3 FROM q3, n)
        SELECT position, "column", round(a, 6) AS q1, round(b, 6) AS q3, round(a - 1.5 * (b - a), 6) AS lower,
               round(b + 1.5 * (b - a), 6) AS upper, rows_before, rows_after FROM r"""
)
def outlier_report(spark, sf):
    report = C.outlier_report(table(spark, sf, "events"))
    return report.withColumns({c: rounded(c) for c in ("q1", "q3", "lower", "upper")})


@query(
    """WITH b AS (SELECT quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b FROM events)
       SELECT event_id, value, value NOT BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) AS value_outlier
       FROM events, b"""
)
def flag_outliers(spark, sf):
    return C.flag_outliers(table(spark, sf, "events").select("event_id", "value"), ["value"])


PREPROCESSED = f"""WITH gaps AS ({GAPS}), filled AS (
      SELECT event_id, ts, user_id,
             coalesce(event_type, (SELECT event_type FROM gaps WHERE event_type IS NOT NULL
                                   GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type,
             coalesce(value, (SELECT avg(value) FROM gaps)) AS value, props FROM gaps),
    {outlier_steps("filled", ["event_id", "user_id", "value"])}"""


@query(f"{PREPROCESSED} SELECT event_id, ts, user_id, event_type, round(value, 6) AS value, props FROM step3")
def preprocess(spark, sf):
    return preprocess_plan(_events_with_gaps(spark, sf)).withColumn("value", rounded("value"))


@query(
    f"""{PREPROCESSED} SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share,
               round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM step3 GROUP BY event_type"""
)
def clean_group_profile(spark, sf):
    """The flagship: clean a table, then profile a measure per group."""
    from tablewright.operators.findings import group_profile

    found = group_profile(preprocess_plan(_events_with_gaps(spark, sf)), "event_type", "value")
    return found.withColumns({c: rounded(c) for c in ("share", "mean", "median")})
