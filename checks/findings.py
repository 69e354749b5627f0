"""Correlations, distributions, groups and trends."""

from __future__ import annotations

from itertools import combinations

from tablewright.operators import findings as G

from . import query, rounded, table

LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem"
        for a, b in combinations(LINES, 2)
    )
)
def correlations(spark, sf):
    return G.correlations(table(spark, sf, "lineitem")).withColumn("r", rounded("r"))


@query(
    """SELECT 'event_id' AS x, 'value' AS y, round(corr(event_id, CASE WHEN value >= 20 THEN value END), 6) AS r FROM events
       UNION ALL SELECT 'event_id', 'one', NULL UNION ALL SELECT 'value', 'one', NULL"""
)
def correlations_gaps(spark, sf):
    """Pairs with missing values and with a constant column."""
    gaps = table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN value >= 20 THEN value END AS value", "1 AS one"
    )
    return G.correlations(gaps).withColumn("r", rounded("r"))


_GAPS = {f"{c}_{g}": f"CASE WHEN l_linenumber <> {g} THEN {c} END" for c in LINES[4:] for g in (1, 2)}


@query(
    "WITH w AS (SELECT "
    + ", ".join([*LINES, *(f"{e} AS {c}" for c, e in _GAPS.items())])
    + " FROM lineitem), t AS (SELECT "
    + ", ".join(f"corr({a}, {b}) AS r{i}" for i, (a, b) in enumerate(combinations([*LINES, *_GAPS], 2)))
    + " FROM w) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(r{i}, 6) + 0.0 AS r FROM t"
        for i, (a, b) in enumerate(combinations([*LINES, *_GAPS], 2))
    )
)
def correlations_wide(spark, sf):
    """120 pairs of 16 columns, half of them with gaps, in one scan."""
    wide = table(spark, sf, "lineitem").selectExpr(*LINES, *(f"{e} AS {c}" for c, e in _GAPS.items()))
    return G.correlations(wide).withColumn("r", rounded("r"))


def _distribution(column: str, source: str) -> str:
    return f"""WITH m AS (SELECT count({column}) AS n, avg({column}) AS mean, median({column})::DOUBLE AS median,
                       stddev_pop({column}) AS std FROM {source}),
         k AS (SELECT avg((({column} - mean) / std) ** 3) AS skew FROM {source}, m)
       SELECT '{column}' AS "column", n, round(mean, 6) AS mean, round(median, 6) AS median,
              round(skew, 6) AS skewness,
              CASE WHEN skew > 0 THEN 'right' WHEN skew < 0 THEN 'left' ELSE 'symmetric' END AS direction FROM m, k"""


@query(_distribution("value", "events"))
def distribution(spark, sf):
    found = G.distribution(table(spark, sf, "events"), "value")
    return found.withColumns({c: rounded(c) for c in ("mean", "median", "skewness")})


@query(_distribution("o_totalprice", "orders"))
def distribution_orders(spark, sf):
    found = G.distribution(table(spark, sf, "orders"), "o_totalprice")
    return found.withColumns({c: rounded(c) for c in ("mean", "median", "skewness")})


def _groups(group: str, value: str, source: str) -> str:
    return f"""SELECT {group}, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share,
                      round(avg({value}), 6) AS mean, round(median({value}), 6) AS median
               FROM {source} GROUP BY {group}"""


@query(_groups("event_type", "value", "events"))
def group_profile(spark, sf):
    found = G.group_profile(table(spark, sf, "events"), "event_type", "value")
    return found.withColumns({c: rounded(c) for c in ("share", "mean", "median")})


@query(_groups("l_returnflag", "l_extendedprice", "lineitem"))
def group_profile_lineitem(spark, sf):
    found = G.group_profile(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")
    return found.withColumns({c: rounded(c) for c in ("share", "mean", "median")})


@query(
    """SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 6)
              AS intercept, round(regr_r2(p_retailprice, p_size), 6) AS r2, count(*) AS n FROM part"""
)
def trend(spark, sf):
    found = G.trend(table(spark, sf, "part"), "p_size", "p_retailprice")
    return found.withColumns({c: rounded(c) for c in ("slope", "intercept", "r2")})
