"""Chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.order import first_rows
from tablewright.operators import charts as C
from tablewright.plans.charting import ChartSpec, write_charts
from tablewright.plans.charting import charts as make_charts
from tablewright.sources.workspace import scratch_path

from . import query, rounded, table


def _digest(*keys: str) -> str:
    """SQL: the digest of the keys and the seed that orders rows."""
    return "substr(md5(concat_ws('|', " + ", ".join(f"{k}::VARCHAR" for k in keys) + ", '42')), 1, 15)"


@query(
    f"SELECT * FROM lineitem ORDER BY {_digest('l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber, COLUMNS(*) LIMIT {C.SAMPLE_ROWS}"
)
def chart_sample(spark, sf):
    return C.sample_rows(table(spark, sf, "lineitem"), key=["l_orderkey", "l_linenumber"])


@query(
    f"""WITH s AS (SELECT * FROM lineitem QUALIFY row_number() OVER (ORDER BY {_digest('l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')})
                   <= ceil(0.5::DOUBLE * count(*) OVER ()))
        SELECT count(*) AS n, sum(l_orderkey)::BIGINT AS orders, round(sum(l_extendedprice), 2) AS price FROM s"""
)
def chart_sample_half(spark, sf):
    """Half of all rows, found by counting."""
    lines = table(spark, sf, "lineitem")
    half, _ = first_rows(lines, -(-lines.count() // 2), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 42)
    return half.agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("orders"), rounded(F.sum("l_extendedprice"), 2).alias("price")
    )


@query(
    f"SELECT user_id AS x, value AS y FROM events ORDER BY {_digest('event_id')}, event_id LIMIT {C.SCATTER_ROWS}"
)
def scatter(spark, sf):
    return C.scatter(table(spark, sf, "events"), "user_id", "value", key="event_id")


@query("SELECT p_brand AS x, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 20")
def bar_count(spark, sf):
    return C.bar_count(table(spark, sf, "part"), "p_brand")


@query(
    """SELECT user_id AS x, round(avg(value), 6) AS mean_y FROM events GROUP BY user_id
       ORDER BY avg(value) DESC, user_id LIMIT 20"""
)
def bar_mean(spark, sf):
    return C.bar_mean(table(spark, sf, "events"), "user_id", "value").withColumn("mean_y", rounded("mean_y"))


def _bins(column: str, source: str) -> str:
    """SQL: one row `b` with n, lo, hi, std, bins and width of the automatic histogram."""
    return f"""WITH s AS (SELECT count({column}) AS n, min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi,
                       stddev_samp({column}) AS std,
                       quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25) AS iqr FROM {source}),
       w AS (SELECT *, ceil((hi - lo) / least(greatest(2 * iqr / n ** (1.0 / 3), (hi - lo) / sqrt(n) / 2),
                                              (hi - lo) / (log2(n) + 1))) AS bins FROM s),
       b AS (SELECT *, (hi - lo) / bins AS width FROM w)"""


HISTOGRAM = """{bins}, h AS (SELECT least(floor(({column} - lo) / width), bins - 1)::BIGINT AS bin, count(*) AS n
                    FROM {source}, b WHERE {column} IS NOT NULL GROUP BY 1)
    SELECT bin, round(lo + bin * width, 6) AS "left", round(lo + (bin + 1) * width, 6) AS "right", h.n AS n
    FROM h, b"""


@query(HISTOGRAM.format(bins=_bins("value", "events"), column="value", source="events"))
def histogram(spark, sf):
    bins = C.histogram(table(spark, sf, "events"), "value")
    return bins.withColumns({"left": rounded("left"), "right": rounded("right")})


@query(HISTOGRAM.format(bins=_bins("l_extendedprice", "lineitem"), column="l_extendedprice", source="lineitem"))
def histogram_lineitem(spark, sf):
    bins = C.histogram(table(spark, sf, "lineitem"), "l_extendedprice")
    return bins.withColumns({"left": rounded("left"), "right": rounded("right")})


KDE = """{bins}, g AS (SELECT point::INTEGER AS point, lo + point * (hi - lo) / 199 AS x, std * n ** (-0.2) AS h,
                              b.n AS n, width
                       FROM b, generate_series(0, 199) AS t(point)),
       d AS (SELECT point, x, sum(exp(-0.5 * ((x - v) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density,
                    any_value(n * width) AS scale
             FROM g, (SELECT {column}::DOUBLE AS v FROM {source} WHERE {column} IS NOT NULL) GROUP BY point, x)
    SELECT point, round(x, 6) AS x, round(density, 9) AS density, round(density * scale, 4) AS height FROM d"""


def _density(df):
    return df.withColumns({"x": rounded("x"), "density": rounded("density", 9), "height": rounded("height", 4)})


@query(KDE.format(bins=_bins("value", "events"), column="value", source="events"))
def kde(spark, sf):
    return _density(C.kde(table(spark, sf, "events"), "value"))


@query(KDE.format(bins=_bins("c_acctbal", "customer"), column="c_acctbal", source="customer"))
def bar_numeric(spark, sf):
    _, density = C.bar_numeric(table(spark, sf, "customer"), "c_acctbal")
    return _density(density)


@query(
    """SELECT p_brand AS x, n, round(100.0 * n / sum(n) OVER (), 1) AS percent
       FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10)"""
)
def pie_share(spark, sf):
    return C.pie_share(table(spark, sf, "part"), "p_brand")


@query(
    """WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.5) AS m,
                         quantile_cont(n_chars, 0.75) AS b FROM documents),
       f AS (SELECT n_chars::DOUBLE AS x, n_chars BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) AS inside
             FROM documents, q)
       SELECT round(any_value(a), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(b), 6) AS q3,
              min(x) FILTER (inside) AS whisker_low, max(x) FILTER (inside) AS whisker_high,
              count(*) FILTER (NOT inside) AS fliers FROM f, q"""
)
def box_stats(spark, sf):
    box = C.box_stats(table(spark, sf, "documents"), "n_chars")
    return box.withColumns({c: rounded(c) for c in ("q1", "median", "q3")})


@query(
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
       SELECT value AS x FROM events, q WHERE value NOT BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)"""
)
def box_fliers(spark, sf):
    return C.box_fliers(table(spark, sf, "events"), "value")


@query(
    """SELECT x, y, coalesce(n, 0) AS n
       FROM (SELECT DISTINCT source AS x FROM documents) CROSS JOIN (SELECT DISTINCT lang AS y FROM documents)
       LEFT JOIN (SELECT source AS x, lang AS y, count(*) AS n FROM documents GROUP BY 1, 2) USING (x, y)"""
)
def crosstab(spark, sf):
    return C.crosstab(table(spark, sf, "documents"), "source", "lang")


@query("SELECT o_orderpriority AS x, o_orderstatus AS y, count(*) AS n FROM orders GROUP BY 1, 2")
def crosstab_counts(spark, sf):
    return C.crosstab_counts(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query(
    """SELECT l_returnflag AS x, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O"
       FROM lineitem GROUP BY l_returnflag"""
)
def crosstab_wide(spark, sf):
    return C.crosstab_wide(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    """WITH c AS (SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem)
       SELECT 'l_quantity' AS row, 'l_quantity' AS "column", 1.0::DOUBLE AS r
       UNION ALL SELECT 'l_quantity', 'l_extendedprice', r FROM c
       UNION ALL SELECT 'l_extendedprice', 'l_quantity', r FROM c
       UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0"""
)
def corr_pair(spark, sf):
    cells = C.corr_pair(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return cells.withColumn("r", rounded("r"))


@query(
    """SELECT p_size::DOUBLE AS x, round(avg(p_retailprice), 6) AS mean_y,
              round(avg(p_retailprice) - 1.96 * stddev_samp(p_retailprice) / sqrt(count(*)), 6) AS low,
              round(avg(p_retailprice) + 1.96 * stddev_samp(p_retailprice) / sqrt(count(*)), 6) AS high,
              count(*) AS n FROM part GROUP BY p_size"""
)
def line_series(spark, sf):
    line = C.line_series(table(spark, sf, "part"), "p_size", "p_retailprice")
    return line.withColumns({c: rounded(c) for c in ("mean_y", "low", "high")})


_WEIGHT = " + ".join(f"(u >= '{s}')::INTEGER" for s in C.poisson_steps())


@query(
    f"""WITH w AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y, r,
                         substr(md5(p_partkey::VARCHAR || '|42|' || (r // 4)::VARCHAR), 8 * (r % 4)::INTEGER + 1, 8) AS u
                  FROM part, range(200) AS t(r)),
       m AS (SELECT x, r, sum(({_WEIGHT}) * y) / sum({_WEIGHT}) AS m FROM w GROUP BY x, r HAVING sum({_WEIGHT}) > 0),
       b AS (SELECT x, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY x)
       SELECT x, round(mean_y, 6) AS mean_y, round(low, 6) AS low, round(high, 6) AS high, n
       FROM (SELECT p_size::DOUBLE AS x, avg(p_retailprice) AS mean_y, count(*) AS n FROM part GROUP BY 1) JOIN b USING (x)"""
)
def line_series_bootstrap(spark, sf):
    """The band of 200 resamplings."""
    line = C.line_series(table(spark, sf, "part"), "p_size", "p_retailprice", "bootstrap", "p_partkey", replicates=200)
    return line.withColumns({c: rounded(c) for c in ("mean_y", "low", "high")})


@query("SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part")
def area_series(spark, sf):
    return C.area_series(table(spark, sf, "part"), "p_size", "p_retailprice")


SPECS = [
    ChartSpec("user_id", "value", "Scatter Plot"),
    ChartSpec("event_type", None, "Bar Chart"),
    ChartSpec("user_id", "value", "Bar Chart"),
    ChartSpec("event_type", None, "Pie Chart"),
    ChartSpec("value", None, "Pie Chart"),
    ChartSpec("event_type", "props", "Heatmap"),
    ChartSpec("user_id", "value", "Heatmap"),
    ChartSpec("user_id", "event_type", "Heatmap"),
    ChartSpec("user_id", "value", "Area Chart"),
    ChartSpec("value", None, "Line Chart"),
    ChartSpec("value", None, "Violin Plot"),
    ChartSpec("price", None, "Histogram"),
]


@query(
    """SELECT * FROM (VALUES
         (0, 'user_id', 'value', 'Scatter Plot', 'done', 'points', 50),
         (1, 'event_type', NULL, 'Bar Chart', 'done', 'bars', (SELECT least(20, count(DISTINCT event_type)) FROM events)),
         (2, 'user_id', 'value', 'Bar Chart', 'done', 'bars', (SELECT least(20, count(DISTINCT user_id)) FROM events)),
         (3, 'event_type', NULL, 'Pie Chart', 'done', 'shares', (SELECT least(10, count(DISTINCT event_type)) FROM events)),
         (4, 'value', NULL, 'Pie Chart', 'skipped', NULL, NULL),
         (5, 'event_type', 'props', 'Heatmap', 'done', 'cells',
             (SELECT count(*) FROM (SELECT DISTINCT event_type, props FROM events
                                    WHERE event_type IS NOT NULL AND props IS NOT NULL))),
         (6, 'user_id', 'value', 'Heatmap', 'done', 'cells', 4),
         (7, 'user_id', 'event_type', 'Heatmap', 'skipped', NULL, NULL),
         (8, 'user_id', 'value', 'Area Chart', 'done', 'area', (SELECT count(*) FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)),
         (9, 'value', NULL, 'Line Chart', 'skipped', NULL, NULL),
         (10, 'value', NULL, 'Violin Plot', 'skipped', NULL, NULL),
         (11, 'price', NULL, 'Histogram', 'skipped', NULL, NULL))
       AS t(position, x_axis, y_axis, chart_type, status, part, rows)"""
)
def charts(spark, sf):
    status = write_charts(table(spark, sf, "events"), SPECS, scratch_path(spark, "charts"), key="event_id")
    return status.drop("path", "reason")


@query()
def charts_sampled(spark, sf):
    specs = [
        ChartSpec("value", None, "Histogram", sample=C.SAMPLE_ROWS),
        ChartSpec("event_type", None, "Histogram", sample=C.SAMPLE_ROWS),
        ChartSpec("value", None, "Box Plot", sample=C.SAMPLE_ROWS),
        ChartSpec("user_id", "value", "Line Chart", sample=C.SAMPLE_ROWS),
        ChartSpec("value", None, "Bar Chart"),
    ]
    status = write_charts(table(spark, sf, "events"), specs, scratch_path(spark, "charts"), key="event_id")
    return status.drop("path", "reason")


def _chart(spark, sf, name, part, *spec):
    (chart,) = make_charts(table(spark, sf, name), [ChartSpec(*spec)])
    return chart.data[part]


@query(HISTOGRAM.format(bins=_bins("o_totalprice", "orders"), column="o_totalprice", source="orders"))
def charts_histogram(spark, sf):
    bins = _chart(spark, sf, "orders", "bars", "o_totalprice", None, "Histogram")
    return bins.withColumns({"left": rounded("left"), "right": rounded("right")})


@query(
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
       SELECT l_extendedprice AS x FROM lineitem, q
       WHERE l_extendedprice NOT BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)"""
)
def charts_box(spark, sf):
    return _chart(spark, sf, "lineitem", "fliers", "l_extendedprice", None, "Box Plot")


@query(
    """SELECT l_quantity::DOUBLE AS x, round(avg(l_extendedprice), 4) AS mean_y,
              round(avg(l_extendedprice) - 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)), 4) AS low,
              round(avg(l_extendedprice) + 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)), 4) AS high,
              count(*) AS n FROM lineitem GROUP BY l_quantity"""
)
def charts_line(spark, sf):
    line = _chart(spark, sf, "lineitem", "line", "l_quantity", "l_extendedprice", "Line Chart")
    return line.withColumns({c: rounded(c, 4) for c in ("mean_y", "low", "high")})


@query("SELECT user_id::DOUBLE AS x, value AS y FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL")
def charts_area(spark, sf):
    return _chart(spark, sf, "events", "area", "user_id", "value", "Area Chart")


@query("SELECT event_type AS x, props AS y, count(*) AS n FROM events WHERE event_type IS NOT NULL AND props IS NOT NULL GROUP BY 1, 2")
def charts_heatmap(spark, sf):
    return _chart(spark, sf, "events", "cells", "event_type", "props", "Heatmap")
