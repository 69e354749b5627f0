"""The shapes of SELECT a user can send to the view `db`."""

from __future__ import annotations

from tablewright.operators.sql import limit_rows as limit_plan
from tablewright.operators.sql import register, sql_select

from . import query, table


def _on(spark, sf, name: str, text: str):
    register(table(spark, sf, name))
    return sql_select(spark, text)


PROJECTION = """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
       CASE WHEN l_quantity >= 25 THEN 'bulk' ELSE 'piece' END AS kind FROM {db}"""


@query(PROJECTION.format(db="lineitem"))
def sql_projection(spark, sf):
    return _on(spark, sf, "lineitem", PROJECTION.format(db="db"))


FILTER = """SELECT o_orderkey, o_custkey, o_totalprice FROM {db}
       WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('F', 'O')
         AND o_orderpriority ILIKE '%urgent' AND o_custkey IS NOT NULL"""


@query(FILTER.format(db="orders"))
def sql_filter(spark, sf):
    return _on(spark, sf, "orders", FILTER.format(db="db"))


GROUPS = """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty,
       round(avg(l_extendedprice), 4) AS avg_price, min(l_tax) AS min_tax, max(l_discount) AS max_discount
       FROM {db} GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10"""


@query(GROUPS.format(db="lineitem"))
def sql_group_by(spark, sf):
    return _on(spark, sf, "lineitem", GROUPS.format(db="db"))


DISTINCT = """SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders
       FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_orderkey FROM {db}) t GROUP BY l_returnflag"""


@query(DISTINCT.format(db="lineitem"))
def sql_distinct(spark, sf):
    return _on(spark, sf, "lineitem", DISTINCT.format(db="db"))


TOP = "SELECT o_orderkey, o_custkey, o_totalprice FROM {db} ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"


@query(TOP.format(db="orders"))
def sql_top_k(spark, sf):
    return _on(spark, sf, "orders", TOP.format(db="db"))


SUBQUERY = """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {db} GROUP BY o_custkey)
       SELECT o_orderkey, o_custkey, o_totalprice FROM {db} o
       WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {db})
         AND o_custkey IN (SELECT o_custkey FROM big WHERE total > 1000000)
         AND o_totalprice > (SELECT avg(i.o_totalprice) FROM {db} i WHERE i.o_custkey = o.o_custkey)"""


@query(SUBQUERY.format(db="orders"))
def sql_subquery(spark, sf):
    return _on(spark, sf, "orders", SUBQUERY.format(db="db"))


JOIN = """SELECT a.o_orderkey, f.first_key, b.o_totalprice AS cheaper_first
       FROM {db} a
       JOIN (SELECT o_custkey, min(o_orderkey) AS first_key FROM {db} GROUP BY o_custkey) f
         ON a.o_custkey = f.o_custkey
       LEFT JOIN {db} b ON b.o_orderkey = f.first_key AND b.o_totalprice < a.o_totalprice"""


@query(JOIN.format(db="orders"))
def sql_self_join(spark, sf):
    return _on(spark, sf, "orders", JOIN.format(db="db"))


SETS = """SELECT o_custkey FROM {db} WHERE o_orderstatus = 'F'
       INTERSECT SELECT o_custkey FROM {db} WHERE o_orderstatus = 'O'
       EXCEPT SELECT o_custkey FROM {db} WHERE o_totalprice > 490000
       UNION ALL SELECT o_custkey FROM {db} WHERE o_orderpriority = '1-URGENT'"""


@query(SETS.format(db="orders"))
def sql_set_operations(spark, sf):
    return _on(spark, sf, "orders", SETS.format(db="db"))


WINDOW = """SELECT o_orderkey, o_custkey,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS nth,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running
       FROM {db}"""


@query(WINDOW.format(db="orders"))
def sql_window(spark, sf):
    return _on(spark, sf, "orders", WINDOW.format(db="db"))


@query(
    """SELECT upper(substr(p_brand, 1, 8)) AS brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types,
              sum(length(p_name))::BIGINT AS letters, max(p_brand || '/' || p_type) AS last_pair
       FROM part GROUP BY upper(substr(p_brand, 1, 8))"""
)
def sql_strings(spark, sf):
    return _on(
        spark,
        sf,
        "part",
        """SELECT upper(substr(p_brand, 1, 8)) AS brand,
                  listagg(DISTINCT p_type, ',') WITHIN GROUP (ORDER BY p_type) AS types,
                  sum(length(p_name)) AS letters, max(p_brand || '/' || p_type) AS last_pair
           FROM db GROUP BY upper(substr(p_brand, 1, 8))""",
    )


@query(
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(avg(o_totalprice), 4) AS avg_price
       FROM orders GROUP BY 1"""
)
def sql_dates(spark, sf):
    return _on(
        spark,
        sf,
        "orders",
        """SELECT date_format(o_orderdate, 'yyyy-MM') AS month, count(*) AS n, round(avg(o_totalprice), 4) AS avg_price
           FROM db GROUP BY date_format(o_orderdate, 'yyyy-MM')""",
    )


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 100")
def limit_rows(spark, sf):
    ordered = _on(spark, sf, "lineitem", "SELECT l_orderkey, l_linenumber FROM db ORDER BY l_orderkey, l_linenumber")
    return limit_plan(ordered)
