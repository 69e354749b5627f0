"""Read-only SQL over one registered view.

`sql_select` is a guard against mistakes and stray statements, not a sandbox.
Spark itself parses and analyses the query; the guard only wraps it as a
subquery, which no other statement survives, and reads from `EXPLAIN` which
relations it uses.
"""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

VIEW = "db"
WIDTH = "spark.sql.debug.maxToStringFields"

# Functions that call arbitrary Java methods.
FORBIDDEN = re.compile(r"\b(java_method|reflect|try_reflect)\b", re.IGNORECASE)
_RELATION = re.compile(r"UnresolvedRelation \[([^\]]*)\]")
_WITH = re.compile(r"CTE \[([^\]]*)\]")
_VIEW_NODE = re.compile(r"View \(`([^`]*)`")
_TABLE_NODE = re.compile(r"SubqueryAlias (spark_catalog\.\S+)")


def register(df: DataFrame, name: str = VIEW) -> DataFrame:
    """Make the table available to `sql_select`, replacing an earlier one."""
    df.createOrReplaceTempView(name)
    return df


def sql_select(spark: SparkSession, query: str, view: str = VIEW) -> DataFrame:
    """Run a SELECT that reads only `view`; anything else is a ValueError."""
    query = query.strip().rstrip(";")
    if FORBIDDEN.search(query):
        raise ValueError("the query calls Java methods")
    wrapped = f"SELECT * FROM (\n{query}\n) AS answer"
    parsed, analysed = _plans(spark, wrapped)
    _plans(spark, query)  # whole by itself, not only inside the brackets
    _, allowed = _plans(spark, f"SELECT * FROM {view}")
    if "ScriptTransformation" in parsed:
        raise ValueError("the query runs a script")
    if "'UnresolvedTableValuedFunction [" in parsed:
        raise ValueError(f"the query reads a table function; only {view!r} is available")
    named = set(_RELATION.findall(parsed))
    named -= {name.strip() for names in _WITH.findall(parsed) for name in names.split(",")}
    used = set(_VIEW_NODE.findall(analysed)) | set(_TABLE_NODE.findall(analysed))
    known = set(_VIEW_NODE.findall(allowed)) | set(_TABLE_NODE.findall(allowed))
    stray = sorted({n for n in named if n.lower() != view.lower()} | (used - known))
    if stray:
        raise ValueError(f"the query reads {', '.join(stray)}; only {view!r} is available")
    return spark.sql(wrapped)


def _plans(spark: SparkSession, query: str) -> tuple[str, str]:
    width = spark.conf.get(WIDTH)
    spark.conf.set(WIDTH, 1_000_000)  # no list of names is abbreviated
    try:
        text = spark.sql(f"EXPLAIN EXTENDED {query}").first()[0]
    except ParseException as e:
        raise ValueError(f"not a SELECT: {e}") from e
    finally:
        spark.conf.set(WIDTH, width)
    parsed, _, rest = text.partition("== Analyzed Logical Plan ==")
    analysed, _, _ = rest.partition("== Optimized Logical Plan ==")
    if not analysed.strip():
        raise ValueError(f"the query cannot be analysed: {text.strip()}")
    return parsed, analysed


def limit_rows(df: DataFrame, k: int = 100) -> DataFrame:
    """At most `k` rows of an answer."""
    return df.limit(k)
