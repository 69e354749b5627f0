"""The registered queries, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL where SQL can express it."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded as in the SQL, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def outlier_steps(source: str, columns: list[str]) -> str:
    """SQL common table expressions `step1`, `step2`, ...: one outlier filter after the other."""
    steps = []
    for i, c in enumerate(columns, 1):
        before = source if i == 1 else f"step{i - 1}"
        steps.append(
            f"q{i} AS (SELECT quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b, "
            f"min({c}) lo, max({c}) hi FROM {before}), "
            f"step{i} AS (SELECT t.* FROM {before} t, q{i} WHERE lo = hi OR "
            f"{c} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))"
        )
    return ", ".join(steps)


from . import charts, cleaning, findings, models, profiling, sources, sql  # noqa: E402, F401
