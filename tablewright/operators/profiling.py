"""What a table holds: statistics, columns, types, shape, first rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import batches, col, is_numeric, is_text, number, numeric_columns, present
from ..functions.quantiles import exact_quantiles
from .cleaning import LONG_TEXT_BYTES, most_frequent

STATISTICS = (
    "position int, column string, count bigint, unique bigint, top string, freq bigint, "
    "mean double, std double, min double, q25 double, q50 double, q75 double, max double"
)


def _is_category(dtype: T.DataType) -> bool:
    return is_text(dtype) or isinstance(
        dtype, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    )


def describe_all(df: DataFrame) -> DataFrame:
    """One row of statistics per column.

    Numeric columns have mean to max, all others unique, top and freq; columns
    of nested types have only the count. Standard deviation is the sample form.
    """
    fields = df.schema.fields
    basics: dict[str, dict] = {}
    for chunk in batches(fields, per_item=5):
        aggregates = []
        for i, f in enumerate(chunk):
            aggregates.append(F.count(present(f)).alias(f"count{i}"))
            if is_text(f.dataType):
                aggregates.append(F.avg(F.octet_length(col(f.name))).alias(f"bytes{i}"))
            elif is_numeric(f.dataType):
                x = number(df, f.name)
                for name, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
                    aggregates.append(fn(x).alias(f"{name}{i}"))
        row = df.agg(*aggregates).first().asDict()
        for i, f in enumerate(chunk):
            basics[f.name] = {k: row.get(f"{k}{i}") for k in ("count", "bytes", "mean", "std", "min", "max")}

    numeric = [f.name for f in fields if is_numeric(f.dataType)]
    quartiles = exact_quantiles(
        df, {c: [0.25, 0.5, 0.75] for c in numeric}, {c: basics[c]["count"] for c in numeric}
    )
    categories = [f.name for f in fields if _is_category(f.dataType)]
    long = [c for c in categories if (basics[c]["bytes"] or 0) > LONG_TEXT_BYTES]
    tops = {r["column"]: r for r in most_frequent(df, categories, long).collect()} if categories else {}

    rows = []
    for i, f in enumerate(fields):
        b, q, t = basics[f.name], quartiles.get(f.name, [None] * 3), tops.get(f.name)
        category = (t["unique"], t["top"], t["freq"]) if t else (None, None, None)
        rows.append((i, f.name, b["count"], *category, b["mean"], b["std"], b["min"], *q, b["max"]))
    return df.sparkSession.createDataFrame(rows, STATISTICS)


def describe_numeric(df: DataFrame) -> DataFrame:
    """The numeric columns' statistics; of all columns if none is numeric."""
    names = numeric_columns(df)
    if not names:
        return describe_all(df)
    return describe_all(df.select(*[col(c) for c in names])).drop("unique", "top", "freq")


def describe_long(df: DataFrame) -> DataFrame:
    """(column, stat, value, text): one row per statistic that a column has."""
    wide = describe_all(df)
    numbers = ["count", "unique", "freq", "mean", "std", "min", "q25", "q50", "q75", "max"]
    doubles = wide.select("column", *[F.col(c).cast("double").alias(c) for c in numbers])
    none = F.lit(None)
    return (
        doubles.unpivot("column", numbers, "stat", "value")
        .withColumn("text", none.cast("string"))
        .unionByName(
            wide.select("column", F.lit("top").alias("stat"), none.cast("double").alias("value"), F.col("top").alias("text"))
        )
        .filter("value IS NOT NULL OR text IS NOT NULL")
    )


def columns(df: DataFrame) -> DataFrame:
    """(position, name)."""
    return df.sparkSession.createDataFrame(list(enumerate(df.columns)), "position int, name string")


def dtypes(df: DataFrame) -> DataFrame:
    """(position, column, dtype)."""
    rows = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def shape(df: DataFrame) -> DataFrame:
    """(rows, columns), one row."""
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"))


def head(df: DataFrame, key: str | list[str], n: int = 5) -> DataFrame:
    """The first rows in `key` order; a distributed table has no order of its own."""
    keys = [key] if isinstance(key, str) else key
    return df.orderBy(*[col(k) for k in keys]).limit(n)


def sample_text(df: DataFrame, key: str | list[str], n: int = 5) -> DataFrame:
    """(position, line): the first rows as `column1 = {'name': value, ...},`."""
    first = head(df, key, n)
    pairs = [
        F.concat(F.lit(f"{name!r}: "), F.coalesce(col(name).cast("string"), F.lit("nan")))
        for name in df.columns
    ]
    keys = [key] if isinstance(key, str) else key
    numbered = first.select(F.struct(*[col(k) for k in keys]).alias("k"), F.concat_ws(", ", *pairs).alias("body"))
    # At most n rows: gather and number them.
    lines = numbered.agg(F.sort_array(F.collect_list(F.struct("k", "body"))).alias("rows"))
    return lines.select(F.posexplode("rows").alias("position", "row")).select(
        (F.col("position") + 1).alias("position"),
        F.concat(
            F.lit("column"), (F.col("position") + 1).cast("string"), F.lit(" = {"), F.col("row.body"), F.lit("},")
        ).alias("line"),
    )


# The words in a question that choose its answer, in order of precedence.
KINDS = [
    (("describe", "statistics"), "statistics"),
    (("columns", "fields"), "columns"),
    (("shape", "size"), "shape"),
    (("sample",), "sample"),
]


def profile(df: DataFrame, kind: str, key: str | list[str] | None = None) -> DataFrame:
    """Answer a question about the table: statistics, columns, shape or a sample."""
    asked = kind.lower()
    found = next((answer for words, answer in KINDS if any(w in asked for w in words)), None)
    if found == "statistics":
        return describe_numeric(df)
    if found == "columns":
        return columns(df)
    if found == "shape":
        return shape(df)
    if found == "sample":
        return head(df, key or df.columns)
    raise ValueError(f"cannot answer {kind!r}; ask for statistics, columns, shape or a sample")
