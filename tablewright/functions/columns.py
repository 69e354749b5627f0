"""Column references, type dispatch and missing-value rules.

A missing value is NULL everywhere in this package. Float columns read from
Parquet can also hold NaN; `present` turns those into NULL so that `avg`,
`count` and the quantiles skip them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Aggregate expressions per job. Few wide jobs beat many narrow ones, but the
# generated code of a very wide aggregate is too large to be compiled to machine
# code. Each job of a split reads only its own columns.
AGGREGATES_PER_JOB = 64


def col(name: str) -> Column:
    """Reference a column by its literal name (`x.1` and `Unnamed: 4` are legal names)."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field(df: DataFrame, name: str) -> T.StructField:
    for f in df.schema.fields:
        if f.name == name:
            return f
    raise ValueError(f"unknown column {name!r}; columns are {df.columns}")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in schema order; booleans are not numeric here."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def present(f: T.StructField) -> Column:
    """The column with NaN as NULL; unchanged for types that have no NaN."""
    c = col(f.name)
    return F.nanvl(c, F.lit(None).cast(f.dataType)) if is_floating(f.dataType) else c


def number(df: DataFrame, name: str) -> Column:
    """A numeric column as a double with NaN as NULL."""
    f = field(df, name)
    if not is_numeric(f.dataType):
        raise ValueError(f"column {name!r} is {f.dataType.simpleString()}, not numeric")
    c = present(f)
    return c if isinstance(f.dataType, T.DoubleType) else c.cast("double")


def numbers(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named numeric columns, as doubles."""
    return df.select(*[number(df, n).alias(n) for n in names])


def batches(items: list, per_item: int = 1) -> Iterable[list]:
    """Split work into lists small enough for one aggregate job each."""
    size = max(1, AGGREGATES_PER_JOB // per_item)
    for start in range(0, len(items), size):
        yield items[start : start + size]


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL for a zero denominator (ANSI mode would raise)."""
    return numerator / F.nullif(denominator, F.lit(0))
