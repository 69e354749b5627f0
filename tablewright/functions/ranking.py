"""Codes of a column's values in sorted order, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import ensure_checkpoint_dir
from .columns import col

# Distinct values that may be numbered on the driver.
LISTED_VALUES = 100_000


def sorted_codes(df: DataFrame, column: str, listed_values: int = LISTED_VALUES) -> DataFrame:
    """(category, code): the distinct non-null values numbered 0..n-1 in sorted order.

    The result is materialised: up to `LISTED_VALUES` rows as a local table,
    more as a checkpoint.
    """
    distinct = df.select(col(column).alias("category")).dropna().distinct()
    listed = distinct.orderBy("category").limit(listed_values + 1).collect()
    if len(listed) <= listed_values:
        codes = [(r["category"], i) for i, r in enumerate(listed)]
        schema = T.StructType([*distinct.schema.fields, T.StructField("code", T.LongType())])
        return df.sparkSession.createDataFrame(codes, schema)

    # More values than one place should hold: range-partition them, number them
    # inside each range and add the sizes of the ranges before it. The ranges
    # are materialised first, because sampling could place them differently
    # when a lost task is run again.
    ensure_checkpoint_dir(df.sparkSession)
    ranges = (
        distinct.repartitionByRange("category").withColumn("part", F.spark_partition_id()).checkpoint()
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.groupBy("part")
        .count()
        .select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    )
    within = F.row_number().over(Window.partitionBy("part").orderBy("category")) - 1
    numbered = ranges.join(F.broadcast(offsets), "part").select(
        "category", (within + F.col("offset")).cast("long").alias("code")
    )
    return numbered.checkpoint()
