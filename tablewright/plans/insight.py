"""What an analyst needs to see first: sample rows, columns and statistics in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profiling import columns, describe_long, sample_text


def insight_inputs(df: DataFrame, key: str | list[str]) -> DataFrame:
    """(section, position, item, value, text) with the sections sample, columns and statistics."""
    none = F.lit(None)
    sample = sample_text(df, key).select(
        F.lit("sample").alias("section"),
        "position",
        none.cast("string").alias("item"),
        none.cast("double").alias("value"),
        F.col("line").alias("text"),
    )
    names = columns(df).select(
        F.lit("columns").alias("section"),
        "position",
        F.col("name").alias("item"),
        none.cast("double").alias("value"),
        none.cast("string").alias("text"),
    )
    statistics = describe_long(df).select(
        F.lit("statistics").alias("section"),
        none.cast("int").alias("position"),
        F.concat_ws(".", "column", "stat").alias("item"),
        "value",
        "text",
    )
    return sample.unionByName(names).unionByName(statistics)
