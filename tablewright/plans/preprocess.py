"""The cleaning flow: checks, empty columns, imputation, outliers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import col
from ..operators.cleaning import (
    Imputation,
    Missing,
    OutlierFilter,
    count_missing,
    fit_mean,
    fit_mode,
    fit_outliers,
    require_nonempty,
)
from ..sources.csv import scan_csv
from ..sources.sink import write_clean
from ..sources.workspace import scratch_path


@dataclass(frozen=True)
class Cleaning:
    """Everything cleaning learned from one table; `apply` is a projection and filters."""

    columns: list[str]
    missing: Missing
    imputation: Imputation
    outliers: OutlierFilter

    def apply(self, df: DataFrame) -> DataFrame:
        kept = df.select(*[col(c) for c in self.columns])
        return self.outliers.apply(self.imputation.apply(kept))


def fit_cleaning(df: DataFrame) -> Cleaning:
    require_nonempty(df)
    missing = count_missing(df)
    columns = [c for c in df.columns if missing.known[c] > 0]
    if not columns:
        raise ValueError("all columns are empty")
    kept = df.select(*[col(c) for c in columns])
    fills = {**fit_mean(kept, missing=missing).fills, **fit_mode(kept, missing=missing).fills}
    imputation = Imputation(fills)
    outliers = fit_outliers(imputation.apply(kept), rows=missing.rows)
    if outliers.rows_after == 0:
        raise ValueError("removing outliers left no rows")
    return Cleaning(columns, missing, imputation, outliers)


def preprocess(df: DataFrame) -> DataFrame:
    """Drop empty columns, impute means and modes, then remove outliers."""
    return fit_cleaning(df).apply(df)


def clean_file(spark: SparkSession, source: str, target: str, fmt: str = "parquet") -> DataFrame:
    """Scan a CSV, clean it and write the result.

    The scan is written to the shared folder once as Parquet, because fitting
    reads it once per numeric column and a CSV cannot be read by column.
    """
    staged = scratch_path(spark, "scan")
    write_clean(scan_csv(spark, source), staged)
    write_clean(preprocess(spark.read.parquet(staged)), target, fmt)
    return spark.read.parquet(target) if fmt == "parquet" else scan_csv(spark, target)
