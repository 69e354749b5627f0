"""Metrics of predictions, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, ratio

CLASS_REPORT = ["class", "precision", "recall", "f1", "support"]


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n)."""
    pairs = df.select(col(label).alias("label"), col(prediction).alias("prediction"))
    return pairs.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def eval_classification(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support): one row per class, then accuracy and two averages.

    An undefined precision, recall or F1 counts as 0. The accuracy row has the
    accuracy in `f1`.
    """
    cells = confusion(df, label, prediction)
    hit = F.col("label") == F.col("prediction")
    # Each cell counts once for its true class and once for its predicted one.
    sides = cells.select(
        F.inline(
            F.array(
                _side("label", F.col("n"), F.lit(0), F.when(hit, F.col("n")).otherwise(0)),
                _side("prediction", F.lit(0), F.col("n"), F.lit(0)),
            )
        )
    )
    sums = sides.groupBy("class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hits")]
    )
    precision, recall = _share("hits", "predicted"), _share("hits", "support")
    classes = sums.select(
        F.col("class").cast("string").alias("class"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(ratio(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
        "support",
        "hits",
    )
    none = F.lit(None).cast("double")
    total = F.sum("support")
    scores = ["precision", "recall", "f1"]

    def row(name: str, precision: Column, recall: Column, f1: Column) -> Column:
        values = zip(CLASS_REPORT, (F.lit(name), precision, recall, f1, total), strict=True)
        return F.struct(*[v.alias(c) for c, v in values])

    summary = classes.agg(
        F.array(
            row("accuracy", none, none, _share_of(F.sum("hits"), total)),
            row("macro avg", *[F.avg(c) for c in scores]),
            row("weighted avg", *[_share_of(F.sum(F.col(c) * F.col("support")), total) for c in scores]),
        ).alias("rows")
    )
    return classes.select(*CLASS_REPORT).unionByName(summary.select(F.inline("rows")))


def _side(column: str, support: Column, predicted: Column, hits: Column) -> Column:
    return F.struct(
        F.col(column).cast("string").alias("class"),
        support.cast("bigint").alias("support"),
        predicted.cast("bigint").alias("predicted"),
        hits.cast("bigint").alias("hits"),
    )


def _share(part: str, whole: str) -> Column:
    return _share_of(F.col(part), F.col(whole))


def _share_of(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part.cast("double"), whole), F.lit(0.0))


def eval_regression(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(mae, mse, r2, n); r2 is null if the label is constant."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    pairs = df.select(y.alias("y"), (y - p).alias("e"))
    # A filter on the error would predict each row twice: below the filter and above it.
    e = F.nanvl("e", F.lit(None))
    known = F.when(e.isNotNull(), F.col("y"))
    return pairs.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        (1 - ratio(F.sum(e * e), F.regr_syy(known, known))).alias("r2"),
        F.count(e).alias("n"),
    )
