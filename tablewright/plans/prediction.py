"""Train on four fifths of a table, evaluate on the rest, predict new rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.base import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, field, is_numeric, is_text
from ..functions.ranking import sorted_codes
from ..operators import boosting, models
from ..operators.evaluation import eval_classification, eval_regression
from ..operators.features import fit_features, with_codes
from ..operators.kernels import Platt, calibrated, fourier_features
from ..operators.models import select_model, tier_rows, train_test_split
from ..sources.workspace import ensure_checkpoint_dir

# A classifier keeps statistics per class on the driver.
MODEL_CLASSES = 1_000

VECTOR, LABEL = "tw_features", "tw_label"


@dataclass(frozen=True)
class Predictor:
    """A fitted model with what it needs to read rows and to name its classes."""

    target: str
    task: str
    inputs: T.StructType
    features: PipelineModel
    model: Model
    codes: DataFrame | None
    platt: Platt | None = None

    def score(self, df: DataFrame) -> DataFrame:
        """The rows with the model's `prediction`."""
        if "prediction" in df.columns:
            raise ValueError("the rows already have a column 'prediction'")
        return self._predicted(df).select(F.col("tw_row.*"), "prediction")

    def _predicted(self, df: DataFrame) -> DataFrame:
        # The row travels apart, so that no column of it can be taken for the model's own.
        row = F.struct(*[col(c) for c in df.columns]).alias("tw_row")
        ready = self.features.transform(df).select(row, F.col(VECTOR).alias("features"))
        scored = self.model.transform(ready)
        out = ["tw_row", F.col("prediction").cast("double").alias("prediction")]
        if self.task == "classification":
            if self.platt is not None:
                out.append(self.platt.probabilities(F.col("rawPrediction")).alias("probabilities"))
            elif "probability" in scored.columns:
                out.append(vector_to_array("probability").alias("probabilities"))
            else:  # boosting of one class against the rest gives scores
                odds = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x)))
                total = F.aggregate(odds, F.lit(0.0), lambda s, x: s + x)
                out.append(F.transform(odds, lambda x: x / total).alias("probabilities"))
        return scored.select(*out)


@dataclass(frozen=True)
class Prediction:
    predictor: Predictor
    metrics: DataFrame
    predictions: DataFrame
    mapping: DataFrame | None


def fit_predict(
    df: DataFrame, target: str, task: str, key: str | list[str] | None = None, model: str | None = None, kernel: str = "rbf"
) -> tuple[Predictor, DataFrame]:
    """Fit on the training part; (predictor, `target`, `label` and `prediction` of the test part).

    `model` names the tier ("small", "middle", "large") instead of the number of rows.
    The small classifier separates by a radial basis kernel, or by planes with
    `kernel="linear"`; its probabilities are calibrated on rows that its fit has not seen.
    """
    if kernel not in ("rbf", "linear"):
        raise ValueError(f"unknown kernel {kernel!r}; use 'rbf' or 'linear'")
    tier_rows(0, model)
    select_model(task, 0)  # refuse an unknown task before any work
    ensure_checkpoint_dir(df.sparkSession)
    rows, known = df.agg(F.count("*"), F.count(col(target))).first()
    if rows == 0:
        raise ValueError("the dataset is empty")
    if known < rows:
        raise ValueError(f"target {target!r} has {rows - known} missing values")
    codes, classes = None, 0
    if task == "classification" or is_text(field(df, target).dataType):
        codes = sorted_codes(df, target)
        classes = codes.count()
    if task == "classification" and not 2 <= classes <= MODEL_CLASSES:
        raise ValueError(f"target {target!r} has {classes} classes; a classifier needs 2 to {MODEL_CLASSES}")

    used = [f.name for f in df.schema.fields if f.name == target or _is_feature(f)]
    train, test = train_test_split(df, key=key, rows=rows, kept=used if rows > boosting.DIRECT_ROWS else None)
    features = fit_features(train.drop(target), VECTOR)

    def labelled(part: DataFrame) -> DataFrame:
        if codes is None:
            return part.withColumn(LABEL, col(target).cast("double"))
        return with_codes(part, target, codes, LABEL).withColumn(LABEL, F.col(LABEL).cast("double"))

    def learned(part: DataFrame) -> DataFrame:
        return features.transform(labelled(part)).select(F.col(VECTOR).alias("features"), F.col(LABEL).alias("label"))

    ready = learned(train)
    size = tier_rows(rows, model)
    estimator, platt = select_model(task, size, classes), None
    if task == "classification" and size <= models.SMALL_ROWS:
        if kernel == "rbf":
            spread = fourier_features(features.transform(train), VECTOR)
            features = PipelineModel([features, spread])
            ready = learned(train)
        # Read once for each step of each fit. At most SMALL_ROWS rows are one part.
        ready = (ready.coalesce(1) if rows <= models.SMALL_ROWS else ready).checkpoint()
        fitted, platt = calibrated(estimator, ready, classes)
    elif size > models.MIDDLE_ROWS:
        part = rows - math.ceil(models.TEST_SHARE * rows)
        fitted = boosting.fit(estimator, ready, part, lambda share: learned(train.sample(share, boosting.SEED)))
    else:
        fitted = estimator.fit(ready)
    inputs = T.StructType([f for f in df.schema.fields if f.name != target])
    predictor = Predictor(target, task, inputs, features, fitted, codes, platt)
    scored = predictor._predicted(labelled(test)).select(
        F.col("tw_row").getField(target).alias("target"),
        F.col("tw_row").getField(LABEL).alias("label"),
        "prediction",
    )
    return predictor, scored


def evaluate(predictor: Predictor, scored: DataFrame) -> DataFrame:
    """Metrics of scored test rows; classes appear by their own names."""
    if predictor.task == "regression":
        return eval_regression(scored)
    predicted = _decoded(predictor, scored).select(F.col("target").alias("label"), "decoded")
    return eval_classification(predicted, "label", "decoded")


def _decoded(predictor: Predictor, scored: DataFrame) -> DataFrame:
    names = predictor.codes.select(F.col("category").alias("decoded"), F.col("code").alias("tw_code"))
    # At most MODEL_CLASSES names.
    joined = scored.join(F.broadcast(names), F.bround("prediction", 0).cast("bigint") == F.col("tw_code"), "left")
    return joined.drop("tw_code")


def predict_rows(predictor: Predictor, rows: DataFrame, column: str = "line", round_output: bool = True) -> DataFrame:
    """Predict from comma-separated texts that hold the features in table order.

    Adds `raw`, `rounded` (half to even) and, for a classifier, `decoded`, then `error`. An
    empty field is a missing value. A line with another number of fields, or with a
    text where a number belongs, gets no prediction; its `error` says why. Columns that
    are no features, such as arrays, have no field.
    """
    fields = [f for f in predictor.inputs.fields if _is_feature(f)]
    names = [f.name for f in fields]
    parts = F.split(col(column), ",", -1)
    split = rows.select(col(column).alias("tw_line"), parts.alias("tw_parts"))
    wrong = F.concat(
        F.lit(f"expected {len(names)} fields ({', '.join(names)}), got: "), F.coalesce("tw_line", F.lit(""))
    )
    error = F.when(F.coalesce(F.size("tw_parts") != len(names), F.lit(True)), wrong)
    for i, f in enumerate(fields):
        if not is_text(f.dataType):
            text = _field(i)
            bad = text.isNotNull() & text.try_cast(f.dataType).isNull()
            error = error.when(bad, F.concat(F.lit(f"{f.name}: not a number: "), text))
    ignored = [F.lit(None).cast(f.dataType).alias(f.name) for f in predictor.inputs.fields if not _is_feature(f)]
    typed = split.select("tw_line", error.alias("tw_error"), *[_parsed(i, f) for i, f in enumerate(fields)], *ignored)
    scored = predictor._predicted(typed).select(
        F.col("tw_row.tw_line").alias("tw_line"),
        F.col("tw_row.tw_error").alias("tw_error"),
        F.when(F.col("tw_row.tw_error").isNull(), F.col("prediction")).alias("prediction"),
    )
    out = [F.col("tw_line").alias(column), F.col("prediction").alias("raw")]
    if round_output:
        out.append(F.bround("prediction", 0).cast("bigint").alias("rounded"))
    if predictor.task == "classification":
        scored = _decoded(predictor, scored)
        out.append(F.col("decoded"))
    return scored.select(*out, F.col("tw_error").alias("error"))


def _is_feature(f: T.StructField) -> bool:
    return is_numeric(f.dataType) or is_text(f.dataType)


def _field(i: int) -> Column:
    text = F.trim(F.get("tw_parts", F.lit(i)))
    return F.when(text != "", text)


def _parsed(i: int, f: T.StructField) -> Column:
    if is_text(f.dataType):
        text = F.get("tw_parts", F.lit(i))
        return F.when(text != "", text).alias(f.name)
    return _field(i).try_cast(f.dataType).alias(f.name)


def probabilities(predictor: Predictor, df: DataFrame) -> DataFrame:
    """The rows with `probabilities`: for each class its name and share, most likely first; equal ones by code."""
    if predictor.task != "classification":
        raise ValueError("only a classifier has probabilities")
    scored = predictor._predicted(df).select(F.col("tw_row"), F.transform("probabilities", lambda p, k: F.struct((-p).alias("away"), k.alias("code"))).alias("all"))
    # At most MODEL_CLASSES names.
    names = {r["code"]: r["category"] for r in predictor.codes.collect()}
    kind = predictor.codes.schema["category"].dataType
    named = F.create_map(*[x for k, v in sorted(names.items()) for x in (F.lit(k).cast("int"), F.lit(v).cast(kind))])
    each = F.transform(F.array_sort("all"), lambda x: F.struct(F.element_at(named, x["code"]).alias("class"), (-x["away"]).alias("probability")))
    return scored.select("tw_row.*", each.alias("probabilities"))


def label_mapping(predictor: Predictor) -> DataFrame | None:
    """(category, code) of an encoded target; None if it was not encoded."""
    return predictor.codes


def prediction(
    df: DataFrame, target: str, task: str, rows: DataFrame, key: str | list[str] | None = None, model: str | None = None
) -> Prediction:
    """The whole flow: split, fit, evaluate, predict `rows`, name the classes."""
    predictor, scored = fit_predict(df, target, task, key, model)
    return Prediction(
        predictor, evaluate(predictor, scored), predict_rows(predictor, rows), label_mapping(predictor)
    )
