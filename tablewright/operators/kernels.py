"""A radial basis kernel by random Fourier features, and probabilities by Platt scaling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the seed of the drawn frequencies.
SEED = 42
#: Fourier features; the kernel is met up to an error of about 1 / sqrt(FEATURES).
FEATURES = 100
#: Calibration holds out one row in so many.
FOLDS = 5


def scale_gamma(df: DataFrame, vector: str) -> float:
    """1 / (features * variance of all entries together); 1 where that is 0."""
    row = df.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col(vector)).alias("s")).first()["s"]
    if not row["count"]:
        return 1.0
    mean, n = row["mean"].toArray(), row["count"]
    spread = row["variance"].toArray() * (n - 1) / n if n > 1 else np.zeros_like(mean)
    total = float(spread.mean() + (mean**2).mean() - mean.mean() ** 2) if len(mean) else 0.0
    return 1 / (len(mean) * total) if total > 0 else 1.0


def draw(width: int, gamma: float, features: int = FEATURES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (width x features) and phases whose features z(x) have z(x).z(y) near exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    return rng.normal(scale=np.sqrt(2 * gamma), size=(width, features)), rng.uniform(0, 2 * np.pi, features)


class FourierFeatures(Transformer):
    """Replaces a vector column by its `features` Fourier features. The draw is repeatable from its seed."""

    def __init__(self, column: str, width: int, gamma: float, features: int = FEATURES, seed: int = SEED) -> None:
        super().__init__()
        self.column, self.width, self.gamma, self.features, self.seed = column, width, gamma, features, seed

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, phases = draw(self.width, self.gamma, self.features, self.seed)

        @F.pandas_udf("array<double>")
        def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in batches:
                if not len(rows):
                    yield pd.Series([], dtype=object)
                    continue
                angles = np.stack(rows.to_numpy()) @ weights + phases
                yield pd.Series(list(np.sqrt(2 / len(phases)) * np.cos(angles)))

        return dataset.withColumn(self.column, array_to_vector(mapped(vector_to_array(self.column))))


def fourier_features(df: DataFrame, vector: str, gamma: float | None = None, features: int = FEATURES, seed: int = SEED) -> FourierFeatures:
    """The map for this column; `gamma` is taken from the table's spread unless given."""
    first = df.select(vector).first()
    width = len(first[0].toArray()) if first else 0
    return FourierFeatures(vector, width, scale_gamma(df, vector) if gamma is None else gamma, features, seed)


@dataclass(frozen=True)
class Platt:
    """For each class the line that turns a score into log-odds."""

    lines: dict[int, tuple[float, float]]

    def probabilities(self, raw: Column) -> Column:
        """An array with a probability for each class, from a raw prediction vector; they add up to 1."""
        scores = vector_to_array(raw)
        if len(self.lines) == 1:
            a, b = self.lines[1]
            p = 1 / (1 + F.exp(-(F.lit(a) * scores[1] + F.lit(b))))
            return F.array(1 - p, p)
        each = F.array(*[1 / (1 + F.exp(-(F.lit(a) * scores[k] + F.lit(b)))) for k, (a, b) in sorted(self.lines.items())])
        total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
        return F.transform(each, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0 / len(self.lines))))


def platt(scored: DataFrame, classes: int) -> Platt:
    """From (raw, label) of rows that the scores were not fitted on.

    The targets are those of Platt: (n+ + 1) / (n+ + 2) for members of a class and
    1 / (n- + 2) for the others, so that no probability is 0 or 1 for lack of rows.
    """
    lines = {}
    for k in [1] if classes <= 2 else range(classes):
        own = scored.select(vector_to_array("raw")[k].alias("score"), (F.col("label") == k).alias("in"))
        n = own.agg(F.count_if("in"), F.count_if(~F.col("in"))).first()
        target = F.when(F.col("in"), (n[0] + 1) / (n[0] + 2)).otherwise(1 / (n[1] + 2))
        sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), target.alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - target).alias("weight"))))
        rows = own.select(array_to_vector(F.array("score")).alias("features"), sides.alias("side")).select("features", "side.*")
        fitted = LogisticRegression(weightCol="weight", regParam=0.0, standardization=True).fit(rows)
        lines[k] = (float(fitted.coefficients[0]), float(fitted.intercept))
    return Platt(lines)


def calibrated(estimator: Estimator, ready: DataFrame, classes: int, folds: int = FOLDS) -> tuple[Model, Platt]:
    """The estimator fitted on all rows of (features, label), and its probabilities.

    Calibration uses scores of rows that a fit has not seen: one row in `folds`, by a hash
    of the row, is scored by a model of the others. Where the others lack a class,
    or none is held out, scores of the fitted rows are used.
    """
    held = F.pmod(F.xxhash64(vector_to_array("features"), "label"), F.lit(folds)) == 0
    model = estimator.fit(ready)
    known, out = ready.agg(F.count_distinct(F.when(~held, F.col("label"))), F.count_if(held)).first()
    if known == classes and out:
        scored = estimator.fit(ready.filter(~held)).transform(ready.filter(held))
    else:
        scored = model.transform(ready)
    return model, platt(scored.select(F.col("rawPrediction").alias("raw"), "label"), classes)
