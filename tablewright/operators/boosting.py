"""Boosted trees on any number of rows: rows that the trees cannot tell apart are learned as one."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import staged

# Up to so many rows, or beyond so many features, trees read the rows themselves.
DIRECT_ROWS = 100_000
NARROW = 256
# As in Spark's trees: the bins of a feature, and the rows that their borders are chosen from.
BINS = 32
BORDER_ROWS = 10_000
# Rows that a task reads in each of the many rounds.
PART_ROWS = 50_000
# Classes that are learned side by side; their rounds are short.
AT_ONCE = 4
SEED = 42


def borders(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Where Spark's trees may split a feature with these values, a null or NaN left out.

    Between any two neighbours if there are at most `bins` values, else where the count of
    values comes closest to each multiple of a bin's share. A value at a border is below it.
    """
    found, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    with np.errstate(invalid="ignore"):
        between = (found[:-1] + found[1:]) / 2
    if len(found) > bins:
        share = counts.sum() / bins
        passed, target, kept = np.cumsum(counts), share, []
        for i in range(1, len(found)):
            if abs(passed[i - 1] - target) < abs(passed[i] - target):
                kept.append(i - 1)
                target += share
        between = between[kept]
    return between[~np.isnan(between)]


def _binned(features: Column, cuts: list[np.ndarray]) -> Column:
    """The bin of each feature as a byte."""
    width = len(cuts)

    @F.arrow_udf("binary")
    def bins(vectors: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)
        codes = np.empty(x.shape, np.uint8)
        for i, cut in enumerate(cuts):
            codes[:, i] = np.searchsorted(cut, x[:, i])
        ends = np.arange(len(x) + 1, dtype=np.int32) * width
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(codes)])

    return bins(vector_to_array(features))


def _vector(bins: Column, width: int) -> Column:
    @F.arrow_udf("array<double>")
    def numbers(codes: pa.Array) -> pa.Array:
        x = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).astype(float)
        return pa.ListArray.from_arrays(np.arange(len(codes) + 1, dtype=np.int32) * width, x)

    return array_to_vector(numbers(bins))


class BinnedModel(Model):
    """A model that was learned from the bins of the features."""

    def __init__(self, model: Model, cuts: list[np.ndarray]):
        super().__init__()
        self.model, self.cuts = model, cuts

    def _transform(self, dataset: DataFrame) -> DataFrame:
        bins = _vector(_binned(F.col("features"), self.cuts), len(self.cuts))
        return self.model.transform(dataset.withColumn("features", bins))


def fit(estimator: Estimator, ready: DataFrame, rows: int, some: Callable[[float], DataFrame] | None = None) -> Model:
    """Boosted trees, or such of one class against the rest, from `features` and `label` of about `rows` rows.

    `some` gives a random share of them, where that costs less than to sample `ready`.

    Trees see only a feature's bin. Rows with the same bins always reach the same leaf, so
    on large tables each such group is one row, with their number as its weight: a
    classifier's for each label, a regressor's with the mean of the labels (under squared
    loss, a split's gain depends on the sums of the labels alone). These are the same
    trees, but for rounding, and a round takes as long as there are groups: the
    number of bins limits them, not the number of rows.
    """
    many = isinstance(estimator, OneVsRest)
    if rows <= DIRECT_ROWS:
        return (estimator.copy({estimator.parallelism: AT_ONCE}) if many else estimator).fit(ready)
    width = ready.first()["features"].size
    squared = not isinstance(estimator, GBTRegressor) or estimator.getLossType() == "squared"
    if width > NARROW or not squared:
        return estimator.fit(ready.repartition(math.ceil(rows / PART_ROWS)))
    share = min(1.0, BORDER_ROWS / rows)
    seen = (some(share) if some else ready.sample(share, SEED)).select(vector_to_array("features").alias("x")).toPandas()["x"]
    cuts = [borders(x) for x in np.stack(seen).T]
    label = [] if isinstance(estimator, GBTRegressor) else ["label"]
    bins = ready.select(_binned(F.col("features"), cuts).alias("bins"), "label")
    sums = [F.count("*").cast("double").alias("weight"), *([] if label else [F.avg("label").alias("label")])]
    groups = bins.groupBy("bins", *label).agg(*sums)
    groups = staged(groups.select(_vector(F.col("bins"), width).alias("features"), "label", "weight"), "boosting")
    n = groups.count()
    # A feature has at most BINS values by now. Of fewer than maxBins ** 2 rows, Spark reads all to find them.
    trees = (estimator.getClassifier() if many else estimator).copy()
    trees.setMaxBins(max(BINS, math.isqrt(n) + 1)).setWeightCol("weight")
    if many:
        trees = estimator.copy({estimator.classifier: trees, estimator.weightCol: "weight", estimator.parallelism: AT_ONCE})
    return BinnedModel(trees.fit(groups.repartition(math.ceil(n / PART_ROWS))), cuts)
