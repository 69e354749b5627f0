"""Choosing a model by task and number of rows."""

from __future__ import annotations

import math

from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame

from ..functions.order import first_rows

# Row limits of the small and the middle tier, share of test rows, seed.
SMALL_ROWS = 1_000
MIDDLE_ROWS = 10_000
TEST_SHARE = 0.2
SEED = 42

# The forest and boosting settings that the tiers stand for.
FOREST = {"numTrees": 100, "maxDepth": 12, "seed": SEED}
BOOSTING = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3, "seed": SEED}

# The tiers that a caller may name.
TIERS = ("large", "middle", "small")


def tier_rows(rows: int, model: str | None) -> int:
    """The number of rows that decides the model: that of the table, or one of the tier that the caller names."""
    if model is None:
        return rows
    if model not in TIERS:
        raise ValueError(f"unknown model {model!r}; use one of {TIERS}")
    return min(rows, SMALL_ROWS) if model == "small" else max(SMALL_ROWS + 1, min(rows, MIDDLE_ROWS)) if model == "middle" else max(rows, MIDDLE_ROWS + 1)


def select_classifier(rows: int, classes: int = 2) -> Estimator:
    """Support vectors, a random forest or boosted trees, by the number of rows.

    The support vectors are linear in the features that they are given; see `kernels` for a radial basis.
    """
    if rows <= SMALL_ROWS:
        # The usual penalty C = 1 on the sum of losses is 1 / rows on their mean.
        model = LinearSVC(regParam=1.0 / max(rows, 1), tol=1e-2, maxIter=20)
    elif rows <= MIDDLE_ROWS:
        return RandomForestClassifier(**FOREST)
    else:
        model = GBTClassifier(**BOOSTING)
    return model if classes <= 2 else OneVsRest(classifier=model)


def select_regressor(rows: int) -> Estimator:
    """Linear regression, a random forest or boosted trees, by the number of rows."""
    if rows <= SMALL_ROWS:
        return LinearRegression()
    if rows <= MIDDLE_ROWS:
        return RandomForestRegressor(featureSubsetStrategy="all", **FOREST)
    return GBTRegressor(**BOOSTING)


def select_model(task: str, rows: int, classes: int = 2) -> Estimator:
    if task == "classification":
        return select_classifier(rows, classes)
    if task == "regression":
        return select_regressor(rows)
    raise ValueError(f"unknown task {task!r}; use 'classification' or 'regression'")


def train_test_split(
    df: DataFrame,
    test_share: float = TEST_SHARE,
    seed: int = SEED,
    key: str | list[str] | None = None,
    rows: int | None = None,
    kept: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts that together are the table; the test part has ceil(test_share * rows) rows.

    A row's part depends only on its `key` values (all columns by default), so
    a task that runs again decides alike. Only where the border falls among rows of
    one key do their other values decide. `rows` is the number of rows, if it is known.
    `kept` names the columns to return, for parts that are read many times: these are written once.
    """
    keys = df.columns if key is None else [key] if isinstance(key, str) else key
    rows = df.count() if rows is None else rows
    test, train = first_rows(df, min(rows, math.ceil(test_share * rows)), keys, seed, kept)
    return train, test
