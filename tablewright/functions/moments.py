"""Moment expressions that give NULL, not an error, on constant columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ratio


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both values are present."""
    x_paired = F.when(y.isNotNull(), x)
    y_paired = F.when(x.isNotNull(), y)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x_paired) * F.stddev_pop(y_paired))
