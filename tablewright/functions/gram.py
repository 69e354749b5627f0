"""Sums of products of many columns in one scan, over the rows where both columns of a pair are present."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import col

# Columns that one scan takes; a wider table has a scan for each two panels of half as many.
SCAN_COLUMNS = 512
# Values that a task multiplies at once.
_PIECE = 1 << 20

_BOUNDS = "name string, n long, low double, high double, total double"
_PAIRS = "x string, y string, n double, sx double, sy double, sxx double, syy double, sxy double"


def _matrix(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The batch as pieces of rows by columns; missing values are NaN."""
    step = max(1, _PIECE // max(1, batch.num_columns))
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        yield np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns])


def _numbered(values: DataFrame) -> DataFrame:
    """The columns under plain names, as any others stop the hand-over to Python."""
    return values.toDF(*[f"c{i}" for i in range(len(values.columns))])


def column_bounds(values: DataFrame) -> DataFrame:
    """(name, n, low, high, mean) of each column of doubles, null where a column has no value."""
    names = values.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(names), np.int64), np.zeros(len(names))
        low, high = np.full(len(names), np.inf), np.full(len(names), -np.inf)
        for batch in batches:
            for x in _matrix(batch):
                n += (~np.isnan(x)).sum(axis=0)
                # A sum beyond the range of doubles is infinite, as is that of infinite values.
                with np.errstate(over="ignore", invalid="ignore"):
                    total += np.nansum(x, axis=0)
                low, high = np.fmin(low, np.fmin.reduce(x)), np.fmax(high, np.fmax.reduce(x))
        some = n > 0
        arrays = [pa.array(np.array(names)[some], pa.string()), *(pa.array(a[some]) for a in (n, low, high, total))]
        yield pa.RecordBatch.from_arrays(arrays, ["name", "n", "low", "high", "total"])

    found = _numbered(values).mapInArrow(run, _BOUNDS).groupBy("name").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total")
    )
    return found.select("name", "n", "low", "high", (F.col("total") / F.col("n")).alias("mean"))


def pair_sums(values: DataFrame, shift: dict[str, float], scale: dict[str, float]) -> DataFrame:
    """(x, y, n, sx, sy, sxx, syy, sxy) for each two columns, x before y: sums over the rows where both are present.

    Sums are of (value - shift) / scale. A task keeps each with the rounding error
    of its additions, and hands over one row a pair; these meet in a grouped sum.
    """
    names = values.columns
    if len(names) <= SCAN_COLUMNS:
        return _scan(values, shift, scale, [(0, len(names))])
    half = SCAN_COLUMNS // 2
    panels = [names[i : i + half] for i in range(0, len(names), half)]
    out = None
    for p, first in enumerate(panels):
        for q in range(p + 1, len(panels)):
            inner = [(0, len(first))] if q == p + 1 else []
            if p == len(panels) - 2:
                inner.append((len(first), len(first) + len(panels[q])))
            part = _scan(values.select(*map(col, first + panels[q])), shift, scale, inner, split=len(first))
            out = part if out is None else out.unionByName(part)
    return out


def _scan(values: DataFrame, shift: dict, scale: dict, inner: list[tuple[int, int]], split: int = 0) -> DataFrame:
    """The pairs within each range of columns in `inner`, and those of a column before `split` and one from there on."""
    names = values.columns
    moved, scaled = np.array([shift[c] for c in names]), np.array([scale[c] for c in names])
    own = np.zeros((len(names), len(names)), bool)
    own[:split, split:] = True
    for lo, hi in inner:
        own[lo:hi, lo:hi] = True
    first, second = np.nonzero(np.triu(own, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, error = np.zeros((2, 4, len(names), len(names)))
        for batch in batches:
            for x in _matrix(batch):
                known = ~np.isnan(x)
                x = np.where(known, (x - moved) / scaled, 0.0)
                m = known.astype(float)
                new = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
                after = total + new
                error += np.where(abs(total) >= abs(new), (total - after) + new, (new - after) + total)
                total = after
        n, s, q, p = total + error
        i, j = first, second
        sums = [n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]]
        some = sums[0] > 0
        titles = [pa.array(np.array(names)[k[some]], pa.string()) for k in (i, j)]
        yield pa.RecordBatch.from_arrays([*titles, *(pa.array(a[some]) for a in sums)], ["x", "y", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = _numbered(values).mapInArrow(run, _PAIRS)
    return parts.groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
