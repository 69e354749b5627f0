"""Facts about a table that are worth reporting."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import AGGREGATES_PER_JOB, batches, col, field, number, numbers, numeric_columns, present
from ..functions.gram import column_bounds, pair_sums
from ..functions.moments import pearson
from ..functions.quantiles import exact_group_quantile, exact_quantiles
from ..sources.workspace import staged


# Columns per block of pairs.
BLOCK = 8
# A spread that is left from sums so much larger has lost digits, and is computed anew.
CANCELLED = 1e-6


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x, y, r) for every pair of numeric columns, strongest first; r is null if one is constant or infinite somewhere.

    Where all pairs fit one aggregate, they are expressions of it. Beyond, one scan
    finds means and ranges, and another adds up the products of all pairs.
    """
    names = numeric_columns(df) if columns is None else columns
    if len(names) < 2:
        raise ValueError("correlations need two numeric columns")
    values = numbers(df, names)
    pairs = _few_pairs(values, names) if len(names) * (len(names) - 1) // 2 <= AGGREGATES_PER_JOB else _many_pairs(values, names)
    return pairs.orderBy(F.abs("r").desc_nulls_last(), "x", "y")


def _many_pairs(values: DataFrame, names: list[str]) -> DataFrame:
    found = {r["name"]: r for r in column_bounds(values).collect()}
    usable = [c for c in names if c in found and found[c]["low"] < found[c]["high"] and math.isfinite(found[c]["mean"])]
    scale = {c: max(found[c]["high"] - found[c]["mean"], found[c]["mean"] - found[c]["low"]) for c in usable}
    usable = [c for c in usable if math.isfinite(scale[c])]
    wanted = [(a, b) for a, b in combinations(names, 2) if not (a in scale and b in scale)]
    spark = values.sparkSession
    out = spark.createDataFrame([(a, b, None) for a, b in wanted], "x string, y string, r double")
    if len(usable) < 2:
        return out
    sums = pair_sums(values.select(*map(col, usable)), {c: found[c]["mean"] for c in usable}, scale)
    n = F.col("n")
    spread = {c: F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / n for c in "xy"}
    # Few rows of a pair may lie close together, and far from the mean of their column.
    lost = (n > 1) & ((spread["x"] <= CANCELLED * F.col("sxx")) | (spread["y"] <= CANCELLED * F.col("syy")))
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(spread["x"] * spread["y"])
    known = F.when((n > 1) & ~lost, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    rated = staged(sums.select("x", "y", known.alias("r"), lost.alias("lost")), "correlations")
    anew = [(row["x"], row["y"]) for row in rated.filter("lost").select("x", "y").collect()]
    out = out.unionByName(rated.filter("NOT lost").drop("lost"))
    # A pair without common rows has no sums at all.
    alone = spark.createDataFrame(list(combinations(usable, 2)), "x string, y string").join(rated, ["x", "y"], "left_anti")
    out = out.unionByName(alone.withColumn("r", F.lit(None).cast("double")))
    for chunk in batches(anew, per_item=3):
        out = out.unionByName(_as_rows(values, chunk, [pearson(col(a), col(b)) for a, b in chunk]))
    return out


def _as_rows(values: DataFrame, pairs: list[tuple[str, str]], exprs: list[Column]) -> DataFrame:
    """(x, y, r) of one aggregate that holds an expression for each pair."""
    rows = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)
    ]
    return values.agg(*[e.alias(f"r{i}") for i, e in enumerate(exprs)]).select(F.inline(F.array(*rows)))


def _few_pairs(values: DataFrame, names: list[str]) -> DataFrame:
    scored = _standard_scores(values, names)
    parts = []
    # Pairs in blocks of 8 by 8 columns, so that a job reads few columns.
    pairs_of = sorted(combinations(range(len(names)), 2), key=lambda p: (p[0] // BLOCK, p[1] // BLOCK))
    named = [(names[i], names[j]) for i, j in pairs_of]
    for chunk in batches(named, per_item=1 if len(scored.complete) == len(names) else 3):
        exprs = [
            F.avg(col(a) * col(b)) if a in scored.complete and b in scored.complete else pearson(col(a), col(b))
            for a, b in chunk
        ]
        parts.append(_as_rows(scored.values, chunk, exprs))
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    return pairs


@dataclass(frozen=True)
class _Scores:
    values: DataFrame
    complete: set[str]


def _standard_scores(values: DataFrame, names: list[str]) -> _Scores:
    """Replace columns that are neither constant nor missing anywhere by their standard scores.

    The correlation of two such columns is the mean of their product.
    """
    found: dict[str, tuple[float, float]] = {}
    for chunk in batches(names, per_item=3):
        aggregates = [F.count("*")]
        for c in chunk:
            aggregates += [F.count(col(c)), F.avg(col(c)), F.stddev_pop(col(c))]
        rows, *rest = values.agg(*aggregates).first()
        for i, c in enumerate(chunk):
            known, mean, std = rest[3 * i : 3 * i + 3]
            if known == rows and std:
                found[c] = (mean, std)
    scored = [
        ((col(c) - F.lit(found[c][0])) / F.lit(found[c][1])).alias(c) if c in found else col(c) for c in names
    ]
    return _Scores(values.select(*scored), set(found))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(column, n, mean, median, skewness, direction); skewness in the population form."""
    x = number(df, column)
    n, mean, std, skewness = df.agg(
        F.count(x), F.avg(x), F.stddev_pop(x), F.when(F.stddev_pop(x) > 0, F.skewness(x))
    ).first()
    median = exact_quantiles(df, {column: [0.5]}, {column: n})[column][0] if n else None
    if skewness is None:
        direction = None
    else:
        direction = "right" if skewness > 0 else "left" if skewness < 0 else "symmetric"
    return df.sparkSession.createDataFrame(
        [(column, n, mean, median, skewness, direction)],
        "column string, n bigint, mean double, median double, skewness double, direction string",
    )


def group_profile(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, share, mean, median) per non-null group.

    `n` and `share` count rows; mean and median skip missing values.
    """
    data = df.select(present(field(df, group)).alias("g"), number(df, value).alias("y")).filter("g IS NOT NULL")
    groups = data.groupBy("g").agg(F.count("*").alias("n"), F.avg("y").alias("mean"))
    total = data.count()
    medians = exact_group_quantile(data, "g", "y", 0.5).withColumnRenamed("quantile", "median")
    return groups.join(medians, "g", "left").select(
        F.col("g").alias(group), "n", (F.col("n") / F.lit(total)).alias("share"), "mean", "median"
    )


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept, r2, n) of the least-squares line of y on x; null on a constant x."""
    a, b = number(df, x), number(df, y)
    both = F.when(a.isNotNull() & b.isNotNull(), F.lit(1))
    return df.agg(
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.regr_r2(b, a).alias("r2"),
        F.count(both).alias("n"),
    )
