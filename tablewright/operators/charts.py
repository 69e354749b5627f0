"""The data behind each chart; drawing is left to the reader's plotting tool.

Operators work on the whole table. `sample_rows` bounds what a chart of single
points or a quick look reads; a sample that several jobs share is pinned, so
that all of them see the same rows.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, field, is_numeric, number, numbers, present
from ..functions.moments import pearson
from ..functions.order import digest, first_rows
from ..functions.quantiles import exact_quantiles

# Sample sizes, category cuts, density grid and confidence factor.
SCATTER_ROWS = 50
SAMPLE_ROWS = 1000
BAR_CATEGORIES = 20
PIE_CATEGORIES = 10
GRID_POINTS = 200
NORMAL_95 = 1.96
WHISKER_FACTOR = 1.5

# Resamplings of a bootstrap band.
REPLICATES = 1000
BANDS = ("bootstrap", "normal")

# A sample of at most so many rows is a sorted top of the table.
SORTED_ROWS = 100_000
# A contingency table is filled with zeros only if one side has at most this many labels.
DENSE_LABELS = 10_000
# Beyond this many bandwidths exp(-z*z/2) is exactly 0 in double precision.
KERNEL_REACH = 39.0


def sample_rows(df: DataFrame, n: int = SAMPLE_ROWS, seed: int = 42, key: str | list[str] | None = None) -> DataFrame:
    """`n` rows without replacement, or all if there are fewer.

    With a `key` that identifies a row, the choice depends only on its values;
    without one, on the order of the rows in their files. A large sample with a
    key is found by counting digests, so that no task sorts it.
    """
    if key is None:
        return df.orderBy(F.rand(seed)).limit(n)
    keys = [key] if isinstance(key, str) else key
    if n <= SORTED_ROWS:
        # Rows of one key go by their other columns; nested ones as texts, as maps have no order.
        nested = (T.ArrayType, T.MapType, T.StructType)
        rest = [F.to_json(col(f.name)) if isinstance(f.dataType, nested) else col(f.name) for f in df.schema.fields if f.name not in keys]
        own = [col(k) for k in keys]
        return df.orderBy(digest(own, seed), *own, *rest).limit(n)
    if df.count() <= n:
        return df
    return first_rows(df, n, keys, seed)[0]


def pinned_sample(df: DataFrame, n: int = SAMPLE_ROWS, seed: int = 42, key: str | list[str] | None = None) -> DataFrame:
    """A sample held as a local table of at most `n` rows."""
    return df.sparkSession.createDataFrame(sample_rows(df, n, seed, key).collect(), df.schema)


def scatter(df: DataFrame, x: str, y: str, n: int = SCATTER_ROWS, seed: int = 42, key=None) -> DataFrame:
    """(x, y) of exactly `n` sampled rows; an error if the table has fewer."""
    if df.limit(n).count() < n:
        raise ValueError(f"a scatter plot needs {n} rows")
    keys = [] if key is None else [key] if isinstance(key, str) else key
    used = df.select(*[col(c) for c in dict.fromkeys([x, y, *keys])])
    return sample_rows(used, n, seed, key).select(col(x).alias("x"), col(y).alias("y"))


def bar_count(df: DataFrame, x: str, k: int | None = BAR_CATEGORIES) -> DataFrame:
    """(x, n): the most frequent values; the smaller value first on ties."""
    counts = (
        df.select(present(field(df, x)).alias("x")).dropna().groupBy("x").agg(F.count("*").alias("n"))
    )
    ordered = counts.orderBy(F.desc("n"), "x")
    return ordered if k is None else ordered.limit(k)


def bar_mean(df: DataFrame, x: str, y: str, k: int = BAR_CATEGORIES) -> DataFrame:
    """(x, mean_y): the values of x with the largest means of y."""
    means = (
        df.select(present(field(df, x)).alias("x"), number(df, y).alias("y"))
        .filter("x IS NOT NULL")
        .groupBy("x")
        .agg(F.avg("y").alias("mean_y"))
    )
    return means.filter("mean_y IS NOT NULL").orderBy(F.desc("mean_y"), "x").limit(k)


def _auto_bins(n: int, low: float, high: float, q1: float, q3: float) -> int:
    """Number of equal bins: the narrower of the Sturges and Freedman-Diaconis widths.

    The latter is taken no narrower than half the square-root rule's width, so
    there are at most 2 * sqrt(n) bins.
    """
    if high == low:
        return 1
    spread = high - low
    freedman = max(2.0 * (q3 - q1) / n ** (1.0 / 3.0), spread / math.sqrt(n) / 2.0)
    sturges = spread / (math.log2(n) + 1.0)
    return math.ceil(spread / min(freedman, sturges))


@dataclass(frozen=True)
class Summary:
    """A numeric column's values as `x`, their count, range, deviation and quartiles."""

    values: DataFrame
    n: int
    low: float
    high: float
    std: float | None
    q1: float
    median: float
    q3: float

    @property
    def bins(self) -> tuple[int, float, float]:
        """Number of bins, left edge and width."""
        if self.high == self.low:
            return 1, self.low - 0.5, 1.0
        bins = _auto_bins(self.n, self.low, self.high, self.q1, self.q3)
        return bins, self.low, (self.high - self.low) / bins


def summarize(df: DataFrame, x: str) -> Summary:
    """Read once, by histogram, density and box, what they all need."""
    values = numbers(df, [x]).dropna().withColumnRenamed(x, "x")
    c = F.col("x")
    n, low, high, std = values.agg(F.count(c), F.min(c), F.max(c), F.stddev_samp(c)).first()
    if n == 0:
        raise ValueError(f"column {x!r} has no values")
    return Summary(values, n, low, high, std, *exact_quantiles(values, {"x": [0.25, 0.5, 0.75]}, {"x": n})["x"])


def bar_numeric(df: DataFrame, x: str) -> tuple[DataFrame, DataFrame]:
    """Histogram and density of a numeric column."""
    summary = summarize(df, x)
    return histogram(df, x, summary), kde(df, x, summary=summary)


def histogram(df: DataFrame, x: str, summary: Summary | None = None) -> DataFrame:
    """(bin, left, right, n) of the filled bins; the last bin includes its right edge."""
    summary = summary or summarize(df, x)
    bins, start, width = summary.bins
    place = F.least(F.floor((F.col("x") - F.lit(start)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    edge = F.lit(start) + F.col("bin") * F.lit(width)
    return (
        summary.values.groupBy(place.alias("bin"))
        .agg(F.count("*").alias("n"))
        .select("bin", edge.alias("left"), (edge + F.lit(width)).alias("right"), "n")
    )


def kde(df: DataFrame, x: str, points: int = GRID_POINTS, summary: Summary | None = None) -> DataFrame:
    """(point, x, density, height): Gaussian density with Scott's bandwidth on an even grid.

    `height` is the density on the histogram's scale of counts. A row only
    meets the grid points within the reach of its kernel, and the terms are
    summed before the shuffle.
    """
    s = summary or summarize(df, x)
    if s.n < 2 or not s.std:
        raise ValueError(f"column {x!r} has no spread, so it has no density")
    bandwidth = s.std * s.n ** (-0.2)
    step = (s.high - s.low) / (points - 1)
    reach = KERNEL_REACH * bandwidth
    _, _, width = s.bins

    def nearest(bound: Column, rounding, limit, last: int) -> Column:
        return limit(rounding((bound - F.lit(s.low)) / F.lit(step)).cast("int"), F.lit(last))

    first = nearest(F.col("x") - F.lit(reach), F.ceil, F.greatest, 0)
    last = nearest(F.col("x") + F.lit(reach), F.floor, F.least, points - 1)
    met = s.values.withColumns({"first": first, "last": last}).filter("first <= last")
    at = F.lit(s.low) + F.col("point") * F.lit(step)
    z = (at - F.col("x")) / F.lit(bandwidth)
    sums = (
        met.select("x", F.explode(F.sequence("first", "last")).alias("point"))
        .groupBy("point")
        .agg(F.sum(F.exp(-0.5 * z * z)).alias("total"))
    )
    density = F.coalesce(F.col("total"), F.lit(0.0)) / F.lit(s.n * bandwidth * math.sqrt(2 * math.pi))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    return grid.join(F.broadcast(sums), "point", "left").select(
        "point", at.alias("x"), density.alias("density"), (density * F.lit(s.n * width)).alias("height")
    )


def pie_share(df: DataFrame, x: str, k: int = PIE_CATEGORIES) -> DataFrame:
    """(x, n, percent): the most frequent values and their share of these values' total."""
    if is_numeric(field(df, x).dataType):
        raise ValueError(f"a pie chart is not suitable for the numeric column {x!r}")
    top = bar_count(df, x, k)
    total = F.sum("n").over(Window.partitionBy())  # over at most k rows
    return top.select("x", "n", F.round(100.0 * F.col("n") / total, 1).alias("percent"))


def _outside(s: Summary) -> Column:
    reach = WHISKER_FACTOR * (s.q3 - s.q1)
    return (F.col("x") < F.lit(s.q1 - reach)) | (F.col("x") > F.lit(s.q3 + reach))


def box_stats(df: DataFrame, x: str, summary: Summary | None = None) -> DataFrame:
    """(q1, median, q3, whisker_low, whisker_high, fliers), one row."""
    s = summary or summarize(df, x)
    inside = F.when(~_outside(s), F.col("x"))
    return s.values.agg(
        F.lit(s.q1).alias("q1"),
        F.lit(s.median).alias("median"),
        F.lit(s.q3).alias("q3"),
        F.least(F.min(inside), F.lit(s.q1)).alias("whisker_low"),
        F.greatest(F.max(inside), F.lit(s.q3)).alias("whisker_high"),
        F.count_if(_outside(s)).alias("fliers"),
    )


def box_fliers(df: DataFrame, x: str, summary: Summary | None = None) -> DataFrame:
    """(x): the values beyond the whiskers."""
    s = summary or summarize(df, x)
    return s.values.filter(_outside(s))


def crosstab_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n) of the pairs that occur."""
    pairs = df.select(col(x).cast("string").alias("x"), col(y).cast("string").alias("y")).dropna()
    return pairs.groupBy("x", "y").agg(F.count("*").alias("n"))


def _labels(counts: DataFrame, side: str) -> list[str] | None:
    """The side's labels in order, or None if there are too many to list."""
    found = counts.select(side).distinct().limit(DENSE_LABELS + 1).collect()
    return None if len(found) > DENSE_LABELS else sorted(r[0] for r in found)


def crosstab(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n) of all pairs of a label of x and a label of y; 0 where a pair does not occur."""
    counts = crosstab_counts(df, x, y)
    listed, other = "y", "x"
    labels = _labels(counts, listed)
    if labels is None:
        listed, other = "x", "y"
        labels = _labels(counts, listed)
    if labels is None:
        raise ValueError(f"{x!r} and {y!r} have too many labels to fill with zeros; use crosstab_counts")
    if not labels:
        raise ValueError(f"{x!r} and {y!r} have no common rows")
    # One literal, whatever the number of labels.
    all_labels = F.from_json(F.lit(json.dumps(labels)), "array<string>")
    cells = counts.select(other).distinct().select(other, F.explode(all_labels).alias(listed))
    return cells.join(counts, ["x", "y"], "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n"))


def crosstab_wide(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row per label of x, one column of counts per label of y."""
    counts = crosstab_counts(df, x, y)
    labels = _labels(counts, "y")
    if labels is None:
        raise ValueError(f"{y!r} has too many labels for columns; use crosstab or crosstab_counts")
    return counts.groupBy("x").pivot("y", labels).agg(F.first("n")).fillna(0)


def corr_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """(row, column, r): the 2x2 correlation matrix; null where a column is constant."""
    a, b = F.col("a"), F.col("b")
    pair = df.select(number(df, x).alias("a"), number(df, y).alias("b"))
    own = {c: F.when(F.stddev_pop(c) > 0, 1.0) for c in ("a", "b")}
    r = pair.agg(pearson(a, b).alias("ab"), own["a"].alias("aa"), own["b"].alias("bb"))
    cells = [(x, x, "aa"), (x, y, "ab"), (y, x, "ab"), (y, y, "bb")]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("row"), F.lit(j).alias("column"), F.col(c).alias("r"))
            for i, j, c in cells
        ]
    )
    return r.select(F.inline(rows))


def line_series(
    df: DataFrame, x: str, y: str, band: str = "normal", key: str | list[str] | None = None,
    replicates: int = REPLICATES, seed: int = 42,
) -> DataFrame:
    """(x, mean_y, low, high, n) in x order: mean of y and its 95 % band per x.

    The band is normal, or with `band="bootstrap"` the central 95 % of the means of
    resampled rows; see `bootstrap_means`, which needs a `key` that identifies a row.
    """
    if band not in BANDS:
        raise ValueError(f"unknown band {band!r}; use one of {BANDS}")
    pairs = df.select(number(df, x).alias("x"), number(df, y).alias("y")).dropna()
    if band == "bootstrap":
        lines = pairs.groupBy("x").agg(F.avg("y").alias("mean_y"), F.count("*").alias("n"))
        means = bootstrap_means(df, x, y, key, replicates, seed)
        ends = means.groupBy("x").agg(F.percentile("mean_y", F.lit(0.025)).alias("low"), F.percentile("mean_y", F.lit(0.975)).alias("high"))
        return lines.join(ends, "x", "left").select("x", "mean_y", "low", "high", "n").orderBy("x")
    reach = F.lit(NORMAL_95) * F.col("std") / F.sqrt("n")
    return (
        pairs.groupBy("x")
        .agg(F.avg("y").alias("mean_y"), F.stddev_samp("y").alias("std"), F.count("*").alias("n"))
        .select("x", "mean_y", (F.col("mean_y") - reach).alias("low"), (F.col("mean_y") + reach).alias("high"), "n")
        .orderBy("x")
    )


def bootstrap_means(
    df: DataFrame, x: str, y: str, key: str | list[str] | None, replicates: int = REPLICATES, seed: int = 42
) -> DataFrame:
    """(x, replicate, mean_y): the mean of y per x in each of `replicates` resamplings of the rows.

    In a replicate a row counts as often as a Poisson variable of mean 1 says, which
    is read off a digest of its `key` values; so replicates do not depend on the
    partitions, and are sums that are combined before the shuffle. An x of which a
    replicate has no row is missing there. Rows of one key count alike, so the key
    must tell rows apart.
    """
    if key is None:
        raise ValueError("a bootstrap needs a key that identifies a row")
    keys = [col(k).cast("string") for k in ([key] if isinstance(key, str) else key)]
    name = F.concat_ws("|", *[F.coalesce(k, F.lit("\\N")) for k in keys], F.lit(str(seed)))
    pairs = df.select(number(df, x).alias("x"), number(df, y).alias("y"), name.alias("name")).dropna(subset=["x", "y"])
    # A digest has 32 digits: enough for four replicates of 8 digits.
    blocks = pairs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4))))
    blocks = blocks.withColumn("h", F.md5(F.concat_ws("|", "name", "block").cast("binary")))
    weights = []
    for i in range(4):
        u = F.substring("h", 8 * i + 1, 8)
        weights.append(reduce(add, [(u >= s).cast("int") for s in poisson_steps()]))
    sums = blocks.groupBy("x", "block").agg(
        *[F.sum(w).alias(f"w{i}") for i, w in enumerate(weights)],
        *[F.sum(w * F.col("y")).alias(f"s{i}") for i, w in enumerate(weights)],
    )
    parts = F.array(*[
        F.struct((F.col("block") * 4 + i).alias("replicate"), (F.col(f"s{i}") / F.nullif(F.col(f"w{i}"), F.lit(0))).alias("mean_y"))
        for i in range(4)
    ])
    found = sums.select("x", F.inline(parts))
    return found.filter((F.col("replicate") < replicates) & F.col("mean_y").isNotNull())


def poisson_steps() -> list[str]:
    """Eight hexadecimal digits are at or above step i with the chance that a Poisson variable of mean 1 exceeds i."""
    steps, term, total = [], math.exp(-1), 0.0
    for i in range(12):
        total += term
        steps.append(f"{math.ceil(total * 16**8):08x}")
        term /= i + 1
    return [s for s in steps if len(s) == 8]


def area_series(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) in x order."""
    return df.select(number(df, x).alias("x"), number(df, y).alias("y")).dropna().orderBy("x", "y")
