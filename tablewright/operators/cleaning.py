"""Dropping empty columns, imputing missing values and removing outliers.

What is learned from a table (fill values, bounds) is a small dataclass whose
`apply` is a plain projection or filter, so it also works on another table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from dataclasses import field as default

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chained import chained_quartiles
from ..functions.columns import batches, col, field, is_numeric, is_text, number, numbers, numeric_columns, present
from ..functions.quantiles import DIRECT_ROWS, Guess, exact_quantiles, guess_quantiles
from ..sources.workspace import staged

# Bounds lie this many interquartile ranges beyond the quartiles.
IQR_FACTOR = 1.5
QUARTILES = [0.25, 0.75]

# Texts longer than this on average are counted by digest.
LONG_TEXT_BYTES = 100
# Digests that are broadcast for a lookup (32 bytes each).
LOOKUP_DIGESTS = 100_000


def require_nonempty(df: DataFrame) -> None:
    """Raise ValueError unless `df` is a table with columns and rows."""
    if not hasattr(df, "schema"):
        raise ValueError("the loaded data is not a DataFrame")
    if not df.columns:
        raise ValueError("the dataset has no columns")
    if df.isEmpty():
        raise ValueError("the dataset is empty")


@dataclass(frozen=True)
class Missing:
    """Rows, per column the non-missing count and (for numerics) the mean, and the columns of long texts."""

    rows: int
    known: dict[str, int]
    means: dict[str, float | None]
    long: list[str]


def count_missing(df: DataFrame) -> Missing:
    known: dict[str, int] = {}
    means: dict[str, float | None] = {}
    long: list[str] = []
    rows = 0
    for chunk in batches(df.schema.fields, per_item=2):
        aggregates = [F.count("*").alias("rows")]
        for i, f in enumerate(chunk):
            aggregates.append(F.count(present(f)).alias(f"k{i}"))
            if is_numeric(f.dataType):
                aggregates.append(F.avg(number(df, f.name)).alias(f"m{i}"))
            elif is_text(f.dataType):
                aggregates.append(F.avg(F.octet_length(col(f.name))).alias(f"b{i}"))
        row = df.agg(*aggregates).first()
        rows = row["rows"]
        for i, f in enumerate(chunk):
            known[f.name] = row[f"k{i}"]
            if is_numeric(f.dataType):
                means[f.name] = row[f"m{i}"]
            elif is_text(f.dataType) and (row[f"b{i}"] or 0) > LONG_TEXT_BYTES:
                long.append(f.name)
    return Missing(rows, known, means, long)


def drop_empty_columns(df: DataFrame, missing: Missing | None = None) -> DataFrame:
    """Remove the columns in which every value is missing."""
    missing = missing or count_missing(df)
    return df.select(*[col(c) for c in df.columns if missing.known[c] > 0])


@dataclass(frozen=True)
class Imputation:
    """Fill values per column; numeric columns become double where they are filled."""

    fills: dict[str, object]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[self._filled(f) for f in df.schema.fields])

    def _filled(self, f: T.StructField) -> Column:
        if f.name not in self.fills:
            return col(f.name)
        value = present(f)
        if is_numeric(f.dataType):
            value = value.cast("double")
        return F.coalesce(value, F.lit(self.fills[f.name])).alias(f.name)


def fit_mean(df: DataFrame, columns: list[str] | None = None, missing: Missing | None = None) -> Imputation:
    missing = missing or count_missing(df)
    chosen = numeric_columns(df) if columns is None else columns
    return Imputation(
        {c: missing.means[c] for c in chosen if 0 < missing.known[c] < missing.rows}
    )


def impute_mean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing numbers become the column's mean."""
    return fit_mean(df, columns).apply(df)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for the non-null values of several columns, as text, in one shuffle."""
    texts = df.select(*[col(c).cast("string").alias(c) for c in columns])
    return (
        texts.unpivot([], [col(c) for c in columns], "column", "value")
        .dropna()
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def most_frequent(df: DataFrame, columns: list[str], long: list[str] | None = None) -> DataFrame:
    """(column, unique, top, freq): distinct values, the most frequent one (smallest on ties), its count.

    Columns named in `long` hold long texts; of these only digests are shuffled.
    """
    long = long or []
    parts = [_most_frequent_digest(df, c) for c in long]
    short = [c for c in columns if c not in long]
    if short:
        parts.append(
            value_counts(df, short)
            .groupBy("column")
            .agg(
                F.count("*").alias("unique"),
                F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
                F.max("n").alias("freq"),
            )
        )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _most_frequent_digest(df: DataFrame, column: str) -> DataFrame:
    texts = df.select(col(column).cast("string").alias("value")).dropna()
    digested = texts.withColumn("digest", F.unhex(F.sha2("value", 256)))
    counts = staged(digested.groupBy("digest").agg(F.count("*").alias("n")), "digests")
    unique, freq = counts.agg(F.count("*"), F.max("n")).first()
    # The top value is the smallest text among the most frequent ones. If none
    # repeats, these are all texts; else few digests remain to look up.
    if freq is not None and freq > 1:
        tied = counts.filter(F.col("n") == freq).select("digest")
        if tied.limit(LOOKUP_DIGESTS + 1).count() <= LOOKUP_DIGESTS:
            tied = F.broadcast(tied)
        digested = digested.join(tied, "digest", "left_semi")
    top = digested.agg(F.min("value").alias("top"))
    return top.select(
        F.lit(column).alias("column"),
        F.lit(unique).cast("bigint").alias("unique"),
        "top",
        F.lit(freq).cast("bigint").alias("freq"),
    )


def _has_mode(dtype: T.DataType) -> bool:
    # A boolean column with gaps is text-like to the reader of a CSV.
    return is_text(dtype) or isinstance(dtype, T.BooleanType)


def fit_mode(df: DataFrame, columns: list[str] | None = None, missing: Missing | None = None) -> Imputation:
    missing = missing or count_missing(df)
    chosen = [f.name for f in df.schema.fields if _has_mode(f.dataType)] if columns is None else columns
    gaps = [c for c in chosen if 0 < missing.known[c] < missing.rows]
    if not gaps:
        return Imputation({})
    tops = {r["column"]: r["top"] for r in most_frequent(df, gaps, [c for c in missing.long if c in gaps]).collect()}
    for c in gaps:
        if isinstance(field(df, c).dataType, T.BooleanType):
            tops[c] = tops[c] == "true"
    return Imputation(tops)


def impute_mode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing texts become the most frequent value; the smallest one on ties."""
    return fit_mode(df, columns).apply(df)


def impute_report(df: DataFrame, missing: Missing | None = None) -> DataFrame:
    """(position, column, missing, action): what imputation does to each column."""
    missing = missing or count_missing(df)
    rows = []
    for i, f in enumerate(df.schema.fields):
        gaps = missing.rows - missing.known[f.name]
        if gaps == 0:
            action = "none"
        elif missing.known[f.name] == 0:
            action = "drop"
        elif is_numeric(f.dataType):
            action = "mean"
        elif _has_mode(f.dataType):
            action = "mode"
        else:
            action = "skip"
        rows.append((i, f.name, gaps, action))
    return df.sparkSession.createDataFrame(rows, "position int, column string, missing bigint, action string")


@dataclass(frozen=True)
class Bounds:
    """Quartiles and inclusive bounds of one column; no bounds if it has one value or none."""

    column: str
    rows: int
    q1: float | None = None
    q3: float | None = None
    whole: bool = False

    @property
    def lower(self) -> float | None:
        return None if self.q1 is None else self.q1 - IQR_FACTOR * (self.q3 - self.q1)

    @property
    def upper(self) -> float | None:
        return None if self.q3 is None else self.q3 + IQR_FACTOR * (self.q3 - self.q1)

    def inside(self) -> Column:
        # On the bare column and in its own type, so that Parquet row groups can be skipped by it.
        low, high = self.lower, self.upper
        if self.whole:
            low, high = max(math.ceil(low), -(2**63)), min(math.floor(high), 2**63 - 1)
        return (col(self.column) >= F.lit(low)) & (col(self.column) <= F.lit(high))


def iqr_bounds(df: DataFrame, column: str) -> Bounds:
    """Quartiles (linear interpolation) and the bounds 1.5 interquartile ranges beyond them."""
    return fit_bounds(df, [column])[0]


def fit_bounds(df: DataFrame, columns: list[str]) -> list[Bounds]:
    """Bounds of several columns, each over the whole table."""
    missing = count_missing(df.select(*[col(c) for c in columns]))
    known = {c: missing.known[c] for c in columns}
    quartiles = exact_quantiles(df, {c: QUARTILES for c in columns}, known)
    return [Bounds(c, missing.rows, *quartiles[c], _is_whole(df, c)) for c in columns]


def _is_whole(df: DataFrame, column: str) -> bool:
    return isinstance(field(df, column).dataType, T.IntegralType)


@dataclass(frozen=True)
class OutlierFilter:
    """Bounds in the order they apply; each was fitted on the rows the earlier ones kept."""

    bounds: list[Bounds] = default(default_factory=list)
    rows_after: int = 0

    def apply(self, df: DataFrame) -> DataFrame:
        for b in self.bounds:
            if b.q1 is not None:
                df = df.filter(b.inside())
        return df


@dataclass(frozen=True)
class _Facts:
    """What the fit needs to know of a column on some rows."""

    rows: int
    known: int
    low: float | None
    high: float | None
    q1: float | None
    q3: float | None


def _facts(df: DataFrame, names: list[str], at_most: int, guesses: dict[str, list[Guess]]) -> dict[str, _Facts]:
    direct = at_most <= DIRECT_ROWS
    values = numbers(df, names)
    basics: dict[str, tuple] = {}
    quartiles: dict[str, list] = {}
    counted: list[tuple[Guess, list[int]]] = []
    for chunk in batches(names, per_item=4 if direct else 11):
        aggregates = [F.count("*").alias("rows")]
        for i, c in enumerate(chunk):
            x = col(c)
            aggregates += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"low{i}"), F.max(x).alias(f"high{i}")]
            if direct:
                aggregates.append(F.percentile(x, F.array(*[F.lit(p) for p in QUARTILES])).alias(f"q{i}"))
            tests = [t for g in guesses.get(c, []) for t in g.tests()] if not direct else []
            aggregates += [F.expr(f"count_if({t}) AS t{i}_{j}") for j, t in enumerate(tests)]
        row = values.agg(*aggregates).first()
        for i, c in enumerate(chunk):
            basics[c] = (row["rows"], row[f"n{i}"], row[f"low{i}"], row[f"high{i}"])
            if direct:
                quartiles[c] = row[f"q{i}"]
                continue
            for k, g in enumerate(guesses.get(c, [])):
                counted.append((g, [row[f"t{i}_{j}"] for j in range(4 * k, 4 * k + 4)]))
    if not direct:
        # A column with one value or none needs no quartiles.
        varied = [c for c in names if basics[c][1] and basics[c][2] != basics[c][3]]
        quartiles = exact_quantiles(
            values, {c: QUARTILES for c in varied}, {c: basics[c][1] for c in varied}, counted=counted
        )
    return {c: _Facts(*basics[c], *(quartiles.get(c) or (None, None))) for c in names}


def fit_outliers(df: DataFrame, columns: list[str] | None = None, rows: int | None = None) -> OutlierFilter:
    """Fit the bounds column by column in schema order.

    Each column's quartiles depend on what the earlier bounds kept. On large tables
    all are found together, in a few scans however many columns remove rows. On
    small ones, and if a guess of that way fails, all columns are read together;
    that is enough up to the first column whose bounds remove a row. After it the
    columns left are read together on the rows left, and so on.
    """
    names = numeric_columns(df) if columns is None else columns
    at_most = df.count() if rows is None else rows
    if not names:
        return OutlierFilter([], at_most)
    if at_most > DIRECT_ROWS and len(set(names)) == len(names):
        found = chained_quartiles(df, {c: _is_whole(df, c) for c in names}, at_most, IQR_FACTOR)
        if found is not None:
            return OutlierFilter([Bounds(c, q.rows, q.q1, q.q3, _is_whole(df, c)) for c, q in zip(names, found[0], strict=True)], found[1])
    guesses = {}
    if at_most > DIRECT_ROWS:
        guesses = guess_quantiles(df, {c: QUARTILES for c in names}, {c: at_most for c in names})
    together = _facts(df, names, at_most, guesses)
    kept, left, complete = df, at_most, True
    bounds: list[Bounds] = []
    for at, name in enumerate(names):
        if not complete:
            together, complete = _facts(kept, names[at:], left, guesses), True
        facts = together[name]
        left = facts.rows
        if facts.known == 0 or facts.low == facts.high:
            bounds.append(Bounds(name, left))
            continue
        bound = Bounds(name, left, facts.q1, facts.q3, _is_whole(df, name))
        bounds.append(bound)
        inside = facts.known == facts.rows and bound.lower <= facts.low and facts.high <= bound.upper
        if not inside:
            kept, complete = kept.filter(bound.inside()), False
    return OutlierFilter(bounds, left if complete else kept.count())


def remove_outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Keep the rows inside the bounds of every numeric column, one column after the other."""
    return fit_outliers(df, columns).apply(df)


def outlier_report(df: DataFrame, fitted: OutlierFilter | None = None) -> DataFrame:
    """(position, column, q1, q3, lower, upper, rows_before, rows_after) per numeric column."""
    fitted = fitted or fit_outliers(df)
    after = [b.rows for b in fitted.bounds[1:]] + [fitted.rows_after]
    rows = [
        (i, b.column, b.q1, b.q3, b.lower, b.upper, b.rows, left)
        for i, (b, left) in enumerate(zip(fitted.bounds, after, strict=True))
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "position int, column string, q1 double, q3 double, lower double, upper double, "
        "rows_before bigint, rows_after bigint",
    )


def flag_outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add `<column>_outlier`: true outside the bounds of the whole table, null for missing values."""
    names = numeric_columns(df) if columns is None else columns
    flags = {
        f"{b.column}_outlier": F.when(number(df, b.column).isNotNull(), ~b.inside())
        if b.q1 is not None
        else F.lit(None).cast("boolean")
        for b in fit_bounds(df, names)
    }
    return df.withColumns(flags)
