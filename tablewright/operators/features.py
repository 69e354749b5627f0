"""Turning a table into model input: label codes, imputed and scaled numbers, one-hot categories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import batches, col, field, is_numeric, is_text, number, quoted
from ..functions.quantiles import exact_quantiles
from ..functions.ranking import LISTED_VALUES, sorted_codes
from .categories import JoinedCategories, fit_categories

# Fixed value: what a missing category becomes.
MISSING = "missing"

# A model whose columns have at most about so many categories each, and bytes of them, holds their
# index on the driver; for more the index is a table. The vectors are the same.
MODEL_CATEGORIES = 100_000
MODEL_CATEGORY_BYTES = 32 << 20
# Categories that may become columns of a table.
WIDE_CATEGORIES = 1_000


def split_xy(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """The feature columns and the target column."""
    field(df, target)
    return df.drop(target), df.select(col(target))


@dataclass(frozen=True)
class FeatureTypes:
    numeric: list[str]
    categorical: list[str]
    ignored: list[str]


def feature_types(df: DataFrame) -> FeatureTypes:
    """Numbers and texts are features; booleans, dates and nested types are not."""
    kinds = FeatureTypes([], [], [])
    for f in df.schema.fields:
        if is_numeric(f.dataType):
            kinds.numeric.append(f.name)
        elif is_text(f.dataType):
            kinds.categorical.append(f.name)
        else:
            kinds.ignored.append(f.name)
    return kinds


def with_codes(df: DataFrame, column: str, codes: DataFrame, out: str) -> DataFrame:
    """Add the code of each value; null for a value without one."""
    if codes.limit(LISTED_VALUES + 1).count() <= LISTED_VALUES:
        codes = F.broadcast(codes)
    codes = codes.select(col("category").alias("tw_category"), col("code").alias(out))
    return df.join(codes, col(column) == F.col("tw_category"), "left").drop("tw_category")


def label_encode(df: DataFrame, target: str, out: str = "label", codes: DataFrame | None = None) -> DataFrame:
    """Add `out`: the target's code 0..n-1 in sorted order if it is text, else the target itself."""
    if not is_text(field(df, target).dataType):
        return df.withColumn(out, col(target))
    return with_codes(df, target, codes or sorted_codes(df, target), out)


def fit_median(df: DataFrame, columns: list[str]) -> dict[str, float]:
    medians = exact_quantiles(df, {c: [0.5] for c in columns})
    empty = [c for c in columns if medians[c][0] is None]
    if empty:
        raise ValueError(f"columns without any value have no median: {empty}")
    return {c: medians[c][0] for c in columns}


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numbers become the column's exact median; the columns become double."""
    medians = fit_median(df, columns)
    return df.withColumns({c: F.coalesce(number(df, c), F.lit(medians[c])) for c in columns})


@dataclass(frozen=True)
class Scale:
    mean: float
    std: float

    def apply(self, x: Column) -> Column:
        return (x - F.lit(self.mean)) / F.lit(self.std)


def fit_scale(df: DataFrame, columns: list[str], medians: dict[str, float] | None = None) -> dict[str, Scale]:
    """Mean and population standard deviation; a deviation of 0 counts as 1."""
    scales: dict[str, Scale] = {}
    for chunk in batches(columns, per_item=2):
        aggregates = []
        for i, c in enumerate(chunk):
            x = number(df, c)
            if medians:
                x = F.coalesce(x, F.lit(medians[c]))
            aggregates += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
        row = df.agg(*aggregates).first()
        for i, c in enumerate(chunk):
            scales[c] = Scale(row[f"m{i}"], row[f"s{i}"] or 1.0)
    return scales


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation."""
    scales = fit_scale(df, columns)
    return df.withColumns({c: scales[c].apply(number(df, c)) for c in columns})


def impute_constant(df: DataFrame, columns: list[str], value: str = MISSING) -> DataFrame:
    """Missing texts become `value`."""
    return df.withColumns({c: F.coalesce(col(c), F.lit(value)) for c in columns})


def categories(df: DataFrame, column: str, at_most: int) -> list[str]:
    """The column's values in sorted order; an error if there are more than `at_most`."""
    found = df.select(col(column)).dropna().distinct().orderBy(col(column)).limit(at_most + 1).collect()
    if len(found) > at_most:
        raise ValueError(f"column {column!r} has more than {at_most} categories")
    return [r[0] for r in found]


def one_hot(df: DataFrame, columns: list[str], fitted: dict[str, list[str]] | None = None) -> DataFrame:
    """Replace each column by one 0/1 column `<column>=<value>` per category.

    With `fitted` categories, a value that is not among them has only zeros.
    """
    fitted = fitted or {c: categories(df, c, WIDE_CATEGORIES) for c in columns}
    flags = {
        f"{c}={v}": F.coalesce((col(c) == F.lit(v)).cast("int"), F.lit(0)) for c in columns for v in fitted[c]
    }
    return df.withColumns(flags).drop(*columns)


def fit_features(df: DataFrame, out: str = "features") -> PipelineModel:
    """Fit the step from a table to a vector `out` of scaled numbers and one-hot categories.

    Categories stand in sorted order, whatever their number.
    """
    kinds = feature_types(df)
    if not kinds.numeric and not kinds.categorical:
        raise ValueError("there is no numeric or text column to learn from")
    medians = fit_median(df, kinds.numeric) if kinds.numeric else {}
    scales = fit_scale(df, kinds.numeric, medians) if kinds.numeric else {}

    prepared = ["*"]
    for i, c in enumerate(kinds.numeric):
        filled = f"coalesce(nanvl(cast({quoted(c)} AS double), NULL), {medians[c]!r}D)"
        prepared.append(f"({filled} - {scales[c].mean!r}D) / {scales[c].std!r}D AS tw_number{i}")
    for i, c in enumerate(kinds.categorical):
        prepared.append(f"coalesce({quoted(c)}, '{MISSING}') AS tw_text{i}")
    numbers = [f"tw_number{i}" for i in range(len(kinds.numeric))]
    texts = [f"tw_text{i}" for i in range(len(kinds.categorical))]
    codes = [f"tw_code{i}" for i in range(len(texts))]
    flags = [f"tw_flags{i}" for i in range(len(texts))]

    stages = [SQLTransformer(statement=f"SELECT {', '.join(prepared)} FROM __THIS__")]
    if not _listed(df, kinds.categorical):
        ready = stages[0].transform(df)
        return PipelineModel([*stages, JoinedCategories(numbers, {c: fit_categories(ready, c) for c in texts}, out)])
    if texts:
        # An unseen category gets the extra index that the encoder drops: a zero vector.
        stages.append(
            StringIndexer(
                inputCols=texts, outputCols=codes, handleInvalid="keep", stringOrderType="alphabetAsc"
            )
        )
        stages.append(OneHotEncoder(inputCols=codes, outputCols=flags, dropLast=True))
    stages.append(VectorAssembler(inputCols=numbers + flags, outputCol=out))
    return Pipeline(stages=stages).fit(df)


def _listed(df: DataFrame, columns: list[str]) -> bool:
    """Whether the driver may hold the categories: about how many there are, times the longest.

    An empty text cannot name an entry of a listed vector.
    """
    held = 0
    for chunk in batches(columns, per_item=3):
        sizes = [F.octet_length(col(c)) for c in chunk]
        found = [
            F.struct(F.approx_count_distinct(col(c)).alias("n"), F.max(s).alias("most"), F.min(s).alias("least"))
            for c, s in zip(chunk, sizes, strict=True)
        ]
        for r in df.agg(*[f.alias(f"f{i}") for i, f in enumerate(found)]).first():
            held += r["n"] * (r["most"] or 0)
            if r["n"] > MODEL_CATEGORIES or r["least"] == 0 or held > MODEL_CATEGORY_BYTES:
                return False
    return True


def assemble(df: DataFrame) -> DataFrame:
    """The table with its `features` vector, fitted on itself."""
    out = fit_features(df).transform(df)
    return out.select(*[col(c) for c in df.columns], "features")
