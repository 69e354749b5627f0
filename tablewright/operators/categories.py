"""Categories of any number as sparse 0/1 vectors: the index is a table that rows are joined to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..functions.ranking import LISTED_VALUES, sorted_codes
from ..sources.workspace import staged

# Rows of one value above this share of all rows are not shuffled.
HOT_SHARE = 10_000
# Entries that a vector can count.
MOST_ENTRIES = 2**31 - 1


@dataclass(frozen=True)
class Categories:
    """The index of a column: `codes` (digest, code, hot) in the shared folder, a row for each of `size` values.

    Values are known by their SHA-256 digest, so a row is small however long its text.
    """

    codes: DataFrame
    size: int


def _digest(column: str) -> Column:
    return F.unhex(F.sha2(col(column), 256))


def fit_categories(df: DataFrame, column: str) -> Categories:
    """Number the column's distinct values in sorted order. Nulls have no code.

    Nothing is gathered: values are numbered by ranges, and counted by digest with
    partial sums. Hot are those of more than a ten-thousandth of all rows.
    """
    values = df.select(col(column).alias("category"))
    counts = values.dropna().groupBy(_digest("category").alias("digest")).agg(F.count("*").alias("n"))
    codes = sorted_codes(values, "category", listed_values=0)
    rows = df.count()
    found = codes.select(_digest("category").alias("digest"), "code").join(counts, "digest")
    found = staged(found.select("digest", "code", (F.col("n") * HOT_SHARE > rows).alias("hot")), "categories")
    return Categories(found, found.count())


def with_category_code(df: DataFrame, column: str, fitted: Categories, out: str, listed_values: int = LISTED_VALUES) -> DataFrame:
    """Add the code of each value; null for nulls and for values that the fit has not seen.

    Up to `listed_values` codes are broadcast. Beyond, rows of hot values (at most 10,000
    values) meet a broadcast of these, and only the other rows are shuffled to the
    codes. Rows that have their code by then, or no value, are dealt out evenly. A frequent
    unseen value is a plain skewed key of this join, which Spark splits.
    """
    keyed = df.withColumn("tw_digest", _digest(column))
    codes = fitted.codes
    if fitted.size <= listed_values:
        known = codes.select(F.col("digest").alias("tw_digest"), F.col("code").alias(out))
        return keyed.join(F.broadcast(known), "tw_digest", "left").drop("tw_digest")
    hot = codes.filter("hot").select(F.col("digest").alias("tw_digest"), F.col("code").alias("tw_hot"))
    cold = codes.filter("NOT hot").select(F.col("digest").alias("tw_key"), F.lit(0).cast("long").alias("tw_salt"), F.col("code").alias("tw_cold"))
    keyed = keyed.join(F.broadcast(hot), "tw_digest", "left")
    searched = F.col("tw_hot").isNull() & F.col("tw_digest").isNotNull()
    keyed = keyed.withColumns(
        {"tw_key": F.when(searched, F.col("tw_digest")), "tw_salt": F.when(searched, F.lit(0)).otherwise(F.monotonically_increasing_id())}
    )
    coded = keyed.join(cold, ["tw_key", "tw_salt"], "left").withColumn(out, F.coalesce("tw_hot", "tw_cold"))
    return coded.drop("tw_digest", "tw_hot", "tw_key", "tw_salt", "tw_cold")


def sparse_vector(entries: list[tuple[Column, Column | float]], size: int) -> Column:
    """A sparse vector of `size` from (place, value) in rising order of place; null places and zeros are left out.

    It is spelled as JSON and read as a vector, since no SQL function makes sparse
    vectors: no Python, and no attribute of each entry in the schema.
    """
    if size > MOST_ENTRIES:
        raise ValueError(f"a vector holds at most {MOST_ENTRIES} entries, not {size}")
    pairs = [F.struct(i.cast("int").alias("i"), (v if isinstance(v, Column) else F.lit(float(v))).alias("v")) for i, v in entries]
    kept = F.filter(F.array(*pairs), lambda x: x["i"].isNotNull() & (x["v"] != 0))
    spelled = F.struct(
        F.lit(0).alias("type"),
        F.lit(size).alias("size"),
        F.transform(kept, lambda x: x["i"]).alias("indices"),
        F.transform(kept, lambda x: x["v"]).alias("values"),
    )
    kind = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(spelled.alias("v"))), kind)["v"]


def sparse_parts(vector: Column) -> Column:
    """A sparse vector as struct(size, indices, values)."""
    parts = "v struct<size int, indices array<int>, values array<double>>"
    return F.from_json(F.to_json(F.struct(vector.alias("v"))), parts)["v"]


class JoinedCategories(Transformer):
    """Adds `out`: the numbers, then for each text column a 1 at its value's place.

    An unseen or null text has only zeros.
    """

    def __init__(self, numbers: list[str], texts: dict[str, Categories], out: str, listed_values: int = LISTED_VALUES):
        super().__init__()
        self.numbers, self.texts, self.out, self.listed_values = numbers, texts, out, listed_values
        self.size = len(numbers) + sum(c.size for c in texts.values())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        entries = [(F.lit(i), col(c)) for i, c in enumerate(self.numbers)]
        coded, start, added = dataset, len(self.numbers), []
        for i, (c, fitted) in enumerate(self.texts.items()):
            added.append(f"tw_place{i}")
            coded = with_category_code(coded, c, fitted, added[-1], self.listed_values)
            entries.append((F.col(added[-1]) + start, 1.0))
            start += fitted.size
        return coded.withColumn(self.out, sparse_vector(entries, self.size)).drop(*added)


def encode_categories(df: DataFrame, columns: list[str], out: str = "categories", fitted: dict[str, Categories] | None = None) -> DataFrame:
    """Replace text columns of any number of values by one sparse vector `out`, the values of each column in sorted order.

    With `fitted` categories, a value that is not among them has only zeros.
    """
    fitted = fitted or {c: fit_categories(df, c) for c in columns}
    return JoinedCategories([], {c: fitted[c] for c in columns}, out).transform(df).drop(*columns)
