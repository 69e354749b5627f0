"""An order of rows that depends on their values alone, and the place where its first k rows end.

The order is that of MD5 digests, which every SQL engine has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import staged
from .columns import col

# Hexadecimal digits of a digest that make the order, and how many of them a round decides.
DIGITS = 15
ROUND_DIGITS = 4
# Digests that the driver may hold to end the search.
LISTED = 10_000
# Copies that one row of a list of copies stands for.
_COPIES = 100_000


def digest(keys: list[Column], seed: int) -> Column:
    """The first 15 hexadecimal digits of the MD5 of the values as texts and the seed, with `|` between; null as \\N."""
    texts = [F.coalesce(k.cast("string"), F.lit("\\N")) for k in keys]
    return F.substring(F.md5(F.concat_ws("|", *texts, F.lit(str(seed))).cast("binary")), 1, DIGITS)


@dataclass(frozen=True)
class Cut:
    """Digests below `at` are `below` rows; `equal` rows have it themselves."""

    at: str
    below: int
    equal: int


def find_cut(digests: DataFrame, k: int) -> Cut:
    """Where the `k` (at least 1) smallest of the digests in column `h` end.

    Each round counts the rows by the next digits among those that share the digits
    known so far, so rows are never sorted or moved; two or three scans do for 10^12.
    """
    prefix, below = "", 0
    while True:
        size = len(prefix) + ROUND_DIGITS
        left = digests.filter(F.col("h").startswith(prefix)) if prefix else digests
        groups = left.groupBy(F.substring("h", 1, size).alias("p")).agg(F.count("*").alias("n")).collect()
        for group in sorted(groups, key=lambda g: g["p"]):
            if below + group["n"] >= k:
                break
            below += group["n"]
        else:
            raise ValueError(f"fewer than {k} rows")
        prefix = group["p"]
        if size >= DIGITS:
            return Cut(prefix, below, group["n"])
        if group["n"] <= LISTED:
            listed = sorted(r["h"] for r in digests.filter(F.col("h").startswith(prefix)).select("h").collect())
            at = listed[k - below - 1]
            return Cut(at, below + listed.index(at), listed.count(at))


def first_rows(df: DataFrame, k: int, keys: list[str], seed: int, kept: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Exactly the `k` first rows in the order of the digests of `keys`, and all others.

    Rows of one key that the end falls among go by the digest of the whole row.
    Rows that are alike in all columns are copies: as many as needed are counted out.
    With `kept`, only these columns are returned; they are written to the shared folder once, with
    each row's side, as otherwise each scan of the rows computes all digests anew.
    """
    if k <= 0:
        return (df.limit(0), df) if kept is None else (df.select(*map(col, kept)).limit(0), df.select(*map(col, kept)))
    own = digest([col(c) for c in keys], seed)
    cut = find_cut(df.select(own.alias("h")), k)
    if cut.below + cut.equal == k:
        return _sides(df, own <= cut.at, own > cut.at, kept)
    # Columns of any type as one text; the name of the struct's fields does not matter.
    whole = digest([F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"})], seed)
    border = df.filter(own == cut.at)
    inner = find_cut(border.select(whole.alias("h")), k - cut.below)
    before = (own < cut.at) | ((own == cut.at) & (whole < inner.at))
    after = (own > cut.at) | ((own == cut.at) & (whole > inner.at))
    chosen = k - cut.below - inner.below
    if chosen == inner.equal:
        return _sides(df, ~after, after, kept)
    one = border.filter(whole == inner.at).limit(1)
    if kept is not None:
        one = _written(one, kept)
    first, rest = _sides(df, before, after, kept)
    return first.unionByName(_copies(one, chosen)), rest.unionByName(_copies(one, inner.equal - chosen))


def _sides(df: DataFrame, first: Column, rest: Column, kept: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """The rows of the one and of the other side; no row is of both."""
    if kept is None:
        return df.filter(first), df.filter(rest)
    side = F.when(first, 0).when(rest, 1)
    name = "_".join(["side", *kept])
    written = _written(df.withColumn(name, side), [*kept, name])
    return tuple(written.filter(col(name) == i).drop(name) for i in (0, 1))


def _written(df: DataFrame, columns: list[str]) -> DataFrame:
    """These columns, of any names, written to the shared folder."""
    plain = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return staged(plain, "rows").toDF(*columns)


def _copies(one: DataFrame, n: int) -> DataFrame:
    """A single row `n` times, made by many tasks where these are many."""
    name = "_".join(["copies", *one.columns])
    lots, rest = divmod(n, _COPIES)
    sizes = F.concat(F.array_repeat(F.lit(_COPIES), lots), F.array(F.lit(rest)))
    made = one.withColumn(name, F.explode(sizes))
    made = made.repartition(min(lots, 1000)) if lots > 1 else made
    return made.withColumn(name, F.explode(F.array_repeat(F.lit(0), col(name)))).drop(name)
