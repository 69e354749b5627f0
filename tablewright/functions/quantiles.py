"""Exact quantiles that never gather a column in one task.

Spark's `percentile` and `median` are exact but keep every distinct value of
the column in one aggregation buffer. Here they are used only below
`DIRECT_ROWS`. Above it, a bounded sketch (`percentile_approx`) of a random
sample proposes two values around each wanted rank, one counting job over all
rows says on which side of them the rank lies, and the search goes on strictly
between them. Each round divides the candidates by fifty or more and is a scan
with partial aggregation, so no row is shuffled. The sample only chooses where
to look; the counts decide, so the answer is exact.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import ensure_checkpoint_dir
from .columns import batches, col, number, numbers, quoted

DIRECT_ROWS = 20_000
SKETCH_ACCURACY = 10_000
# Rows offered to a sketch: all of a small interval, 1 % of a huge one.
SAMPLE_ROWS = 20_000
SAMPLE_SHARE = 0.01
# Relative ranks at which grouped sketches are read.
GROUP_GRID = 256
# Per-group state up to this many groups is broadcast (about 10 MB).
BROADCAST_GROUPS = 100_000
# Of more groups, those with over 1 / HOT_GROUPS of all rows are broadcast: at most this many.
HOT_GROUPS = 10_000
# Up to this many groups are searched side by side, each as a column.
LISTED_GROUPS = 32


@dataclass
class _Search:
    """One 0-based rank of one column: among the `rows` values strictly inside (low, high), with `below` before them."""

    column: str
    rank: int
    rows: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    @property
    def wanted(self) -> int:
        return self.rank - self.below

    def inside(self) -> str:
        c = quoted(self.column)
        tests = [f"{c} IS NOT NULL"]
        if self.low is not None:
            tests.append(f"{c} > {_literal(self.low)}")
        if self.high is not None:
            tests.append(f"{c} < {_literal(self.high)}")
        return " AND ".join(tests)

    @property
    def interval(self) -> tuple:
        return (self.column, self.low, self.high, self.rows)

    def move(self, a: float, b: float, lt_a: int, le_a: int, lt_b: int, le_b: int) -> None:
        """Go to the part of the interval that holds the rank, or stop on a or b."""
        if self.rank < lt_a:
            self.high, self.rows = a, lt_a - self.below
        elif self.rank < le_a:
            self.value = a
        elif self.rank < lt_b:
            self.low, self.high, self.below, self.rows = a, b, le_a, lt_b - le_a
        elif self.rank < le_b:
            self.value = b
        else:
            self.low, self.rows, self.below = b, self.below + self.rows - le_b, le_b


def _tests(column: str, a: float, b: float) -> list[str]:
    """The conditions whose counts `_Search.move` takes; one comparison each keeps the job's code small."""
    c = quoted(column)
    return [f"{c} {op} {_literal(v)}" for v in (a, b) for op in ("<", "<=")]


def _literal(value: float) -> str:
    return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"


@dataclass(frozen=True)
class Guess:
    """Two values that probably enclose a quantile."""

    column: str
    probability: float
    low: float
    high: float

    def tests(self) -> list[str]:
        """SQL conditions to count, in the order that `exact_quantiles` expects the counts."""
        return _tests(self.column, self.low, self.high)


def guess_quantiles(
    df: DataFrame, probabilities: dict[str, list[float]], rows: dict[str, int]
) -> dict[str, list[Guess]]:
    """Guesses for many columns in one job, from a sample.

    They stay useful when some rows are filtered out afterwards: a wrong guess
    costs a round of the search, never a wrong result.
    """
    names = [n for n in probabilities if rows[n] > 0]
    values = numbers(df, names)
    out: dict[str, list[Guess]] = {}
    for chunk in batches(names):
        drawn = values.select(*[col(n) for n in chunk], F.rand(0).alias("tw_draw"))
        sketches = []
        for i, n in enumerate(chunk):
            margin = _margin(rows[n])
            around = [q for p in probabilities[n] for q in (max(0.0, p - margin), min(1.0, p + margin))]
            masked = F.expr(
                f"CASE WHEN tw_draw < {_literal(_sampled(rows[n]) / rows[n])} THEN {quoted(n)} END"
            )
            sketches.append(F.percentile_approx(masked, around, SKETCH_ACCURACY).alias(f"s{i}"))
        found = drawn.agg(*sketches).first()
        for n, values_of in zip(chunk, found, strict=True):
            if values_of is not None:
                out[n] = [
                    Guess(n, p, values_of[2 * i], values_of[2 * i + 1])
                    for i, p in enumerate(probabilities[n])
                ]
    return out


def exact_quantiles(
    df: DataFrame,
    probabilities: dict[str, list[float]],
    rows: dict[str, int] | None = None,
    direct_rows: int | None = None,
    counted: list[tuple[Guess, list[int]]] | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of numeric columns.

    `rows` are the exact non-missing counts, where the caller has them. `counted`
    are guesses whose tests the caller counted on these rows in a job of its own.
    """
    limit = DIRECT_ROWS if direct_rows is None else direct_rows
    names = list(probabilities)
    if not names:
        return {}
    values = numbers(df, names)
    counts = rows or _counts(values, names)

    out: dict[str, list[float | None]] = {n: [None] * len(probabilities[n]) for n in names}
    small = [n for n in names if 0 < counts[n] <= limit]
    for chunk in batches(small):
        found = values.agg(
            *[
                F.percentile(col(n), F.array(*[F.lit(float(p)) for p in probabilities[n]])).alias(f"q{i}")
                for i, n in enumerate(chunk)
            ]
        ).first()
        for i, n in enumerate(chunk):
            out[n] = list(found[i])

    large = [n for n in names if counts[n] > limit]
    if large:
        wanted = {n: sorted({r for p in probabilities[n] for r in _ranks(p, counts[n])}) for n in large}
        searches = {n: {r: _Search(n, r, counts[n]) for r in wanted[n]} for n in large}
        for guess, sides in counted or []:
            if guess.column in searches:
                for r in set(_ranks(guess.probability, counts[guess.column])):
                    searches[guess.column][r].move(guess.low, guess.high, *sides)
        at = order_statistics(values, [s for found in searches.values() for s in found.values()], limit)
        for n in large:
            out[n] = [_interpolate(p, counts[n], at[n]) for p in probabilities[n]]
    return out


def _counts(values: DataFrame, names: list[str]) -> dict[str, int]:
    counts: dict[str, int] = {}
    for chunk in batches(names):
        row = values.agg(*[F.count(col(n)).alias(f"n{i}") for i, n in enumerate(chunk)]).first()
        counts.update(zip(chunk, row, strict=True))
    return counts


def _ranks(p: float, n: int) -> tuple[int, int]:
    position = (n - 1) * p
    return math.floor(position), math.ceil(position)


def _interpolate(p: float, n: int, at: dict[int, float]) -> float:
    low, high = _ranks(p, n)
    part = (n - 1) * p - low
    return at[low] if low == high else at[low] * (1 - part) + at[high] * part


def order_statistics(values: DataFrame, searches: list[_Search], limit: int) -> dict[str, dict[int, float]]:
    """Finish the searches of all columns together: column -> rank -> value."""
    seed = 0
    while wide := [s for s in searches if s.value is None and s.rows > limit]:
        seed += 1
        for chunk in batches(wide, per_item=2):
            _narrow(values, chunk, seed)
    for chunk in batches([s for s in searches if s.value is None]):
        _pick(values, chunk)
    out: dict[str, dict[int, float]] = defaultdict(dict)
    for s in searches:
        out[s.column][s.rank] = s.value
    return out


def _narrow(values: DataFrame, searches: list[_Search], seed: int) -> None:
    # One sketch per interval serves every rank that lies in it.
    by_interval: dict[tuple, list[_Search]] = defaultdict(list)
    for s in searches:
        by_interval[s.interval].append(s)
    columns = sorted({s.column for s in searches})
    drawn = values.select(*[col(c) for c in columns], F.rand(seed).alias("tw_draw"))
    sketches = []
    for group in by_interval.values():
        sampled, margin = _sampled(group[0].rows), _margin(group[0].rows)
        probabilities = []
        for s in group:
            p = (s.wanted + 0.5) / s.rows
            probabilities += [max(0.0, p - margin), min(1.0, p + margin)]
        chosen = f"{group[0].inside()} AND tw_draw < {_literal(sampled / group[0].rows)}"
        masked = F.expr(f"CASE WHEN {chosen} THEN {quoted(group[0].column)} END")
        sketches.append(F.percentile_approx(masked, probabilities, SKETCH_ACCURACY))
    guesses = drawn.agg(*[e.alias(f"s{i}") for i, e in enumerate(sketches)]).first()
    # Neighbouring ranks get the same pair of values and share their counts.
    bounds: dict[tuple, list[_Search]] = defaultdict(list)
    for group, found in zip(by_interval.values(), guesses, strict=True):
        if found is None:  # nothing was drawn; the next round draws again
            continue
        for i, s in enumerate(group):
            bounds[(s.interval, found[2 * i], found[2 * i + 1])].append(s)
    if not bounds:
        return
    tests = [t for (interval, low, high) in bounds for t in _tests(interval[0], low, high)]
    counts = values.agg(*[F.expr(f"count_if({t}) AS c{i}") for i, t in enumerate(tests)]).first()
    for i, ((_, low, high), group) in enumerate(bounds.items()):
        for s in group:
            s.move(low, high, *counts[4 * i : 4 * i + 4])


def _sampled(rows: int) -> float:
    return min(float(rows), max(SAMPLE_ROWS, rows * SAMPLE_SHARE))


def _margin(rows: int) -> float:
    # Four standard deviations of a sampled rank, and the sketch's own error.
    return 2.0 / math.sqrt(_sampled(rows)) + 1.0 / SKETCH_ACCURACY


def _pick(values: DataFrame, searches: list[_Search]) -> None:
    """Read the ranks from intervals that hold at most `limit` values."""
    if not searches:
        return
    masks = {s.interval: f"CASE WHEN {s.inside()} THEN {quoted(s.column)} END" for s in searches}
    names = {interval: f"v{i}" for i, interval in enumerate(masks)}
    some = " OR ".join(f"({t})" for t in sorted({s.inside() for s in searches}))
    masked = values.filter(some).select(*[F.expr(e).alias(names[i]) for i, e in masks.items()])
    # At most `limit` values per interval.
    lists = masked.agg(*[F.sort_array(F.collect_list(n)).alias(n) for n in names.values()])
    found = lists.select(*[F.get(names[s.interval], F.lit(s.wanted)) for s in searches]).first()
    for s, value in zip(searches, found, strict=True):
        s.value = value


def exact_group_quantile(
    df: DataFrame, group: str, value: str, probability: float, direct_rows: int | None = None
) -> DataFrame:
    """Linearly interpolated quantile of `value` per non-null `group`: (group, quantile).

    A few groups are searched like columns. For more, the state of the search is
    one row per group in a DataFrame, so neither the groups nor a group's values
    meet in one place; a group with a third of all rows is scanned by every task
    like any other.
    """
    limit = DIRECT_ROWS if direct_rows is None else direct_rows
    data = df.select(col(group).alias("g"), number(df, value).alias("y")).dropna()
    sizes = data.groupBy("g").agg(F.count("*").alias("rows"))
    listed = sizes.limit(LISTED_GROUPS + 1).collect()
    if len(listed) <= LISTED_GROUPS:
        return _listed_groups(data, listed, group, probability, limit)
    largest, groups, total = sizes.agg(F.max("rows"), F.count("*"), F.sum("rows")).first()
    if largest <= limit:
        found = data.groupBy("g").agg(F.percentile("y", F.lit(float(probability))).alias("quantile"))
        return found.select(col("g").alias(group), "quantile")

    hot_rows = 0 if groups <= BROADCAST_GROUPS else total // HOT_GROUPS
    position = (F.col("rows") - 1) * F.lit(float(probability))
    none = F.lit(None).cast("double")
    state = sizes.select(
        "g",
        F.floor(position).alias("rank"),
        (position - F.floor(position)).alias("part"),
        F.floor(position).alias("wanted"),
        "rows",
        F.col("rows").alias("size"),
        none.alias("low"),
        none.alias("high"),
        none.alias("found"),
    )
    ensure_checkpoint_dir(df.sparkSession)
    state = state.checkpoint()
    seed = 0
    while largest > limit:
        seed += 1
        state = _narrow_groups(data, state, limit, hot_rows, seed).checkpoint()
        largest = state.filter("found IS NULL").agg(F.max("rows")).first()[0] or 0

    picked = (
        _with_state(data, state.filter("found IS NULL"), hot_rows)
        .filter(_INSIDE)
        .groupBy("g")
        .agg(F.sort_array(F.collect_list("y")).alias("ys"), F.first("wanted").alias("w"))
        .select("g", F.get("ys", F.col("w").cast("int")).alias("picked"))
    )
    lower = state.join(picked, "g", "left").select(
        "g", "rank", "part", "size", F.coalesce("found", "picked").alias("lower")
    )
    # The next order statistic is the same value if it repeats, else the least greater one.
    upper = (
        _with_state(data, lower, hot_rows)
        .groupBy("g")
        .agg(
            F.count_if(F.col("y") <= F.col("lower")).alias("upto"),
            F.min(F.when(F.col("y") > F.col("lower"), F.col("y"))).alias("above"),
            *[F.first(c).alias(c) for c in ("rank", "part", "lower")],
        )
    )
    next_value = F.when(F.col("upto") > F.col("rank") + 1, F.col("lower")).otherwise(
        F.coalesce("above", "lower")
    )
    quantile = F.when(F.col("part") == 0, F.col("lower")).otherwise(
        F.col("lower") * (1 - F.col("part")) + next_value * F.col("part")
    )
    return upper.select(F.col("g").alias(group), quantile.alias("quantile"))


def _listed_groups(
    data: DataFrame, listed: list, group: str, probability: float, limit: int
) -> DataFrame:
    columns = [f"y{i}" for i in range(len(listed))]
    masked = data.select(
        *[F.when(F.col("g") == F.lit(r["g"]), F.col("y")).alias(c) for c, r in zip(columns, listed, strict=True)]
    )
    found = exact_quantiles(
        masked,
        {c: [probability] for c in columns},
        {c: r["rows"] for c, r in zip(columns, listed, strict=True)},
        limit,
    )
    schema = T.StructType(
        [T.StructField(group, data.schema["g"].dataType), T.StructField("quantile", T.DoubleType())]
    )
    rows = [(r["g"], found[c][0]) for c, r in zip(columns, listed, strict=True)]
    return data.sparkSession.createDataFrame(rows, schema)


_INSIDE = "(low IS NULL OR y > low) AND (high IS NULL OR y < high)"


def _with_state(data: DataFrame, state: DataFrame, hot_rows: int) -> DataFrame:
    """The rows with their group's state; groups of more than `hot_rows` rows are not shuffled."""
    hot = state.filter(F.col("size") > hot_rows)
    joined = data.join(F.broadcast(hot), "g")
    if hot_rows == 0:
        return joined
    cold = data.join(F.broadcast(hot.select("g")), "g", "left_anti")
    return joined.unionByName(cold.join(state.filter(F.col("size") <= hot_rows), "g"))


def _narrow_groups(data: DataFrame, state: DataFrame, limit: int, hot_rows: int, seed: int) -> DataFrame:
    wide = state.filter((F.col("rows") > limit) & F.col("found").isNull())
    grid = [i / GROUP_GRID for i in range(GROUP_GRID + 1)]
    share = F.least(F.lit(1.0), F.greatest(F.lit(SAMPLE_SHARE), F.lit(float(SAMPLE_ROWS)) / F.col("rows")))
    sketches = (
        _with_state(data.withColumn("draw", F.rand(seed)), wide.withColumn("share", share), hot_rows)
        .filter(_INSIDE)
        .filter("draw < share")
        .groupBy("g")
        .agg(F.percentile_approx("y", grid, SKETCH_ACCURACY).alias("sketch"))
    )
    at = F.floor((F.col("wanted") + 0.5) / F.col("rows") * GROUP_GRID).cast("int")
    # Where nothing was drawn there is no guess: every count is 0 and the group stays as it is.
    guesses = wide.join(sketches, "g", "left").select(
        *wide.columns,
        F.get("sketch", F.greatest(at - 1, F.lit(0))).alias("a"),
        F.get("sketch", F.least(at + 2, F.lit(GROUP_GRID))).alias("b"),
    )
    counts = (
        _with_state(data, guesses.select("g", "size", "low", "high", "a", "b"), hot_rows)
        .filter(_INSIDE)
        .groupBy("g")
        .agg(
            F.count_if(F.expr("y < a")).alias("n_below"),
            F.count_if(F.expr("y = a")).alias("n_a"),
            F.count_if(F.expr("y > a AND y < b")).alias("n_middle"),
            F.count_if(F.expr("y = b AND y > a")).alias("n_b"),
        )
    )
    moved = (
        guesses.join(counts, "g")
        .withColumn("to_middle", F.expr("n_below + n_a"))
        .withColumn("to_b", F.expr("to_middle + n_middle"))
        .withColumn("to_above", F.expr("to_b + n_b"))
        .withColumn(
            "place",
            F.expr(
                """CASE WHEN a IS NULL THEN 'same' WHEN wanted < n_below THEN 'below' WHEN wanted < to_middle THEN 'a'
                        WHEN wanted < to_b THEN 'middle' WHEN wanted < to_above THEN 'b' ELSE 'above' END"""
            ),
        )
        .selectExpr(
            "g",
            "rank",
            "part",
            "size",
            """CASE place WHEN 'middle' THEN wanted - to_middle WHEN 'above' THEN wanted - to_above
                          ELSE wanted END AS wanted""",
            """CASE place WHEN 'below' THEN n_below WHEN 'middle' THEN n_middle
                          WHEN 'above' THEN rows - to_above ELSE rows END AS rows""",
            "CASE place WHEN 'middle' THEN a WHEN 'above' THEN b ELSE low END AS low",
            "CASE place WHEN 'below' THEN a WHEN 'middle' THEN b ELSE high END AS high",
            "CASE place WHEN 'a' THEN a WHEN 'b' THEN b END AS found",
        )
    )
    settled = state.filter((F.col("rows") <= limit) | F.col("found").isNotNull())
    return moved.unionByName(settled.select(*moved.columns))
