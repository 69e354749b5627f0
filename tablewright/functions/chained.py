"""Quartiles of columns of which each is filtered by the bounds of those before it, found together."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import batches, col, numbers, quoted
from .quantiles import _interpolate, _literal, _ranks

PROBABILITIES = (0.25, 0.75)
# Values of rows in doubt that the driver holds.
HELD_VALUES = 1_000_000
ROUNDS = 12


@dataclass(frozen=True)
class Quartiles:
    """Of the rows that the columns before kept; None where there is no value or only one."""

    rows: int
    q1: float | None = None
    q3: float | None = None


@dataclass(frozen=True)
class _State:
    """A column's two quartiles lie in `bands`; the numbers are of rows that are not in doubt, none of them at first."""

    name: str
    whole: bool
    constant: bool
    bands: tuple
    tried: bool = False
    rows: int = 0
    known: int = 0
    low: float = math.inf
    high: float = -math.inf
    below: tuple = (0, 0)
    at_low: tuple = (0, 0)
    at_high: tuple = (0, 0)


class _Wrong(Exception):
    """A guess that the counts disprove."""


def chained_quartiles(df: DataFrame, columns: dict[str, bool], rows: int, factor: float) -> tuple[list[Quartiles], int] | None:
    """Quartiles of each column (name -> whether whole) in order, and the rows left in the end; None if a guess failed.

    After each column, rows farther than `factor` interquartile ranges beyond its
    quartiles, and those without a value, are gone, unless all its values are equal.

    The order is walked on a sample of the rows in doubt, which gives each quartile a
    band and so each bound one. In doubt is a row that lies strictly inside a band of a
    quartile, or where a bound may be, of any column that it surely reaches. One scan
    counts all other rows by column and band, and the next sample is drawn from those in
    doubt, until the driver can hold them. Then the order is walked exactly, on counts
    and rows in doubt. A rank outside its band shows a wrong guess. So the scans do not
    grow with the columns that remove rows, and the result does not depend on the sample.
    """
    names = list(columns)
    values = numbers(df, names)
    states, doubt, left = [], rows, 0
    for chunk in batches(names, per_item=2):
        ends = values.agg(*[F.struct(F.min(col(c)), F.max(col(c))).alias(f"ends{i}") for i, c in enumerate(chunk)]).first()
        for c, (low, high) in zip(chunk, ends, strict=True):
            if low is not None and (math.isinf(low) or math.isinf(high) or columns[c] and max(-low, high) >= 2**53):
                return None
            states.append(_State(c, columns[c], low is None or low == high, ((low, high), (low, high))))
    held = max(1, HELD_VALUES // len(names))
    upto = None
    try:
        for seed in range(ROUNDS):
            uncertain = values if upto is None else values.filter(upto < 0)
            if doubt <= held:
                return _exact(states, _array(uncertain), left, factor)
            share = 0.8 * held / doubt
            sample = _array(uncertain.filter(F.rand(seed) < share))
            states = _guessed(states, sample, 1 / share, factor)
            upto = _upto(states, factor)
            before = doubt
            states, doubt, left = _counted(values, states, upto)
            if doubt > max(held, 0.8 * before):
                return None
    except _Wrong:
        pass
    return None


def _array(df: DataFrame) -> np.ndarray:
    """At most about HELD_VALUES values, by the caller's count; nulls as NaN."""
    found = df.toArrow()
    return np.column_stack([found.column(i).to_numpy().astype(float) for i in range(found.num_columns)])


def _bounds(whole: bool, q1: float, q3: float, factor: float) -> tuple[float, float]:
    low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
    return (float(math.ceil(low)), float(math.floor(high))) if whole else (low, high)


def _ranges(s: _State, factor: float) -> tuple[float, float, float, float]:
    """Least and greatest lower bound, least and greatest upper bound."""
    (a1, b1), (a3, b3) = s.bands
    # Interpolation between two equal values may round.
    slack = 0.0 if s.whole else 1e-14 * (1 + factor) * max(abs(a1), abs(b1), abs(a3), abs(b3))
    (l0, h1), (l1, h0) = _bounds(s.whole, a1, b3, factor), _bounds(s.whole, b1, a3, factor)
    return l0 - slack, l1 + slack, h0 - slack, h1 + slack


def _guessed(states: list[_State], sample: np.ndarray, weight: float, factor: float) -> list[_State]:
    """Narrower bands, by walking the order on the sample."""
    alive, out = np.ones(len(sample), bool), []
    for k, s in enumerate(states):
        if s.constant:
            out.append(s)
            continue
        x = sample[:, k]
        v = x[alive & ~np.isnan(x)]
        known = s.known + weight * len(v)
        margin = 2 * math.sqrt(len(v)) + 2
        bands, middle = [], []
        for i, p in enumerate(PROBABILITIES):
            a, b = s.bands[i]
            drawn = np.sort(v[(v >= a) & (v <= b)])
            place = (p * (known - 1) - s.below[i] - s.at_low[i]) / weight - np.count_nonzero(v < a)
            low, mid, high = (
                a if at < 0 else b if at >= len(drawn) else float(drawn[at])
                for at in (math.floor(place - margin), round(place), math.ceil(place + margin))
            )
            bands.append((low, high))
            middle.append(mid)
        out.append(replace(s, bands=tuple(bands), tried=True))
        low, high = _bounds(s.whole, *middle, factor)
        alive &= (x >= low) & (x <= high)
    return out


def _upto(states: list[_State], factor: float) -> Column:
    """The place of the column that surely removes a row, the number of columns if none does, -1 if it is in doubt before."""
    steps = []
    for k, s in enumerate(states):
        if s.constant:
            continue
        c = quoted(s.name)
        l0, l1, h0, h1 = (_literal(x) for x in _ranges(s, factor))
        tests = [f"({c} > {_literal(a)} AND {c} < {_literal(b)})" for a, b in s.bands if a < b]
        tests += [f"({c} >= {l0} AND {c} < {l1})", f"({c} > {h0} AND {c} <= {h1})"]
        steps.append(f"WHEN {' OR '.join(tests)} THEN -1 WHEN {c} IS NULL OR {c} < {l0} OR {c} > {h1} THEN {k}")
    return F.expr(f"CASE {' '.join(steps)} ELSE {len(states)} END") if steps else F.lit(len(states))


def _counted(values: DataFrame, states: list[_State], upto: Column) -> tuple[list[_State], int, int]:
    # One comparison for each count keeps the jobs' code small.
    marked = values.withColumn("tw_upto", upto)
    out, doubt, left = [], 0, 0
    for chunk in batches(list(enumerate(states)), per_item=10):
        aggregates = [F.expr("count_if(tw_upto < 0) AS doubt"), F.expr(f"count_if(tw_upto = {len(states)}) AS left")]
        for k, s in chunk:
            aggregates.append(F.expr(f"count_if(tw_upto >= {k}) AS rows{k}"))
            aggregates += [F.expr(f"{f}(x{k}) AS {n}{k}") for f, n in (("count", "known"), ("min", "min"), ("max", "max"))]
            for i, (a, b) in enumerate(s.bands):
                for name, op, v in (("below", "<", a), ("at_low", "=", a), ("at_high", "=", b)):
                    aggregates.append(F.expr(f"count_if(x{k} {op} {_literal(v)}) AS {name}{i}_{k}"))
        counted = [F.expr(f"CASE WHEN tw_upto >= {k} THEN {quoted(s.name)} END AS x{k}") for k, s in chunk]
        row = marked.select("tw_upto", *counted).agg(*aggregates).first()
        doubt, left = row["doubt"], row["left"]
        for k, s in chunk:
            low, high = row[f"min{k}"], row[f"max{k}"]
            counts = {n: tuple(row[f"{n}{i}_{k}"] for i in range(2)) for n in ("below", "at_low", "at_high")}
            out.append(
                replace(s, rows=row[f"rows{k}"], known=row[f"known{k}"], low=math.inf if low is None else low, high=-math.inf if high is None else high, **counts)
            )
    return out, doubt, left


def _exact(states: list[_State], rows: np.ndarray, left: int, factor: float) -> tuple[list[Quartiles], int]:
    """The order walked on the counts and all rows in doubt."""
    alive, out = np.ones(len(rows), bool), []
    for k, s in enumerate(states):
        x = rows[:, k]
        v = np.sort(x[alive & ~np.isnan(x)])
        n, total = s.known + len(v), s.rows + int(alive.sum())
        if s.constant:
            out.append(Quartiles(total))
            continue
        if n == 0 or min([s.low, *v[:1]]) == max([s.high, *v[-1:]]):
            if s.tried:
                raise _Wrong  # its other values went with earlier columns, so it removes nothing
            out.append(Quartiles(total))
            continue
        q1, q3 = (_interpolate(p, n, {r: _ranked(s, i, v, r) for r in _ranks(p, n)}) for i, p in enumerate(PROBABILITIES))
        low, high = _bounds(s.whole, q1, q3, factor)
        if s.tried:
            l0, l1, h0, h1 = _ranges(s, factor)
            if not (l0 <= low <= l1 and h0 <= high <= h1):
                raise _Wrong
        out.append(Quartiles(total, q1, q3))
        alive &= (x >= low) & (x <= high)
    return out, left + int(alive.sum())


def _ranked(s: _State, i: int, v: np.ndarray, rank: int) -> float:
    """The value of a rank among the counted rows and the sorted values `v`."""
    a, b = s.bands[i]
    below, upto, until, end = (int(np.searchsorted(v, y, side)) for y, side in ((a, "left"), (a, "right"), (b, "left"), (b, "right")))
    rank -= s.below[i] + below
    if rank < 0:
        raise _Wrong
    rank -= s.at_low[i] + upto - below
    if rank < 0:
        return a
    inside = v[upto : max(upto, until)]
    if rank < len(inside):
        return float(inside[rank])
    if a < b and rank < len(inside) + s.at_high[i] + end - until:
        return b
    raise _Wrong
