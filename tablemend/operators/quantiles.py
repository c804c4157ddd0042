"""Exact quantiles of many columns without holding a column's distinct values in one task.

``percentile`` keeps every distinct value of a column in a single buffer. Here a sketch
brackets each wanted order statistic, one wide aggregate counts what lies below and inside
each bracket, and a bracket that still holds too many rows is sketched again from its inside
only. Each round shrinks a bracket by a factor in the thousands, so a trillion rows need
three rounds; only then are the few distinct values left in the brackets read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import as_double

SKETCH_ACCURACY = 2_000
READ_LIMIT = 20_000
DIRECT_CELLS = 100_000


@dataclass
class _Bracket:
    """An open interval known to hold the value of one rank; None is an unbounded end."""

    column: str
    rank: int
    low: float | None
    high: float | None
    below: int = 0
    inside: int = 0

    @property
    def span(self) -> tuple:
        return self.column, self.low, self.high


def _double(df: DataFrame, column: str) -> Column:
    return as_double(column, df.schema[column].dataType)


def _interpolate(lower: float, upper: float, position: float) -> float:
    return lower + (upper - lower) * (position - math.floor(position))


def _ranks(count: int, share: float) -> tuple[int, int, float]:
    position = (count - 1) * share
    return math.floor(position), math.ceil(position), position


def exact_quantiles(
    df: DataFrame, columns: list[str], shares: list[float], exact: bool = True
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column (missing cells skipped), as driver numbers."""
    if not columns:
        return {}
    if not exact:
        row = df.agg(
            *[
                F.percentile_approx(_double(df, c), list(map(float, shares)), 10_000).alias(f"q{i}")
                for i, c in enumerate(columns)
            ]
        ).first()
        return {c: list(row[f"q{i}"] or [None] * len(shares)) for i, c in enumerate(columns)}

    whole = {(c, None, None): sorted({g for p in shares for g in _grid(p)}) for c in columns}
    first = _sketch(df, whole)
    counts = {c: first[c, None, None]["count"] for c in columns}
    if sum(counts.values()) <= DIRECT_CELLS:
        row = df.agg(
            *[
                F.percentile(_double(df, c), F.array(*[F.lit(float(p)) for p in shares])).alias(f"q{i}")
                for i, c in enumerate(columns)
            ]
        ).first()
        return {c: list(row[f"q{i}"] or [None] * len(shares)) for i, c in enumerate(columns)}

    brackets = [
        (_Bracket(c, rank, None, None, 0, counts[c]), _grid(p))
        for c in columns
        for p in shares
        if counts[c]
        for rank in _ranks(counts[c], p)[:2]
    ]
    values = _order_statistics(df, brackets, first)
    result: dict[str, list[float | None]] = {}
    for c in columns:
        result[c] = []
        for p in shares:
            if not counts[c]:
                result[c].append(None)
                continue
            low, high, position = _ranks(counts[c], p)
            result[c].append(_interpolate(values[c, low], values[c, high], position))
    return result


def _grid(share: float) -> tuple[float, float]:
    """Two shares around a wanted one, on a grid, so that neighbouring ranks ask for the same."""
    at = share * SKETCH_ACCURACY
    return max(0.0, (math.floor(at) - 2) / SKETCH_ACCURACY), min(1.0, (math.ceil(at) + 2) / SKETCH_ACCURACY)


def _order_statistics(
    df: DataFrame, brackets: list[tuple[_Bracket, tuple[float, float]]], sketched: dict
) -> dict[tuple[str, int], float]:
    """The values at the wanted zero-based ranks."""
    found: dict[tuple[str, int], float] = {}
    ready: list[_Bracket] = []
    while brackets:
        narrowed = _narrow(df, brackets, sketched, found)
        ready += [b for b in narrowed if b.inside <= READ_LIMIT]
        brackets = [(b, _grid((b.rank - b.below) / max(1, b.inside - 1))) for b in narrowed if b.inside > READ_LIMIT]
        if brackets:
            asked: dict[tuple, set[float]] = {}
            for b, shares in brackets:
                asked.setdefault(b.span, set()).update(shares)
            sketched = _sketch(df, {span: sorted(g) for span, g in asked.items()})
    for group in _groups(ready):
        found.update(_read(df, group))
    return found


def _sketch(df: DataFrame, asked: dict[tuple, list[float]]) -> dict[tuple, dict]:
    """One pass: for every span its row count and the sketched values at the asked shares."""
    parts = []
    for i, ((c, low, high), shares) in enumerate(asked.items()):
        x = _double(df, c)
        value = F.when(_within(x, low, high), x)
        parts += [
            F.count(value).alias(f"n{i}"),
            F.percentile_approx(value, shares, SKETCH_ACCURACY).alias(f"s{i}"),
            F.min(value).alias(f"lo{i}"),
            F.max(value).alias(f"hi{i}"),
        ]
    row = df.agg(*parts).first()
    result = {}
    for i, (span, shares) in enumerate(asked.items()):
        points = dict(zip(shares, row[f"s{i}"] or []))
        # the ends of the range are exact, so the first and last ranks stay inside
        points[0.0], points[1.0] = row[f"lo{i}"], row[f"hi{i}"]
        result[span] = {"count": row[f"n{i}"], "points": points}
    return result


def _within(x: Column, low: float | None, high: float | None) -> Column:
    inside = x.isNotNull()
    if low is not None:
        inside = inside & (x > low)
    if high is not None:
        inside = inside & (x < high)
    return inside


def _narrow(df: DataFrame, brackets: list, sketched: dict, found: dict) -> list[_Bracket]:
    """One counting pass over the sketched brackets.

    A rank that falls on an end of its new bracket is found there and then, however many rows
    share that value; what stays open is strictly between the ends, a small share of the rows.
    """
    ends = []
    for b, (low, high) in brackets:
        points = sketched[b.span]["points"]
        ends.append((b.column, points[low], points[high]))

    unique = list(dict.fromkeys(ends))
    sums = []
    for i, (c, low, high) in enumerate(unique):
        x = _double(df, c)
        sums += [
            F.count_if(x < low).alias(f"below{i}"),
            F.count_if(x == low).alias(f"low{i}"),
            F.count_if((x > low) & (x < high)).alias(f"in{i}"),
            F.count_if(x == high).alias(f"high{i}"),
        ]
    row = df.agg(*sums).first()
    still_open = []
    for (b, _), (c, low, high) in zip(brackets, ends):
        i = unique.index((c, low, high))
        start = row[f"below{i}"]
        inner = start + row[f"low{i}"]
        after = inner + row[f"in{i}"]
        if start <= b.rank < inner:
            found[c, b.rank] = low
        elif inner <= b.rank < after:
            still_open.append(_Bracket(c, b.rank, low, high, inner, row[f"in{i}"]))
        elif after <= b.rank < after + row[f"high{i}"]:
            found[c, b.rank] = high
        else:
            raise RuntimeError(f"sketch bracket missed rank {b.rank} of {c}")
    return still_open


def _groups(brackets: list[_Bracket], size: int = 50) -> list[list[_Bracket]]:
    return [brackets[i : i + size] for i in range(0, len(brackets), size)]


def _read(df: DataFrame, brackets: list[_Bracket]) -> dict[tuple[str, int], float]:
    """Read the distinct values left in the brackets (at most READ_LIMIT rows each)."""
    spans = list(dict.fromkeys(b.span for b in brackets))
    any_inside = F.lit(False)
    hits = []
    for i, (c, low, high) in enumerate(spans):
        inside = _within(_double(df, c), low, high)
        any_inside = any_inside | inside
        hits.append(F.when(inside, F.struct(F.lit(i).alias("span"), _double(df, c).alias("value"))))
    rows = (
        df.filter(any_inside)
        .select(F.explode(F.array_compact(F.array(*hits))).alias("hit"))
        .groupBy("hit.span", "hit.value")
        .count()
        .collect()
        if brackets
        else []
    )
    values: dict[int, list[tuple[float, int]]] = {}
    for row in rows:
        values.setdefault(row["span"], []).append((row["value"], row["count"]))
    found = {}
    for b in brackets:
        left = b.rank - b.below
        for value, count in sorted(values[spans.index(b.span)]):
            if left < count:
                found[b.column, b.rank] = value
                break
            left -= count
    return found
