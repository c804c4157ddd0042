"""Filling missing cells: strategy choice, median, mean, mode, neighbours, regression (IMP1-IMP7)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import col, missing
from ..functions.schema import is_numeric, numeric_columns, quoted
from .lookup import join_spread
from .neighbours import MARK, marked, nearest, vector
from .profile import number
from .quantiles import exact_quantiles

NEIGHBOURS = 5
CONTEXT_COLUMNS = 3


@dataclass(frozen=True)
class FillStep:
    column: str
    method: str
    context: tuple[str, ...]
    cells: int


def choose_method(missing_share: float, strategy: str = "auto") -> str:
    """Numeric columns: over 30 % missing the median, over 10 % neighbours, else regression (IMP1)."""
    if strategy != "auto":
        return {"iterative": "regression"}.get(strategy, strategy)
    if missing_share > 0.30:
        return "median"
    return "knn" if missing_share > 0.10 else "regression"


def plan_numeric_fill(
    missing_cells: dict[str, int], rows: int, columns: list[str], strategy: str = "auto"
) -> list[FillStep]:
    """Order of repair: columns in turn, each with the first three complete ones as context (IMP6).

    A column repaired earlier counts as complete, so only the missing counts are needed.
    """
    complete = {c for c in columns if not missing_cells[c]}
    steps = []
    for c in columns:
        if not missing_cells[c]:
            continue
        context = tuple(o for o in columns if o != c and o in complete)[:CONTEXT_COLUMNS]
        method = choose_method(missing_cells[c] / max(1, rows), strategy)
        if missing_cells[c] >= rows:
            method = "zero"
        elif method in ("knn", "regression") and not context:
            method = "median"
        steps.append(FillStep(c, method, context, missing_cells[c]))
        complete.add(c)
    return steps


def fill_numeric(df: DataFrame, steps: list[FillStep]) -> DataFrame:
    """Carry the planned steps out in order. A filled column becomes double."""
    plain = [s.column for s in steps if s.method == "median"]
    medians = exact_quantiles(df, plain, [0.5]) if plain else {}
    for step in steps:
        if step.method == "median":
            df = fill_with(df, {step.column: medians[step.column][0]})
        elif step.method == "mean":
            df = fill_mean(df, [step.column])
        elif step.method == "knn":
            df = fill_knn(df, step.column, list(step.context))
        elif step.method == "regression":
            df = fill_regression(df, step.column, list(step.context))
        elif step.method == "zero":
            df = fill_with(df, {step.column: 0.0})
        else:
            raise ValueError(f"unknown fill method {step.method!r}")
    return df


def fill_with(df: DataFrame, values: dict) -> DataFrame:
    """Fill missing cells with one given value per column."""
    filled = {}
    for c, value in values.items():
        if value is None:
            continue
        cell = number(df, c) if is_numeric(df.schema[c].dataType) else col(c)
        filled[c] = F.coalesce(cell, F.lit(value))
    return df.withColumns(filled) if filled else df


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median fill (IMP2)."""
    return fill_with(df, {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()})


def fill_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean fill (IMP2)."""
    row = df.agg(*[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return fill_with(df, {c: row[f"m{i}"] for i, c in enumerate(columns)})


def mode_values(df: DataFrame, columns: list[str], blank_is_missing: bool = False) -> dict[str, str | None]:
    """Most frequent present value per text column, ties to the smallest (IMP3).

    One scan for all columns; equal values fold before the shuffle and only the winner of each
    column reaches the driver.
    """
    if not columns:
        return {}
    cells = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])
        ).alias("cell")
    ).select("cell.*")
    cells = cells.filter(F.col("value").isNotNull())
    if blank_is_missing:
        cells = cells.filter(F.trim("value") != "")
    best = (
        cells.groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column")
        .agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best"))
        .select("column", "best.value")
    )
    found = {r["column"]: r["value"] for r in best.collect()}
    return {c: found.get(c) for c in columns}


def fill_mode(df: DataFrame, columns: list[str], default: str = "Unknown") -> DataFrame:
    """Mode fill of text columns; a column without any value gets the default (IMP3, IMP7)."""
    return fill_with(df, {c: v if v is not None else default for c, v in mode_values(df, columns).items()})


def fill_knn(df: DataFrame, column: str, context: list[str], k: int = NEIGHBOURS, key: str | None = None, **options) -> DataFrame:
    """Mean of the nearest donors by unscaled context columns (IMP4).

    Rows with equal context share one search. Ties go by ``key``, or by donor value without one.
    Only incomplete rows are shuffled; complete rows pass through.
    """
    present = ~missing(column, df.schema[column].dataType)
    donors = df.filter(present).select(
        vector(df, context).alias("vec"), (col(key) if key else number(df, column)).alias("id"), number(df, column).alias("__value")
    )
    holes = marked(df.filter(~present).withColumn("vec", vector(df, context)))
    found = nearest(holes, donors, k, payload=["__value"], **options)
    means = found.groupBy(*MARK).agg(F.avg("__value").alias("__fill"))
    whole = df.filter(present).withColumn(column, number(df, column))
    mended = join_spread(holes, means, MARK, "left").withColumn(column, F.col("__fill")).drop("vec", "__fill", *MARK)
    return whole.unionByName(mended.select(*[quoted(c) for c in df.columns]))


def regression_weights(df: DataFrame, column: str, context: list[str]) -> tuple[float, list[float]]:
    """Intercept and slopes of the least-squares fit, from one aggregate of moments."""
    y = number(df, column)
    present = y.isNotNull()
    x = [F.when(present, number(df, c)) for c in context]
    k = len(context)
    parts = [F.avg(y).alias("my")]
    for i in range(k):
        parts += [F.avg(x[i]).alias(f"m{i}"), F.covar_pop(x[i], y).alias(f"b{i}")]
        parts += [F.covar_pop(x[i], x[j]).alias(f"a{i}_{j}") for j in range(i, k)]
    row = df.agg(*parts).first()
    if row["my"] is None:
        return 0.0, [0.0] * k
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    b = np.array([row[f"b{i}"] for i in range(k)], float)
    scale = np.sqrt(np.diag(a))
    scale[scale == 0] = 1.0
    slopes = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-12)[0] / scale
    intercept = row["my"] - float(sum(s * row[f"m{i}"] for i, s in enumerate(slopes)))
    return intercept, [float(s) for s in slopes]


def fill_regression(df: DataFrame, column: str, context: list[str]) -> DataFrame:
    """Linear prediction from the context columns (IMP5): with one incomplete column the iterated
    regression is a single fit."""
    intercept, slopes = regression_weights(df, column, context)
    guess = F.lit(intercept)
    for c, slope in zip(context, slopes):
        guess = guess + F.lit(slope) * number(df, c)
    return df.withColumn(column, F.coalesce(number(df, column), guess))


def final_sweep(df: DataFrame) -> DataFrame:
    """No missing cell leaves: text by mode (blanks count as missing if there is a null), numbers
    by median, everything else that can be by a default (CST5)."""
    counts = df.agg(*[F.count_if(missing(f.name, f.dataType)).alias(f"n{i}") for i, f in enumerate(df.schema)]).first()
    holes = [f for i, f in enumerate(df.schema) if counts[f"n{i}"]]
    texts = [f.name for f in holes if f.dataType.simpleString() == "string"]
    numbers = [f.name for f in holes if f.name in numeric_columns(df)]
    if texts:
        blanked = df.withColumns({c: F.when(F.trim(col(c)) != "", col(c)) for c in texts})
        modes = mode_values(blanked, texts)
        df = fill_with(blanked, {c: modes[c] if modes[c] is not None else "Unknown" for c in texts})
    if numbers:
        medians = exact_quantiles(df, numbers, [0.5])
        df = fill_with(df, {c: medians[c][0] if medians[c][0] is not None else 0.0 for c in numbers})
    return df


def replace_empty_columns(df: DataFrame, empty: list[str]) -> DataFrame:
    """A column without any value gets a default: 'Unknown' for text, 0 for numbers (CST4)."""
    values = {}
    for c in empty:
        dtype = df.schema[c].dataType
        if dtype.simpleString() == "string":
            values[c] = F.lit("Unknown")
        elif is_numeric(dtype):
            values[c] = F.lit(0).cast(dtype)
    return df.withColumns(values) if values else df

