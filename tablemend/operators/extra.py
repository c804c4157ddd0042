"""Missing patterns, weighted quality score, automatic transforms, local outlier factor (LEG1-LEG6)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import col, missing
from ..functions.moments import adjusted_kurtosis, adjusted_skew
from ..session import settle
from ..functions.schema import is_text, numeric_columns
from .lookup import join_spread
from .neighbours import attach_neighbours, nearest
from .ordering import with_row_numbers
from .profile import distinct_counts, duplicate_rows, number, per_column, rows_frame
from .quantiles import exact_quantiles


def missing_severity(df: DataFrame) -> DataFrame:
    """Missing share and severity per column (LEG1)."""
    measures = {
        f.name: {"n_missing": F.count_if(missing(f.name, f.dataType)), "n_rows": F.count(F.lit(1))} for f in df.schema
    }
    share = F.col("n_missing") * 100.0 / F.col("n_rows")
    return per_column(df, measures).select(
        "column",
        "n_missing",
        F.round(share, 2).alias("percent"),
        F.when(share > 50, "High").when(share > 20, "Medium").otherwise("Low").alias("severity"),
    )


def missing_by_row(df: DataFrame) -> DataFrame:
    """Complete and partial rows, most and mean missing cells per row (LEG1)."""
    cells = F.lit(0)
    for f in df.schema:
        cells = cells + missing(f.name, f.dataType).cast("int")
    return df.select(cells.alias("m")).agg(
        F.coalesce(F.max("m"), F.lit(0)).alias("max_missing"),
        F.round(F.coalesce(F.avg("m"), F.lit(0.0)), 2).alias("avg_missing"),
        F.count_if(F.col("m") == 0).alias("complete_rows"),
        F.count_if(F.col("m") > 0).alias("partial_rows"),
    )


def systematic_missing(df: DataFrame, order_by: list[str], columns: list[str] | None = None, **options) -> DataFrame:
    """Columns missing at every g-th row, g over 1, more than five times (LEG2).

    m distinct positions between a and b with (b - a) = g (m - 1), all congruent to a modulo g,
    are exactly a, a + g, ..., b; so two aggregates decide it without sorting the gaps.
    """
    columns = columns or [c for c in df.columns if c not in order_by]
    placed = with_row_numbers(df, order_by, "__at", **options)
    at = {c: F.when(missing(c, df.schema[c].dataType), F.col("__at")) for c in columns}
    spans = placed.agg(
        *[
            e
            for i, c in enumerate(columns)
            for e in (F.count(at[c]).alias(f"n{i}"), F.min(at[c]).alias(f"a{i}"), F.max(at[c]).alias(f"b{i}"))
        ]
    ).first()
    even = {}
    for i, c in enumerate(columns):
        n, a, b = spans[f"n{i}"], spans[f"a{i}"], spans[f"b{i}"]
        if n > 5 and (b - a) % (n - 1) == 0 and (b - a) // (n - 1) > 1:
            even[c] = (n, a, (b - a) // (n - 1))
    schema = "column string, n_missing long, every long"
    if not even:
        return df.sparkSession.createDataFrame([], schema)
    off = placed.agg(
        *[F.count_if((at[c] - a) % g != 0).alias(f"o{i}") for i, (c, (_, a, g)) in enumerate(even.items())]
    ).first()
    rows = [(c, n, g) for i, (c, (n, a, g)) in enumerate(even.items()) if off[f"o{i}"] == 0]
    return rows_frame(df.sparkSession, rows, schema)


CATEGORY_LIMIT = 20


def weighted_quality(df: DataFrame) -> DataFrame:
    """Completeness, consistency, validity and their weighted score (LEG3)."""
    numbers = numeric_columns(df)
    texts = [f.name for f in df.schema if is_text(f.dataType)]
    few = [c for c, n in distinct_counts(df, texts, watch=60).items() if n < CATEGORY_LIMIT]
    copies = duplicate_rows(df).first()
    parts = [F.count(F.lit(1)).alias("rows")]
    parts += [F.count_if(missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(df.schema)]
    for i, c in enumerate(numbers):
        x = number(df, c)
        parts += [F.count_if(x < 0).alias(f"neg{i}"), F.avg(x).alias(f"avg{i}"), F.stddev_samp(x).alias(f"std{i}")]
    for i, c in enumerate(few):
        parts += [F.count_distinct(col(c)).alias(f"d{i}"), F.count_distinct(F.lower(col(c))).alias(f"l{i}")]
    row = df.agg(*parts).first()
    flaws = 0
    for i, c in enumerate(numbers):
        flaws += int("age" in c.lower() and row[f"neg{i}"] > 0)
        flaws += int(bool(row[f"avg{i}"]) and row[f"std{i}"] is not None and row[f"std{i}"] / row[f"avg{i}"] > 5)
    flaws += sum(row[f"l{i}"] < row[f"d{i}"] for i in range(len(few)))
    rows, width = row["rows"], len(df.columns)
    holes = sum(row[f"m{i}"] for i in range(width))
    complete = round((rows * width - holes) / (rows * width) * 100, 2)
    consistent = round((rows - copies["n_duplicates"]) / rows * 100, 2)
    valid = round((width - flaws) / width * 100, 2)
    score = round(complete * 0.4 + consistent * 0.3 + valid * 0.3, 2)
    return rows_frame(
        df.sparkSession,
        [(complete, consistent, valid, score)],
        "completeness double, consistency double, validity double, overall_score double",
    )


# Candidate exponents of the power transforms, -2 to 2.
EXPONENTS = [i / 20 for i in range(-40, 41)]


def yeo_johnson(x: Column, power: float) -> Column:
    up = F.log1p(x) if abs(power) < 1e-12 else (F.pow(x + 1, F.lit(power)) - 1) / power
    rest = 2 - power
    down = -F.log1p(-x) if abs(rest) < 1e-12 else -(F.pow(1 - x, F.lit(rest)) - 1) / rest
    return F.when(x >= 0, up).otherwise(down)


def box_cox(x: Column, power: float) -> Column:
    return F.log(x) if abs(power) < 1e-12 else (F.pow(x, F.lit(power)) - 1) / power


def best_power(df: DataFrame, column: str, kind: str = "yeo-johnson") -> float:
    """Exponent of the highest log-likelihood over a fixed grid; one pass for all candidates."""
    x = number(df, column)
    slope = F.signum(x) * F.log1p(F.abs(x)) if kind == "yeo-johnson" else F.log(x)
    shape = yeo_johnson if kind == "yeo-johnson" else box_cox
    row = df.agg(
        F.count(x).alias("n"),
        F.sum(slope).alias("s"),
        *[F.var_pop(shape(x, p)).alias(f"v{i}") for i, p in enumerate(EXPONENTS)],
    ).first()
    likelihood = [
        -row["n"] / 2 * np.log(row[f"v{i}"]) + (p - 1) * row["s"] if row[f"v{i}"] else -np.inf
        for i, p in enumerate(EXPONENTS)
    ]
    return EXPONENTS[int(np.argmax(likelihood))]


def choose_transform(skew: float | None, kurtosis: float | None, low: float | None, n: int) -> str:
    if n < 5 or low is None:
        return "none"
    if skew is not None and abs(skew) > 2:
        return "log"
    if kurtosis is not None and abs(kurtosis) > 3:
        return "yeo-johnson"
    return "log" if low > 0 else "none"


def transform_plan(df: DataFrame, columns: list[str], method: str = "auto") -> dict[str, tuple[str, float]]:
    """Kind and parameter (shift or exponent) of the transform of each column (LEG4)."""
    parts = []
    for i, c in enumerate(columns):
        x = number(df, c)
        parts += [
            F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"),
            adjusted_skew(x).alias(f"s{i}"), adjusted_kurtosis(x).alias(f"k{i}"),
        ]
    row = df.agg(*parts).first()
    plan = {}
    for i, c in enumerate(columns):
        low, n = row[f"lo{i}"], row[f"n{i}"]
        kind = choose_transform(row[f"s{i}"], row[f"k{i}"], low, n) if method == "auto" else method
        if low is None or n < 5 or kind == "none":
            continue
        if kind == "log":
            plan[c] = ("log", 0.0 if low > 0 else 1.0 - low)
        elif kind == "sqrt":
            plan[c] = ("sqrt", 0.0 if low >= 0 else -low)
        elif kind == "box-cox":
            if low > 0:
                plan[c] = ("box-cox", best_power(df, c, "box-cox"))
        elif kind == "yeo-johnson":
            plan[c] = ("yeo-johnson", best_power(df, c))
        else:
            raise ValueError(f"unknown transform {kind!r}")
    return plan


def apply_transforms(df: DataFrame, plan: dict[str, tuple[str, float]]) -> DataFrame:
    changed = {}
    for c, (kind, value) in plan.items():
        x = number(df, c)
        if kind == "log":
            changed[c] = F.log1p(x + F.lit(value))
        elif kind == "sqrt":
            changed[c] = F.sqrt(x + F.lit(value))
        else:
            changed[c] = (box_cox if kind == "box-cox" else yeo_johnson)(x, value)
    return df.withColumns(changed) if changed else df


LOF_NEIGHBOURS = 20
LOF_SHARE = 0.1


def local_outlier_factor(
    df: DataFrame, column: str, key: str, k: int = LOF_NEIGHBOURS, contamination: float = LOF_SHARE, **options
) -> DataFrame:
    """Local outlier factor (Breunig et al. 2000) of one numeric column (LEG6): key, lof, is_outlier."""
    present = df.filter(number(df, column).isNotNull()).select(
        col(key).alias(key), F.array(number(df, column)).alias("vec")
    )
    base = present.select("vec", col(key).alias("id"))
    found = nearest(present, base, k + 1, **options)
    near = settle(attach_neighbours(present, found, key, True, k).select(key, "neighbour", "distance"))
    reach = near.groupBy(key).agg(F.max("distance").alias("kdist"))
    density = (
        # a row may be near to very many others
        join_spread(near, reach.select(F.col(key).alias("neighbour"), "kdist"), ["neighbour"], spread=F.xxhash64(key))
        .groupBy(key)
        .agg((1.0 / (F.avg(F.greatest("distance", "kdist")) + 1e-10)).alias("density"))
    )
    other = density.select(F.col(key).alias("neighbour"), F.col("density").alias("near_density"))
    lof = (
        join_spread(near, other, ["neighbour"], spread=F.xxhash64(key))
        .groupBy(key)
        .agg(F.avg("near_density").alias("mean_density"))
        .join(density, key)
        .select(key, (F.col("mean_density") / F.col("density")).alias("lof"))
    )
    cut = exact_quantiles(lof, ["lof"], [1 - contamination])["lof"][0]
    return lof.withColumn("is_outlier", F.col("lof") > F.lit(cut))


