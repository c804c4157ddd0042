"""Column profile: missing cells, duplicates, moments, outlier counts, distinct values.

Statistics of all columns share one wide aggregate instead of one pass per column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import as_double, col, missing
from ..functions.moments import adjusted_skew, sketch_distinct
from ..functions.schema import is_numeric, is_text, numeric_columns
from .quantiles import exact_quantiles


def per_column(df: DataFrame, measures: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate over ``df``, reshaped to a row per column.

    ``measures`` maps a column name to its named aggregate expressions.
    """
    wide, shaped = [], []
    for i, (name, exprs) in enumerate(measures.items()):
        cells = [F.lit(name).alias("column")]
        for key, expr in exprs.items():
            wide.append(expr.alias(f"{key}_{i}"))
            cells.append(F.col(f"{key}_{i}").alias(key))
        shaped.append(F.struct(*cells))
    return df.agg(*wide).select(F.inline(F.array(*shaped)))


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing cells per column, with the row count (DGN1)."""
    return per_column(
        df,
        {
            f.name: {"n_missing": F.count_if(missing(f.name, f.dataType)), "n_rows": F.count(F.lit(1))}
            for f in df.schema
        },
    )


def row_digest(df: DataFrame) -> Column:
    """256 bits of a row: equal for rows with equal cells, nulls included, and for no others.

    Cells are written as JSON under their column's number, so a missing cell (which is left out), an empty text and a text
    that looks like another cell differ. NaN equals NaN and -0.0 equals 0.0, as in grouping; only inside arrays -0.0 is its own.
    """
    cells = []
    for i, f in enumerate(df.schema):
        cell = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            cell = cell + F.lit(0.0).cast(f.dataType)
        cells.append(cell.alias(f"c{i}"))
    whole = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.sha2(F.to_json(F.struct(*cells), whole).cast("binary"), 256)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows (DGN2); nulls count as equal.

    Rows are grouped by their digest, so what is shuffled does not grow with their width.
    """
    groups = df.select(F.unhex(row_digest(df)).alias("__d")).groupBy("__d").agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def numeric_stats(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Mean, median and sample deviation per numeric column (DGN3)."""
    columns = columns or numeric_columns(df)
    medians = exact_quantiles(df, columns, [0.5], exact)
    return per_column(
        df,
        {
            c: {
                "mean": F.avg(number(df, c)),
                "median": F.lit(medians[c][0]).cast("double"),
                "std": F.stddev_samp(number(df, c)),
            }
            for c in columns
        },
    )


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Cells strictly beyond 1.5 interquartile ranges of the quartiles, per column (DGN4)."""
    columns = columns or numeric_columns(df)
    quartiles = exact_quantiles(df, columns, [0.25, 0.75], exact)
    measures = {}
    for c in columns:
        q1, q3 = quartiles[c]
        measures[c] = {
            "q1": F.lit(q1).cast("double"),
            "q3": F.lit(q3).cast("double"),
            "n_outliers": F.count_if(beyond_iqr(number(df, c), q1, q3)),
        }
    return per_column(df, measures)


def beyond_iqr(x: Column, q1: float | None, q3: float | None) -> Column:
    if q1 is None or q3 is None:
        return F.lit(False)
    reach = 1.5 * (q3 - q1)
    return (x < q1 - reach) | (x > q3 + reach)


def skewed_features(df: DataFrame, threshold: float = 1.0, columns: list[str] | None = None) -> DataFrame:
    """Numeric columns whose bias-adjusted skewness exceeds the threshold in size (DGN16)."""
    columns = columns or numeric_columns(df)
    skews = per_column(df, {c: {"skew": adjusted_skew(number(df, c))} for c in columns})
    return skews.filter(F.abs("skew") > threshold).select("column", F.round("skew", 4).alias("skew"))


def number(df: DataFrame, column: str) -> Column:
    return as_double(column, df.schema[column].dataType)


def distinct_counts(df: DataFrame, columns: list[str], watch: float = 200) -> dict[str, int]:
    """Distinct present values per column: exact up to about ``watch``, a sketch beyond (see ``exact_distinct_counts``).

    Exact counting multiplies every row by the number of columns, so only columns the sketch
    finds small are counted exactly; their values fold map-side to a few rows.
    """
    if not columns:
        return {}
    sketch = df.agg(
        *[sketch_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(columns)]
    ).first()
    result = {c: sketch[f"d{i}"] for i, c in enumerate(columns)}
    small = [c for c in columns if result[c] <= 1.2 * watch]
    if small:
        exact = df.agg(*[F.count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(small)]).first()
        result.update({c: exact[f"d{i}"] for i, c in enumerate(small)})
    return result


def exact_distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct present values per column, exact whatever their number: a column at a time, folded map-side."""
    counts = {}
    for c in columns:
        present = df.select(col(c).alias("v")).filter(F.col("v").isNotNull())
        counts[c] = present.distinct().count()
    return counts


@dataclass
class ColumnProfile:
    missing: int = 0
    distinct: int = 0
    mean: float | None = None
    std: float | None = None
    low: float | None = None
    high: float | None = None
    skew: float | None = None


@dataclass
class TableProfile:
    """Driver-side summary of a table: a few numbers per column, from one aggregate."""

    rows: int
    columns: dict[str, ColumnProfile] = field(default_factory=dict)

    @property
    def missing_total(self) -> int:
        return sum(c.missing for c in self.columns.values())

    def missing_share(self, column: str) -> float:
        return self.columns[column].missing / max(1, self.rows)


def profile_table(df: DataFrame) -> TableProfile:
    """Rows, missing cells, sketched distincts and moments of every column in one job."""
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema):
        parts.append(F.count_if(missing(f.name, f.dataType)).alias(f"missing_{i}"))
        if is_numeric(f.dataType) or is_text(f.dataType):
            parts.append(sketch_distinct(col(f.name)).alias(f"distinct_{i}"))
        if is_numeric(f.dataType):
            x = number(df, f.name)
            parts += [
                F.avg(x).alias(f"mean_{i}"),
                F.stddev_samp(x).alias(f"std_{i}"),
                F.min(x).alias(f"low_{i}"),
                F.max(x).alias(f"high_{i}"),
                adjusted_skew(x).alias(f"skew_{i}"),
            ]
    row = df.agg(*parts).first().asDict()
    profile = TableProfile(rows=row["rows"])
    for i, f in enumerate(df.schema):
        keys = ("missing", "distinct", "mean", "std", "low", "high", "skew")
        profile.columns[f.name] = ColumnProfile(**{k: row[f"{k}_{i}"] for k in keys if f"{k}_{i}" in row})
    return profile


def rows_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small result table from driver numbers."""
    return spark.createDataFrame(rows, schema)
