"""Cell-level audit of a repair (AUD2) and the step log (AUD1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import col
from ..functions.schema import is_temporal

CARRIED = "__before"


def _text(df: DataFrame, column: str):
    if is_temporal(df.schema[column].dataType):
        return F.date_format(col(column), "yyyy-MM-dd HH:mm:ss")
    return col(column).cast("string")


def carry_before(df: DataFrame) -> DataFrame:
    """Keep the original cells next to the row, so that the audit needs no join."""
    return df.withColumn(CARRIED, F.struct(*[_text(df, c).alias(f"b{i}") for i, c in enumerate(df.columns)]))


def carried_cells(df: DataFrame, original: list[str], keys: list[str]) -> DataFrame:
    """Changed cells of a repaired table that carries its original cells."""
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"{CARRIED}.b{i}").alias("before"), _text(df, c).alias("after")
        )
        for i, c in enumerate(original)
        if c in df.columns
    ]
    return (
        df.select(*[col(k) for k in keys], F.explode(F.array(*cells)).alias("cell"))
        .filter(~F.col("cell.before").eqNullSafe(F.col("cell.after")))
        .select(*keys, "cell.*")
    )


def cell_audit(
    before: DataFrame, after: DataFrame, keys: list[str], columns: list[str] | None = None, reason: str = "repair"
) -> DataFrame:
    """Changed cells between two versions of a table, matched by unique keys (AUD2)."""
    columns = columns or [c for c in before.columns if c in after.columns and c not in keys]
    left = before.select(*[col(k) for k in keys], *[_text(before, c).alias(f"b{i}") for i, c in enumerate(columns)])
    right = after.select(*[col(k) for k in keys], *[_text(after, c).alias(f"a{i}") for i, c in enumerate(columns)])
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("before"), F.col(f"a{i}").alias("after"))
        for i, c in enumerate(columns)
    ]
    return (
        left.join(right, keys)
        .select(*keys, F.explode(F.array(*cells)).alias("cell"))
        .filter(~F.col("cell.before").eqNullSafe(F.col("cell.after")))
        .select(*keys, "cell.*", F.lit(reason).alias("reason"))
    )
