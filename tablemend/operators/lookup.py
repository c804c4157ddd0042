"""Attach a per-value statistic to every row, safe against hot values (left lookup join).

How many rows a value holds is a table as well. Its few entries beyond a task's rows are joined on (at most a value per
``TASK_ROWS`` rows of the table, so they may be broadcast) and say over how many salts the rows of such a value are dealt.
Nothing is counted by a job of its own, and no list of values passes through the driver or into an expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import col

#: Tasks over which rows without a value are dealt; they match nothing.
SALTS = 64
#: Rows of one value that a task handles; a value with more is dealt to as many tasks as that takes.
TASK_ROWS = 1_000_000


def value_counts(df: DataFrame, column: str, count: str = "n") -> DataFrame:
    """Rows per present value; partial aggregation folds a hot value before the shuffle."""
    return df.filter(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias(count))


def hot_values(df: DataFrame, column: str, rows: int, share: float = 1 / SALTS) -> list:
    """Values that hold more than ``share`` of the rows: by arithmetic at most ``1/share`` of them."""
    counts = value_counts(df, column)
    return [r["value"] for r in counts.filter(F.col("n") > rows * share).select("value").collect()]


def salt_table(counts: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(__hot, __salts) of the values of ``counts`` (value, n) that hold more rows than a task handles."""
    hot = counts.filter(F.col("n") > task_rows)
    return hot.select(F.col("value").alias("__hot"), F.ceil(F.col("n") / task_rows).cast("int").alias("__salts"))


def _salted(df: DataFrame, cell: Column, salts: DataFrame | None) -> DataFrame:
    """``df`` with the number of salts of each cell in ``__salts``."""
    if salts is None:
        return df.withColumn("__salts", F.lit(1))
    joined = df.join(F.broadcast(salts), cell.eqNullSafe(F.col("__hot")), "left").drop("__hot")
    return joined.withColumn("__salts", F.coalesce("__salts", F.lit(1)))


def attach_by_value(
    df: DataFrame, column: str, table: DataFrame, counts: DataFrame | None = None, salt_by: Column | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Left join ``table`` (unique ``value`` plus statistics) on ``column``.

    Adaptive execution turns this into a broadcast join when the finished table turns out small. ``counts`` (value, n)
    tells how many rows the values hold, roughly: those of a hot one are spread over its salts, and the table's row is
    repeated once per salt. Rows without a value are always spread.
    """
    salts = salt_table(counts, task_rows) if counts is not None else None
    spread = salt_by if salt_by is not None else F.xxhash64(*[col(c) for c in df.columns])
    many = F.when(col(column).isNull(), F.lit(SALTS)).otherwise(F.col("__salts"))
    left = _salted(df.withColumn("__spread", spread), col(column), salts)
    left = left.withColumn("__salt", F.pmod("__spread", many).cast("int")).drop("__spread", "__salts")
    right = _salted(table.withColumnRenamed("value", "__v"), F.col("__v"), salts)
    right = right.withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    return left.join(right, (col(column) == F.col("__v")) & (F.col("__salt") == F.col("__s")), "left").drop("__v", "__s", "__salt")


def join_spread(
    rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", spread: Column | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Join whose left side may hold one key on very many rows; ``table`` holds few rows per key.

    The rows of hot keys are spread over their salts and the few table rows of those keys are
    repeated once per salt.
    """
    salts = salt_table(rows.groupBy(col(keys[0]).alias("value")).agg(F.count(F.lit(1)).alias("n")), task_rows)
    by = spread if spread is not None else F.xxhash64(*[col(c) for c in rows.columns])
    left = _salted(rows.withColumn("__spread", by), col(keys[0]), salts)
    left = left.withColumn("__salt", F.pmod("__spread", F.col("__salts")).cast("int")).drop("__spread", "__salts")
    right = _salted(table, col(keys[0]), salts)
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
