"""Windows over one global order, without one task holding the whole table.

A window without a partition key moves every row to one task. Here the order keys are cut
into contiguous ranges at sampled boundaries; a window then works inside one range, with the
last rows of the ranges before it (lag, rolling mean) or their sums (row numbers) joined on.
Boundaries are whole key tuples, so one timestamp that holds a third of the rows is cut too. They are
a table: every block of them hangs on its first one, and only these first ones, the square root of
their number, are literals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import col
from ..functions.schema import quoted
from ..session import settle

ROWS_PER_RANGE = 1_000_000
SAMPLES_PER_RANGE = 20
RANGE = "__range"


def with_ranges(
    df: DataFrame, order_by: list[str], rows: int | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Add the number of the contiguous key range each row falls in; there are as many as the rows need."""
    rows = df.count() if rows is None else rows
    ranges = max(1, math.ceil(rows / rows_per_range))
    if ranges == 1:
        return df.withColumn(RANGE, F.lit(0))
    cuts, heads, width = _cuts(df, order_by, rows, ranges, rows_per_range)
    if not heads:
        return df.withColumn(RANGE, F.lit(0))
    key = F.struct(*[_sortable(df, c).alias(f"k{i}") for i, c in enumerate(order_by)])
    # two levels: the block of cuts by its first one, then the cut inside the block, of which a row brings along only one block
    block = _passed(F.array(*heads), len(heads))
    inner = _passed(F.col("__cuts"), width)
    return (
        df.withColumn("__key", key)
        .withColumn("__block", block)
        .join(F.broadcast(cuts), "__block", "left")  # a cut for every range of a million rows
        .withColumn(RANGE, F.when(F.col("__block") == 0, F.lit(0)).otherwise((F.col("__block") - 1) * width + inner))
        .drop("__key", "__block", "__cuts")
    )


def _passed(cuts: Column, most: int) -> Column:
    """How many of at most ``most`` ascending cuts are not beyond ``__key``, by steps that halve."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= F.col("__key"), at + step).otherwise(at))


def _sortable(df: DataFrame, column: str) -> Column:
    """Struct comparison sorts nulls first, as the window order does."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col(column).cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return F.unix_date(col(column))
    return col(column)


def _cuts(
    df: DataFrame, order_by: list[str], rows: int, ranges: int, rows_per_range: int
) -> tuple[DataFrame, list[Column], int]:
    """Key tuples at equal steps of a sample, in blocks (``__block`` from 1, ``__cuts``), the first one of each block, and the
    size of a block. Results do not depend on which tuples are drawn. The sample is ranged in the same way, until it is
    one range."""
    names = [f"k{i}" for i in range(len(order_by))]
    keys = df.select(*[_sortable(df, c).alias(n) for n, c in zip(names, order_by)]).dropna()
    share = min(1.0, 1.2 * SAMPLES_PER_RANGE * ranges / rows)
    drawn = settle((keys.sample(fraction=share, seed=42) if share < 1.0 else keys).distinct())
    found = drawn.count()
    numbered = with_row_numbers(drawn, names, "__at", found, rows_per_range=max(rows_per_range, 4 * SAMPLES_PER_RANGE))
    # the row with which the number of ranges passed rises
    step = F.expr(f"(__at - 1) * {ranges} div {max(1, found)}")
    before = F.expr(f"(__at - 2) * {ranges} div {max(1, found)}")
    picked = settle(numbered.filter((F.col("__at") > 1) & (step > before)).select(F.struct(*names).alias("__cut"), step.cast("long").alias("__nth")))
    width = max(1, math.isqrt(ranges))
    # a row a cut: the only global order is over these
    dense = F.row_number().over(Window.orderBy("__cut")) - 1
    blocks = picked.select("__cut", dense.alias("__nth")).groupBy(F.expr(f"__nth div {width} + 1").cast("int").alias("__block"))
    blocks = settle(blocks.agg(F.array_sort(F.collect_list("__cut")).alias("__cuts")))
    types = [f.dataType for f in keys.schema]
    heads = [
        F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in zip(names, r["__cut"], types)])
        for r in blocks.select("__block", F.get("__cuts", F.lit(0)).alias("__cut")).orderBy("__block").collect()
    ]
    return blocks, heads, width


def with_row_numbers(
    df: DataFrame, order_by: list[str], name: str = "position", rows: int | None = None, **options: int
) -> DataFrame:
    """Number rows from 1 in the given order: number inside the range plus the sizes before it."""
    ranged = with_ranges(df, order_by, rows, **options)
    inside = Window.partitionBy(RANGE).orderBy(*[col(c) for c in order_by])
    before = running_offsets(ranged.groupBy(RANGE).agg(F.count(F.lit(1)).alias("__n")), "__n")
    return (
        ranged.withColumn(name, F.row_number().over(inside).cast("long"))
        .join(F.broadcast(before), RANGE)
        .withColumn(name, F.col(name) + F.col("__before"))
        .drop(RANGE, "__before")
    )


def running_offsets(sizes: DataFrame, value: str) -> DataFrame:
    """Sum of ``value`` over all earlier ranges. One row per range, a millionth of the rows."""
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(RANGE, F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("__before"))


def with_lookback(
    df: DataFrame,
    order_by: list[str],
    entity: list[str],
    depth: int,
    columns: dict[str, tuple[str, int, int]],
    value: str,
    rows: int | None = None,
    **options: int,
) -> DataFrame:
    """Window columns over the ``depth`` rows before each row, in global or per-entity order.

    ``columns`` maps a name to ``("lag", k, 0)`` or ``("avg", from, to)``. The ranges follow
    (entity, order), so a hot entity is spread over ranges as well.
    """
    keys = [*entity, *order_by]
    ranged = with_ranges(df, keys, rows, **options).withColumn("__halo", F.lit(False))
    last = Window.partitionBy(RANGE).orderBy(*[col(c).desc() for c in keys])
    tails = ranged.withColumn("__r", F.row_number().over(last)).filter(F.col("__r") <= depth).drop("__r")
    # the rows before a range are among the tails of the ``depth`` non-empty ranges before it
    place = tails.select(RANGE).distinct().withColumn("__dense", F.row_number().over(Window.orderBy(RANGE)))
    steps = (
        tails.join(F.broadcast(place), RANGE)
        .withColumn("__step", F.explode(F.sequence(F.lit(1), F.lit(depth))))
        .withColumn("__dense", F.col("__dense") + F.col("__step"))
        .drop(RANGE, "__step")
    )
    halo = (
        steps.join(F.broadcast(place), "__dense")
        .drop("__dense")
        .withColumn("__halo", F.lit(True))
        .select(*[quoted(c) for c in ranged.columns])
    )
    both = ranged.unionByName(halo)
    window = Window.partitionBy(RANGE, *[col(c) for c in entity]).orderBy(*[col(c) for c in order_by])
    added = {}
    for name, (kind, a, b) in columns.items():
        if kind == "lag":
            added[name] = F.lag(col(value), a).over(window)
        else:
            added[name] = F.avg(col(value)).over(window.rowsBetween(a, b))
    return both.withColumns(added).filter(~F.col("__halo")).drop("__halo", RANGE)
