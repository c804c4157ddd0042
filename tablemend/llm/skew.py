"""Joins that a frequent key cannot stall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written


def once(value: Column) -> Column:
    """``value`` computed once a row: a generated column is not put into the expressions that use it."""
    return F.explode(F.array(value))


def attach(
    rows: DataFrame, values: DataFrame, key: str, most: int = 10_000, how: str = "inner", counts: DataFrame | None = None
) -> DataFrame:
    """Join ``rows`` with ``values`` (one row a key), keeping all rows with ``how="left"``.

    A key with more than 1 / ``most`` of the rows, and more than 1,000, is frequent. There are at most ``most`` such
    keys, so their values may be broadcast; the other keys have groups small enough to be shuffled. ``counts`` (key, n)
    spares the counting.
    """
    if counts is None:
        counts = written(rows.groupBy(key).agg(F.count("*").alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = written(values.join(counts.filter(F.col("n") > max(1000, total // most)).select(key), key), "hot")
    if hot.isEmpty():
        return rows.join(values, key, how)
    common = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return common.unionByName(others.join(values, key, how))
