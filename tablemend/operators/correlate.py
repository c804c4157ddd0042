"""Correlation, rank correlation, mutual information and the leakage flags built on them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import col
from ..functions.moments import pearson
from ..functions.schema import is_numeric, numeric_columns, quoted, target_of
from ..session import settle
from .lookup import attach_by_value
from .ordering import RANGE, with_ranges
from .profile import distinct_counts, number, per_column
from .quantiles import exact_quantiles

WIDE_PAIRS = 30
STRONG = 0.95
STRONG_INFORMATION = 0.8


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns over pairwise complete rows (DGN8).

    Few pairs are plain aggregates in one pass. Many would not fit one generated method, so
    each partition then adds up cross-product matrices and a small aggregate sums them.
    """
    columns = columns or numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if len(pairs) <= WIDE_PAIRS:
        if not pairs:
            return df.sparkSession.createDataFrame([], "left string, right string, r double")
        wide = df.agg(*[pearson(number(df, a), number(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
        cells = [
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"r{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
        ]
        return wide.select(F.inline(F.array(*cells)))
    return _matrix_correlation(df, columns)


def _matrix_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    centre = np.array([m if m is not None else 0.0 for m in means])
    width = len(columns)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((width, width))
        sx, sxx, sxy = n.copy(), n.copy(), n.copy()
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan)
            there = ~np.isnan(x)
            z = np.where(there, x - centre, 0.0)
            present = there.astype(float)
            n += present.T @ present
            sx += z.T @ present
            sxx += (z * z).T @ present
            sxy += z.T @ z
        i, j = np.triu_indices(width, 1)
        yield pd.DataFrame(
            {
                "i": i, "j": j, "n": n[i, j], "sx": sx[i, j], "sy": sx[j, i],
                "sxx": sxx[i, j], "syy": sxx[j, i], "sxy": sxy[i, j],
            }
        )

    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    shape = "i int, j int, " + ", ".join(f"{s} double" for s in sums)
    total = (
        df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
        .mapInPandas(products, shape)
        .groupBy("i", "j")
        .agg(*[F.sum(s).alias(s) for s in sums])
    )
    names = F.array(*[F.lit(c) for c in columns])
    vx = F.expr("n * sxx - sx * sx")
    vy = F.expr("n * syy - sy * sy")
    steady = (vx > 1e-12 * F.expr("n * sxx")) & (vy > 1e-12 * F.expr("n * syy"))
    return total.select(
        F.get(names, F.col("i")).alias("left"),
        F.get(names, F.col("j")).alias("right"),
        F.when(steady, F.expr("n * sxy - sx * sy") / F.sqrt(vx * vy)).alias("r"),
    )


def redundant_pairs(df: DataFrame, columns: list[str] | None = None, threshold: float = STRONG) -> DataFrame:
    """Pairs of numeric columns whose absolute correlation exceeds the threshold."""
    pairs = correlation_pairs(df, columns)
    return pairs.filter(F.abs("r") > threshold).select("left", "right", F.round(F.abs("r"), 4).alias("r"))


def all_target_correlations(df: DataFrame, target: str) -> DataFrame:
    features = numeric_columns(df, [target])
    return per_column(df, {c: {"r": F.abs(pearson(number(df, c), number(df, target)))} for c in features})


def target_correlations(df: DataFrame, target: str | None = None, top: int = 5) -> DataFrame:
    """The ``top`` columns by absolute Pearson correlation with the target (DGN9)."""
    target = target_of(df, target)
    return _strongest(all_target_correlations(df, target), top)


def _strongest(table: DataFrame, top: int) -> DataFrame:
    return (
        table.filter(F.col("r").isNotNull())
        .orderBy(F.col("r").desc(), "column")
        .limit(top)
        .select("column", F.round("r", 4).alias("r"))
    )


def all_rank_correlations(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """Absolute Spearman correlation of every feature with the target, average ranks for ties.

    Ranks come from value counts cut into ordered ranges. Those of the target are joined on with frequent values spread,
    so neither a frequent value nor a long column sits in one task; then each value of a feature only needs the sums of the
    target's ranks. Features without a hole where the target is present share the target's ranks.
    """
    features = features or numeric_columns(df, [target])
    x = [number(df, c) for c in features]
    plain = df.select(number(df, target).alias("y"), *[e.alias(f"x{i}") for i, e in enumerate(x)]).filter(F.col("y").isNotNull())
    row = plain.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"x{i}").alias(f"n{i}") for i in range(len(features))]).first()
    whole = [i for i in range(len(features)) if row[f"n{i}"] == row["n"]]
    holed = [i for i in range(len(features)) if i not in whole]

    def cells(rows: DataFrame, which: list[int], other: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"x{i}").alias("x")) for i in which]))
        return rows.select(each.alias("cell"), other).select("cell.column", "cell.x", other)

    parts = []
    if whole:
        first = plain.withColumn("column", F.lit(-1))
        parts.append(cells(_attach_ranks(first, first, "y"), whole, "rank_y"))
    if holed:
        paired = cells(plain, holed, "y").filter(F.col("x").isNotNull())
        parts.append(_attach_ranks(paired, paired, "y").select("column", "x", "rank_y"))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, r double")
    paired = reduce(DataFrame.unionByName, parts)
    # equal values share a rank, so sums of the target's ranks by value are all that the rows are needed for
    folded = paired.groupBy("column", "x").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rank_y").alias("sy"), F.sum(F.expr("rank_y * rank_y")).alias("syy")
    )
    sums = _ranked(settle(folded), "x").groupBy("column").agg(
        F.sum("n").alias("n"),
        *[
            F.sum(F.expr(expr)).alias(name)
            for name, expr in {
                "sx": "n * rank_x", "sy": "sy", "sxx": "n * rank_x * rank_x", "syy": "syy", "sxy": "rank_x * sy",
            }.items()
        ],
    )
    vx, vy = F.expr("sxx - sx * sx / n"), F.expr("syy - sy * sy / n")
    r = F.when((vx > 0) & (vy > 0), F.abs(F.expr("sxy - sx * sy / n")) / F.sqrt(vx * vy))
    named = F.get(F.array(*[F.lit(c) for c in features]), F.col("column"))
    return sums.select(named.alias("column"), r.alias("r"))


def _attach_ranks(cells: DataFrame, base: DataFrame, side: str) -> DataFrame:
    """Join the centred average rank of each value.

    ``base`` holds the column numbers and values that are ranked. Their counts are written once, for
    cuts, ranks and salts all come from them.
    """
    counts = settle(base.groupBy("column", side).agg(F.count(F.lit(1)).alias("n")))
    key = F.struct("column", side)
    ranks = _ranked(counts, side).select(key.alias("value"), f"rank_{side}")
    held = counts.select(key.alias("value"), "n")
    return attach_by_value(cells.withColumn("__k", key), "__k", ranks, held).drop("__k")


def _ranked(counts: DataFrame, side: str) -> DataFrame:
    """Add the centred average rank of each value (shifted by half the count to keep sums small) to counts that are written."""
    ranged = with_ranges(counts, ["column", side])
    inside = Window.partitionBy(RANGE, "column").orderBy(side).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range and column: small however long the table is
    sizes = ranged.groupBy(RANGE, "column").agg(F.sum("n").alias("size"))
    earlier = Window.partitionBy("column").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        RANGE,
        "column",
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"),
        F.sum("size").over(Window.partitionBy("column")).alias("total"),
    )
    rank = F.col("before") + F.col("inner") + (F.col("n") + 1) / 2 - (F.col("total") + 1) / 2
    return (
        ranged.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), [RANGE, "column"])
        .select(*[quoted(c) for c in counts.columns], rank.alias(f"rank_{side}"))
    )


def target_rank_correlations(df: DataFrame, target: str | None = None, top: int = 5) -> DataFrame:
    """The ``top`` columns by absolute Spearman correlation with the target (DGN10)."""
    return _strongest(all_rank_correlations(df, target_of(df, target)), top)


def bin_of(x: Column, edges: list[float]) -> Column:
    """Number of edges below the value: equal-frequency bins from literal edges, null to bin -1."""
    at = F.lit(0)
    for edge in edges:
        at = at + (x > edge).cast("int")
    return F.coalesce(at, F.lit(-1))


def mutual_information_binned(
    df: DataFrame, target: str | None = None, features: list[str] | None = None, bins: int = 10
) -> DataFrame:
    """Mutual information with the target in nats, over equal-frequency bins (DGN11).

    Columns of at most 20 distinct values are binned by value. One scan; the counts that leave
    the map side are at most (bins + 1) squared per column.
    """
    target = target_of(df, target)
    features = features or numeric_columns(df, [target])
    columns = [*features, target]
    counts = distinct_counts(df, columns, watch=100)
    spread = [c for c in columns if is_numeric(df.schema[c].dataType) and counts[c] > 20]
    cuts = exact_quantiles(df, spread, [i / bins for i in range(1, bins)])

    def label(c: str) -> Column:
        if c in spread:
            return bin_of(number(df, c), sorted({e for e in cuts[c] if e is not None})).cast("string")
        return F.coalesce(col(c).cast("string"), F.lit("missing"))

    cells = df.select(
        label(target).alias("y"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), label(c).alias("x")) for c in features])).alias("cell"),
    )
    joint = cells.groupBy("cell.column", "cell.x", "y").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("column")
    shares = joint.select(
        "column",
        F.col("n").cast("double").alias("n"),
        F.sum("n").over(by).cast("double").alias("total"),
        F.sum("n").over(Window.partitionBy("column", "x")).cast("double").alias("nx"),
        F.sum("n").over(Window.partitionBy("column", "y")).cast("double").alias("ny"),
    )
    term = F.expr("n / total * ln(n * total / (nx * ny))")
    return shares.groupBy("column").agg(F.sum(term).alias("mutual_information"))


def leakage_scores(df: DataFrame, target: str | None = None, bins: int = 10) -> DataFrame:
    """Pearson, Spearman and mutual information with a numeric target, and the leak flag (DGN12)."""
    target = target_of(df, target)
    features = numeric_columns(df, [target])
    if target not in numeric_columns(df) or not features:
        return df.sparkSession.createDataFrame(
            [], "column string, pearson double, spearman double, mutual_information double, leaks boolean"
        )
    scores = (
        all_target_correlations(df, target).withColumnRenamed("r", "pearson")
        .join(all_rank_correlations(df, target).withColumnRenamed("r", "spearman"), "column", "left")
        .join(mutual_information_binned(df, target, bins=bins), "column", "left")
    )
    leaks = (
        (F.col("pearson") > STRONG) | (F.col("spearman") > STRONG) | (F.col("mutual_information") > STRONG_INFORMATION)
    )
    return scores.withColumn("leaks", F.coalesce(leaks, F.lit(False)))
