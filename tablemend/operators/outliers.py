"""Outlier masks, winsorising, replacement and log transform (OUT1-OUT4, TRN1)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import col
from ..functions.moments import adjusted_skew
from ..sources.sampling import seeded_sample
from .profile import number
from .quantiles import exact_quantiles

FEWEST_VALUES = 10


def outlier_bounds(df: DataFrame, columns: list[str], method: str = "iqr") -> dict[str, tuple[float, float]]:
    """Lowest and highest regular value per column: 1.5 interquartile ranges beyond the quartiles,
    or 3 population deviations around the mean. Columns of fewer than ten values have none (OUT1)."""
    if not columns:
        return {}
    parts = []
    for i, c in enumerate(columns):
        x = number(df, c)
        parts += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*parts).first()
    usable = [c for i, c in enumerate(columns) if row[f"n{i}"] >= FEWEST_VALUES]
    if method == "iqr":
        quartiles = exact_quantiles(df, usable, [0.25, 0.75])
        return {c: (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, q3) in quartiles.items()}
    if method != "zscore":
        raise ValueError(f"unknown outlier method {method!r}")
    at = {c: i for i, c in enumerate(columns)}
    return {
        c: (row[f"m{at[c]}"] - 3 * row[f"s{at[c]}"], row[f"m{at[c]}"] + 3 * row[f"s{at[c]}"])
        for c in usable
        if row[f"s{at[c]}"]
    }


def outlier_mask(df: DataFrame, columns: list[str], method: str = "iqr") -> dict[str, Column]:
    """Outlier predicate per column, with the bounds as literals (OUT1)."""
    bounds = outlier_bounds(df, columns, method)
    return {
        c: F.coalesce((number(df, c) < bounds[c][0]) | (number(df, c) > bounds[c][1]), F.lit(False))
        if c in bounds
        else F.lit(False)
        for c in columns
    }


def winsor_bounds(df: DataFrame, columns: list[str], percentile: float = 95) -> dict[str, tuple[float, float]]:
    """[100-p, p] percentiles of the columns to clip.

    As a gate the isolation mask always finds a tenth of a column that varies, so these are the
    columns with more than ten values that are not constant.
    """
    if not columns:
        return {}
    low_high = exact_quantiles(df, columns, [1 - percentile / 100, percentile / 100])
    parts = []
    for i, c in enumerate(columns):
        x = number(df, c)
        parts += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*parts).first()
    return {
        c: tuple(low_high[c])
        for i, c in enumerate(columns)
        if row[f"n{i}"] > FEWEST_VALUES and row[f"lo{i}"] < row[f"hi{i}"]
    }


def winsorise(df: DataFrame, columns: list[str], percentile: float = 95) -> DataFrame:
    """Clip each column to its [100-p, p] percentiles; missing cells stay missing (OUT3)."""
    clipped = {}
    for c, (low, high) in winsor_bounds(df, columns, percentile).items():
        x = number(df, c)
        clipped[c] = F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))
    return df.withColumns(clipped) if clipped else df


def outliers_to_median(df: DataFrame, columns: list[str], method: str = "iqr") -> DataFrame:
    """Replace masked outliers by the column median (OUT4)."""
    masks = outlier_mask(df, columns, method)
    medians = exact_quantiles(df, columns, [0.5])
    return df.withColumns(
        {c: F.when(masks[c], F.lit(medians[c][0])).otherwise(number(df, c)) for c in columns if medians[c][0] is not None}
    )


def log_skewed(df: DataFrame, columns: list[str], threshold: float = 1.0) -> tuple[DataFrame, list[str]]:
    """log1p of positive columns whose bias-adjusted skewness exceeds the threshold (TRN1)."""
    if not columns:
        return df, []
    parts = []
    for i, c in enumerate(columns):
        x = number(df, c)
        parts += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), adjusted_skew(x).alias(f"s{i}")]
    row = df.agg(*parts).first()
    chosen = [
        c
        for i, c in enumerate(columns)
        if row[f"n{i}"] >= 4 and row[f"s{i}"] is not None and abs(row[f"s{i}"]) > threshold and row[f"lo{i}"] > 0
    ]
    return (df.withColumns({c: F.log1p(number(df, c)) for c in chosen}) if chosen else df), chosen


# ---- isolation forest (OUT2, DGN5) ----------------------------------------------------------

TREES = 100
TREE_ROWS = 256
POOL_ROWS = 2 * TREES * TREE_ROWS


def path_normaliser(n: float) -> float:
    """Mean depth of an unsuccessful search among n keys (Liu, Ting and Zhou 2008)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


NODE = "tree int, node int, feature int, cut double, left int, right int, depth double"


def grow_tree(x: np.ndarray, seed: int) -> list[tuple]:
    """One isolation tree as rows (node, feature or -1, cut, left, right, path length of a leaf)."""
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(2, len(x))))
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, None, None)]
    while stack:
        rows, depth, parent, side = stack.pop()
        me = len(nodes)
        if parent is not None:
            nodes[parent][side] = me
        low, high = x[rows].min(0), x[rows].max(0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varied):
            nodes.append([me, -1, 0.0, -1, -1, depth + path_normaliser(len(rows))])
            continue
        feature = int(rng.choice(varied))
        cut = float(rng.uniform(low[feature], high[feature]))
        below = x[rows, feature] <= cut
        nodes.append([me, feature, cut, -1, -1, 0.0])
        stack.append((rows[~below], depth + 1, me, 4))
        stack.append((rows[below], depth + 1, me, 3))
    return [tuple(n) for n in nodes]


def fit_isolation_forest(
    df: DataFrame, features: list[str], keys: list[str] | None = None, seed: int = 42, trees: int = TREES
) -> tuple[list[dict[str, np.ndarray]], int]:
    """Trees over hash-drawn subsamples, one task per tree; the forest itself is at most
    ``trees`` times 511 nodes. ``keys`` should tell rows apart."""
    rows = df.count()
    pool = seeded_sample(df, POOL_ROWS, seed, keys, rows).withColumn(
        "__mark", F.xxhash64(*[col(k) for k in (keys or df.columns)])
    )
    size = min(TREE_ROWS, rows)
    drawn = pool.select(
        "__mark", F.array(*[number(df, c) for c in features]).alias("x"),
        F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"),
    ).withColumn("__draw", F.xxhash64("__mark", "tree", F.lit(seed)))
    # each tree needs the rows with its lowest draws; a threshold spares the full sort
    share = min(1.0, (size * 1.5 + 60) / max(1, min(rows, POOL_ROWS)))
    if share < 1.0:
        drawn = drawn.filter(F.pmod("__draw", F.lit(1 << 30)) < int(share * (1 << 30)))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = pdf.sort_values(["__draw", "__mark"], kind="stable").head(size)
        x = np.stack(chosen["x"].to_numpy()).astype(float)
        nodes = grow_tree(x, seed * 1000 + int(key[0]))
        frame = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "depth"])
        frame.insert(0, "tree", key[0])
        return frame

    nodes = drawn.groupBy("tree").applyInPandas(grow, NODE).toPandas()
    forest = []
    for _, tree in nodes.sort_values(["tree", "node"]).groupby("tree"):
        forest.append({c: tree[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth")})
    return forest, size


def score_isolation(df: DataFrame, features: list[str], forest: list[dict[str, np.ndarray]], size: int) -> DataFrame:
    """Add ``anomaly_score`` in (0, 1); rows that are easy to isolate come close to 1."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    scale = path_normaliser(size)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        data = np.stack(x.to_numpy()).astype(float)
        total = np.zeros(len(data))
        for tree in shared.value:
            at = np.zeros(len(data), int)
            active = tree["feature"][at] >= 0
            while active.any():
                f = tree["feature"][at[active]]
                goes = data[active, f] <= tree["cut"][at[active]]
                at[active] = np.where(goes, tree["left"][at[active]], tree["right"][at[active]])
                active = tree["feature"][at] >= 0
            total += tree["depth"][at]
        return pd.Series(np.power(2.0, -(total / len(shared.value)) / max(scale, 1e-12)))

    return df.withColumn("anomaly_score", score(F.array(*[number(df, c) for c in features])))


def isolation_scores(
    df: DataFrame, features: list[str], keys: list[str] | None = None, seed: int = 42
) -> DataFrame:
    """Scores of all rows; missing cells are read as the median, infinities as 0."""
    medians = exact_quantiles(df, features, [0.5])
    ready = df.withColumns(
        {
            f"__f{i}": F.when(F.abs(F.coalesce(number(df, c), F.lit(medians[c][0] or 0.0))) == float("inf"), F.lit(0.0)).otherwise(
                F.coalesce(number(df, c), F.lit(medians[c][0] or 0.0))
            )
            for i, c in enumerate(features)
        }
    )
    names = [f"__f{i}" for i in range(len(features))]
    forest, size = fit_isolation_forest(ready, names, keys, seed)
    return score_isolation(ready, names, forest, size).drop(*names)


def isolation_outliers(
    df: DataFrame, features: list[str], keys: list[str] | None = None, contamination: float | None = None, seed: int = 42
) -> DataFrame:
    """Rows with ``is_outlier``: score over 0.5, or the given share of highest scores."""
    scored = isolation_scores(df, features, keys, seed)
    if contamination is None:
        return scored.withColumn("is_outlier", F.col("anomaly_score") > 0.5)
    cut = exact_quantiles(scored, ["anomaly_score"], [1 - contamination])["anomaly_score"][0]
    return scored.withColumn("is_outlier", F.col("anomaly_score") > F.lit(cut))


