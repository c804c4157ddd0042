"""Exact k-nearest-neighbour join in bounded tasks (NBR1).

Equal vectors are folded: one query per distinct vector, and at most ``k`` base rows per
distinct vector (those with the lowest ids) can ever be among the nearest. Base rows are cut
into cells around sampled pivots. Every query searches its own cell first; the distance of its
k-th find then rules out, by the triangle inequality, the cells that cannot hold a closer row,
and only the others are searched, for rows within that distance. Cells, and the queries sent to them, are split into chunks
of bounded size, so a dense cell is many tasks, and each task returns at most ``k`` rows per query. Within a task, where
vectors are short, leaves of nearby rows are compared instead of all rows with all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import col
from ..functions.schema import quoted
from ..session import outside, scratch, stored
from ..sources.sampling import seeded_sample
from .lookup import join_spread
from .profile import number

BLOCK = 16_384
#: Rows of a block where there are so many that all cores get several pairs of such blocks; every row is sent once a block.
WIDE_BLOCK = 65_536
#: Cells of a block of distances that a task holds at a time, of few rows where they are many.
CELLS = 500_000
#: Columns of a block of distances of which only the least counts at first.
FOLD = 32
#: Rows of a leaf of nearby rows, and columns up to which leaves are tried.
LEAF = 64
LEAF_WIDTH = 16
MOST_PIVOTS = 1_024
FEW_BLOCKS = 2  # up to here plain chunks cost less than finding cells


def vector(df: DataFrame, features: list[str], fill: float | None = None) -> Column:
    """Numeric columns as one array of doubles."""
    cells = [number(df, c) for c in features]
    if fill is not None:
        cells = [F.coalesce(c, F.lit(float(fill))) for c in cells]
    return F.array(*cells)


def marked(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Add a 128-bit mark of the vector, which stands for it in shuffles and joins."""
    return df.withColumns({"q1": F.xxhash64(vec), "q2": F.xxhash64(F.lit(1), vec)})


MARK = ["q1", "q2"]


def nearest(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    payload: list[str] | None = None,
    block: int = BLOCK,
    pivots: int | None = None,
) -> DataFrame:
    """The ``k`` base rows nearest to each distinct query vector.

    ``queries`` has an array column ``vec``; ``base`` has ``vec``, ``id`` and the ``payload``
    columns. Returns the mark of the query vector and ``id, payload..., distance, place``, written; equal
    distances go by id.
    """
    with scratch(queries.sparkSession):
        found = _nearest(queries, base, k, payload, block, pivots)
        with outside():
            return stored(found)


def _nearest(queries: DataFrame, base: DataFrame, k: int, payload: list[str] | None, block: int, pivots: int | None) -> DataFrame:
    payload = payload or []
    asked = marked(queries.select("vec")).groupBy(*MARK).agg(F.any_value("vec").alias("vec"))
    copies = Window.partitionBy(*MARK).orderBy("id")
    donors = (
        marked(base.select("vec", "id", *[quoted(p) for p in payload]))
        .withColumn("__copy", F.row_number().over(copies))
        .filter(F.col("__copy") <= k)
        .drop("__copy", *MARK)
    )
    n_donors = donors.count()
    wanted = pivots if pivots is not None else math.isqrt(n_donors) if n_donors > FEW_BLOCKS * block else 1
    wanted = max(1, min(MOST_PIVOTS, wanted))
    if wanted == 1:
        asked, donors = asked.withColumn("cell", F.lit(0)), donors.withColumn("cell", F.lit(0))
        found = _search(asked, donors, k, payload, {0: n_donors}, block)
        return _first(found, k)

    centres = np.array(
        [
            list(r["vec"])
            for r in seeded_sample(donors.select("vec").distinct(), wanted, seed=7, keys=["vec"]).collect()
        ]
    )
    donors = stored(_assign(donors, centres))
    cells = donors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("near"), F.max("reach").alias("far"))
    bounds = {r["cell"]: (r["n"], r["near"], r["far"]) for r in cells.collect()}
    sizes = {c: b[0] for c, b in bounds.items()}
    asked = stored(_assign(asked, centres))
    # the chunks of a cell are merged before anything is written: at most k rows a query
    own = stored(_first(_search(asked.select("vec", *MARK, "cell"), donors.drop("reach"), k, payload, sizes, block), k).drop("place"))
    kth = own.groupBy(*MARK).agg(
        F.count(F.lit(1)).alias("found"), F.array_sort(F.collect_list("distance")).alias("d")
    )  # at most k rows
    limits = kth.select(*MARK, F.when(F.col("found") >= k, F.get("d", F.lit(k - 1))).alias("limit"))
    routed = stored(_route(asked.join(limits, MARK, "left"), centres, bounds))
    n_asked, sent = routed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()
    blocks = math.ceil(n_donors / block) + math.ceil(n_asked / block)
    if pivots is None and sent > n_asked * blocks:
        # the cells rule out little: blocks of the whole table send each row less often than cells do
        plain = donors.drop("reach", "cell").withColumn("cell", F.lit(0))
        cores = max(2, queries.sparkSession.sparkContext.defaultParallelism)
        block = max(block, min(WIDE_BLOCK, math.isqrt(n_donors * n_asked // (4 * cores))))
        return _first(_search(routed.select("vec", *MARK, "limit", F.lit(0).alias("cell")), plain, k, payload, {0: n_donors}, block), k)
    routed = routed.select("vec", *MARK, "limit", F.explode("cells").alias("cell"))
    others = _search(routed, donors.drop("reach"), k, payload, sizes, block)
    return _first(own.unionByName(others), k)


def _first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*MARK).orderBy("distance", "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * (x @ centres.T)
    return np.sqrt(np.maximum(square, 0.0))


def _blocks(rows: int, width: int) -> list[slice]:
    """Consecutive rows of which a block of distances to ``width`` others is held at a time."""
    step = max(1, CELLS // max(1, width))
    return [slice(start, start + step) for start in range(0, rows, step)]


def _assign(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """Nearest pivot of each vector, and the distance to it."""

    @F.pandas_udf("cell int, reach double")
    def place(vec: pd.Series) -> pd.DataFrame:
        cell, reach = np.zeros(len(vec), "int32"), np.zeros(len(vec))
        for part in _blocks(len(vec), len(centres)):
            d = _distances(np.stack(vec.to_numpy()[part]).astype(float), centres)
            cell[part] = d.argmin(1)
            reach[part] = d.min(1)
        return pd.DataFrame({"cell": cell, "reach": reach})

    return df.withColumn("__p", place("vec")).select(*[quoted(c) for c in df.columns], "__p.cell", "__p.reach")


def _route(asked: DataFrame, centres: np.ndarray, bounds: dict) -> DataFrame:
    """The further cells of each query that may hold a row as near as its limit.

    For a row s of cell c: d(q,s) is at least d(q,c) - far, near - d(q,c), and
    (d(q,c)^2 - d(q,own)^2) / 2 d(own,c).
    """
    near = np.full(len(centres), np.inf)
    far = np.full(len(centres), -np.inf)
    for c, (_, low, high) in bounds.items():
        near[c], far[c] = low, high
    apart = np.maximum(_distances(centres, centres), 1e-300)

    def needed(vec: np.ndarray, home: np.ndarray, reach: np.ndarray) -> list[np.ndarray]:
        x = np.stack(vec).astype(float)
        d = _distances(x, centres)
        each = np.arange(len(d))
        to_home = d[each, home][:, None]
        # distances carry rounding of the size of the coordinates, so the limit gets slack
        reach = (reach + 1e-6 * (np.abs(x).max(1) + np.abs(centres).max()) + 1e-9)[:, None]
        with np.errstate(invalid="ignore"):  # an empty cell is never near: its bounds are infinite
            keep = (d <= far + reach) & (d >= near - reach)
        d *= d
        keep &= d <= apart[home] * (2.0 * reach) + to_home * to_home
        keep[each, home] = False  # already searched
        at, cell = np.nonzero(keep)
        return np.split(cell.astype("int32"), np.searchsorted(at, each[1:]))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cells(vec: pd.Series, own: pd.Series, limit: pd.Series) -> pd.Series:
        reach = limit.to_numpy(dtype=float, na_value=np.inf)
        reach = np.where(np.isnan(reach), np.inf, reach)
        rows, home = vec.to_numpy(), own.to_numpy().astype(int)
        return pd.Series([c for part in _blocks(len(rows), len(centres)) for c in needed(rows[part], home[part], reach[part])], dtype=object)

    return asked.withColumn("cells", cells("vec", "cell", "limit")).drop("cell", "reach")


def _search(
    asked: DataFrame, donors: DataFrame, k: int, payload: list[str], sizes: dict[int, int], block: int
) -> DataFrame:
    """All pairs inside chunks: at most about ``block`` queries against ``block`` base rows.

    Rows beyond a query's ``limit``, if there is one, are not among its nearest.
    """
    limited = [F.col("limit")] if "limit" in asked.columns else []
    routed = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    width = max([*sizes, *routed, 0]) + 1
    chunks = [max(1, math.ceil(sizes.get(c, 0) / block)) for c in range(width)]
    salts = [max(1, math.ceil(routed.get(c, 0) / block)) for c in range(width)]

    def at(values: list[int]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("cell"))

    def upto(values: list[int]) -> Column:
        return F.explode(F.sequence(F.lit(0), at(values) - 1))

    # both sides may stem from one table, so their vectors get names, hence identities, of their own
    left = asked.select(
        F.col("vec").alias("asked"), *MARK, *limited, "cell", upto(chunks).alias("chunk"),
        F.pmod("q1", at(salts)).cast("int").alias("salt"),
    )
    right = donors.select(
        F.col("vec").alias("donor"), "id", *[quoted(p) for p in payload], "cell",
        F.pmod(F.xxhash64(F.col("id"), F.col("vec")), at(chunks)).cast("int").alias("chunk"),
        upto(salts).alias("salt"),
    )
    base_fields = [f for f in donors.schema if f.name in ("id", *payload)]
    shape = T.StructType(
        [
            *[T.StructField(m, T.LongType()) for m in MARK],
            *sorted(base_fields, key=lambda f: ["id", *payload].index(f.name)),
            T.StructField("distance", T.DoubleType()),
        ]
    )

    def brute(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in shape})
        b = b.sort_values("id", kind="stable").reset_index(drop=True)
        x, y = np.stack(q["asked"].to_numpy()).astype(float), np.stack(b["donor"].to_numpy()).astype(float)
        limit = q["limit"].to_numpy(dtype=float, na_value=np.inf) if "limit" in q else np.full(len(x), np.inf)
        # a distance summed in other tasks is the same number, but for vectors that are equal only by their mark
        limit = np.where(np.isnan(limit), np.inf, limit) * (1 + 1e-9) + 1e-300
        rows, cols, far = _within(x, y, k, limit)
        out = {m: q[m].to_numpy()[rows] for m in MARK}
        for name in ("id", *payload):
            out[name] = b[name].to_numpy()[cols]
        out["distance"] = far
        return pd.DataFrame(out)

    keys = ["cell", "chunk", "salt"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(brute, shape)


def _leaves(x: np.ndarray) -> list[np.ndarray]:
    """Rows in groups of at most ``LEAF``, halved along their widest column."""
    stack, done = [np.arange(len(x))], []
    while stack:
        rows = stack.pop()
        if len(rows) <= LEAF:
            done.append(rows)
            continue
        part = x[rows]
        widest, half = int((part.max(0) - part.min(0)).argmax()), len(rows) // 2
        order = np.argpartition(part[:, widest], half)
        stack += [rows[order[half:]], rows[order[:half]]]
    return done


def _within(x: np.ndarray, b: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_top`` without the rows beyond the limits of their queries, over blocks or leaves of nearby rows.

    A leaf is left out for a group of queries if its box is farther from each than its limit, or than its k-th row in the
    leaves nearest to it. Where leaves rule out little, or a cell is no number, all rows are compared.
    """
    parts, todo = [], np.arange(len(x))
    if x.shape[1] <= LEAF_WIDTH and len(b) > 8 * max(LEAF, k) and np.isfinite(x).all() and np.isfinite(b).all():
        leaves, groups = _leaves(b), _leaves(x)
        low, high = (np.stack([f(b[rows], axis=0) for rows in leaves]) for f in (np.min, np.max))
        first, met = max(2, -(-4 * k // LEAF)), 0
        for n, group in enumerate(groups):
            q = x[group]
            gap = np.zeros((len(q), len(leaves)))
            for j in range(x.shape[1]):
                c = q[:, j : j + 1]
                step = np.maximum(np.maximum(low[:, j] - c, c - high[:, j]), 0.0)
                gap += step * step
            near = np.argpartition(gap.min(0) + gap.mean(0), first)[:first]
            some = b[np.concatenate([leaves[i] for i in near])]
            square = np.zeros((len(q), len(some)))
            for j in range(x.shape[1]):
                step = q[:, j : j + 1] - some[:, j]
                square += step * step
            bound = np.minimum(np.partition(square, k - 1, axis=1)[:, k - 1], limit[group] ** 2)
            kept = np.flatnonzero((gap <= (bound * (1 + 1e-9) + 1e-300)[:, None]).any(0))
            at = np.sort(np.concatenate([leaves[i] for i in kept])) if len(kept) else np.zeros(0, int)
            met += len(at)
            if n == 7 and met > 4 * len(b):
                parts, todo = [], np.arange(len(x))  # half of all rows for the first groups
                break
            if len(at):
                rows, cols, far = _top(q, b[at], k)
                parts.append((group[rows], at[cols], far))
            todo = todo[:0]
    for part in _blocks(len(todo), len(b)):
        rows, cols, far = _top(x[todo[part]], b, k)
        parts.append((todo[part][rows], cols, far))
    rows, cols, far = (np.concatenate([np.zeros(0, kind), *(p[c] for p in parts)]) for c, kind in enumerate((int, int, float)))
    near = far <= limit[rows]
    return rows[near], cols[near], far[near]


def _edge(rough: np.ndarray, k: int) -> np.ndarray:
    """A bound that at least ``k`` cells of each row do not exceed: the k-th least of the least cells of disjoint groups.

    At most ``k`` groups, and others that tie, have a cell within it.
    """
    width = rough.shape[1] // FOLD
    if width < 4 * k:
        return np.partition(rough, k - 1, axis=1)[:, k - 1]
    low = rough[:, : width * FOLD].reshape(len(rough), FOLD, width).min(axis=1)
    low = np.concatenate([low, rough[:, width * FOLD :]], axis=1)
    return np.partition(low, k - 1, axis=1)[:, k - 1]


def _top(x: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and distances of the k nearest rows of ``b`` (ties by position) per row of ``x``.

    Products give rough distances; rows within their rounding of the k-th are measured exactly.
    """
    centre = b.mean(0)
    xc, bc = x - centre, b - centre
    xx, bb = (xc * xc).sum(1), (bc * bc).sum(1)
    rough = xx[:, None] + bb[None, :] - 2.0 * (xc @ bc.T)
    if b.shape[0] > k:
        edge = _edge(rough, k)
    else:
        edge = np.full(len(x), np.inf)
    slack = 1e-11 * (xx + bb.max()) * max(1, x.shape[1]) + 1e-300
    rows, cols = np.nonzero(rough <= (edge + 2 * slack)[:, None])
    square = np.zeros(len(rows))
    for j in range(x.shape[1]):
        step = x[rows, j] - b[cols, j]
        square += step * step
    order = np.lexsort((cols, square, rows))
    rows, cols, square = rows[order], cols[order], square[order]
    starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1] if len(rows) else np.array([], int)
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    first = place < k
    return rows[first], cols[first], np.sqrt(square[first])


def attach_neighbours(df: DataFrame, found: DataFrame, key: str, exclude_self: bool, k: int) -> DataFrame:
    """Neighbours of every row of ``df`` (``vec`` plus key), by its vector; optionally without itself.

    Returns the key, ``neighbour``, payload, ``distance`` and ``place``.
    """
    rows = marked(df.select(col(key).alias("__key"), "vec")).drop("vec")
    paired = join_spread(rows, found.withColumnRenamed("id", "neighbour"), MARK, spread=F.xxhash64("__key")).drop(*MARK)
    if exclude_self:
        paired = paired.filter(F.col("neighbour") != F.col("__key"))
        place = F.row_number().over(Window.partitionBy("__key").orderBy("distance", "neighbour"))
        paired = paired.withColumn("place", place).filter(F.col("place") <= k)
    return paired.withColumnRenamed("__key", key)
