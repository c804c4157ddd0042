"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets of similar lengths. A query meets the buckets from the longest on. With
the query's k-th score so far and a bucket's greatest length, only vectors above a local cosine threshold can still
enter. A threshold over 1 ends the search. Where it is high, the query's largest coordinates bound the same coordinates
of such vectors, and those outside the bounds are passed over; where it is low, only vectors too short are. What is left
is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .worker import frugal

BUCKET = "part int, nth int, longest double, marks array<bigint>, ids array<bigint>, width int, rows binary"
BLOCK = "part int, nth int, reach double, marks array<bigint>, ids array<bigint>, width int, rows binary, floors array<double>"
#: Local cosine threshold from which coordinates prune more than they cost, and how many are looked at.
HIGH, FOCUS = 0.6, 3
#: Whole numbers stay exact in doubles and in longs below these.
EXACT, LONG = float(1 << 53), float(1 << 63)
#: Lengths of tiles that a search for the tiles of a block looks at.
LENGTHS = 100_000


def scaled(vectors: DataFrame, factor: int = 64) -> DataFrame:
    """(mark, vec_id, v, norm): v holds floor(factor * x) for each component x as double; norm is its length.

    Left out: rows without vec_id, null vectors, vectors with a null or non-finite component. The numbers are whole, but
    kept as doubles, in which every one of them is exact; ``mark`` tells rows apart once the table is written.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    most = np.finfo(np.float64).max
    whole = F.transform("x", lambda c: F.least(F.greatest(c * factor, F.lit(-most)), F.lit(most)))
    # beyond 2^53 every double is whole
    whole = F.transform(whole, lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c))
    rows = vectors.filter("vec_id is not null and embedding is not null")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(~F.coalesce(bad, F.lit(True)), x).alias("x")).filter("x is not null")
    rows = rows.select(F.monotonically_increasing_id().alias("mark"), "vec_id", whole.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows, shorter ones filled with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(size.max()) if len(size) else 0))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def packed(batch: pa.RecordBatch) -> dict:
    """Rows (mark, vec_id, v) as one row of little-endian doubles."""
    rows = matrix(batch.column("v"))
    return {"marks": batch.column("mark").to_pylist(), "ids": batch.column("vec_id").to_pylist(), "width": rows.shape[1], "rows": rows.astype("<f8").tobytes()}


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks, ids and vectors of such a row."""
    v = np.frombuffer(row["rows"], "<f8").reshape(len(row["ids"]), row["width"])
    return np.array(row["marks"], np.int64), np.array(row["ids"], np.int64), v


@frugal()
def _buckets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows (mark, vec_id, v, norm) as one row a bucket."""
    part, nth = TaskContext.get().partitionId(), 0
    kind = [("part", pa.int32()), ("nth", pa.int32()), ("longest", pa.float64()), ("marks", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("width", pa.int32()), ("rows", pa.binary())]
    for batch in batches:
        for at in range(0, len(batch), size):
            cut = batch.slice(at, size)
            own = {"part": part, "nth": nth, "longest": float(cut.column("norm").to_numpy().max())}
            yield pa.RecordBatch.from_pylist([own | packed(cut)], pa.schema(kind))
            nth += 1


@frugal()
def _floors(batches: Iterator[pa.RecordBatch], head: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    """Queries (mark, vec_id, v, norm) with the k-th score among the longest vectors, if there are k, and how long a vector
    has to be to reach it."""
    marks, _, longest = head.value
    for batch in batches:
        floors, reach = [], []
        norms = batch.column("norm").to_numpy()
        for mark, query, length in zip(batch.column("mark").to_pylist(), matrix(batch.column("v")), norms.tolist(), strict=True):
            score = products(longest, query)[marks != mark]
            floors.append(float(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else None)
            reach.append(floors[-1] / length if floors[-1] is not None and floors[-1] > 0 and length else 0.0)
        added = [pa.array(floors, pa.float64()), pa.array(reach, pa.float64())]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("mark", "vec_id", "v")] + added, ["mark", "vec_id", "v", "floor", "reach"])


@frugal()
def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive queries as one row a block, with the least reach of them."""
    part, nth = TaskContext.get().partitionId(), 0
    kind = [("part", pa.int32()), ("nth", pa.int32()), ("reach", pa.float64()), ("marks", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))]
    kind += [("width", pa.int32()), ("rows", pa.binary()), ("floors", pa.list_(pa.float64()))]
    for batch in batches:
        for at in range(0, len(batch), size):
            cut = batch.slice(at, size)
            own = {"part": part, "nth": nth, "reach": float(cut.column("reach").to_numpy().min()), "floors": cut.column("floor").to_pylist()}
            yield pa.RecordBatch.from_pylist([own | packed(cut)], pa.schema(kind))
            nth += 1


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Whole inner products, exact: as doubles or longs where these hold them, else as Python's numbers. One beyond a long
    counts as the nearest long."""
    n = min(rows.shape[1], len(query))
    rows, query = rows[:, :n], query[:n]
    with np.errstate(over="ignore"):
        most = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(n, 1)
    if most < EXACT:
        return (rows @ query).astype(np.int64)
    if most < LONG:
        return (rows.astype(np.int64) * query.astype(np.int64)).sum(axis=1)
    own = [int(x) for x in query.tolist()]
    exact = (sum(int(x) * y for x, y in zip(row, own, strict=True)) for row in rows.tolist())
    return np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in exact], np.int64)


def search(bucket: tuple[np.ndarray, np.ndarray, np.ndarray], query: np.ndarray, length: float, floor: int | None) -> np.ndarray:
    """Positions of a bucket (rows, lengths falling, unit rows) whose product with the query may be ``floor`` or more."""
    rows, norms, unit = bucket
    if floor is None or floor <= 0 or length == 0 or not len(norms) or norms[0] == 0:
        return np.arange(len(rows))
    local = (floor / length) / norms[0] - 1e-9
    if not np.isfinite(norms[0]):
        return np.arange(len(rows))
    if local > 1:
        return np.zeros(0, np.int64)
    # length: a vector shorter than floor / length cannot reach the floor
    n = int(np.searchsorted(-norms, -(floor / length) * (1 - 1e-9), "right"))
    if local < HIGH:
        return np.arange(n)
    # coordinates: at a cosine of at least local, a unit vector's coordinate lies within these bounds
    keep, q = np.ones(n, bool), query[: unit.shape[1]] / length
    for f in np.argsort(-np.abs(q))[:FOCUS].tolist():
        reach = np.sqrt(max(0.0, (1 - q[f] ** 2) * (1 - local**2)))
        low = -1.0 if -q[f] >= local else q[f] * local - reach
        high = 1.0 if q[f] >= local else q[f] * local + reach
        keep &= (unit[:n, f] >= low - 1e-7) & (unit[:n, f] <= high + 1e-7)
    return np.flatnonzero(keep)


def _best(score: np.ndarray, ids: np.ndarray, marks: np.ndarray, k: int) -> np.ndarray:
    """The positions of the k best, ties to smaller ids."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= edge)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((marks[at], ids[at], ~score[at]))[:k]]  # ~ falls as the score rises, and holds every long


def _tile(table: pa.Table, k: int) -> pa.Table:
    """The best of the buckets of one tile for each query of one block: at most k, and none below the score to beat."""
    rows = table.to_pylist()
    blocks = sorted((r for r in rows if not r["is_query"]), key=lambda r: (-r["longest"], r["nth"]))
    out: list[tuple] = []
    buckets = []
    for r in blocks:
        marks, ids, v = unpacked(r)
        with np.errstate(over="ignore", invalid="ignore"):
            norms = np.sqrt((v * v).sum(axis=1))
            order = np.argsort(-norms, kind="stable")
            marks, ids, v, norms = marks[order], ids[order], v[order], norms[order]
            buckets.append((marks, ids, (v, norms, v / np.maximum(norms, 1e-300)[:, None])))
    for r in rows:
        if not r["is_query"]:
            continue
        for mark, name, query, floor in zip(*unpacked(r), r["floors"], strict=True):
            with np.errstate(over="ignore"):
                length = float(np.sqrt((query * query).sum()))
            best, best_ids, best_marks = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for marks, ids, bucket in buckets:
                if floor is not None and floor > 0 and length * bucket[1][0] * (1 + 1e-9) < floor:
                    break
                at = search(bucket, query, length, floor)
                at = at[marks[at] != mark]
                score = products(bucket[0][at], query)
                if floor is not None:
                    enough = np.array(score >= floor * (1 - 1e-15) if floor > 0 else score >= floor * (1 + 1e-15), bool)
                    at, score = at[enough], score[enough]
                best = np.concatenate([best, score])
                best_ids, best_marks = np.concatenate([best_ids, ids[at]]), np.concatenate([best_marks, marks[at]])
                top = _best(best, best_ids, best_marks, k)
                best, best_ids, best_marks = best[top], best_ids[top], best_marks[top]
                if len(best) == k:
                    floor = float(best[-1]) if floor is None else max(floor, float(best[-1]))
            out += [(int(mark), int(name), m, i, s) for m, i, s in zip(best_marks.tolist(), best_ids.tolist(), best.tolist(), strict=True)]
    columns = list(zip(*out, strict=True)) or [()] * 5
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("asked", "query_id", "mark", "vec_id", "score"), columns, strict=True)})


@frugal()
def _pairs(batches: Iterator[pa.RecordBatch], lengths: list[float], step: int, count: int) -> Iterator[pa.RecordBatch]:
    """Each block with the tiles that may hold a vector of its reach: those before the first length that is too short."""
    falling = np.maximum.accumulate(np.array(lengths, np.float64)[::-1])[::-1]
    for batch in batches:
        reach = batch.column("reach").to_numpy()
        need = np.minimum(count, np.searchsorted(-falling * (1 + 1e-9), -reach, "right") * step)
        row = np.repeat(np.arange(len(need)), need)
        tile = np.arange(len(row)) - np.repeat(np.cumsum(need) - need, need)
        picked = batch.take(pa.array(row))
        yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(tile.astype(np.int32))], [*batch.schema.names, "tile"])


def top_products(
    vectors: DataFrame, k: int = 20, every: int = 20, factor: int = 64, bucket: int = 1024, tile: int = 16, block: int = 4096
) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``, the ``k`` other rows with the greatest products.

    ``vectors``: vec_id, embedding; other columns are not read. Returns query_id, rank (from 1), vec_id, score; ties go
    to the smaller vec_id, and fewer rows are returned where there are fewer. See ``scaled`` for what takes part; a
    vector of fewer components counts as filled with zeros, so an empty or zero vector scores 0. Rows that repeat a vec_id
    are candidates, and queries, of their own. A score beyond a long counts as the nearest long. No rows give none.

    A task holds one tile of buckets and one block of queries. Queries are ranged by the length that a vector needs to
    enter their results, so a block goes to the tiles of longer vectors only, and a tile returns nothing below the score
    that a query has to beat.
    """
    spark = vectors.sparkSession
    rows = written(scaled(vectors, factor), "vectors")
    ordered = rows.repartitionByRange(F.desc("norm"), "vec_id", "mark").sortWithinPartitions(F.desc("norm"), "vec_id", "mark")
    buckets = written(ordered.mapInArrow(partial(_buckets, size=bucket), BUCKET), "buckets")
    # the longest vectors give each query a score to beat; one bucket of them is broadcast
    top = buckets.orderBy(F.desc("longest"), "part", "nth").limit(1).collect()
    head = spark.sparkContext.broadcast(unpacked(top[0].asDict()) if top else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0))))
    asked = rows.filter(F.col("vec_id") % every == 0)
    asked = asked.mapInArrow(partial(_floors, head=head, k=k), "mark bigint, vec_id bigint, v array<double>, floor double, reach double")
    asked = written(asked, "asked").repartitionByRange("reach", "mark").sortWithinPartitions("reach", "mark")
    queries = written(asked.mapInArrow(partial(_blocks, size=block), BLOCK), "queries")
    queries = queries.withColumnsRenamed({"part": "block", "nth": "place"})

    buckets = buckets.withColumn("sub", F.expr(f"nth div {tile}"))
    tiles = buckets.groupBy("part", "sub").agg(F.max("longest").alias("most"))
    # one row a tile: the only global order is over these; parts are ranges of falling length
    tiles = written(tiles.withColumn("tile", F.row_number().over(Window.orderBy("part", "sub")) - 1), "tiles")
    count = tiles.count()
    step = max(1, -(-count // LENGTHS))
    # the length of every step-th tile at most: a block needs the tiles before the first one that is too short
    lengths = [r["most"] for r in tiles.filter(F.col("tile") % step == 0).orderBy("tile").collect()]
    pairs = queries.select("block", "place", "reach").mapInArrow(partial(_pairs, lengths=lengths, step=step, count=count), "block int, place int, reach double, tile int")
    pairs = pairs.join(tiles, "tile").filter(F.col("most") * (1 + 1e-9) >= F.col("reach")).select("block", "place", "tile", "part", "sub")
    pairs = written(pairs, "pairs")
    none = F.lit(None).cast("array<double>").alias("floors")
    held = buckets.join(pairs, ["part", "sub"]).select("tile", "block", "place", F.lit(False).alias("is_query"), "longest", "nth", "marks", "ids", "width", "rows", none)
    sought = queries.join(pairs, ["block", "place"]).select(
        "tile", "block", "place", F.lit(True).alias("is_query"), F.lit(0.0).alias("longest"), F.lit(0).alias("nth"), "marks", "ids", "width", "rows", "floors"
    )
    kind = "asked bigint, query_id bigint, mark bigint, vec_id bigint, score bigint"
    found = held.union(sought).groupBy("tile", "block", "place").applyInArrow(lambda t: _tile(t, k), kind)
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "mark")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
