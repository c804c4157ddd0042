"""Whitening of embeddings by shifted CholeskyQR.

The covariance is never decomposed itself: the centred vectors A are orthogonalised. A pass over them sums the Gram matrix
of A R^-1 (a triangular solve a row), its Cholesky factor is composed into R, and the next pass goes on from there. The
first pass adds a shift, so that vectors of any condition get a factor; after three passes A R^-1 is orthonormal and the
singular values and right vectors of R are those of A. Directions without variance, which no triangular solve can make
orthonormal, are taken care of by a last Gram matrix, whose root goes into R before its singular value decomposition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .worker import frugal

ROUND = np.finfo(np.float64).eps / 2
#: Rows that a task turns into doubles at a time.
ROWS = 4096
OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double"


@frugal()
def _scaled(batches: Iterator[pa.RecordBatch], factor: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, x): floor(factor * c) of each component as little-endian longs, without the zeros at the end."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            vectors = part.column("embedding")
            values = np.asarray(vectors.flatten().fill_null(np.nan), np.float64)
            size = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(values * factor) + 0.0
            bad = ~np.isfinite(values) | ~(np.abs(whole) < 2.0**63)
            wrong = np.concatenate([[0], np.cumsum(bad)])
            keep = vectors.is_valid().to_numpy(zero_copy_only=False) & (wrong[ends[1:]] == wrong[ends[:-1]])
            whole = np.where(bad, 0.0, whole).astype("<i8")
            rows = [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            rows = [np.trim_zeros(r, "b").tobytes() if k else None for r, k in zip(rows, keep.tolist(), strict=True)]
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([part.column("vec_id").filter(keep), pa.array(rows, pa.binary()).filter(keep)], ["vec_id", "x"])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of longs, shorter ones filled with zeros; ``width`` is the greatest length."""
    out = np.zeros((len(column), width), np.int64)
    raws = column.to_pylist()
    if raws and all(len(r) == 8 * width for r in raws):
        return np.frombuffer(b"".join(raws), "<i8").reshape(len(raws), width)
    for k, raw in enumerate(raws):
        out[k, : len(raw) // 8] = np.frombuffer(raw, "<i8")
    return out


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield matrix(batch.column("x").slice(at, ROWS), width)


@frugal()
def _sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Per dimension the sums of the upper and lower 32 bits: exact whatever the components."""
    high, low = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for x in _parts(batches, width):
        high += (x >> 32).sum(axis=0)
        low += (x & 0xFFFFFFFF).sum(axis=0)
    yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(width, dtype=np.int32)), "high": pa.array(high), "low": pa.array(low)})


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, rounded once: n x - S is made whole first, where it fits."""
    most = int(np.abs(x).max(initial=0))
    if n * most + max(map(abs, sums), default=0) < 1 << 53:
        return (n * x - np.array(sums, np.int64)).astype(np.float64) / n
    mean = [divmod(s, n) for s in sums]
    whole = np.array([m for m, _ in mean], np.float64)
    return (x.astype(np.float64) - whole) - np.array([r / n for _, r in mean])


@frugal()
def _gram(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], solve: np.ndarray, columns: int) -> Iterator[pa.RecordBatch]:
    """The rows of the Gram matrix of this task's centred vectors times ``solve``."""
    total = np.zeros((columns, columns))
    for x in _parts(batches, len(sums)):
        q = centred(x, n, sums) @ solve
        total += q.T @ q
    if total.any():
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(columns, dtype=np.int32)), "g": pa.array(list(total), pa.list_(pa.float64()))})


def _added(table: pa.Table) -> pa.Table:
    rows = np.array(table.column("g").to_pylist(), np.float64)
    return pa.table({"i": table.column("i")[:1], "g": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})


def inverse(r: np.ndarray) -> np.ndarray:
    """The inverse of an upper triangular matrix, a column of substitutions at a time."""
    d = len(r)
    out = np.zeros((d, d))
    for i in range(d - 1, -1, -1):
        out[i] = (np.eye(d)[i] - r[i, i + 1 :] @ out[i + 1 :]) / r[i, i]
    return out


def factor_of(gram: Callable[[np.ndarray], np.ndarray], n: int, width: int, passes: int = 3) -> np.ndarray:
    """B with B'B the Gram matrix of the centred vectors, composed of ``passes`` Cholesky factors.

    ``gram`` sums the Gram matrix of the centred vectors times a matrix, over all of them.
    """
    r = np.eye(width)
    for step in range(passes):
        g = gram(inverse(r))
        # the shift that keeps the factor real, by the bound on the rounding of the Gram matrix and its factor
        shift = 11 * (n * width + width * (width + 1)) * ROUND * np.trace(g)
        while True:
            try:
                lower = np.linalg.cholesky(g + (shift if step == 0 else 0.0) * np.eye(width))
                break
            except np.linalg.LinAlgError:
                if step:  # directions without variance: the root below takes them as they are
                    lower = None
                    break
                shift = 10 * shift or 1.0
        if lower is None:
            break
        r = lower.T @ r
    values, vectors = np.linalg.eigh(gram(inverse(r)))
    return (np.sqrt(np.clip(values, 0, None))[:, None] * vectors.T) @ r


@frugal()
def _whitened(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], axes: np.ndarray, explained: list[float]) -> Iterator[pa.RecordBatch]:
    width, top = len(sums), axes.shape[1]
    offsets = np.array(sums, object)
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            x = matrix(part.column("x"), width)
            most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
            if width * most * most < 1 << 63:
                deviation = ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [int(((n * row.astype(object) - offsets) ** 2).sum()) for row in x]
                deviation = [d if d < 1 << 63 else None for d in deviation]
            white = centred(x, n, sums) @ axes
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": part.column("vec_id").take(np.repeat(np.arange(len(part)), top)),
                    "component": pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), len(part))),
                    "n": pa.array(np.full(len(part) * top, n, np.int64)),
                    "deviation": pa.array([d for d in deviation for _ in range(top)], pa.int64()),
                    "whitened": pa.array(white.ravel()),
                    "explained": pa.array(np.tile(explained, len(part)), pa.float64()),
                }
            )


def whiten(vectors: DataFrame, components: int = 4, factor: int = 256) -> DataFrame:
    """Whitened leading components: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``vectors``: vec_id, embedding; other columns are not read. x = floor(factor * c) of each component c as double; the
    fit is on the distinct x. Left out are null vectors and such with a null or non-finite component, or one whose x is
    beyond a long. A vector of fewer components counts as filled with zeros, so an empty one is zero. Each row gives a row
    per component, rows that repeat or lack a vec_id too. Components without variance do not exist: there are fewer than
    ``components`` then, and no rows if all vectors are equal or there are none. A deviation beyond a long is null.
    The driver holds matrices of the vectors' width only; each pass over the vectors returns one such matrix a task,
    added up row by row.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(rows.mapInArrow(partial(_scaled, factor=factor), "vec_id bigint, x binary"), "scaled")
    fit = written(rows.select("x").distinct(), "fit")
    n, size = fit.agg(F.count("*"), F.coalesce(F.max(F.length("x")), F.lit(0))).first()
    width = size // 8
    none = spark.createDataFrame([], OUT + ", identity_error double")
    if n == 0 or width == 0:
        return none
    added = fit.mapInArrow(partial(_sums, width=width), "dim int, high bigint, low bigint")
    wide = "sum(cast({} as decimal(38, 0)))"
    found = added.groupBy("dim").agg(F.expr(wide.format("high")).alias("high"), F.expr(wide.format("low")).alias("low")).collect()
    sums = [0] * width
    for r in found:
        sums[r["dim"]] = (int(r["high"]) << 32) + int(r["low"])

    def gram(solve: np.ndarray) -> np.ndarray:
        columns = solve.shape[1]
        parts = fit.mapInArrow(partial(_gram, n=n, sums=sums, solve=solve, columns=columns), "i int, g array<double>")
        out = np.zeros((columns, columns))
        for r in parts.groupBy("i").applyInArrow(_added, "i int, g array<double>").collect():
            out[r["i"]] = r["g"]
        return (out + out.T) / 2

    _, singular, right = np.linalg.svd(factor_of(gram, n, width))
    values = singular**2 / n
    top = int((singular[:components] > 0).sum())
    measured = gram(right[:top].T / np.sqrt(values[:top])) / n if top else np.zeros((0, 0))
    # a direction without variance has a length that is rounding only, so what it whitens has no variance of 1
    real = np.abs(measured.diagonal() - 1) < 1e-3
    top = top if real.all() else int(real.argmin())
    if top == 0:
        return none
    axes = right[:top].T / np.sqrt(values[:top])
    error = float(np.abs(measured[:top, :top] - np.eye(top)).max())
    explained = (values[:top] / values.sum()).tolist()
    white = rows.mapInArrow(partial(_whitened, n=n, sums=sums, axes=axes, explained=explained), OUT)
    return white.withColumn("identity_error", F.lit(error))
