"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased and everything but letters becomes one blank; n-grams of 3 to 7 characters are hashed to 2^20
cells. Cells in which the classes differ most are the features. A feature enters twice, as presence and as density (so
that a chance occurrence in a long text counts less), both times multiplied by the logarithm of the ratio of its smoothed
shares in the two classes; logistic regression weighs them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .store import written
from .words import mix, slices
from .worker import frugal

CELLS = 1 << 20
SIZES = range(3, 8)
FEATURES = 8192
#: Characters over which a single occurrence counts as full density.
SPAN = 1000


@dataclass
class Model:
    """Cell to feature (from 1; 0 for none), weights of presence and density, intercept."""

    feature: np.ndarray
    presence: np.ndarray
    density: np.ndarray
    intercept: float


def _letters() -> np.ndarray:
    table = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)
    return table


_LETTER: list[np.ndarray] = []


def plain(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of texts in a row, other runs as one blank, and where each text begins and ends."""
    if not _LETTER:
        _LETTER.append(_letters())
    parts = []
    for text in texts:
        code = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "replace"), np.uint32)
        code = np.where(_LETTER[0][np.minimum(code, 0xFFFF)] | (code > 0xFFFF), code, 32)
        blank = code == 32
        parts.append(code[~(blank & np.append(False, blank[:-1]))])
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), ends


def cells(codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size of n-gram the cell at each place, and which places lie within one text."""
    run = codes.astype(np.uint64)
    for n in range(2, SIZES.stop):
        if len(codes) < n:
            return
        run = run[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in SIZES:
            inside = np.ones(len(run), bool)
            for back in range(1, n):
                cut = ends[1:] - back
                inside[cut[(cut >= 0) & (cut < len(run))]] = False
            yield (mix(run) & np.uint64(CELLS - 1)).astype(np.int64), inside


def counts(texts: list[str | None], feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The features that occur in each text: text, feature (from 0) and density; and where each text's begin and end."""
    codes, ends = plain(texts)
    keys = [np.zeros(0, np.int64)]
    for cell, inside in cells(codes, ends):
        found = feature[cell]
        at = np.flatnonzero((found > 0) & inside)
        keys.append((np.searchsorted(ends, at, "right") - 1) * FEATURES + found[at] - 1)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    owner = key // FEATURES
    density = np.minimum(1.0, count * (SPAN / np.maximum(np.diff(ends), SPAN))[owner])
    return owner, key % FEATURES, density, np.searchsorted(owner, np.arange(len(texts) + 1))


@frugal()
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class in which a cell occurs; cells of one document only are left out when they are many."""
    total = np.zeros((2, CELLS), np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                seen = np.zeros(CELLS, bool)
                for cell, inside in cells(*plain([text])):
                    seen[cell[inside]] = True
                total[label] += seen
    at = np.flatnonzero(total.sum(0))
    for a in range(0, len(at), 100_000):
        cell = at[a : a + 100_000]
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cell), "clean": pa.array(total[0][cell]), "toxic": pa.array(total[1][cell])})


@frugal()
def _vectors(batches: Iterator[pa.RecordBatch], feature: np.ndarray, ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("label", pa.int32()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float64()))])
    for batch in batches:
        for part in slices(batch, "text"):
            _, at, density, cuts = counts(part.column("text").to_pylist(), feature)
            span = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            places = [np.concatenate([at[a:b], at[a:b] + len(ratio)]).tolist() for a, b in span]
            x = [np.concatenate([ratio[at[a:b]], ratio[at[a:b]] * density[a:b]]).tolist() for a, b in span]
            yield pa.RecordBatch.from_pydict({"label": part.column("label"), "at": places, "x": x}, schema=kind)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> Model:
    """Train on documents (doc_id, text) with a label (doc_id, label 0 or 1).

    At most ``sample`` labelled doc_ids of each class are used, those of least hash; this bound is the only sampling.
    A doc_id with several labels has the more frequent one (1 if equal). Null labels and texts are left out. With one
    class only, or none, the score is that class's share, or 0.
    """
    spark = docs.sparkSession
    each = labels.filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.expr("cast(avg(label) >= 0.5 as int)").alias("label"))
    each = each.withColumn("h", F.xxhash64("doc_id"))
    chosen = [each.filter(F.col("label") == k).orderBy("h", "doc_id").limit(sample).select("doc_id", "label") for k in (0, 1)]
    chosen = written(chosen[0].union(chosen[1]), "chosen")  # at most twice the sample, so it may be broadcast
    rows = docs.filter("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "label")
    rows = written(rows, "labelled").repartition(4)
    size = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    none = Model(np.zeros(CELLS, np.uint16), np.zeros(1), np.zeros(1), 0.0)
    if len(size) < 2:
        none.intercept = 30.0 if 1 in size else -30.0
        return none
    found = rows.mapInArrow(_frequencies, "cell bigint, clean bigint, toxic bigint")
    found = found.groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter("clean + toxic >= 3")
    share = lambda c, k: F.log((F.col(c) + 0.5) / (size[k] + 1))
    apart = F.abs(F.col("toxic") - F.col("clean") * (size[1] / size[0]))
    found = found.withColumn("ratio", share("toxic", 1) - share("clean", 0))
    found = found.withColumn("power", F.abs("ratio") * F.sqrt(F.least("toxic", "clean") + apart))
    table = found.orderBy(F.desc("power"), "cell").limit(FEATURES).select("cell", "ratio").collect()
    ratio = np.array([r["ratio"] for r in table])
    feature = np.zeros(CELLS, np.uint16)
    feature[[r["cell"] for r in table]] = np.arange(1, len(table) + 1)
    vectors = rows.mapInArrow(partial(_vectors, feature=feature, ratio=ratio), "label int, at array<int>, x array<double>")
    width = 2 * len(ratio)
    pack = F.udf(lambda at, x: SparseVector(width, at, x), VectorUDT())
    # the toxic rows weigh a third of the clean ones together, whatever their shares in the sample
    weight = F.when(F.col("label") == 1, size[0] / (3 * size[1])).otherwise(1.0).alias("weight")
    train = vectors.select(F.col("label").cast("double").alias("label"), weight, pack("at", "x").alias("features")).cache()
    learned = LogisticRegression(weightCol="weight", maxIter=60, regParam=0.002, standardization=False).fit(train)
    train.unpersist()
    weight = np.array(learned.coefficients.toArray())
    return Model(feature, weight[: len(ratio)] * ratio, weight[len(ratio) :] * ratio, float(learned.intercept))


@frugal()
def _scores(batches: Iterator[pa.RecordBatch], shared, name: str) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for batch in batches:
        for part in slices(batch, "text"):
            owner, at, density, _ = counts(part.column("text").to_pylist(), model.feature)
            weight = model.presence[at] + model.density[at] * density
            raw = np.bincount(owner, weights=weight, minlength=len(part)) + model.intercept
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))], [*part.schema.names, name])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` (text and any other columns but ``name``) with the column ``name``, 0 to 1: higher, label 1 likelier.

    Whole texts count; null is scored like an empty text. Repeated rows get equal scores; no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by CELLS and FEATURES
    kind = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(partial(_scores, shared=shared, name=name), kind)


def held_out(key: str = "doc_id") -> Column:
    """The fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from ``limit`` on). ``labels``: doc_id, toxic.

    The model learns from labels outside the held-out fold only. Null texts are scored as empty, rows without doc_id
    are scored and not held out, repeated rows give a row each. Other columns are not read.
    """
    known = labels.filter(~held_out()).selectExpr("cast(doc_id as bigint) doc_id", "cast(toxic as int) label")
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    scored = score(rows, fit(rows, known)).select("doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.expr(f"cast(score >= {limit} as int)").alias("predicted"))
