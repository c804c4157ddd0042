"""Line dedup by a fixed-depth tree of line templates.

A line's leaf is its number of words and its leading words. Words with a digit are variable fields if at least as many are
constant. Below the leaf the other words are cut into fields of two tenths of the line, and a line belongs to one template
for each field, which is variable in it. So the templates of a line follow from the line alone: no order and no size of a
leaf changes them, and what occurs in several documents is found by counting templates. A line that shares a template with
an earlier document is dropped.

Lines of one template agree in the fields before the middle or in those after it. Only lines one of whose halves occurs in
several documents get that far.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .sieve import bitmap, marked, sieve
from .skew import attach
from .store import fresh, written
from .words import slices
from .worker import frugal

ANY = "<*>"
DIGIT = re.compile(r"\d")
LETTER = re.compile(r"[^\W\d_]")
LINES = "doc_id bigint, nth int, mark bigint, templates array<bigint>"


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def masked(line: str, least: int = 5) -> list[str]:
    """The words of a line, those with a digit as variable fields if at least ``least`` words and half of them are constant."""
    words = line.split()
    if len(words) >= least and DIGIT.search(line):
        fields = [ANY if DIGIT.search(w) else w for w in words]
        if fields.count(ANY) * 2 <= len(words):
            return fields
    return words


def compared(text: str | None, least: int, letters: int) -> Iterator[tuple[int, list[str]]]:
    """Number and words of each line that has ``least`` words or ``letters`` characters without white space."""
    for nth, line in enumerate((text or "").split("\n")):
        words = masked(line, least)
        if len(words) >= least or sum(map(len, words)) >= letters:
            yield nth, words


def leaf(words: list[str], depth: int) -> int:
    """A line's leaf; figures that are no variable fields, words with digits and no letters, have to be equal in it."""
    text = " ".join(words)
    figures = [w for w in words if DIGIT.search(w) and not LETTER.search(w)] if DIGIT.search(text) else []
    return _hash(" ".join([str(len(words)), *words[:depth], *figures]))


@lru_cache(maxsize=10_000)
def fields(size: int, depth: int, similarity: float, least: int) -> list[tuple[int, int]]:
    """Where the fields of a line of ``size`` words begin and end; none if the line is not generalised."""
    free = next(k for k in range(size, -1, -1) if 1 - k / size >= similarity - 1e-9)
    return [(k, min(size, k + free)) for k in range(depth, size, free)] if free and size >= least else []


def halves(words: list[str], depth: int, similarity: float, least: int) -> list[int]:
    """Hashes of which two lines of one template share one: their words before and after the middle field, or all words."""
    place, cut = leaf(words, depth), fields(len(words), depth, similarity, least)
    if not cut:
        return [_hash(f"{place} {' '.join(words)}")]
    middle = cut[len(cut) // 2][0]
    return [_hash(f"{place} < {' '.join(words[depth:middle])}"), _hash(f"{place} > {' '.join(words[middle:])}")]


def templates(words: list[str], depth: int, similarity: float, least: int) -> list[int]:
    """The hashes of a line's templates: one for each field that may differ, or the line's own.

    The leading words, lines of fewer than ``least`` words and lines in which fewer than half the words would be left are
    not generalised.
    """
    place, size = leaf(words, depth), len(words)
    made = [(a, [*words[:a], *[ANY] * (b - a), *words[b:]]) for a, b in fields(size, depth, similarity, least)]
    found = [_hash(f"{place} {a} {' '.join(f)}") for a, f in made if f.count(ANY) * 2 <= size]
    return found or [_hash(f"{place} {' '.join(words)}")]


@frugal()
def _halves(batches: Iterator[pa.RecordBatch], depth: int, similarity: float, least: int, letters: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            keys, docs = [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                own = {h for _, w in compared(text, least, letters) for h in halves(w, depth, similarity, least)}
                keys += own
                docs += [doc] * len(own)
            yield pa.RecordBatch.from_pydict({"half": pa.array(keys, pa.int64()), "doc_id": pa.array(docs, pa.int64())})


@frugal()
def _lines(batches: Iterator[pa.RecordBatch], shared, depth: int, similarity: float, least: int, letters: int) -> Iterator[pa.RecordBatch]:
    """The templates of the lines of which a half occurs in several documents."""
    for batch in batches:
        for part in slices(batch, "text"):
            rows, keys, ends = [], [], [0]
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                for nth, w in compared(text, least, letters):
                    rows.append((doc, nth, w))
                    keys += halves(w, depth, similarity, least)
                    ends.append(len(keys))
            hit = np.concatenate([[0], np.cumsum(marked(shared, np.array(keys, np.int64)))])
            keep = np.flatnonzero(hit[ends[1:]] > hit[ends[:-1]])
            rows = [rows[k] for k in keep.tolist()]
            made = [templates(w, depth, similarity, least) for _, _, w in rows]
            marks = [_hash(" ".join(w)) for _, _, w in rows]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array(marks, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.list_(pa.int64()))], ["doc_id", "nth", "mark", "templates"])


@frugal()
def _without(batches: Iterator[pa.RecordBatch], names: list[str], least: int) -> Iterator[pa.RecordBatch]:
    """The texts without the lines listed (nth, mark) in the last column; a mark of another text of the doc_id is none of its own."""
    for batch in batches:
        texts, total, gone = [], [], []
        for text, drop in zip(batch.column("text").to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            lines = (text or "").split("\n") if text else []
            listed = {(d["nth"], d["mark"]) for d in drop or ()}
            at = {n for n, _ in listed if n < len(lines)}
            out = {n for n in at if (n, _hash(" ".join(masked(lines[n], least)))) in listed}
            kept = [line for k, line in enumerate(lines) if k not in out]
            texts.append("\n".join(kept) if out else text)
            total.append(len(lines))
            gone.append(len(lines) - len(kept))
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_dropped"])


def recurring(found: DataFrame) -> DataFrame:
    """(doc_id, nth, mark) of the lines of ``found`` (these, templates) of which a template occurs in an earlier document."""
    each = found.select("doc_id", "nth", "mark", F.explode("templates").alias("template"))
    spread = each.groupBy("template").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    spread = written(spread.filter("keeper != last"), "recurring")
    # the rest of the templates cannot drop a line, so they need not move
    each = each.filter(sieve(spread.select("template"), "template")(F.col("template")))
    hits = attach(each, spread.select("template", "keeper"), "template", counts=spread.select("template", "n"))
    return hits.filter("doc_id != keeper").select("doc_id", "nth", "mark")


def drop_lines(docs: DataFrame, depth: int = 3, similarity: float = 0.8, least: int = 5, letters: int = 12) -> DataFrame:
    """``docs`` (doc_id, text, any others) with recurring lines dropped, n_lines and n_dropped (in place of such columns).

    A line is dropped if one of its templates occurs in a document with a smaller doc_id. Lines of fewer than ``least``
    words and ``letters`` characters stay; shorter ones than ``least`` words, and lines of which more than half the words
    have digits, are compared unmasked. Lines end at a line feed; what stays is joined by line feeds. Null and empty texts
    stay as they are, with no lines. Rows that repeat a doc_id are one document; rows without doc_id keep their lines. An
    empty table stays empty.
    """
    docs = docs.drop("n_lines", "n_dropped")
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").filter("doc_id is not null")
    shape = {"depth": depth, "similarity": similarity, "least": least, "letters": letters}
    places = rows.mapInArrow(partial(_halves, **shape), "half bigint, doc_id bigint")
    several = places.groupBy("half").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a != b").select("half")
    cut = partial(_lines, shared=bitmap(several), **shape)
    drops = recurring(written(rows.mapInArrow(cut, LINES), "lines"))
    key, drop, maybe = (fresh(docs, name) for name in ("key", "drop", "maybe"))
    drops = written(drops.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("nth", "mark")).alias(drop)), "drops")
    passes = sieve(drops, key)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    tested = docs.withColumn(maybe, passes(F.col("doc_id").cast("long")))
    names = docs.columns
    n_lines = F.when(F.length("text") > 0, F.size(F.split("text", "\n", -1))).otherwise(0).cast("long").alias("n_lines")
    same = tested.filter(~F.col(maybe)).select(*names, n_lines, F.lit(0).cast("long").alias("n_dropped"))
    kind = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    hit = tested.filter(maybe).select(*names, F.col("doc_id").cast("long").alias(key))
    # drops grow with the documents, so the plan is the same at every size: never a broadcast
    hit = hit.join(drops.hint("merge"), key, "left").select(*names, drop)
    return same.unionByName(hit.mapInArrow(partial(_without, names=names, least=least), kind))
