"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import written
from .tokens import default_vocabulary, encoder
from .worker import frugal

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Words an encoder remembers: idle workers of earlier stages take turns with the others, and each holds its own.
KEEP = 100_000
SLOT = "length bigint, rank_from bigint, rank_to bigint, first_sequence bigint, each bigint, first_offset bigint"


@frugal("encoder")
def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(path, KEEP), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for at in range(0, len(batch), 256):
            rows = []
            for key, raw in zip(batch.column(0)[at : at + 256].to_pylist(), encode(batch.column(1)[at : at + 256].to_pylist()), strict=True):
                raw += end
                total = len(raw) // 4
                cuts = [0, *range(total % size or size, total + 1, size)]
                rows += [(key, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, size: int = 2048) -> DataFrame:
    """Token pieces of every document: the ids of its whole text and ``end_id``, cut into ``size`` tokens from the end.

    A null text is empty (one piece of one token). Columns: doc_id, piece, start, length, ids_crc32.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(partial(_pieces, path=vocabulary or default_vocabulary(), end_id=end_id, size=size), PIECE)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit over counts, longest first: runs (length, rank_from, rank_to, first_sequence, each, first_offset).

    Pieces rank_from..rank_to of a length go, ``each`` to a sequence, into the sequences from first_sequence on, from
    first_offset. Open sequences with equal room are one run of numbers, so the work depends on the lengths, not the rows.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    runs, opened = [], 0

    def put_back(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                bisect.insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, done = counts[length], 0
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                free = rooms[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free]
                    rooms.pop(at)
                each = free // length
            else:
                free, each = size, size // length
                first, n = opened, -(-todo // each)
                opened += n
            full, rest = min(n, todo // each), 0
            if full < n and todo % each:
                rest = todo - full * each
            taken = full * each + rest
            runs.append((length, done, done + taken, first, each, size - free))
            put_back(free - each * length, first, full)
            if rest:
                put_back(free - rest * length, first + full, 1)
            put_back(free, first + full + (rest > 0), n - full - (rest > 0))
            todo, done = todo - taken, done + taken
    return runs


def ranked(rows: DataFrame, counts: DataFrame, task_rows: int) -> DataFrame:
    """A rank from 0 within each length. A length with many rows is ranked in chunks whose sizes are summed before."""
    # counts has a row a length, at most the sequence size
    dealt = rows.join(F.broadcast(counts), "length").withColumn(
        "chunk", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32), cast(ceil(n / {task_rows}) as bigint))")
    )
    sizes = dealt.groupBy("length", "chunk").agg(F.count("*").alias("m"))
    order = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "chunk", F.coalesce(F.sum("m").over(order), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("nth", F.row_number().over(within) - 1)
    return numbered.join(sizes, ["length", "chunk"]).withColumn("rank", F.col("base") + F.col("nth")).drop("n", "chunk", "base", "nth")


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, size: int = 2048, task_rows: int = 200_000) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens, in as few as best-fit finds.

    Only documents longer than ``size`` are cut; the first piece is the short one. Returns per piece: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset (gapless from 0). Null texts are empty documents, repeated rows are
    documents of their own, an empty table gives no rows, other columns are not read.
    The plan is made from at most ``size`` counts; no task or driver sees the documents of more than a chunk.
    """
    spark: SparkSession = docs.sparkSession
    cut = written(pieces(docs, vocabulary, end_id, size), "pieces")
    counts = written(cut.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    runs = plan({r["length"]: r["n"] for r in counts.collect()}, size)
    slots = spark.createDataFrame(runs, SLOT)
    if len(runs) <= 200_000:
        slots = F.broadcast(slots)
    placed = ranked(cut, counts, task_rows).join(slots, "length").filter("rank >= rank_from and rank < rank_to")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.expr("first_sequence + (rank - rank_from) div each").alias("sequence_id"),
        F.expr("first_offset + (rank - rank_from) % each * length").alias("offset"),
    )
