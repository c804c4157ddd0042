"""Token-id files of directly addressable codes.

A file is a Parquet folder of segments. A segment holds whole documents; its ids are split into 8-bit chunks. Level k
holds chunk k of every id that reaches it, a bitmap telling which of them continue on level k + 1, and a rank directory
with the set bits before every 512th. The id at a position is found by one chunk read a level: the rank of its bit is
its place one level up, so no block is decoded. Segments are stored uncompressed for that reason.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import default_vocabulary, encoder
from .worker import frugal

BLOCK = 512
LEVEL = pa.struct([("chunks", pa.binary()), ("bitmap", pa.binary()), ("ranks", pa.binary())])
SEGMENT = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int32()),
        ("first", pa.int64()),
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("levels", pa.list_(LEVEL)),
    ]
)
SEGMENT_SQL = (
    "part int, segment int, first bigint, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, "
    "levels array<struct<chunks: binary, bitmap: binary, ranks: binary>>"
)
POPCOUNT = np.array([i.bit_count() for i in range(256)], np.uint8)


def split_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Chunks, continuation bitmap and rank directory of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        ones = POPCOUNT[np.pad(bitmap, (0, -len(bitmap) % (BLOCK // 8)))].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")
        levels.append({"chunks": rest.astype(np.uint8).tobytes(), "bitmap": bitmap.tobytes(), "ranks": ranks.tobytes()})
        rest = rest[more] >> 8
        if not len(rest):
            return levels


def join_levels(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids of a segment."""
    ids, at = None, None
    for k, level in enumerate(levels):
        chunk = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32) << (8 * k)
        if ids is None:
            ids, at = chunk, np.arange(len(chunk))
        else:
            ids[at] |= chunk
        more = np.unpackbits(np.frombuffer(level["bitmap"], np.uint8), count=len(at), bitorder="little")
        at = at[more == 1]
    return ids


def ids_at(levels: list[dict[str, bytes]], positions: np.ndarray) -> np.ndarray:
    """The ids at positions of a segment, by chunk reads and ranks only."""
    ids, who, at = np.zeros(len(positions), np.uint32), np.arange(len(positions)), positions.astype(np.int64)
    for k, level in enumerate(levels):
        chunks, bitmap = np.frombuffer(level["chunks"], np.uint8), np.frombuffer(level["bitmap"], np.uint8)
        ids[who] |= chunks[at].astype(np.uint32) << (8 * k)
        more = (bitmap[at >> 3] >> (at & 7)) & 1 == 1
        who, at = who[more], at[more]
        if not len(at):
            break
        block = at // BLOCK
        near = block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)
        byte = bitmap[np.minimum(near, len(bitmap) - 1)]
        keep = np.where(near < (at >> 3)[:, None], 0xFF, np.where(near == (at >> 3)[:, None], (1 << (at & 7))[:, None] - 1, 0))
        at = np.frombuffer(level["ranks"], "<u4")[block].astype(np.int64) + POPCOUNT[byte & keep.astype(np.uint8)].sum(1, dtype=np.int64)
    return ids


@frugal("encoder")
def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
    part, segment, first = TaskContext.get().partitionId(), 0, 0
    doc_ids, raws, held = [], [], 0

    def close() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(raws), "<u4")
        row = {"part": part, "segment": segment, "first": first, "n_tokens": len(ids), "doc_ids": doc_ids}
        return pa.RecordBatch.from_pylist([row | {"lengths": [len(r) // 4 for r in raws], "levels": split_levels(ids)}], SEGMENT)

    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        for at in range(0, len(batch), 256):
            for key, raw in zip(keys[at : at + 256].to_pylist(), encode(texts[at : at + 256].to_pylist()), strict=True):
                doc_ids.append(key)
                raws.append(raw + end)
                held += len(raw) // 4 + 1
                if held >= size:
                    yield close()
                    segment, first, doc_ids, raws, held = segment + 1, first + held, [], [], 0
    if doc_ids:
        yield close()


def write_token_file(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, segment_tokens: int = 1 << 20) -> None:
    """Write the ids of every whole text of ``docs`` (doc_id, text) to ``path``, in ascending doc_id order.

    A null text is empty, a null doc_id comes first, rows that repeat a doc_id follow each other; each document ends
    with ``end_id``. An empty table gives a file without segments. Other columns are not read.
    ``directory`` beside the segments holds the ids before each write task, so no task has to know the others.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # the text's hash spreads a doc_id that very many rows carry
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    made = rows.mapInArrow(partial(_segments, path=vocabulary or default_vocabulary(), end_id=end_id, size=segment_tokens), SEGMENT_SQL)
    (
        made.write.option("compression", "uncompressed")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.block.size", str(16 << 20))
        .parquet(f"{path}/segments")
    )
    totals = spark.read.schema(SEGMENT_SQL).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row a write task: the only global order is over these
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("part", before.alias("base")).write.parquet(f"{path}/directory")


def _located(spark: SparkSession, path: str) -> DataFrame:
    directory = spark.read.schema("part int, base bigint").parquet(f"{path}/directory")
    segments = spark.read.schema(SEGMENT_SQL).parquet(f"{path}/segments")
    # the directory has 12 bytes a write task, so it is small however large the file
    return segments.join(F.broadcast(directory), "part").withColumn("first", F.expr("base + first")).drop("base")


@frugal()
def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            one = {name: batch.column(name)[row].as_py() for name in ("first", "doc_ids", "lengths", "levels")}
            raw = join_levels(one["levels"]).astype("<u4").tobytes()
            ends = np.cumsum(one["lengths"])
            starts = ends - one["lengths"]
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(one["doc_ids"], pa.int64()),
                    "start": pa.array(starts + one["first"], pa.int64()),
                    "n_tokens": pa.array(one["lengths"], pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a token file: doc_id, start (ids before it), n_tokens, ids_crc32."""
    return _located(spark, path).mapInArrow(_documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


@frugal()
def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            positions = np.array(batch.column("positions")[row].as_py(), np.int64)
            found = ids_at(batch.column("levels")[row].as_py(), positions - batch.column("first")[row].as_py())
            yield pa.RecordBatch.from_pydict({"position": pa.array(positions), "token_id": pa.array(found.astype(np.int64))})


def read_tokens(positions: DataFrame, path: str) -> DataFrame:
    """Random access: the id at each ``position`` of ``positions`` (position, token_id); places outside the file are left out.

    Positions meet their segments by the segment's range; a segment's ids are addressed by rank, not decoded. Repeated
    positions give one row. A segment gets at most as many positions as it has ids.
    """
    spark = positions.sparkSession
    places = _located(spark, path).select("part", "segment", "first", "n_tokens")
    wanted = positions.select(F.col("position").cast("long").alias("position")).distinct()
    grid = 1 << 16  # segments are listed under each stretch of positions they touch, which makes the range join an equi-join
    cells = places.filter("n_tokens > 0").withColumn("cell", F.explode(F.expr(f"sequence(first div {grid}, (first + n_tokens - 1) div {grid})")))
    hits = wanted.withColumn("cell", F.expr(f"position div {grid}")).join(cells, "cell")
    hits = hits.filter("position >= first and position < first + n_tokens")
    groups = hits.groupBy("part", "segment").agg(F.collect_list("position").alias("positions"))
    levels = _located(spark, path).select("part", "segment", "first", "levels")
    return groups.join(levels, ["part", "segment"]).mapInArrow(_tokens, "position bigint, token_id bigint")
