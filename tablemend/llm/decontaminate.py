"""Benchmark decontamination: Wu-Manber search for many test strings at once, over words.

A window of m words is a string whose letters are words. The shift table holds, for each block of two words, how far
the search may move: m - 1 for a block in no window, less for one inside windows, 0 for one that ends windows. Where it
is 0, the block's hash selects the windows to test, and their words are compared one by one. Windows shorter than the
usual length (of short items) are searched with tables of their own.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh, written
from .words import ALNUM, Words, mix, slices
from .worker import frugal

TABLE = 1 << 20
LANE = 512


class Windows:
    """The search tables of the windows of one length."""

    def __init__(self, width: int, found: dict[bytes, tuple[np.ndarray, set[str]]]) -> None:
        self.width, self.block = width, min(2, width)
        self.words = np.array([h for h, _ in found.values()], np.uint64).reshape(len(found), width)
        self.texts = list(found)
        self.items = [sorted(x) for _, x in found.values()]
        self.shift = np.full(TABLE, width - self.block + 1, np.uint8 if width < 256 else np.uint32)
        for at in range(width - self.block + 1):
            key = self.key(self.words[:, at : at + self.block].T)
            np.minimum.at(self.shift, key & np.uint64(TABLE - 1), width - self.block - at)
        suffix = self.key(self.words[:, width - self.block :].T)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    @staticmethod
    def key(words: np.ndarray) -> np.ndarray:
        return mix(words[0]) if len(words) == 1 else mix(words[0] * np.uint64(3) + words[1])

    def search(self, words: Words) -> Iterator[tuple[int, int]]:
        """(first word, window) of every occurrence."""
        m, h = self.width, words.hash
        low = words.first[:-1] + m - 1
        lanes = np.maximum(0, -(-(words.first[1:] - low) // LANE))
        begin = np.repeat(low, lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(begin + LANE, np.repeat(words.first[1:], lanes))
        at, ends = begin, []
        while len(at):
            key = self.key(h[at - (self.block - 1) + np.arange(self.block)[:, None]])
            move = self.shift[key & np.uint64(TABLE - 1)]
            ends.append(at[move == 0])
            at = at + np.maximum(move, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        if not len(ends):
            return
        key = self.key(h[ends - (self.block - 1) + np.arange(self.block)[:, None]])
        a, b = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        which = np.repeat(np.arange(len(ends)), b - a)
        slot = self.order[np.repeat(a, b - a) + np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)]
        first = ends[which] - m + 1
        same = np.ones(len(which), bool)
        for k in range(m):
            same &= h[first + k] == self.words[slot, k]
        for f, s in zip(first[same].tolist(), slot[same].tolist(), strict=True):
            if words.text(f, f + m) == self.texts[s]:
                yield f, s


def tables(items: list[tuple[str | None, str]], width: int) -> list[Windows]:
    """Search tables of the windows of ``width`` words of all items; a shorter item is one window."""
    words = Words(pa.array([t for _, t in items], pa.string()), ALNUM)
    found: dict[int, dict[bytes, tuple[np.ndarray, set[str]]]] = defaultdict(dict)
    for (name, _), a, b in zip(items, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        m = min(width, b - a)
        for f in range(a, b - m + 1) if m else ():
            found[m].setdefault(words.text(f, f + m), (words.hash[f : f + m], set()))[1].update([name] if name is not None else [])
    return [Windows(m, x) for m, x in sorted(found.items())]


def _build(table: pa.Table, width: int) -> pa.Table:
    """The pickled search tables of one block of items."""
    items = list(zip(table.column("item").to_pylist(), table.column("text").to_pylist(), strict=True))
    return pa.table({"block": table.column("block")[:1], "tables": pa.array([pickle.dumps(tables(items, width))], pa.binary())})


def item_blocks(items: DataFrame, width: int, limit: int) -> DataFrame:
    """(block, tables): the items dealt into blocks of about ``limit`` characters, each block's tables built in a task of its own."""
    rows = items.selectExpr("cast(item_id as string) item", "cast(text as string) text").filter("length(text) > 0").distinct()
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(1, -(-size // limit))).cast("long")))
    return written(dealt.groupBy("block").applyInArrow(lambda table: _build(table, width), "block bigint, tables binary"), "item-tables")


@frugal()
def _search(batches: Iterator[pa.RecordBatch], shared: Broadcast | None, text: int) -> Iterator[pa.RecordBatch]:
    """Rows of any columns, that at ``text`` the texts, then the marks, items, words and hits so far."""
    windows = pickle.loads(shared.value) if shared is not None else []
    for batch in batches:
        for part in slices(batch, batch.schema.names[text]):
            words = Words(part.column(text), ALNUM)
            n = len(words.hash)
            marks, names = part.columns[-4:-2]
            edges, items = np.zeros(n + 1, np.int32), [set(x or ()) for x in names.to_pylist()]
            for w in windows:
                hits = list(w.search(words))
                if hits:
                    first = np.array([f for f, _ in hits])
                    np.add.at(edges, first, 1)
                    np.add.at(edges, first + w.width, -1)
                    owner = np.searchsorted(words.first, first, "right") - 1
                    for doc, slot in {*zip(owner.tolist(), (s for _, s in hits), strict=True)}:
                        items[doc].update(w.items[slot])
            marked = np.cumsum(edges)[:n] > 0
            span = list(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True))
            for k, ((a, b), old) in enumerate(zip(span, marks.to_pylist(), strict=True)):
                if old is not None:
                    marked[a:b] |= np.unpackbits(np.frombuffer(old, np.uint8), count=b - a) == 1
            made = [
                pa.array([np.packbits(marked[a:b]).tobytes() if marked[a:b].any() else None for a, b in span], pa.binary()),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                pa.array([b - a for a, b in span], pa.int64()),
                pa.array([int(marked[a:b].sum()) for a, b in span], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*part.columns[:-4], *made], part.schema.names)


def searched(docs: DataFrame, items: DataFrame, width: int, block_chars: int) -> tuple[DataFrame, list[str]]:
    """``docs`` (text and any other columns) with four more columns, whose names are returned: the bits of hit words, the
    items whose windows occur, the numbers of words and of hit ones.

    One block's tables are broadcast at a time, and what was found so far is written before the next one, so neither the
    driver nor a task holds more of a large benchmark.
    """
    names = [fresh(docs, name) for name in ("marks", "items", "n_words", "n_hit")]
    kinds = ("binary", "array<string>", "bigint", "bigint")
    state = docs.withColumn("text", F.col("text").cast("string"))
    state = state.select("*", *(F.lit(None).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)))
    spark, blocks = docs.sparkSession, item_blocks(items, width, block_chars)
    numbers = sorted(r["block"] for r in blocks.select("block").collect())
    for k, number in enumerate(numbers or [None]):
        tables_ = None if number is None else spark.sparkContext.broadcast(bytes(blocks.filter(F.col("block") == number).first()["tables"]))
        state = state.mapInArrow(partial(_search, shared=tables_, text=docs.columns.index("text")), state.schema)
        if k < len(numbers) - 1:
            state = written(state, "searched")
            tables_.destroy()
    return state, names


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, block_chars: int = 4_000_000) -> DataFrame:
    """Per document: n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256, contaminated.

    A window is ``width`` consecutive words of an item (item_id, text); an item of fewer words is one window. Null texts
    and texts without words have no words and no hits; items without words have no windows; items that repeat an id
    count once; an item without id hits words, but is neither counted nor named; repeated documents give a row each;
    without items nothing is hit. Other columns are not read. Items are searched in blocks of about ``block_chars``
    characters, see ``searched``.
    """
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    state, (_, names, words, hits) = searched(rows, items, width, block_chars)
    joined = F.array_join(names, ",")
    return state.select(
        "doc_id",
        F.col(words).alias("n_words"),
        F.col(hits).alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(joined.cast("binary"), 256).alias("items_sha256"),
        (F.col(hits) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, width: int = 10, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) without a hit word, see ``contamination``; each row on its own."""
    state, names = searched(docs, items, width, block_chars)
    return state.filter(F.col(names[3]) == 0).select(*docs.columns)
