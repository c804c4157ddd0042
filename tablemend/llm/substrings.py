"""Repeated passages by prefix-partitioned suffix trees over words.

A suffix starts at each word. Its prefix is as long as its content says: the words up to the end of the least 8-word run
(by hash) that its first 20 words hold. Equal windows of 20 words have equal prefixes, so every inner node of 20 words
and deeper lies under one prefix. Prefixes that occur once have no such node and are left out; the suffixes of the others
are dealt by prefix, those of very frequent prefixes in parts whose size fits in memory. A task sorts the suffixes of its
prefixes, takes the common lengths of neighbours, and the runs in which these reach 20 words are its subtree's deep inner
nodes. All occurrences of a node but its first are covered by a repeat; longer repeats are the union of such windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sieve import bitmap, marked, sieve
from .store import written
from .words import SAME, SPACED, Words, mix, slices, spread
from .worker import frugal

#: Words of a prefix's last run and of a symbol, by which suffixes are compared.
GRAM, SYMBOL = 8, 5
#: Suffix starts of one record: a passage that repeats a few words for long is cut into such records.
STARTS = 64
RECORD = "key bigint, parts boolean, doc_id bigint, start int, text binary"
FOUND = "doc_id bigint, start int, mark int, a bigint, b bigint"
KEPT = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<first: bigint, last: bigint>>, kept string"


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(out) - (width - done)], out[width - done :]) if done < width else out


class Prefixes:
    """Of the words of some texts: which windows lie in one text (``whole``), and the hash that ends each one's prefix (``end``).

    ``every`` holds the hashes of all places where a prefix ends.
    """

    def __init__(self, words: Words, window: int):
        gram = min(GRAM, window)
        n, width = len(words.hash), window - gram + 1
        self.doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        if n < window:
            self.whole, self.end, self.every = np.zeros(0, bool), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            return
        runs = spread(words.hash, gram) | np.uint64(1)
        self.end = least(runs, width)
        self.whole = self.doc[: len(self.end)] == self.doc[window - 1 :]
        padded = np.pad(np.where(self.whole, self.end, np.uint64(0)), width - 1)
        # the greatest of the ends of the windows around a run equals the run's hash where it ends a prefix
        self.every = runs[~least(~padded, width) == runs]


@frugal()
def _ends(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 22):
            ends, n = np.unique(Prefixes(Words(part.column("text"), SPACED, SAME), window).every, return_counts=True)
            yield pa.RecordBatch.from_pydict({"prefix": pa.array(ends.view(np.int64)), "n": pa.array(n.astype(np.int64))})


@frugal()
def _records(batches: Iterator[pa.RecordBatch], window: int, shared: Broadcast, large: Broadcast) -> Iterator[pa.RecordBatch]:
    """Runs of suffixes with one prefix end, with all the words of their windows."""
    hot, pieces = (np.frombuffer(x, np.int64) for x in large.value)
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"), SPACED, SAME)
            found = Prefixes(words, window)
            at = np.flatnonzero(found.whole)
            end = found.end[at].view(np.int64)
            keep = marked(shared, end)
            at, end = at[keep], end[keep]
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) != 1) | (end[1:] != end[:-1])
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            new |= nth % STARTS == 0
            head = np.flatnonzero(new)
            last = np.append(head[1:], len(at)) - 1
            first_word, last_word = at[head], at[last] + window - 1
            doc = found.doc[first_word]
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[doc].astype(np.int64)
            key = end[head]
            place = np.minimum(np.searchsorted(hot, key), max(0, len(hot) - 1))
            split = hot[place] == key if len(hot) else np.zeros(len(key), bool)
            if split.any():
                deal = mix(ids[split].view(np.uint64)) % pieces[place[split]].astype(np.uint64)
                key = key.copy()
                key[split] = mix(key[split].view(np.uint64) + deal).view(np.int64)
            raw, a, b = words.data, words.start[first_word], words.end[last_word]
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array(key),
                    "parts": pa.array(split),
                    "doc_id": pa.array(ids),
                    "start": pa.array((first_word - words.first[doc]).astype(np.int32)),
                    "text": pa.array([raw[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()),
                }
            )


def symbols(words: Words, at: np.ndarray, window: int) -> np.ndarray:
    """The symbols of the window at each place, first ones first; the last may overlap the one before."""
    width = min(SYMBOL, window)
    runs = spread(words.hash, width)
    return np.array([runs[at + k] for k in (*range(0, window - width, width), window - width)])


def marks(symbol: np.ndarray) -> np.ndarray:
    """A hash of each window."""
    total = np.zeros(symbol.shape[1], np.uint64)
    for row in symbol:
        total = mix(total + row)
    return total


def deep_nodes(symbol: np.ndarray, key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in lexicographic order below their prefixes, and which are first in a node of a whole window.

    Neighbours under one prefix that share all symbols are in one node, its first occurrence (doc, start) in front; rows
    that repeat a doc may share that place.
    """
    order = np.lexsort((start, doc, *symbol[::-1], key))
    held = symbol[:, order]
    begins = np.ones(len(order), bool)
    begins[1:] = (key[order][1:] != key[order][:-1]) | (held[:, 1:] != held[:, :-1]).any(axis=0)
    head = order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
    return order, (doc[order] == doc[head]) & (start[order] == start[head])


def _subtrees(table: pa.Table, window: int) -> pa.RecordBatch:
    table = table.combine_chunks()
    words = Words(table.column("text").combine_chunks() if table.column("text").num_chunks != 1 else table.column("text").chunk(0), SPACED, SAME)
    count = np.diff(words.first) - window + 1
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    symbol = symbols(words, words.first[:-1][row] + nth, window)
    key, doc, at_word = (table.column(c).to_numpy() for c in ("key", "doc_id", "start"))
    start = at_word[row] + nth.astype(np.int32)
    order, first = deep_nodes(symbol, key[row], doc[row], start)
    parts = table.column("parts").to_numpy()[row][order]
    # of a prefix dealt in parts, each part's first occurrences meet those of the others
    out = np.flatnonzero(~first | parts)
    at, meets = order[out], (first & parts)[out]
    mark = marks(symbol[:, at])
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(doc[row][at]),
            "start": pa.array(start[at]),
            "mark": pa.array((mark >> np.uint64(32)).astype(np.uint32).view(np.int32)),
            "a": pa.array(mark.view(np.int64), mask=~meets),
            "b": pa.array(marks(symbol[::-1, at]).view(np.int64), mask=~meets),
        }
    )


@frugal()
def _grown(batches: Iterator[pa.RecordBatch], window: int, most: int = 16_384) -> Iterator[pa.RecordBatch]:
    """Subtrees of the records (sorted by key), whole prefixes at a time."""
    held, rows = [], 0
    for batch in batches:
        for part in slices(batch, "text", 1 << 21):
            key = part.column("key").to_numpy()
            if rows >= most:
                last = held[-1].column("key")[-1].as_py()
                cut = int(np.searchsorted(key != last, True)) if key[0] == last else 0
                if cut < len(key):
                    yield _subtrees(pa.Table.from_batches([*held, part.slice(0, cut)]), window)
                    held, rows, part = [], 0, part.slice(cut)
            held.append(part)
            rows += len(part)
    if held:
        yield _subtrees(pa.Table.from_batches(held), window)


@frugal()
def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Each text without the words of its repeats (start, mark): a mark of another text of the same doc_id is none of its own."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"), SPACED, SAME)
            rows = {"n_words": [], "n_removed": [], "spans": [], "kept": []}
            lists = part.column("repeats")
            ends, held = np.asarray(lists.offsets), lists.values
            where, hashes = (held.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            empty = lists.is_null().to_numpy(zero_copy_only=False)
            for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                gone = np.zeros(b - a, bool)
                if not empty[k] and b - a >= window:
                    start, mark = where[ends[k] : ends[k + 1]], hashes[ends[k] : ends[k + 1]]
                    ok = start <= b - a - window
                    start, mark = start[ok].astype(np.int64), mark[ok]
                    own = (marks(symbols(words, a + start, window)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    step = np.zeros(b - a + 1, np.int64)
                    start = start[own == mark]
                    np.add.at(step, start, 1)
                    np.add.at(step, start + window, -1)
                    gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                left = np.flatnonzero(~gone) + a
                rows["n_words"].append(b - a)
                rows["n_removed"].append(int(gone.sum()))
                rows["spans"].append([{"first": x, "last": y - 1} for x, y in edge.reshape(-1, 2).tolist()])
                rows["kept"].append(b" ".join(words.raw[s:e] for s, e in zip(words.start[left].tolist(), words.end[left].tolist(), strict=True)).decode())
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.string())
            columns = [pa.array(c, t) for c, t in zip(rows.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *rows])


def repeats(docs: DataFrame, window: int = 20, most: int = 50_000) -> DataFrame:
    """(doc_id, start, mark) of each window of ``docs`` (doc_id, text) whose words also start earlier; mark is a hash of them.

    A prefix with more than ``most`` occurrences is dealt in parts by document, whose first occurrences are then compared.
    """
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").filter("doc_id is not null")
    ends = rows.select("text").mapInArrow(partial(_ends, window=window), "prefix bigint, n bigint")
    ends = written(ends.groupBy("prefix").agg(F.sum("n").alias("n")).filter("n > 1"), "prefixes")
    count, total = ends.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(28, max(26, (8 * count).bit_length()))  # at most 32 MB; a fuller map only passes more suffixes
    shared = bitmap(ends.select("prefix"), bits)
    # at most a million prefixes, 16 bytes each
    hot = ends.filter(F.col("n") > max(most, total // 1_000_000)).toPandas().sort_values("prefix")
    pieces = -(-hot["n"].to_numpy(np.int64) // most)
    large = docs.sparkSession.sparkContext.broadcast((hot["prefix"].to_numpy(np.int64).tobytes(), pieces.tobytes()))
    records = rows.mapInArrow(partial(_records, window=window, shared=shared, large=large), RECORD)
    dealt = records.repartition("key").sortWithinPartitions("key")
    found = written(dealt.mapInArrow(partial(_grown, window=window), FOUND), "repeats")
    whole = found.filter("a is null").select("doc_id", "start", "mark")
    if hot.empty:
        return whole
    meets = found.filter("a is not null")
    first = meets.groupBy("a", "b").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    later = meets.join(first, ["a", "b"]).filter(F.struct("doc_id", "start") != F.col("first"))
    return whole.union(later.select("doc_id", "start", "mark"))


def drop_repeats(docs: DataFrame, window: int = 20, most: int = 50_000) -> DataFrame:
    """``docs`` (doc_id, text) without words in a window of ``window`` words that also starts earlier.

    Per row: doc_id, n_words, n_removed, spans (first and last word of each passage removed, from 0), kept (the words that
    stay, joined by one blank). Words are runs without white space (blank, 9 to 13), unchanged. Earlier is a smaller
    doc_id, or an earlier start under the same doc_id; rows that repeat a doc_id are judged by these two as well, so equal
    rows stay or go alike. Windows are judged on the input. A null or empty text has no words; a row without doc_id keeps
    its words and repeats nothing. An empty table gives none. Other columns are not read.
    """
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    found = repeats(docs, window, most).groupBy("doc_id").agg(F.collect_set(F.struct("start", "mark")).alias("repeats"))
    found = written(found, "repeat-lists")
    maybe = rows.withColumn("maybe", F.coalesce(sieve(found.select("doc_id"), "doc_id")(F.col("doc_id")), F.lit(False)))
    none = F.lit(None).cast("array<struct<start: int, mark: int>>").alias("repeats")
    same = maybe.filter("not maybe").select("doc_id", "text", none)
    hit = maybe.filter("maybe").select("doc_id", "text").join(found.hint("merge"), "doc_id", "left")
    return same.unionByName(hit).mapInArrow(partial(_cut, window=window), KEPT)
