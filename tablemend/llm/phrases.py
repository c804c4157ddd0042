"""Collocations: phrases that occur more often than their parts suggest, counted on a prefix-free parse.

A text's words are cut where a hash of four words in a row, the trigger, says so. A chunk runs from one trigger to the end
of the next, so neighbours overlap by four words, and equal passages are cut alike wherever they stand. The distinct
chunks of a language and how often each was parsed are the dictionary. Everything is counted on its chunks, weighted: a
phrase belongs to the chunk in which it starts before the last trigger, so an overlap counts once, and as phrases have at
most five words, none is cut.

Phrases are counted one length after the other by a 64-bit hash of language and words, only such whose two shorter parts
are frequent. Each count carries one chunk that holds the phrase, from which the words of the frequent ones are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sieve import bitmap, marked, sieve
from .store import written
from .words import LOWER, MIX_2, Words, mix, slices, spread
from .worker import frugal

#: Bytes that end a piece, and bytes of words: all but these, blank and tab.
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(10, 14)]] = True
INSIDE = ~BREAKS
INSIDE[[9, 32]] = False
#: One in so many places is a trigger.
EVERY = 64
#: Bytes of texts and chunks that a task counts at a time.
AT_ONCE = 1 << 22


@frugal()
def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(lang, chunk, tail, n): chunks as lower-cased bytes, the words at the end that the next chunk holds as well, and their number here."""
    for batch in batches:
        for part in slices(batch, "text", AT_ONCE):
            words = Words(part.column("text"), INSIDE)
            n, tail = len(words.hash), most - 1
            doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
            cut = np.zeros(n, bool)
            if tail and n > tail:
                trigger = mix(spread(words.hash, tail)) % np.uint64(EVERY) == 0
                cut[: len(trigger)] = trigger & (doc[: len(trigger)] == doc[tail - 1 :][: len(trigger)])
            first = words.first[:-1]
            cut[first[first < words.first[1:]]] = True
            head = np.flatnonzero(cut)
            own = np.append(head[1:], n)[: len(head)]
            more = np.append(doc[head[1:]] == doc[head[:-1]], False)[: len(head)] if len(head) else np.zeros(0, bool)
            last = own + np.where(more, tail, 0) - 1
            raw = LOWER[words.data].tobytes()
            held: dict[tuple, int] = {}
            langs = part.column("lang").to_pylist()
            spans = zip(doc[head].tolist(), words.start[head].tolist(), words.end[last].tolist(), more.tolist(), strict=True)
            for d, a, b, overlaps in spans:
                one = (langs[d], raw[a:b], tail if overlaps else 0)
                held[one] = held.get(one, 0) + 1
            columns = zip(*held, strict=True) if held else ((), (), ())
            kinds = (pa.string(), pa.binary(), pa.int32())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(held.values(), pa.int64())], ["lang", "chunk", "tail", "n"])


class Places:
    """Where the phrases of a batch of chunks start, and the hash of each, its language's included."""

    def __init__(self, part: pa.RecordBatch):
        self.words = words = Words(part.column("chunk"), INSIDE)
        count = np.diff(words.first)
        self.row = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(self.row)) - words.first[:-1][self.row]
        tails = part.column("tail").to_numpy()
        self.own = nth < (count - tails)[self.row]
        self.weight = part.column("n").to_numpy()[self.row]
        self.langs = part.column("lang").to_pylist()
        seeds = {x: xxhash.xxh3_64_intdigest(x) for x in set(self.langs)}
        self.seed = np.array([seeds[x] for x in self.langs], np.uint64)[self.row]
        breaks = np.cumsum(BREAKS[words.data], dtype=np.int64) if len(words.data) else np.zeros(0, np.int64)
        self.piece = breaks[words.start] if len(words.start) else np.zeros(0, np.int64)

    def phrases(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``length`` words, and which are phrases: in one piece of one chunk."""
        runs = max(0, len(self.row) - length + 1)
        end = slice(length - 1, None)
        ok = (self.row[:runs] == self.row[end][:runs]) & (self.piece[:runs] == self.piece[end][:runs])
        return mix(spread(self.words.hash, length) ^ self.seed[:runs] * MIX_2 + np.uint64(length)), ok


def _total(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order[begins], np.add.reduceat(weight[order], begins) if len(keys) else weight[:0]


@frugal()
def _count(batches: Iterator[pa.RecordBatch], length: int, shorter: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """(key, n, id) of the phrases of a length that may be frequent by those one word shorter."""
    for batch in batches:
        for part in slices(batch, "chunk", AT_ONCE):
            places = Places(part)
            keys, ok = places.phrases(length)
            if shorter is not None:
                halves = places.phrases(length - 1)[0].view(np.int64)
                known = np.zeros(len(halves), bool)
                known[:] = marked(shorter, halves)
                ok &= known[: len(ok)] & known[1:][: len(ok)]
            at = np.flatnonzero(ok & places.own[: len(ok)])
            keys = keys[at].view(np.int64)
            first, n = _total(keys, places.weight[at])
            ids = part.column("id").to_numpy()[places.row[at[first]]]
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys[first]), "n": pa.array(n), "id": pa.array(ids)})


@frugal()
def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, size, phrase, a): the words of the phrases listed (key, size, n) beside the chunks that hold them."""
    for batch in batches:
        for part in slices(batch, "chunk", AT_ONCE):
            places, out = Places(part), []
            lists = part.column("wanted")
            row = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
            key, size, n = (lists.flatten().field(k).to_numpy() for k in range(3))
            for length in np.unique(size).tolist():
                mine = np.flatnonzero(size == length)
                hashes, ok = places.phrases(length)
                at = np.flatnonzero(ok & places.own[: len(ok)])
                at = at[np.isin(hashes[at].view(np.int64), key[mine])]
                found = dict(zip(zip(places.row[at].tolist(), hashes[at].view(np.int64).tolist(), strict=True), at.tolist(), strict=True))
                for r, k, a in zip(row[mine].tolist(), key[mine].tolist(), n[mine].tolist(), strict=True):
                    place = found[r, k]
                    out.append((places.langs[r], length, places.words.text(place, place + length).decode(), a))
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "size", "phrase", "a"])


def dictionary(docs: DataFrame, most: int = 5) -> DataFrame:
    """(lang, chunk, tail, n): the distinct chunks of ``docs`` (text, lang) by language and how often each was parsed."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    rows = rows.filter("length(text) > 0")
    made = rows.mapInArrow(partial(_chunks, most=most), "lang string, chunk binary, tail int, n bigint")
    return made.groupBy("lang", "chunk", "tail").agg(F.sum("n").alias("n"))


def frequent(chunks: DataFrame, least: int, most: int) -> DataFrame:
    """(lang, size, phrase, a): the phrases of 1 to ``most`` words with at least ``least`` occurrences in a language.

    ``chunks``: the dictionary with an ``id`` of each chunk.
    """
    shared: Broadcast | None = None
    counted = []
    for length in range(1, most + 1):
        made = chunks.mapInArrow(partial(_count, length=length, shorter=shared), "key bigint, n bigint, id bigint")
        keys = made.groupBy("key").agg(F.sum("n").alias("n"), F.min("id").alias("id")).filter(F.col("n") >= least)
        keys = written(keys.withColumn("size", F.lit(length)), "phrases")
        counted.append(keys)
        shared = bitmap(keys.select("key"))
    wanted = reduce(DataFrame.unionByName, counted).groupBy("id").agg(F.collect_list(F.struct("key", "size", "n")).alias("wanted"))
    # a row a chunk that was named, the others need not move
    holding = chunks.filter(sieve(wanted, "id")(F.col("id"))).withColumn("n", F.lit(1).cast("long"))
    return holding.join(wanted, "id").mapInArrow(_named, "lang string, size int, phrase string, a bigint")


def collocations(docs: DataFrame, least: int = 100, most: int = 5, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of 2 to ``most`` words of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs``: text, lang; other columns are not read. Texts are lower-cased (A to Z), split at ``.,;:!?`` and 10 to 13 into
    pieces and at blanks and tabs into words. a counts a phrase's occurrences within pieces, overlapping ones too, n all
    words of the language, l and r the parts before and after a cut; the score floor(1000 a n / (l r)) is that of the
    lowest cut, ties to the shortest first part. Phrases take part from ``least`` occurrences; one that lies inside a longer
    one with as many occurrences is dropped. Ties of the score go to the greater a, then to the phrase in byte order. A
    null text is empty, a null language is ``und``; repeated rows count each. No text gives no rows.
    """
    # the ids are written with the chunks, so every later pass sees the same
    chunks = written(dictionary(docs, most).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    known = written(frequent(chunks, least, most), "phrases")
    counted = known.select("lang", "phrase", "a")
    longer = known.filter("size > 1")
    # a row a language
    totals = chunks.mapInArrow(_words, "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("n"))
    cuts = longer.withColumn("words", F.split("phrase", " ")).withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    part = "array_join(slice(words, {}), ' ')"
    cuts = cuts.select("lang", "phrase", "size", "a", "k", F.expr(part.format("1, k")).alias("left"), F.expr(part.format("k + 1, size - k")).alias("right"))
    cuts = cuts.join(counted.toDF("lang", "left", "l"), ["lang", "left"]).join(counted.toDF("lang", "right", "r"), ["lang", "right"])
    cuts = cuts.join(totals, "lang")
    exact = "cast(cast({} as decimal(18, 0)) * cast({} as decimal(18, 0)) as decimal(37, 0))"
    score = F.expr(f"{exact.format('a * 1000', 'n')} div {exact.format('l', 'r')}").alias("score")
    scored = cuts.select("lang", "phrase", "size", "a", "n", "k", "l", "r", score)
    scored = scored.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    inner = longer.filter("size > 2").withColumn("words", F.split("phrase", " "))
    inner = inner.select("lang", "a", F.explode(F.expr(f"flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> {part.format('i, m')})))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter("within is null or within < a")
    order = Window.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), "phrase")
    kept = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return kept.select("lang", "rank", "phrase", "a", "s.l", "s.r", "n", "s.score")


@frugal()
def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n): words of each chunk, those of its overlap left out, by how often it was parsed."""
    for batch in batches:
        for part in slices(batch, "chunk", AT_ONCE):
            words = Words(part.column("chunk"), INSIDE)
            n = (np.diff(words.first) - part.column("tail").to_numpy()) * part.column("n").to_numpy()
            yield pa.RecordBatch.from_pydict({"lang": part.column("lang"), "n": pa.array(n)})
