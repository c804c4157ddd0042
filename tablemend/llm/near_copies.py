"""Near copies of texts by SuperMinHash signatures, bands, exact verification and union-find.

Each shingle of a document draws a random permutation of the signature's places step by step; step j offers j plus a
random fraction to the place drawn, and a place keeps its least offer. As a step's offers exceed all of the step before,
a document stops when its places hold no later offer. Places that share permutations vary less than independent hashes.

Documents with equal sets are one node. Nodes that agree on a band of four places meet in a bucket. Candidates are
verified on full sets: first each member against one leader of its bucket, twice, with other leaders the second time;
what that joins becomes one class. In buckets where several classes are left, every member outside the largest class is
verified against every member of another class, in blocks of bounded size. A link is thus only passed over if its ends
share no band (five in a million at the threshold) or are in one class already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .sieve import sieve
from .skew import attach
from .store import written
from .words import SPACED, Words, mix, slices, spread
from .worker import frugal, release

PLACES, ROWS, WIDTH = 128, 4, 5
BITS = 25
SKETCH = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"


def shingle_sets(words: Words, width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted hashes; a text of fewer words is one shingle."""
    runs = spread(words.hash, width)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        else:
            out.append(spread(words.hash[a:b], b - a) + np.uint64(b - a) if b > a else runs[:0])
    return out


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """A SuperMinHash signature a row; empty sets keep the largest value everywhere."""
    out = np.full((len(sets), places), 0xFFFFFFFF, np.uint32)
    cells, low = out.reshape(-1), np.uint64((1 << BITS) - 1)
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    drawn = None
    for step in range(places):
        if not len(items):
            break
        noise = mix(items + np.uint64(step * 0xD1342543DE82EF95 % (1 << 64)))
        pick = (step + (((noise >> np.uint64(32)) * np.uint64(places - step)) >> np.uint64(32))).astype(np.intp)
        if step:
            each = np.arange(len(items))
            place = drawn[each, pick]
            drawn[each, pick] = drawn[:, step]
        else:
            place = pick
        np.minimum.at(cells, owner * places + place, (np.uint64(step << BITS) | (noise & low)).astype(np.uint32))
        open_ = out.max(axis=1) >= (step + 1) << BITS
        stay = open_[owner]
        if step == 0:
            items, owner, pick = items[stay], owner[stay], pick[stay]
            drawn = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(items), 1))
            drawn[np.arange(len(items)), pick] = 0
        elif stay.sum() < 0.7 * len(stay):
            items, owner, drawn = items[stay], owner[stay], drawn[stay]
    return out


@frugal()
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(Words(part.column("text"), SPACED))
            marks = signatures(sets).reshape(len(sets), PLACES // ROWS, ROWS)
            bands = spread_rows(marks)
            full = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
                    "bands": pa.array([b if f else None for b, f in zip(bands.view(np.int64), full, strict=True)], pa.list_(pa.int64())),
                }
            )


def spread_rows(marks: np.ndarray) -> np.ndarray:
    """One hash a band, the band's number included."""
    total = np.arange(marks.shape[1], dtype=np.uint64) + np.zeros(marks.shape[:2], np.uint64)
    for k in range(marks.shape[2]):
        total = mix(total + marks[:, :, k].astype(np.uint64))
    return total


def _linked(one: int, other: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (one + other - common)


@frugal()
def _stars(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (leader, salt, doc_id, is_member, text), leaders before their members: the links of members to leaders."""
    group, heads = None, []
    for batch in batches:
        for part in slices(batch, "text"):
            u, v = [], []
            sets = shingle_sets(Words(part.column("text"), SPACED))
            for leader, salt, doc, member, mine in zip(*(part.column(c).to_pylist() for c in ("leader", "salt", "doc_id", "is_member")), sets, strict=True):
                if (leader, salt) != group:
                    group, heads = (leader, salt), []
                if not member:
                    heads.append(mine)
                elif any(_linked(len(h), len(mine), len(np.intersect1d(h, mine, True)), percent) for h in heads):
                    u.append(doc)
                    v.append(leader)
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _block(table: pa.Table, percent: int) -> pa.Table:
    """Links between the probes and the base rows of one block of a bucket, with other classes."""
    table = table.combine_chunks()
    text = table.column("text").combine_chunks()
    text = text if isinstance(text, pa.Array) else pa.array([], pa.string())
    sets = shingle_sets(Words(text, SPACED))
    probe = np.array(table.column("probe").to_pylist(), bool)
    base, probes = np.flatnonzero(~probe), np.flatnonzero(probe)
    doc, kind = (np.array(table.column(c).to_pylist(), np.int64) for c in ("doc_id", "component"))
    bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(table.num_rows, -1)
    key = table.column("key")[0].as_py()
    u, v = [], []
    if len(base) and len(probes):
        size = np.array([len(sets[b]) for b in base])
        items = np.concatenate([sets[b] for b in base])
        owner = np.repeat(np.arange(len(base)), size)
        order = np.argsort(items, kind="stable")
        items, owner = items[order], owner[order]
        for p in probes.tolist():
            a, b = np.searchsorted(items, sets[p], "left"), np.searchsorted(items, sets[p], "right")
            where = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
            common = np.bincount(owner[where], minlength=len(base))
            hit = _linked(len(sets[p]), size, common, percent) & (kind[base] != kind[p]) & (doc[base] != doc[p])
            for q in base[hit].tolist():
                same = bands[p] == bands[q]
                if bands[p][same.argmax()] == key:  # another shared band reports it otherwise
                    u.append(int(doc[p]))
                    v.append(int(doc[q]))
    release()
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _salts(pairs: DataFrame, key: list[str], sizes: str, rows: int, chars: int) -> DataFrame:
    """Into how many tasks each key is split."""
    parts = F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum(sizes) / chars))
    return pairs.groupBy(*key).agg(parts.cast("int").alias("salts"))


def near_copies(docs: DataFrame, percent: int = 75, task_rows: int = 512, task_chars: int = 16_000_000) -> DataFrame:
    """Near-copy classes of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * common shingles >= percent * all their shingles, on the sets of five lower-cased
    words between white space; a text of fewer words is one shingle. Null texts and texts without words have an empty
    set and are linked with nothing. component_id is the least doc_id reachable. Rows that repeat a doc_id are one node
    of the graph and give a row each; a row without doc_id is kept and has no component. Other columns are not read.
    """
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    sketch = written(rows.mapInArrow(_sketch, SKETCH), "sketches")
    sets = sketch.filter("digest is not null and doc_id is not null")
    nodes = sets.groupBy("digest").agg(F.min(F.struct("doc_id", "bands")).alias("s")).select("digest", "s.doc_id", "s.bands")
    nodes = written(nodes, "nodes")
    buckets = nodes.select("doc_id", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).filter("leader != last")
    members = written(buckets.join(shared.select("key", "leader"), "key").distinct(), "members")

    passes = sieve(members.select("doc_id").distinct(), "doc_id")
    texts = rows.filter(passes(F.col("doc_id"))).join(members.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    texts = written(texts.withColumn("n_chars", F.length("text").cast("long")), "candidates")
    sizes = texts.groupBy("doc_id").agg(F.sum("n_chars").alias("n_chars"))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sizes, "doc_id")
        pairs = pairs.join(_salts(pairs, ["leader"], "n_chars", task_rows, task_chars), "leader")
        pairs = pairs.select("leader", F.expr("cast(pmod(xxhash64(doc_id), salts) as int)").alias("salt"), "doc_id")
        heads = pairs.select("leader", "salt").distinct()
        body = pairs.join(texts, "doc_id").select("leader", "salt", "doc_id", F.lit(True).alias("is_member"), "text")
        tops = heads.join(texts.withColumnRenamed("doc_id", "leader"), "leader")
        tops = tops.select("leader", "salt", F.col("leader").alias("doc_id"), F.lit(False).alias("is_member"), "text")
        dealt = body.union(tops).repartition("leader", "salt").sortWithinPartitions("leader", "salt", "is_member")
        return written(dealt.mapInArrow(partial(_stars, percent=percent), "u bigint, v bigint"), "links")

    links = verify(members.filter("doc_id != leader").select("doc_id", "leader").distinct())
    classes = components(links)

    def classed() -> DataFrame:
        known = members.join(classes, members["doc_id"] == classes["node"], "left")
        known = known.select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        mixed = known.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a != b").select("key")
        return written(known.join(mixed, "key"), "mixed")

    open_ = classed()
    second = open_.groupBy("key").agg(F.max_by(F.struct("doc_id", "component"), F.xxhash64("doc_id")).alias("l"))
    second = second.select("key", F.col("l.doc_id").alias("leader"), F.col("l.component").alias("c"))
    links = links.union(verify(open_.join(second, "key").filter("component != c").select("doc_id", "leader").distinct()))
    classes = components(links)

    open_ = classed()
    main = open_.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = main.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("m"))
    main = main.select("key", "main", F.expr("cast(ceil(n / 256) as int)").alias("blocks"), F.expr("cast(ceil((n - m) / 256) as int)").alias("probes"))
    lots = open_.join(main, "key")
    base = lots.select("key", "doc_id", "component", F.lit(False).alias("probe"), F.expr("pmod(xxhash64(doc_id), blocks)").alias("block"), F.explode(F.expr("sequence(0, probes - 1)")).alias("lot"))
    seek = lots.filter("component != main").select("key", "doc_id", "component", F.lit(True).alias("probe"), F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("block"), F.expr("cast(pmod(xxhash64(doc_id), probes) as int)").alias("lot"))
    ready = base.union(seek).join(nodes.select("doc_id", "bands"), "doc_id").join(texts.select("doc_id", "text"), "doc_id")
    rest = ready.groupBy("key", "block", "lot").applyInArrow(lambda table: _block(table, percent), "u bigint, v bigint")
    rest = written(rest, "links")
    if not rest.isEmpty():
        classes = components(links.union(rest))

    # a set's rows follow its node; hot sets are looked up by their digest, of which there is one row a node
    ends = nodes.join(classes, nodes["doc_id"] == classes["node"], "left").select("digest", F.coalesce("component", "doc_id").alias("component_id"))
    lone = sketch.filter("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = attach(sets.select("doc_id", "n_shingles", "digest"), ends, "digest").select("doc_id", "n_shingles", "component_id")
    return found.union(lone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)).alias("kept"))

