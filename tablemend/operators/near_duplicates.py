"""Near-duplicate rows by cosine distance of term weights over all terms (NBR2, DGN14, DUP1, DUP2).

Exact copies are folded first. Terms are ordered from the rarest up. Two unit vectors of cosine at least t share a term
among the leading terms of both, those up to which what is left has norm t (prefix filtering, Bayardo et al. 2007), and at
their first common term the norms of what is left multiply to t or more. The norms of a fixed number of groups of terms multiply to t
or more, too. Terms of a single row count in its norm only. An inverted index of the leading
terms holds only ids, norms and these group norms. What passes all three bounds at the pair's first common term is a
candidate. Where a part of a list has few candidates they become pairs, each kept once however many lists it comes up in;
where it has many, its rows stay together. Vectors are joined on afterwards, once for each pair or part, and multiplied.
All bounds are upper bounds, so no near copy is missed. A task returns a bounded number of rows per row it got.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import col, row_text
from ..functions.schema import quoted
from ..session import outside, scratch, settle, stored
from .lookup import attach_by_value
from .profile import row_digest

NEAREST_DISTANCE = 0.03
#: Rows of a list that a task gets with as many others, and those it compares at a time.
PART = 8_192
TILE = 1_024
#: Rows whose postings are made at a time.
BLOCK = 1_024
#: First terms of a row by which a pair is known to belong to an earlier list.
EARLIER = 16
#: Pairs of a tile from which on their products are taken as a matrix.
DENSE = 2_048
#: Candidates per row of a part of a list up to which they are kept as pairs.
SPARSE = 8
#: Rows of a block, two of which a task gets to compare the norms of their pairs, and terms of one to multiply them.
BLOCK_ROWS = 32_768
BLOCK_TERMS = 4_000_000
#: Most frequent terms that are broadcast.
COMMON = 65_536
#: Groups of terms whose norms a row carries, and those of the rows with a candidate.
GROUPS = 64
FINE = 1_024
DIGEST = "__digest"
#: Cells of a dense block of vectors.
CELLS = 4_000_000
TERM = r"(?U)\b\w\w+\b"


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows (DUP1).

    Only digests are counted, and only rows whose digest occurs twice are shuffled whole to keep one of each.
    """
    marked = df.withColumn(DIGEST, F.unhex(row_digest(df)))
    repeated = marked.groupBy(DIGEST).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(DIGEST)
    repeated = settle(repeated)
    once = marked.join(repeated, DIGEST, "left_anti").select(*[quoted(c) for c in df.columns])
    again = marked.join(repeated, DIGEST, "left_semi").dropDuplicates([DIGEST]).select(*[quoted(c) for c in df.columns])
    return once.unionByName(again)


def _folded(df: DataFrame, key: str, columns: list[str] | None) -> DataFrame:
    """One row per distinct row text: digest, lowest key, number of copies, the text."""
    rows = df.select(col(key).alias("id"), row_text(df, columns).alias("text"))
    return (
        rows.groupBy(F.unhex(F.sha2("text", 256)).alias("digest"))
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value("text").alias("text"))
    )


def _lists_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.Array]:
    """Lengths and values of a column of lists; a missing list is empty."""
    column = batch.column(name)
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), column.flatten()


def _list(row: np.ndarray, rows: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Values of ascending rows as one list a row."""
    ends = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each distinct term occurs in its row."""
    for batch in batches:
        lengths, flat = _lists_of(batch, "words")
        row, term = np.repeat(np.arange(len(batch)), lengths), flat.to_numpy(zero_copy_only=False)
        order = np.lexsort((term, row))
        row, term = row[order], term[order]
        begins = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])][: len(row)])
        tf = np.diff(np.r_[begins, len(row)])
        columns = [batch.column(c) for c in ("id", "mark", "copies")]
        columns += [_list(row[begins], len(batch), term[begins], pa.int64()), _list(row[begins], len(batch), tf, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "copies", "terms", "tf"])


def _weighed(
    n: int, common: tuple[np.ndarray, np.ndarray], closed: bool, cosine: float | None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Weights of the counted terms, rarest first. A term that is neither ``common`` nor in ``found`` occurs in its row
    only; it is left out where the vocabulary is ``closed``."""
    names, often = common

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, flat = _lists_of(batch, "terms")
            row, term = np.repeat(np.arange(len(batch)), lengths), flat.to_numpy(zero_copy_only=False)
            tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False)
            held = _lists_of(batch, "found")[1]
            known = np.r_[names, held.field("term").to_numpy(zero_copy_only=False)]
            times = np.r_[often, held.field("df").to_numpy(zero_copy_only=False)]
            known, first = np.unique(known, return_index=True)
            times = times[first]
            df, shared = batch.column("copies").to_numpy()[row], np.zeros(len(row), bool)
            if len(known):
                at = np.minimum(np.searchsorted(known, term), len(known) - 1)
                shared = known[at] == term
                df = np.where(shared, times[at], df)
            if closed:
                row, term, tf, df, shared = (x[shared] for x in (row, term, tf, df, shared))
            raw = tf * (np.log((1.0 + n) / (1.0 + df)) + 1.0)
            w = raw / np.sqrt(np.bincount(row, raw * raw, len(batch)))[row]
            if cosine is not None:
                # a term of one row multiplies with none, and a row needs this much weight on its other terms
                square = np.bincount(row, w * w * shared, len(batch))
                use = shared & (square >= cosine * cosine - 1e-9)[row]
                row, term, df, w = row[use], term[use], df[use], w[use]
            order = np.lexsort((term, df, row))
            row, term, df, w = row[order], term[order], df[order], w[order]
            columns = [batch.column("id"), batch.column("mark")]
            kinds = ((term, pa.int64()), (df, pa.int64()), (w, pa.float64()))
            columns += [_list(row, len(batch), x, kind) for x, kind in kinds]
            whole = pa.RecordBatch.from_arrays(columns, ["id", "mark", "terms", "df", "w"])
            yield whole if cosine is None else whole.filter(pa.array(np.bincount(row, minlength=len(batch)) > 0))

    return made


def _vectors(folded: DataFrame, vocabulary: int | None = None, cosine: float | None = None) -> DataFrame:
    """Unit term weights as lists, rarest term first: id, mark, terms, df, w.

    Terms are counted where their row is. Only the rarer ones are shuffled to learn in how many rows they occur; the most
    frequent ones, a bounded number, are broadcast. With ``cosine`` only what a partner of that cosine can share is kept.
    """
    spark = folded.sparkSession
    words = F.regexp_extract_all(F.lower("text"), F.lit(TERM), 0)
    id_field = T.StructField("id", folded.schema["id"].dataType)
    base = [id_field, T.StructField("mark", T.LongType())]
    terms_field = T.StructField("terms", T.ArrayType(T.LongType()))
    shape = T.StructType([*base, T.StructField("copies", T.LongType()), terms_field, T.StructField("tf", T.ArrayType(T.IntegerType()))])
    hashed = folded.select("id", F.xxhash64("digest").alias("mark"), "copies", F.transform(words, lambda w: F.xxhash64(w)).alias("words"))
    counted = stored(hashed.mapInArrow(_counts, shape))
    listed = counted.select("copies", F.explode("terms").alias("term"))
    terms = listed.groupBy("term").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("df"))
    if vocabulary is not None:
        each = folded.select("copies", F.explode(words).alias("word")).groupBy("word").agg(F.sum("copies").alias("total"))
        kept = each.orderBy(F.col("total").desc(), "word").limit(vocabulary).select(F.xxhash64("word").alias("term"))
        terms = terms.join(kept, "term", "left_semi")
    else:
        terms = terms.filter("rows > 1")
    terms = stored(terms)
    n = folded.agg(F.sum("copies").alias("n")).first()["n"] or 0
    # sizes by power of two, so the cut keeps at most COMMON terms
    sizes = terms.groupBy(F.floor(F.log2("rows")).cast("int").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    cut, number = 63, 0
    for size in sorted(sizes.collect(), key=lambda r: -r["size"]):
        number += size["n"]
        if number > COMMON:
            break
        cut = size["size"]
    top = terms.filter(F.floor(F.log2("rows")) >= cut).select("term", "df").toPandas().sort_values("term")
    common = top["term"].to_numpy(np.int64), top["df"].to_numpy(np.int64)
    found = [*base, T.StructField("term", T.LongType())]

    def rarer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, flat = _lists_of(batch, "terms")
            term = flat.to_numpy(zero_copy_only=False)
            rare = np.flatnonzero(~np.isin(term, common[0]))
            at = pa.array(np.repeat(np.arange(len(batch)), lengths)[rare])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("mark").take(at), pa.array(term[rare])], ["id", "mark", "term"])

    rest = counted.select("id", "mark", "terms").mapInArrow(rarer, T.StructType(found))
    rest = rest.join(terms.filter(F.floor(F.log2("rows")) < cut).select("term", "df"), "term")
    rest = rest.groupBy("id", "mark").agg(F.collect_list(F.struct("term", "df")).alias("found"))
    joined = counted.withColumnsRenamed({"id": "__id", "mark": "__mark"}).join(
        rest, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__mark") == F.col("mark")), "left"
    )
    ready = joined.select(F.col("__id").alias("id"), F.col("__mark").alias("mark"), "copies", "terms", "tf", "found")
    shape = T.StructType([*base, terms_field, T.StructField("df", T.ArrayType(T.LongType())), T.StructField("w", T.ArrayType(T.DoubleType()))])
    return ready.mapInArrow(_weighed(n, common, vocabulary is not None, cosine), shape)


def term_weights(folded: DataFrame, vocabulary: int | None = None) -> DataFrame:
    """Unit term weights (id, term, df, w): counts of terms times smoothed inverse document frequency
    ``ln((1+n)/(1+df)) + 1``; ``term`` is a 64-bit hash.

    Copies count in the frequencies as often as they occur. ``vocabulary`` keeps the most frequent terms only.
    """
    cells = F.inline(F.arrays_zip(F.col("terms").alias("term"), "df", "w"))
    return _vectors(folded, vocabulary).select("id", cells).toDF("id", "term", "df", "w")


def _norms(row: np.ndarray, term: np.ndarray, square: np.ndarray, rows: int, groups: int) -> list[bytes]:
    """Norms of groups of terms of each row in half precision, rounded up."""
    each = np.sqrt(np.bincount(row * groups + term % groups, square, rows * groups)).reshape(-1, groups)
    above = np.nextafter(each.astype(np.float16), np.float16(np.inf))
    return [g.tobytes() for g in np.where(each > 0, above, np.float16(0)).astype("<f2")]


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, groups) of each row, for many groups."""
    for whole in batches:
        for start in range(0, len(whole), BLOCK):
            batch = whole.slice(start, BLOCK)
            lengths, flat = _lists_of(batch, "terms")
            term, square = flat.to_numpy(zero_copy_only=False), batch.column("w").flatten().to_numpy(zero_copy_only=False) ** 2
            made = _norms(np.repeat(np.arange(len(batch)), lengths), term, square, len(batch), FINE)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(made, pa.binary())], ["id", "mark", "groups"])


def _postings(cosine: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, id, mark, nth, left, before, groups) of each leading term of a row: its place, the norm of the terms from it
    on, the first few terms before it, and the norms of the groups of terms."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), BLOCK):
                batch = whole.slice(start, BLOCK)
                lengths, flat = _lists_of(batch, "terms")
                term, square = flat.to_numpy(zero_copy_only=False), batch.column("w").flatten().to_numpy(zero_copy_only=False) ** 2
                row = np.repeat(np.arange(len(batch)), lengths)
                begin = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
                total = np.bincount(row, square, len(batch))
                run = np.cumsum(square) - square
                rest = total[row] - (run - run[begin[row]]) if len(row) else square
                lead = np.flatnonzero(rest >= cosine * cosine - 1e-9)
                own = row[lead]
                nth = lead - begin[own]
                before = [term[i - k : i - k + min(k, EARLIER)].astype("<i8").tobytes() for i, k in zip(lead.tolist(), nth.tolist(), strict=True)]
                raw = _norms(row, term, square, len(batch), GROUPS)
                at = pa.array(own)
                columns = [
                    pa.array(term[lead]), batch.column("id").take(at), batch.column("mark").take(at), pa.array(nth, pa.int32()),
                    pa.array(np.sqrt(np.maximum(rest[lead], 0.0))), pa.array(before, pa.binary()), pa.array([raw[k] for k in own.tolist()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["term", "id", "mark", "nth", "left", "before", "groups"])

    return made


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (term, a, b), which follow one another."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("term", "a", "b")])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if y - x == 1 and 0 < x and y < len(batch):
                continue  # alone in its list
            now = tuple(key[:, x].tolist())
            if held and now != at:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
            at = now
    if held:
        yield pa.Table.from_batches(held)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the two chunks of a part of a list; they are the same chunk on the diagonal."""
    chunk = table.column("chunk").to_numpy()
    return np.flatnonzero(chunk == table.column("a")[0].as_py()), np.flatnonzero(chunk == table.column("b")[0].as_py())


def _pairs(table: pa.Table, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a part of a list, left and right, that may be near copies, by tile.

    Pairs with one of their first terms in common are left to its list; others may come up in several lists.
    """
    left, right = _sides(table)
    rest, nth = table.column("left").to_numpy(), table.column("nth").to_numpy()
    groups = np.frombuffer(b"".join(table.column("groups").to_pylist()), "<f2").reshape(table.num_rows, -1).astype(np.float32)
    ids = table.column("id").to_pandas().to_numpy()
    within = table.column("a")[0].as_py() == table.column("b")[0].as_py()
    before: dict[int, frozenset] = {}

    def earlier(k: int) -> frozenset:
        if k not in before:
            before[k] = frozenset(np.frombuffer(table.column("before")[k].as_py(), "<i8").tolist())
        return before[k]

    for x in range(0, len(left), TILE):
        for y in range(0, len(right), TILE):
            p, q = left[x : x + TILE], right[y : y + TILE]
            near = (groups[p] @ groups[q].T >= cosine - 1e-5) & (rest[p][:, None] * rest[q][None, :] >= cosine - 1e-9)
            i, j = np.nonzero(near)
            i, j = p[i], q[j]
            once = ids[i] < ids[j] if within else ids[i] != ids[j]
            i, j = i[once], j[once]
            late = np.flatnonzero((nth[i] > 0) & (nth[j] > 0))
            if len(late):
                first = np.ones(len(i), bool)
                first[late] = [earlier(u).isdisjoint(earlier(v)) for u, v in zip(i[late].tolist(), j[late].tolist(), strict=True)]
                i, j = i[first], j[first]
            if len(i):
                yield i, j


def _products(vectors: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All products of left with right vectors, terms taken in blocks of bounded size."""
    rows = np.r_[left, right]
    owner = np.repeat(np.arange(len(rows)), [len(vectors[k][0]) for k in rows])
    term, w = (np.concatenate([vectors[k][c] for k in rows]) for c in (0, 1))
    _, at, often = np.unique(term, return_inverse=True, return_counts=True)
    place = np.cumsum(often > 1) - 1  # a term of one row multiplies with none
    shared = often[at] > 1
    owner, at, w = owner[shared], place[at[shared]], w[shared]
    out, width = np.zeros((len(left), len(right))), max(1, CELLS // max(1, len(rows)))
    order = np.argsort(at, kind="stable")
    owner, at, w = owner[order], at[order], w[order]
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, (start, start + width))
        x = np.zeros((len(rows), min(width, int(at[-1]) + 1 - start)))
        x[owner[a:b], at[a:b] - start] = w[a:b]
        out += x[: len(left)] @ x[len(left) :].T
    return out


def _cosines(vectors: list[tuple[np.ndarray, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the pairs: few are taken one by one, many as a matrix."""
    left, at_left = np.unique(i, return_inverse=True)
    right, at_right = np.unique(j, return_inverse=True)
    if len(i) > DENSE and len(i) * 8 > len(left) * len(right):
        return _products(vectors, left, right)[at_left, at_right]
    out = np.zeros(len(i))
    for k, (u, v) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        _, a, b = np.intersect1d(vectors[u][0], vectors[v][0], assume_unique=True, return_indices=True)
        out[k] = vectors[u][1][a] @ vectors[v][1][b]
    return out


def _candidates(cosine: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The candidates of each part of a list: as pairs where they are few for its rows, else the rows that have one."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _lists(batches):
            if table.num_rows < 2:
                continue
            number, pairs, used = 0, [], []
            for i, j in _pairs(table, cosine):
                number += len(i)
                if number <= SPARSE * table.num_rows:
                    pairs.append((i, j))
                used.append(np.unique(np.r_[i, j]))
            if not number:
                continue
            kind = table.schema.field("id").type
            shape = pa.schema([*(pa.field(f.name, f.type) for f in table.schema), pa.field("near_id", kind), pa.field("near_mark", pa.int64())])
            if number > SPARSE * table.num_rows:
                kept = table.take(np.unique(np.concatenate(used)))
                columns = [*kept.columns, pa.nulls(kept.num_rows, kind), pa.nulls(kept.num_rows, pa.int64())]
                yield from pa.Table.from_arrays(columns, schema=shape).combine_chunks().to_batches()
                continue
            i, j = (np.concatenate([p[c] for p in pairs]) for c in (0, 1))
            ids = table.column("id").to_pandas().to_numpy()
            first = ids[i] < ids[j]
            i, j = np.where(first, i, j), np.where(first, j, i)
            columns = [
                table.column(c).combine_chunks().take(pa.array(i)) if c in ("id", "mark") else pa.nulls(len(i), table.schema.field(c).type)
                for c in table.column_names
            ]
            columns += [table.column(c).combine_chunks().take(pa.array(j)) for c in ("id", "mark")]
            yield pa.RecordBatch.from_arrays(columns, schema=shape)

    return made


def _paired(
    pairs: DataFrame, rows: DataFrame, blocks: int, shape: T.StructType,
    compared: Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], pa.Table],
) -> DataFrame:
    """``compared`` on the pairs (id, mark, near_id, near_mark) and their two rows, given as places among the rows of a task.

    Rows are cut into blocks, and a pair goes where the rows of its two blocks are, so a row is sent once to each block it
    has partners in, however many they are.
    """
    own, other = (F.pmod(F.xxhash64(*c), F.lit(blocks)) for c in (("id", "mark"), ("near_id", "near_mark")))
    dealt = stored(pairs.select("*", F.least(own, other).alias("a"), F.greatest(own, other).alias("b")))
    sides = dealt.select("a", "b", "id", "mark").unionByName(dealt.select("a", "b", F.col("near_id").alias("id"), F.col("near_mark").alias("mark")))
    cells = [c for c in rows.columns if c not in ("id", "mark")]
    # both sides stem from one table, so these columns get names, hence identities, of their own
    held = sides.distinct().join(rows, ["id", "mark"]).select(
        F.col("a").alias("x"), F.col("b").alias("y"), F.col("id").alias("row"), F.col("mark").alias("row_mark"), *cells
    )

    def placed(held: pa.Table, asked: pa.Table) -> pa.Table:
        at = held.select(["row", "row_mark"]).to_pandas().set_axis(["id", "mark"], axis=1)
        at["i"] = np.arange(len(at))
        found = asked.select(["id", "mark", "near_id", "near_mark"]).to_pandas()
        found["pair"] = np.arange(len(found))
        found = found.merge(at, on=["id", "mark"]).merge(at.set_axis(["near_id", "near_mark", "j"], axis=1), on=["near_id", "near_mark"])
        found = found.sort_values(["i", "j"])
        return compared(held, asked.take(pa.array(found["pair"].to_numpy())), found["i"].to_numpy(), found["j"].to_numpy())

    return held.groupBy("x", "y").cogroup(dealt.groupBy("a", "b")).applyInArrow(placed, shape)


def _likely(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """The pairs that the norms of many groups of terms do not rule out."""
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in pairs.schema])
    names = pairs.columns

    def compared(held: pa.Table, asked: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.Table:
        norms = np.frombuffer(b"".join(held.column("groups").to_pylist()), "<f2").reshape(held.num_rows, FINE)
        near = np.zeros(len(i), bool)
        for k in range(0, len(i), TILE):
            x, y = (norms[c[k : k + TILE]].astype(np.float32) for c in (i, j))
            near[k : k + TILE] = np.einsum("ij,ij->i", x, y) >= cosine - 1e-5
        return asked.select(names).filter(pa.array(near))

    kind = T.StructType([vectors.schema["id"], T.StructField("mark", T.LongType()), T.StructField("groups", T.BinaryType())])
    norms = vectors.select("id", "mark", "terms", "w").mapInArrow(_finer, kind)
    blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    return stored(_paired(pairs, norms, blocks, shape, compared))


def _multiplied(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """Pairs of at least this cosine, once from each side: id, near_id, cosine."""
    kind = vectors.schema["id"].dataType
    shape = T.StructType([T.StructField("id", kind), T.StructField("near_id", kind), T.StructField("cosine", T.DoubleType())])

    def compared(held: pa.Table, asked: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.Table:
        columns = [held.column(c).combine_chunks() for c in ("terms", "w")]
        ends = np.cumsum(columns[0].value_lengths().to_numpy())
        cells = list(zip(*(np.split(c.flatten().to_numpy(zero_copy_only=False), ends[:-1]) for c in columns), strict=True))
        likeness = np.concatenate([np.zeros(0), *(_cosines(cells, i[k : k + PART], j[k : k + PART]) for k in range(0, len(i), PART))])
        close = likeness >= cosine
        u, v, value = held.column("row").take(pa.array(i[close])), held.column("row").take(pa.array(j[close])), likeness[close]
        return pa.table({
            "id": pa.chunked_array([*u.chunks, *v.chunks], u.type), "near_id": pa.chunked_array([*v.chunks, *u.chunks], u.type),
            "cosine": pa.array(np.r_[value, value]),
        })

    size = vectors.agg(F.sum(F.size("terms"))).first()[0] or 0
    return _paired(pairs, vectors.select("id", "mark", "terms", "w"), max(1, -(-size // BLOCK_TERMS)), shape, compared)


def near_links(weights: DataFrame, cosine: float, block: int = PART) -> DataFrame:
    """Per row with a partner of at least this cosine: lowest partner id and highest cosine. ``weights``: id, term, df, w."""
    listed = weights.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "term", "w"))).alias("cells"))
    cells = F.col("cells")
    return _linked(stored(listed.select("id", F.lit(0).cast("long").alias("mark"), cells["term"].alias("terms"), cells["w"].alias("w"))), cosine, block)


def _linked(vectors: DataFrame, cosine: float, block: int = PART) -> DataFrame:
    """Links of rows whose terms (id, mark, terms, w) are listed from the rarest up."""
    id_field = T.StructField("id", vectors.schema["id"].dataType)
    posting = T.StructType(
        [
            T.StructField("term", T.LongType()),
            id_field,
            T.StructField("mark", T.LongType()),
            T.StructField("nth", T.IntegerType()),
            T.StructField("left", T.DoubleType()),
            T.StructField("before", T.BinaryType()),
            T.StructField("groups", T.BinaryType()),
        ]
    )
    postings = vectors.select("id", "mark", "terms", "w").mapInArrow(_postings(cosine), posting)
    # the few lists of more than a chunk: at most a term per ``block`` postings
    sizes = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    sizes = stored(sizes.select("term", F.ceil(F.col("n") / block).cast("int").alias("chunks")))
    # every unordered pair of chunks of a list is one group; a row goes to the groups of its chunk
    sized = postings.join(F.broadcast(sizes), "term", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunked = sized.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    parts = chunked.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)"))).select(
        "*", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b")
    ).drop("other", "chunks")
    keys = ["term", "a", "b"]
    dealt = parts.repartition(*keys).sortWithinPartitions(*keys)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each part that have a candidate there, as they are."""
        for table in _lists(batches):
            if table.num_rows > 1:
                used = [np.unique(np.r_[i, j]) for i, j in _pairs(table, cosine)]
                if used:
                    yield from table.take(np.unique(np.concatenate(used))).combine_chunks().to_batches()

    # a pair (id, mark, near_id, near_mark), or a row of a part that stays together and has no ``near_mark``
    near = [T.StructField("near_id", id_field.dataType), T.StructField("near_mark", T.LongType())]
    coarse = stored(dealt.mapInArrow(_candidates(cosine), T.StructType([*(T.StructField(f.name, f.dataType) for f in dealt.schema), *near])))
    apart = coarse.filter("near_mark is not null").select("id", "mark", "near_id", "near_mark").distinct()
    # long rows are alike in few groups, so more of them are multiplied before vectors are joined on
    finer = vectors.select("id", "mark", "terms", "w").mapInArrow(_finer, T.StructType([f for f in posting if f.name in ("id", "mark", "groups")]))
    finer = coarse.filter("near_mark is null").drop("groups").join(finer, ["id", "mark"]).select(*dealt.columns)
    finer = finer.repartition(*keys).sortWithinPartitions(*keys)
    together = stored(finer.mapInArrow(needed, dealt.schema))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _lists(batches):
            columns = [table.column(c).combine_chunks() for c in ("terms", "w")]
            ends = np.cumsum(columns[0].value_lengths().to_numpy())
            values = [np.split(c.flatten().to_numpy(zero_copy_only=False), ends[:-1]) for c in columns]
            cells = list(zip(*values, strict=True))
            ids = table.column("id").to_pandas().to_numpy()
            kind = table.schema.field("id").type
            for i, j in _pairs(table, cosine):
                likeness = _cosines(cells, i, j)
                close = likeness >= cosine
                i, j, likeness = i[close], j[close], likeness[close]
                if not len(i):
                    continue
                own, other = np.r_[i, j], np.r_[j, i]
                order = np.lexsort((ids[other], own))
                own, other, value = own[order], other[order], np.r_[likeness, likeness][order]
                begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[own[begins]], kind), pa.array(ids[other[begins]], kind), pa.array(np.maximum.reduceat(value, begins))],
                    ["id", "near_id", "cosine"],
                )

    full = together.join(vectors.select("id", "mark", "terms", "w"), ["id", "mark"]).select(*together.columns, "terms", "w")
    full = full.repartition(*keys).sortWithinPartitions(*keys)
    shape = T.StructType([id_field, T.StructField("near_id", id_field.dataType), T.StructField("cosine", T.DoubleType())])
    found = full.mapInArrow(compared, shape).unionByName(_multiplied(_likely(apart, vectors, cosine), vectors, cosine))
    return found.groupBy("id").agg(F.min("near_id").alias("near_id"), F.max("cosine").alias("cosine"))


def near_duplicate_rows(
    df: DataFrame,
    key: str,
    columns: list[str] | None = None,
    distance: float = NEAREST_DISTANCE,
    vocabulary: int | None = None,
    block: int = PART,
) -> DataFrame:
    """Rows that have a near copy: key, the lowest key among their near copies, highest cosine.

    An exact copy counts, with cosine 1. ``key`` tells rows apart. All terms count unless ``vocabulary`` limits them to
    the most frequent ones.
    """
    with scratch(df.sparkSession):
        found = _near_duplicate_rows(df, key, columns, distance, vocabulary, block)
        with outside():
            return stored(found)


def _near_duplicate_rows(
    df: DataFrame, key: str, columns: list[str] | None, distance: float, vocabulary: int | None, block: int
) -> DataFrame:
    with scratch(df.sparkSession):
        whole = stored(_folded(df, key, columns))
        weighed = _vectors(whole, vocabulary, 1.0 - distance)
        with outside():
            folded, vectors = stored(whole.drop("text")), stored(weighed)
    links = _linked(vectors, 1.0 - distance, block)
    groups = (
        folded
        .join(links.withColumnRenamed("near_id", "linked"), "id", "left")
        .select("digest", F.col("id").alias("first"), "copies", "linked", "cosine")
        .filter((F.col("copies") > 1) | F.col("linked").isNotNull())
        .withColumnRenamed("digest", "value")
    )
    named = df.select(col(key).alias("id"), F.unhex(F.sha2(row_text(df, columns), 256)).alias("digest"))
    copies = folded.select(F.col("digest").alias("value"), F.col("copies").alias("n"))
    joined = attach_by_value(named, "digest", groups, copies, F.xxhash64("id"))
    own = F.col("id") != F.col("first")
    return joined.filter(F.col("first").isNotNull()).select(
        F.col("id").alias(key),
        F.when(own, F.least("first", F.coalesce("linked", "first"))).otherwise(F.col("linked")).alias("near_id"),
        F.when(F.col("copies") > 1, F.lit(1.0)).otherwise(F.col("cosine")).alias("cosine"),
    )


def drop_near_duplicates(df: DataFrame, key: str, **options) -> DataFrame:
    """Keep the lowest key of near copies: a row goes if a near copy has a lower key (DUP2)."""
    later = near_duplicate_rows(df, key, **options).filter(F.col("near_id") < F.col(key)).select(key)
    return df.join(later, key, "left_anti")
