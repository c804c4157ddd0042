"""A bitmap of fixed size that says which keys may matter, so that a scan can leave the others where they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .worker import release

BITS = 26
#: Words of 64 bits in a block of the bitmap.
WORDS = 1 << 14


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (w, b) as blocks of the bitmap."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        w, b = (batch.column(k).to_numpy() for k in range(2))
        for at in np.unique(w // WORDS).tolist():
            own = w // WORDS == at
            held.setdefault(at, np.zeros(WORDS, np.int64))[w[own] % WORDS] = b[own]
    yield pa.RecordBatch.from_pydict({"at": pa.array(list(held), pa.int64()), "bits": pa.array([x.tobytes() for x in held.values()], pa.binary())})


def bitmap(hashes: DataFrame, width: int = BITS) -> Broadcast:
    """The bits of ``hashes`` (one column of 64-bit hashes) by their leading ``width`` bits; nulls are left out.

    With 26 bits 8 MB whatever the number of keys, so it may be broadcast. When it fills up, more rows pass and none is lost.
    Tasks make the blocks, so the driver only puts them in a row.
    """
    name = hashes.columns[0]
    place = F.shiftrightunsigned(F.col(name), 64 - width)
    bits = hashes.filter(F.col(name).isNotNull()).select(place.alias("p"))
    bits = bits.groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b"))
    blocks = bits.repartition(F.expr(f"w div {WORDS}")).mapInArrow(_blocks, "at bigint, bits binary")
    table = bytearray(1 << (width - 3))
    for row in blocks.collect():
        table[row["at"] * WORDS * 8 : (row["at"] + 1) * WORDS * 8] = row["bits"]
    shared = hashes.sparkSession.sparkContext.broadcast(bytes(table))
    del table
    release()
    return shared


def marked(shared: Broadcast, hashes: np.ndarray) -> np.ndarray:
    """Which signed 64-bit hashes have their bit set."""
    table = np.frombuffer(shared.value, np.int64)
    place = (hashes.astype(np.int64).view(np.uint64) >> np.uint64(59 - len(table).bit_length())).astype(np.int64)
    return (table[place >> 6] >> (place & 63)) & 1 == 1


def sieve(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test on a column: true for every non-null ``key`` of ``keys``, and by chance for a few other values.

    What passes must still be joined with the keys.
    """
    shared = bitmap(keys.filter(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h")))

    def passes(h: pd.Series) -> pd.Series:
        return pd.Series(marked(shared, h.to_numpy()))

    test = F.pandas_udf(passes, BooleanType())
    return lambda column: test(F.xxhash64(column)) & column.isNotNull()
