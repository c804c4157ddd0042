"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find within a task, a block of edges at a time: each node of a block with the least node of its class there."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, find(x)) for x in parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_pydict({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: longs, neither null); the component is its least node.

    Tasks first reduce their edges by union-find; then stars are moved to ever smaller centres until nothing changes,
    which takes a number of rounds logarithmic in the length of the longest chain. A round is written before the next.
    An empty table gives an empty result.
    """
    stars = edges.select("u", "v").filter("u != v").mapInArrow(_forest, "u bigint, v bigint").distinct()
    stars = written(stars, "stars")
    seen = None
    while True:
        both = stars.union(stars.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").filter("v != m").toDF("u", "v").union(low.select("u", F.col("m").alias("v")))
        stars = written(small.distinct(), "stars")
        state = stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(pmod(xxhash64(v, u), 1000003))")).first()
        if state == seen:
            break
        seen = state
    ends = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(stars.select("v", "v")).distinct()
