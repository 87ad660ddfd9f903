"""Connected components: each partition's own first, then alternating large and small stars, or one task where few links are left."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


#: Up to so many links, some 100 MB in a task, are joined in one task; more by stars.
ONE_TASK = 400_000


def shrunk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as links to the smallest node of each of its own components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    rows = [(x, find(x)) for x in root]
    rows = [r for r in rows if r[0] != r[1]]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])


def least(links: DataFrame) -> DataFrame:
    """a, b and the least neighbour or self of a, over both directions of the links."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a")


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node it reaches) of every node with a link. links: a, b of bigint."""
    links = staged(links.select("a", "b").where("a <> b").mapInArrow(shrunk, "a bigint, b bigint"), "links")
    if links.count() <= ONE_TASK:
        links = staged(links.coalesce(1).mapInArrow(shrunk, "a bigint, b bigint"), "links")
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    before = None
    while True:
        n, total = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = (n, total)
        large = least(links).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: the smaller neighbours and the node itself, to the least of them
        down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        links = staged(small, "links")
