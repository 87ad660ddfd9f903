"""Sums of long numpy vectors over the partitions of a frame."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 14
BLOCKS = "block int, task bigint, vec binary"


def vectors(part: Callable[[Iterable[pa.RecordBatch]], np.ndarray]) -> Callable:
    """A mapInArrow function that gives a partition's vector in compressed blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, v, task = zstandard.ZstdCompressor(level=1), part(batches), TaskContext.get().partitionId()
        blocks = [i for i in range(0, len(v), BLOCK) if v[i : i + BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK for i in blocks], pa.int32()), pa.array([task] * len(blocks), pa.int64()), pa.array([z.compress(v[i : i + BLOCK].tobytes()) for i in blocks], pa.binary())], ["block", "task", "vec"])

    return run


def added(keys: tuple, table: pa.Table) -> pa.Table:
    z = zstandard.ZstdDecompressor()
    total = sum(np.frombuffer(z.decompress(v)) for v in table.column("vec").to_pylist())
    return pa.table({"block": pa.array([keys[0].as_py()], pa.int32()), "task": pa.array([0], pa.int64()), "vec": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())})


def tree_sum(frame: DataFrame, part: Callable, size: int) -> np.ndarray:
    """The sum over partitions of part(batches), float64 of that size; a group holds about the root of the partitions at most."""
    few = max(1, math.isqrt(frame.rdd.getNumPartitions()))
    rows = frame.mapInArrow(vectors(part), BLOCKS).withColumn("task", F.col("task") % few).groupBy("block", "task").applyInArrow(added, BLOCKS).groupBy("block").applyInArrow(added, BLOCKS).collect()
    out = np.zeros(size)
    for r in rows:
        v = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.vec))
        out[r.block * BLOCK : r.block * BLOCK + len(v)] = v
    return out
