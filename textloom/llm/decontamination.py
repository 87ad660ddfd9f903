"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping segments of LENGTH characters (shorter items are one segment). A segment that
stands in a text with at most e edits shares at least n + 1 - q * (e + 1) q-grams with it, on diagonals within e of each
other. So, for every position of every text: shared q-grams are counted in windows of the text, then for windows that may
reach the bound by segment in overlapping diagonal bands, and bands that reach it are verified by a banded alignment.
Case of A-Z and kind of white space don't count as edits; positions are code points.

Null or empty texts match nothing; null or empty items, and those shorter than q characters, match nothing. Repeated rows
each get their row; an empty table gives an empty result, an empty benchmark marks nothing. A text of any length is searched
in chunks that overlap by more than a region. Benchmarks larger than BLOCK_BYTES are taken in blocks, each a pass over the
documents, and their regions are gathered by row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, read, staged, text_bytes, trim
from .words import groups

Q, LENGTH, STRIDE, EDIT_SHARE = 8, 96, 48, 16
CHUNK_BYTES, BLOCK_BYTES = 1 << 20, 2 << 20
#: Pairs of a text's and a segment's q-gram that are held at once.
PAIRS = 1 << 20
_PLAIN = bytes([*range(9), *[32] * 5, *range(14, 65), *range(97, 123), *range(91, 256)])
_BITS = 22
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def plain(raw: bytes) -> np.ndarray:
    """Code points, A-Z lower-cased and white space as spaces."""
    return np.frombuffer(raw.translate(_PLAIN).decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")


def grams(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 8 code points from each position."""
    if len(x) < Q:
        return np.zeros(0, np.uint64)
    h = x.astype(np.uint64)
    for step, m in zip((1, 2, 4), _MIX, strict=True):
        h = h[:-step] * m + h[step:]
        h ^= h >> np.uint64(29)
    return h


def slot(codes: np.ndarray) -> np.ndarray:
    return ((codes * _MIX[0]) >> np.uint64(64 - _BITS)).astype(np.int64)


def string(x: np.ndarray) -> str:
    return x.tobytes().decode("utf-32-le", "surrogatepass")


class Index:
    """Segments of benchmark items by q-gram, in sorted arrays: some 14 bytes a q-gram, two for each character of an item."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.segments: list[tuple[int, str, int]] = []  # item, text, edits allowed
        codes, owner, place = [], [], []
        for item, text in items:
            x = plain((text or "").strip().encode("utf-8", "replace"))
            if item is None or len(x) < Q:
                continue
            g, last = grams(x), max(0, len(x) - LENGTH)
            for a in sorted({*range(0, last, STRIDE), last}):
                n = len(x[a : a + LENGTH])
                own = g[a : a + n - Q + 1]
                codes.append(own)
                owner.append(np.full(len(own), len(self.segments), np.int32))
                place.append(np.arange(len(own), dtype=np.int16))
                self.segments.append((item, string(x[a : a + LENGTH]), max(0, min(n // EDIT_SHARE, (n + 1) // Q - 2))))
        codes = np.concatenate([np.zeros(0, np.uint64), *codes])
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        self.owner = np.concatenate([np.zeros(0, np.int32), *owner])[order]
        self.place = np.concatenate([np.zeros(0, np.int16), *place])[order]
        self.first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        self.codes = codes[self.first]
        self.count = np.diff(np.append(self.first, len(codes)))
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[slot(self.codes)] = True
        self.edits = np.array([e for _, _, e in self.segments], np.int64)
        sizes = np.array([len(s) for _, s, _ in self.segments], np.int64)
        self.need = sizes + 1 - Q * (self.edits + 1)
        self.least = int(self.need.min()) if len(sizes) else 1
        self.span = int((sizes + self.edits).max()) if len(sizes) else 0

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose q-gram a segment has, and the q-gram's number."""
        at = np.flatnonzero(self.maybe[slot(codes)])
        if not len(at):
            return at, at
        i = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        same = self.codes[i] == codes[at]
        return at[same], i[same]

    def bands(self, at: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """(segment, band) that may hold a match, for positions `at` in order with their q-grams' numbers. Bands are two steps of e + 1 diagonals wide and overlap by one."""
        out, low = [np.zeros((0, 2), np.int64)], 0
        total = np.concatenate([[0], np.cumsum(self.count[gram])])
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(total, total[low] + PAIRS, side="right")) - 1)
            # a band's positions lie within a region's length, so parts overlap by that much
            stop = max(high, int(np.searchsorted(at, at[high - 1] + 2 * self.span + Q)))
            n = self.count[gram[low:stop]]
            i = np.repeat(self.first[gram[low:stop]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            owner = self.owner[i].astype(np.int64)
            band = (np.repeat(at[low:stop], n) - self.place[i]) // (self.edits[owner] + 1)
            size = int(at[-1]) + 4
            key, seen = np.unique(np.concatenate([owner * size + band + 2, owner * size + band + 1]), return_counts=True)
            key = key[seen >= self.need[key // size]]
            out.append(np.stack([key // size, key % size - 2], axis=1))
            low = high
        return np.unique(np.concatenate(out), axis=0)

    def matches(self, text: np.ndarray, at: np.ndarray, gram: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, end) of verified segments of one text; at: its positions with shared q-grams, in order."""
        out = []
        for n, band in self.bands(at, gram).tolist():
            item, s, e = self.segments[n]
            low = band * (e + 1)
            begin, end = max(0, low - e), min(len(text), low + 2 * (e + 1) + len(s) + e)
            if begin < end and (hit := aligned(s, string(text[begin:end]), e, low - begin)):
                out.append((item, begin + hit[0], begin + hit[1]))
        return out


def aligned(s: str, t: str, e: int, low: int) -> tuple[int, int] | None:
    """The first end in t, and a start, of a stretch within e edits of s. Diagonals (place in t minus place in s) run from low - e to low + 3e + 1."""
    if (i := t.find(s)) >= 0:
        return i, i + len(s)
    far = e + 1
    first, width = low - e, 4 * e + 2
    row = [0 if 0 <= first + d <= len(t) else far for d in range(width)]  # any start is free
    start = [first + d for d in range(width)]
    for i, c in enumerate(s):
        new, begun = [far] * width, [0] * width
        for d in range(width):
            j = first + d + i + 1  # characters of t used
            if not 0 <= j <= len(t):
                continue
            best, b = (row[d] + (j == 0 or t[j - 1] != c), start[d]) if j else (far, 0)
            if d + 1 < width and row[d + 1] + 1 < best:
                best, b = row[d + 1] + 1, start[d + 1]
            if d and new[d - 1] + 1 < best:
                best, b = new[d - 1] + 1, begun[d - 1]
            new[d], begun[d] = min(best, far), b
        row, start = new, begun
        if min(row) > e:
            return None
    d = min(range(width), key=row.__getitem__)
    return (max(0, start[d]), min(len(t), first + d + len(s))) if row[d] <= e else None


REGIONS = "doc_id bigint, n_regions bigint, items array<bigint>, regions array<struct<item: bigint, start: bigint, stop: bigint>>"


def merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Regions of an item that touch are one; in order of item and place."""
    out: list[tuple[int, int, int]] = []
    for item, s, e in sorted(found):
        if out and out[-1][0] == item and s <= out[-1][2]:
            out[-1] = (item, out[-1][1], max(e, out[-1][2]))
        else:
            out.append((item, s, e))
    return out


def close_ones(at: np.ndarray, gram: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Positions in windows, as long as the longest segment with its edits, that hold the least bound of shared q-grams."""
    close = np.searchsorted(at, at + index.span) - np.arange(len(at)) >= index.least
    edge = np.zeros(len(at) + 1, np.int64)
    i = np.flatnonzero(close)
    np.add.at(edge, i, 1)
    np.add.at(edge, np.searchsorted(at, at[i] + index.span), -1)
    keep = np.cumsum(edge[:-1]) > 0
    return at[keep], gram[keep]


def found_in(texts: list[bytes], index: Index) -> list[list[tuple[int, int, int]]]:
    """Verified regions of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not index.segments:
        return out
    whole = plain(b"\0".join([*texts, b""]))
    at, gram = index.shared(grams(whole))
    if not len(at):
        return out
    at, gram = close_ones(at, gram, index)
    if not len(at):
        return out
    ends = np.flatnonzero(whole == 0) + 1 if b"\0" not in b"".join(texts) else np.cumsum([len(plain(t)) + 1 for t in texts])
    doc = np.searchsorted(ends, at, side="right")
    for d in np.unique(doc).tolist():
        a, b = (int(ends[d - 1]) if d else 0), int(ends[d]) - 1
        mine = doc == d
        out[d] = merged(index.matches(whole[a:b], at[mine] - a, gram[mine]))
    return out


def regions_of(texts: pa.Array, index: Index) -> list[list[tuple[int, int, int]]]:
    return [f for _, some in groups(list(range(len(texts))), texts, CHUNK_BYTES) for f in found_in(text_bytes(some), index)]


KIND = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))


def structs(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[dict(zip(("item", "start", "stop"), x, strict=True)) for x in f] for f in found], KIND)


def searcher(index) -> Callable:  # noqa: ANN001  a broadcast
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = regions_of(batch.column("text"), index.value)
            items = [sorted({x[0] for x in f}) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(f) for f in found], pa.int64()), pa.array(items, pa.list_(pa.int64())), structs(found)], ["doc_id", "n_regions", "items", "regions"])
        trim()

    return run


def hits(index) -> Callable:  # noqa: ANN001  a broadcast
    """Only the rows that hold a region, by row number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = regions_of(batch.column("text"), index.value)
            yield pa.RecordBatch.from_arrays([batch.column("row"), structs(found)], ["row", "regions"]).filter(pa.array([bool(f) for f in found], pa.bool_()))
        trim()

    return run


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the benchmark, each of about BLOCK_BYTES of text. Items of one block are a hash's share of the items."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for i in range(n):
        yield Index([(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).toLocalIterator()])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: the benchmark items found in it and where."""
    sc, all_blocks = docs.sparkSession.sparkContext, blocks(benchmark)
    first, second = next(all_blocks), next(all_blocks, None)
    if second is None:
        return documents(docs).mapInArrow(searcher(sc.broadcast(first)), REGIONS).withColumn("contaminated", F.col("n_regions") > 0)
    base = staged(documents(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = None
    for index in (first, second, *all_blocks):
        part = staged(base.mapInArrow(hits(sc.broadcast(index)), "row bigint, regions array<struct<item: bigint, start: bigint, stop: bigint>>"), "regions")
        found = part if found is None else found.unionAll(part)
    by_row = found.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("regions"))).alias("regions"))
    got = base.select("row", "doc_id").join(by_row, "row", "left").withColumn("regions", F.coalesce("regions", F.array().cast("array<struct<item: bigint, start: bigint, stop: bigint>>")))
    items = F.array_sort(F.array_distinct("regions.item"))
    return got.select("doc_id", F.size("regions").cast("bigint").alias("n_regions"), items.alias("items"), "regions", (F.size("regions") > 0).alias("contaminated"))


def holds(index) -> Callable:  # noqa: ANN001  a broadcast
    @F.arrow_udf("boolean")
    def contaminated(texts: pa.Array) -> pa.Array:
        return pa.array([bool(f) for f in regions_of(texts, index.value)], pa.bool_())

    return contaminated


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no benchmark passage, all their columns as they are."""
    sc = docs.sparkSession.sparkContext
    names = {c.lower(): c for c in docs.columns}
    for index in blocks(benchmark):
        contaminated = holds(sc.broadcast(index))
        docs = docs.where(~contaminated(F.col(f"`{names['text']}`").cast("string")))
    return docs


def op1(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
