"""Repeated fixed-length windows of tokens, found by minimiser.

Consecutive windows whose smallest m-gram is the same occurrence form a run. A run travels once, as one packed
string, to the bucket of that m-gram, so equal windows of any two documents meet in one bucket. Buckets are many
and small; their number follows the input. Copies of a run within a task's chunk are settled there: only those of
the smallest doc_id travel, so a passage in a third of all documents costs a bucket one run a chunk. A bucket that is
large all the same is settled in slices of window hashes, so its memory is bounded by a slice and one task's share.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ids_repeat, mix, source_bytes, staged, text_bytes, trim

_B = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Input bytes, as stored, for which a bucket is made, and for which a partition of buckets.
BUCKET_BYTES, PARTITION_BYTES = 1 << 20, 4 << 20
#: Windows of a bucket that are settled at once; more are settled in slices.
SLICE = 2_500_000
#: Payload bytes that a task gathers before it writes them out by bucket.
FLUSH_BYTES = 24 << 20


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = 1 << max(12, n.bit_length())
        out = []
        for base in (_B[which], pow(_B[which], -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _POWERS[which] = (out[0], out[1])
    return _POWERS[which]


class Rolled:
    """Hashes of any span of a sequence of 64-bit tokens, from one running sum."""

    def __init__(self, tokens: np.ndarray, which: int = 0):
        self.up, down = powers(which, len(tokens) + 1)
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * down[: len(tokens)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start])

    def every(self, length: int) -> np.ndarray:
        """The hash of each span of that length."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.up[:n])


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    n, cur, s = len(key) - width + 1, key, 1
    while 2 * s <= width:
        cur, s = np.minimum(cur[:-s], cur[s:]), 2 * s
    return np.minimum(cur[:n], cur[width - s : width - s + n]) if s < width else cur[:n]


#: Low bits of a key in which an m-gram's place is kept, under its hash.
PLACE_BITS = 24


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of each `width` m-grams, the first of equal ones; in slices that the place bits can count."""
    out = np.empty(max(0, len(grams) - width + 1), np.int64)
    place = np.uint64((1 << PLACE_BITS) - 1)
    room = (1 << PLACE_BITS) - width + 1
    for a in range(0, len(out), room):
        part = grams[a : a + room + width - 1]
        out[a : a + room] = sliding_min((part & ~place) | np.arange(len(part), dtype=np.uint64), width) & place
        out[a : a + room] += a
    return out


def runs_of(tokens: np.ndarray, ends: np.ndarray, k: int, m: int, buckets: int) -> tuple[np.ndarray, ...]:
    """start, windows, document, bucket and content hash of each run in documents that lie end to end."""
    n = len(tokens)
    none = np.zeros(0, np.int64)
    if n < k:
        return none, none, none, none, none.astype(np.uint64)
    rolled = Rolled(tokens)
    grams = rolled.every(m)
    low = minimisers(grams, k - m + 1)
    lens = np.diff(ends, prepend=0)
    left = np.repeat(ends, lens)[: n - k + 1] - np.arange(n - k + 1)
    ok = left >= k
    first = ok.copy()
    first[1:] &= ~(ok[:-1] & (low[1:] == low[:-1]))
    last = ok.copy()
    last[:-1] &= ~(ok[1:] & (low[1:] == low[:-1]))
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(ends, start, side="right")
    bucket = (grams[low[start]] % np.uint64(buckets)).astype(np.int64)
    stop = end + k - 1
    content = mix(rolled.of(start, stop) + (stop - start).astype(np.uint64))
    return start, end - start, doc, bucket, content


def pack(rows: list[tuple]) -> bytes:
    """rows: arrays of document, text hash, start, windows, payload length, and the payload."""
    ids, rid, start, count, size = (np.concatenate([r[i] for r in rows]) for i in range(5))
    head = struct.pack("<q", len(ids)) + np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes() + rid.astype("<i8").tobytes() + start.astype("<i4").tobytes() + count.astype("<i4").tobytes() + size.astype("<i4").tobytes()
    return struct.pack("<q", int(count.sum())) + zstandard.ZstdCompressor(level=1).compress(head + b"".join(r[5] for r in rows))


def windows_in(blob: bytes) -> int:
    return struct.unpack_from("<q", blob)[0]


def unpack(blob: bytes) -> tuple:
    raw = zstandard.ZstdDecompressor().decompress(blob[8:])
    (n,) = struct.unpack_from("<q", raw)
    at, out = 8, []
    for kind in ("<i8", "<i8", "<i4", "<i4", "<i4"):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * int(kind[-1])
    out[0] = np.cumsum(out[0])
    return (*out, raw[at:])


PACKED = "bucket int, blob binary"


def send(chunks: Callable[[Iterable[pa.RecordBatch]], Iterator[tuple]], k: int, m: int, buckets: int, keep_rid: bool) -> Callable:
    """The map side. chunks gives tokens, document ends, ids, text hashes and a function from token spans to bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = sorted(held)
            for i in range(0, len(keys), 64):
                part = keys[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([pack(held[b]) for b in part], pa.binary())], ["bucket", "blob"])
            held.clear()

        for tokens, ends, ids, rids, cut in chunks(batches):
            start, count, doc, bucket, content = runs_of(tokens, ends, k, m, buckets)
            if not len(start):
                continue
            base = np.concatenate([[0], ends])[doc]
            own, rid = ids[doc], rids[doc] if keep_rid else np.zeros(len(doc), np.int64)
            # copies within the chunk: the smallest doc_id speaks for the others, whose windows all repeat an earlier document
            order = np.lexsort((own, content))
            sorted_content, sorted_own = content[order], own[order]
            head = np.flatnonzero(np.concatenate([[True], sorted_content[1:] != sorted_content[:-1]]))
            least = np.repeat(sorted_own[head], np.diff(np.append(head, len(order))))
            later = np.zeros(len(order), bool)
            later[order] = sorted_own > least
            if later.any():
                i = np.flatnonzero(later)
                held.setdefault(-1 - int(ids[0]) % buckets, []).append((own[i], rid[i], start[i] - base[i], count[i], np.zeros(len(i), np.int64), b""))
            i = np.flatnonzero(~later)
            i = i[np.argsort(bucket[i], kind="stable")]
            at = np.flatnonzero(np.concatenate([[True], bucket[i][1:] != bucket[i][:-1]]))
            for a, b in zip(at, np.append(at[1:], len(i)), strict=True):
                j = i[a:b]
                parts = cut(start[j], start[j] + count[j] + k - 1)
                held.setdefault(int(bucket[j[0]]), []).append((own[j], rid[j], start[j] - base[j], count[j], np.fromiter(map(len, parts), np.int64, len(parts)), b"".join(parts)))
                size += len(held[int(bucket[j[0]])][-1][5])
            if size > FLUSH_BYTES:
                yield from flush()
                size = 0
        yield from flush()
        trim()

    return run


RANGES = "doc_id bigint, rid bigint, start int, stop int"


def settle(ranks: Callable, keys: Callable, k: int) -> Callable:
    """The reduce side: of each bucket, the windows that also start in a document with a smaller doc_id, as token ranges."""

    def ranges(ids: np.ndarray, rid: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rid, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["doc_id", "rid", "start", "stop"])

    def covered(ids: np.ndarray, rid: np.ndarray, start: np.ndarray, count: np.ndarray, repeated: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Ranges of the windows that are repeated; windows lie run by run."""
        at = np.flatnonzero(repeated)
        if not len(at):
            return
        begin = np.cumsum(count) - count
        r = np.searchsorted(begin, at, side="right") - 1
        within = at - begin[r]
        first = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (r[1:] != r[:-1])])
        last = np.append(first[1:], True)
        r = r[first]
        yield ranges(ids[r], rid[r], start[r] + within[first], start[r] + within[last] + k)

    def whole(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(b) for b in blobs]
        ids, rid, start, count = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(4))
        own = np.repeat(ids, count)
        repeated = np.zeros(len(own), bool)
        at, least = ranks(parts, count, own)
        repeated[at] = own[at] > least
        del own, at, least, parts
        yield from covered(ids, rid, start, count, repeated)

    def sliced(blobs: list[bytes], slices: int) -> Iterator[pa.RecordBatch]:
        """The same by the least document of each window hash, a slice of the hashes at a time; one task's share is unpacked at a time."""
        marks: list[np.ndarray | None] = [None] * len(blobs)

        def of(blob: bytes, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
            part = unpack(blob)
            key = keys(part)
            at = np.flatnonzero(key % np.uint64(slices) == which)
            return key[at], np.repeat(part[0], part[3])[at], at, len(key)

        def least(key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(key, kind="stable")
            key, own = key[order], own[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            return key[head], np.minimum.reduceat(own, head) if len(head) else own

        for which in range(slices):
            table, held, size = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0
            for blob in blobs:
                held.append(least(*of(blob, which)[:2]))
                size += len(held[-1][0])
                if size > SLICE // 2 or blob is blobs[-1]:
                    table = least(*(np.concatenate([table[i], *(h[i] for h in held)]) for i in (0, 1)))
                    held, size = [], 0
            for i, blob in enumerate(blobs):
                key, own, at, n = of(blob, which)
                flags = np.zeros(n, bool)
                flags[at[own > table[1][np.searchsorted(table[0], key)]]] = True
                bits = np.packbits(flags)
                marks[i] = bits if marks[i] is None else marks[i] | bits
        for blob, bits in zip(blobs, marks, strict=True):
            ids, rid, start, count = (x.astype(np.int64) for x in unpack(blob)[:4])
            yield from covered(ids, rid, start, count, np.unpackbits(bits, count=int(count.sum())).astype(bool))

    def bucket_of(blobs: list[bytes], settled: bool) -> Iterator[pa.RecordBatch]:
        if settled:  # runs that a task has found repeated itself
            for blob in blobs:
                ids, rid, start, count = (x.astype(np.int64) for x in unpack(blob)[:4])
                yield ranges(ids, rid, start, start + count + k - 1)
            return
        windows = sum(windows_in(b) for b in blobs)
        yield from (whole(blobs) if windows <= SLICE else sliced(blobs, -(-windows // SLICE)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != now and blobs:
                    yield from bucket_of(blobs, now < 0)
                    blobs = []
                now = b
                blobs.append(blob)
        if blobs:
            yield from bucket_of(blobs, now < 0)
        trim()

    return run


def group_least(keys: tuple[np.ndarray, ...], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose keys are shared, sorted by key, and for each the smallest document of its group."""
    order = np.argsort(keys[0])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        s = key[order]
        new[1:] |= s[1:] != s[:-1]
    alone = new & np.append(new[1:], True)
    order, new = order[~alone], new[~alone]
    if not len(order):
        return order, own[:0]
    head = np.flatnonzero(new)
    return order, np.repeat(np.minimum.reduceat(own[order], head), np.diff(np.append(head, len(order))))


def repeated_ranges(docs: DataFrame, chunks: Callable, ranks: Callable, keys: Callable, k: int, m: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(documents with rid, their repeated token ranges by doc_id and rid). Rows with a null doc_id or text take no part."""
    buckets = max(12, -(-source_bytes(docs) // BUCKET_BYTES))
    keep_rid = ids_repeat(docs)
    base = documents(docs).select("doc_id", F.xxhash64("text").alias("rid") if keep_rid else F.lit(0).cast("bigint").alias("rid"), "text")
    packed = base.where("doc_id is not null and text is not null").mapInArrow(send(chunks, k, m, buckets, keep_rid), PACKED)
    partitions = max(12, -(-source_bytes(docs) // PARTITION_BYTES))
    found = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(settle(ranks, keys, k), RANGES)
    return base, staged(found, name)


SQUEEZED = "doc_id bigint, rid bigint, body binary"


def squeeze(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed UTF-8, for their way through a shuffle."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        body = [z.compress(t) for t in text_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(body, pa.binary())], ["doc_id", "rid", "body"])


def cut_documents(base: DataFrame, found: DataFrame, cutter: Callable, schema: str) -> DataFrame:
    """Each document with its ranges, through cutter(text bytes, [(start, stop)]) to a row. Ranges of one document are as many as its length allows."""
    of = found.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    joined = base.mapInArrow(squeeze, SQUEEZED).join(of, ["doc_id", "rid"], "left").select("doc_id", "body", "cuts")
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for d, body, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for c in sorted((c["start"], c["stop"]) for c in cuts or ()):
                    if spans and c[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], c[1])
                    else:
                        spans.append([*c])
                rows.append((d, *cutter(z.decompress(body), spans)))
            yield pa.RecordBatch.from_arrays([pa.array(x) if i else pa.array(x, pa.int64()) for i, x in enumerate(zip(*rows, strict=True))] if rows else [pa.array([])] * len(names), names)

    return joined.mapInArrow(run, schema)
