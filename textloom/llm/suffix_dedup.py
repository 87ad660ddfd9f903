"""Suffix-array dedup by distributed prefix doubling, on bytes.

The order of positions is only needed where it decides equality over `k` bytes, so the global sort is cut into
independent ones: positions travel to the bucket of their window's minimiser (all equal windows share it), with the
bytes they need. There, rank pairs (rank at i, rank at i + length) are sorted at growing offsets; a position whose rank
is unique leaves before the next doubling, and doubling ends once the rank spans k bytes.

Null or empty text, and texts shorter than k bytes: nothing removed. Rows with a null doc_id stay whole and are no
source. Rows that share a doc_id are judged each for itself. Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import runs
from .common import mix, text_bytes

CHUNK_BYTES = 1 << 21
#: A 64-bit number for each byte value.
BYTE = [mix(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(s)) for s in (1, 2)]


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    texts, ids, rids, size = [], [], [], 0

    def out() -> tuple:
        joined = b"".join(texts)
        tokens = BYTE[0][np.frombuffer(joined, np.uint8)]

        def cut(start: np.ndarray, end: np.ndarray) -> list[bytes]:
            return [joined[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)]

        return tokens, np.cumsum([len(t) for t in texts]), np.array(ids, np.int64), np.array(rids, np.int64), cut

    for batch in batches:
        for d, r, t in zip(batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist(), text_bytes(batch.column("text")), strict=True):
            if size and size + len(t) > CHUNK_BYTES:
                yield out()
                texts, ids, rids, size = [], [], [], 0
            texts.append(t)
            ids.append(d)
            rids.append(r)
            size += len(t)
    if texts:
        yield out()


def ranks(k: int, first: int):
    def spans(parts: list[tuple], length: int, keep: np.ndarray | None, offset: int, which: int) -> np.ndarray:
        """The rank (a hash of `length` bytes) at `offset` behind each window start that is kept."""
        out, done = [], 0
        for part in parts:
            raw, count, size = np.frombuffer(part[5], np.uint8), part[3].astype(np.int64), part[4].astype(np.int64)
            begin = np.cumsum(size) - size
            for i in range(0, len(count), 20_000):
                c = count[i : i + 20_000]
                a, b = begin[i], begin[i : i + 20_000][-1] + size[i : i + 20_000][-1]
                start = np.repeat(begin[i : i + 20_000] - a - (np.cumsum(c) - c), c) + np.arange(c.sum())
                if keep is not None:
                    start = start[keep[done : done + len(start)]]
                done += int(c.sum())
                at = start + offset
                out.append(runs.Rolled(BYTE[which][raw[a:b]], which).of(at, at + length) if len(at) else at.astype(np.uint64))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def of(parts: list[tuple], count: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alive, length = None, first
        rank = spans(parts, length, None, 0, 0)
        while True:
            who = own if alive is None else own[alive]
            order, least = runs.group_least((rank,), who)
            stay = np.zeros(len(rank), bool)
            stay[order] = True
            if alive is None:
                alive = stay
            else:
                alive[np.flatnonzero(alive)[~stay]] = False
            if length >= k:
                # equal ranks are confirmed by a second hash of all k bytes
                places, second = np.flatnonzero(alive), spans(parts, k, alive, 0, 1)
                order, least = runs.group_least((rank[stay], second), own[places])
                return places[order], least
            if not len(order):
                return order, least
            step = min(length, k - length)  # the pair (rank at i, rank at i + step) spans length + step bytes
            rank = mix(rank[stay] ^ np.uint64(0xA5A5)) + spans(parts, length, alive, step, 1)
            length += step

    return of


def keys(k: int):
    def of(part: tuple) -> np.ndarray:
        """A hash of the k bytes of each window of one task's share of a bucket."""
        raw, count, size = np.frombuffer(part[5], np.uint8), part[3].astype(np.int64), part[4].astype(np.int64)
        start = np.repeat(np.cumsum(size) - size - (np.cumsum(count) - count), count) + np.arange(count.sum())
        one, two = (runs.Rolled(BYTE[i][raw], i).of(start, start + k) for i in (0, 1))
        return mix(one + mix(two))

    return of


def suffix_dedup(docs: DataFrame, k: int = 50, m: int = 16) -> tuple[DataFrame, DataFrame]:
    """(documents, repeated byte ranges)."""
    return runs.repeated_ranges(docs, chunks, ranks(k, -(-k // 2)), keys(k), k, min(m, k), "suffixes")


def kept_bytes(text: bytes, spans: list[list[int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def digest(text: bytes, spans: list[list[int]]) -> tuple[int, int, int, str]:
    kept = kept_bytes(text, spans)
    return len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()


def op10(docs: DataFrame, k: int = 50) -> DataFrame:
    base, found = suffix_dedup(docs, k)
    return runs.cut_documents(base, found, digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
