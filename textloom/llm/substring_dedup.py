"""Substring dedup by super-k-mer partitioning.

A window is k consecutive words of one document. Consecutive windows that share a minimiser travel as one packed
string to the minimiser's bucket, where the windows are sorted and counted exactly on interned words.

Null or empty text, and texts shorter than a window: no window, nothing removed. Rows with a null doc_id stay whole
and are no source. Rows that share a doc_id are judged each for itself, never against each other. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import runs
from .common import text_bytes

CHUNK_WORDS = 1 << 20


class Intern(dict):
    """Words to well-spread 64-bit numbers, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    known, words, ends, ids, rids = Intern(), [], [], [], []

    def out() -> tuple:
        tokens = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        joined = b" ".join(words)

        def cut(start: np.ndarray, end: np.ndarray) -> list[bytes]:
            a, b = np.where(start > 0, stops[start - 1], 0).tolist(), (stops[end - 1] - 1).tolist()
            return [joined[x:y] for x, y in zip(a, b, strict=True)]

        return tokens, np.array(ends), np.array(ids, np.int64), np.array(rids, np.int64), cut

    for batch in batches:
        for d, r, t in zip(batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist(), text_bytes(batch.column("text")), strict=True):
            words += t.split()  # of bytes, this splits at exactly space, tab, LF, VT, FF and CR
            ends.append(len(words))
            ids.append(d)
            rids.append(r)
            if len(words) > CHUNK_WORDS:
                yield out()
                words, ends, ids, rids = [], [], [], []
    if words:
        yield out()


def ranks(k: int):
    def of(parts: list[tuple], count: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows sorted by two hashes of their interned words, which are exact names within the bucket."""
        intern: dict[bytes, int] = {}
        keys = [[], []]
        for part in parts:
            payload, at = part[5], 0
            sizes, n = part[4], part[3]
            for i in range(0, len(n), 5000):
                size, c = int(sizes[i : i + 5000].sum()), n[i : i + 5000].astype(np.int64)
                # payloads have no separator between them, so each is split for itself
                stops = (at + np.cumsum(sizes[i : i + 5000].astype(np.int64))).tolist()
                words: list[bytes] = []
                a = at
                for b in stops:
                    words += payload[a:b].split(b" ")
                    a = b
                at += size
                names = np.fromiter((intern.setdefault(w, len(intern)) for w in words), np.uint64, len(words))
                base = np.cumsum(c + k - 1) - (c + k - 1)
                start = np.repeat(base - (np.cumsum(c) - c), c) + np.arange(c.sum())
                for which in (0, 1):
                    keys[which].append(runs.Rolled(runs.mix(names + np.uint64(1 + which)), which).of(start, start + k))
        return runs.group_least(tuple(np.concatenate(x) for x in keys), own)

    return of


def keys(k: int):
    def of(part: tuple) -> np.ndarray:
        """A hash of the k words of each window of one task's share of a bucket."""
        count, known, words, a = part[3].astype(np.int64), Intern(), [], 0
        for b in np.cumsum(part[4].astype(np.int64)).tolist():
            words += part[5][a:b].split(b" ")
            a = b
        names = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        base = np.cumsum(count + k - 1) - (count + k - 1)
        start = np.repeat(base - (np.cumsum(count) - count), count) + np.arange(count.sum())
        one, two = (runs.Rolled(runs.mix(names + np.uint64(1 + i)), i).of(start, start + k) for i in (0, 1))
        return runs.mix(one + runs.mix(two))

    return of


def substring_dedup(docs: DataFrame, k: int = 50, m: int = 4) -> tuple[DataFrame, DataFrame]:
    """(documents, repeated word ranges): start and stop count words; a range is covered by windows that also start in a smaller doc_id."""
    return runs.repeated_ranges(docs, chunks, ranks(k), keys(k), k, min(m, k), "superkmers")


def kept_words(text: bytes, spans: list[list[int]]) -> tuple[int, int, bytes]:
    words = text.split()
    out, at = [], 0
    for a, b in spans:
        out += words[at:a]
        at = b
    out += words[at:]
    return len(words), len(words) - len(out), b" ".join(out)


def digest(text: bytes, spans: list[list[int]]) -> tuple[int, int, str]:
    n, removed, kept = kept_words(text, spans)
    return n, removed, hashlib.sha256(kept).hexdigest()


def op5(docs: DataFrame, k: int = 50) -> DataFrame:
    base, found = substring_dedup(docs, k)
    return runs.cut_documents(base, found, digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
