"""Packing by power-of-two decomposition.

A document of n ids becomes pieces of 2048 ids and then of the powers of two of the rest, largest first. Each piece is
a sequence of its own, already of a power-of-two length, so nothing is padded and no sequence crosses documents.
Pieces of equal length form a bucket: `bucket` is log2 of the length, for batches of equal shape.

Null or empty text has one id, the end. Repeated rows are packed each. Other columns are ignored. Sequence ids are
unique, from the input partition and the place in it.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, kept, trim

END = 1


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words remembered by a Python worker, over all its tasks, and characters of text worked on at once.
MOST_WORDS, PART_CHARS = 1_000_000, 1 << 20
PUNCTUATED = re.compile(r"([a-z]+)([.,;:!?|%&*$#]+)")
EMPTY = np.zeros(0, "<u4")


class Words:
    """Ids of whole texts, from those of their words.

    The tokenizer drops white space, never joins over it and lower-cases, so words can be kept apart, after A-Z are
    lower-cased. A letters-only word is one unit to it, as is a run of punctuation. Texts with special tokens' first
    characters go through the tokenizer whole.
    """

    def __init__(self, path: str, most: int = MOST_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.most = Tokenizer.from_file(path), {}, most

    def whole(self, words: list[str]) -> Iterator[bytes]:
        for i in range(0, len(words), 10_000):
            for e in self.tokenizer.encode_batch_fast(words[i : i + 10_000], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    def letters(self, words: list[str]) -> Iterator[bytes]:
        """Of letters-only words, many in one call."""
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            unit = np.array(e.word_ids, np.int64)
            if not len(unit) or unit[-1] != len(part) - 1 or len(np.unique(unit)) != len(part):
                yield from self.whole(part)
                continue
            raw, stop = np.array(e.ids, "<u4").tobytes(), (4 * np.searchsorted(unit, np.arange(len(part)), side="right")).tolist()
            at = 0
            for x in stop:
                yield raw[at:x]
                at = x

    def learn(self, words: list[str]) -> None:
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + 2 * len(new) > self.most:
            known.clear()
            new = words
        joined = [(w, *m.groups()) for w in new if (m := PUNCTUATED.fullmatch(w))]
        rest = {*new}.difference(w for w, _, _ in joined).union(x for _, *ends in joined for x in ends).difference(known)
        alone = [w for w in rest if w.isalpha()]
        known.update(zip(alone, self.letters(alone), strict=True))
        other = [w for w in rest if not w.isalpha()]
        known.update(zip(other, self.whole(other), strict=True))
        known.update((w, known[a] + known[b]) for w, a, b in joined)

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, then the end."""
        special = {i for i, t in enumerate(texts) if "<|" in t}
        plain = pa.array([t if "<|" not in t else "" for t in texts], pa.large_string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        coded = lists.values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        self.learn(names)
        own = [self.known[w] for w in names]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        begin = np.cumsum(sizes) - sizes
        table = np.frombuffer(b"".join(own), "<u4") if own else EMPTY
        word = coded.indices.to_numpy()
        n = sizes[word]
        done = np.concatenate([[0], np.cumsum(n)])
        ids = table[np.repeat(begin[word] - done[:-1], n) + np.arange(done[-1])] if len(word) else EMPTY
        at = done[lists.offsets.to_numpy()]
        end = np.array([END], "<u4")
        for i in range(len(texts)):
            if i in special:
                yield np.array([*self.tokenizer.encode(texts[i], add_special_tokens=False).ids, END], "<u4")
            else:
                yield np.concatenate([ids[at[i] : at[i + 1]], end])


def words_of(path: str, most: int) -> Words:
    """One for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("words", path, most), lambda: Words(path, most))


def parts(ids: list, texts: pa.Array) -> Iterator[tuple[list, list[str]]]:
    """Rows in groups of about PART_CHARS characters."""
    d, t, size = [], [], 0
    for i, x in zip(ids, texts, strict=True):
        d.append(i)
        t.append(x.as_py() or "")
        size += len(t[-1])
        if size > PART_CHARS:
            yield d, t
            d, t, size = [], [], 0
    if d:
        yield d, t


def pieces(n: int, full: int) -> list[tuple[int, int]]:
    """(start, length) of each piece."""
    out = [(s, full) for s in range(0, n - full + 1, full)]
    at, size = len(out) * full, full
    while size:
        if (n - at) & size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bucket int"


def packed(path: str, full: int, with_ids: bool = False, most: int = MOST_WORDS) -> Callable:
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids

    def rows(some: list, ids_of: list[np.ndarray]) -> pa.RecordBatch:
        """The pieces of some documents; their ids stand in one flat buffer, which the pieces cut up."""
        docs, starts, lengths, totals = [], [], [], []
        for d, ids in zip(some, ids_of, strict=True):
            cut = pieces(len(ids), full)
            docs += [d] * len(cut)
            totals += [len(ids)] * len(cut)
            for s, n in cut:
                starts.append(s)
                lengths.append(n)
        flat = np.concatenate([EMPTY, *ids_of])
        stops = np.cumsum(np.array([0, *lengths], np.int64))
        raw, at = memoryview(flat).cast("B"), (4 * stops).tolist()
        sums = [zlib.crc32(raw[x:y]) for x, y in zip(at, at[1:], strict=False)]
        columns = [pa.array(x, pa.int64()) for x in (docs, starts, lengths, sums, totals)] + [pa.array([n.bit_length() - 1 for n in lengths], pa.int32())]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(flat.view("<i4"))))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path, most)
        for batch in batches:
            for some, texts in parts(batch.column("doc_id").to_pylist(), batch.column("text")):
                yield rows(some, list(words.ids(texts)))
        trim()

    return run


def pack(docs: DataFrame, path: str | None = None, full: int = 2048, with_ids: bool = False, most: int = MOST_WORDS) -> DataFrame:
    """One row a piece; with_ids also its token ids."""
    out = documents(docs).mapInArrow(packed(path or tokenizer_path(), full, with_ids, most), PIECES + (", ids array<int>" if with_ids else ""))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), "bucket", *(["ids"] if with_ids else []))


op9 = pack
