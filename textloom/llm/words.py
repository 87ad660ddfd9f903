"""Words of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def hashed_words(texts: pa.Array | list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text, code of each word, 64-bit hash of each code). Words are runs of anything but space and \\x09-\\x0D; A-Z are lower-cased."""
    plain = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain) if lower else plain)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    codes = coded.indices.to_numpy()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names)).astype(np.int64)
    sizes = np.diff(offsets)
    if b"" in names:
        full = codes != names.index(b"")
        sizes = np.diff(np.concatenate([[0], np.cumsum(full)])[offsets])
        codes = codes[full]
    return sizes, codes, hashes


def signs(texts: pa.Array, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of each different word of a text, and of each different beginning of `prefix` characters."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    starts = pc.utf8_slice_codeunits(coded.dictionary, 0, prefix).cast(pa.large_binary()).to_pylist()
    word = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
    start = np.fromiter((xxhash.xxh64_intdigest(x + b" ") for x in starts), np.uint64, len(starts))
    full = np.fromiter(map(len, names), np.int64, len(names)) > 0
    long = pc.utf8_length(coded.dictionary).to_numpy() >= prefix
    a, b = full[codes], long[codes]
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start, begins = np.unique(start, return_inverse=True)
    each = np.concatenate([word, start])
    key = np.unique(np.concatenate([doc[a] * len(each) + codes[a], doc[b] * len(each) + len(word) + begins[codes[b]]]))
    return key // len(each), each[key % len(each)]


def groups(rows: list, texts: pa.Array, chars: int):
    """Rows and their texts in groups of about so many bytes."""
    lens = np.maximum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 1)
    part = np.cumsum(lens) // chars
    cut = np.flatnonzero(np.diff(part, prepend=-1, append=-1) != 0).tolist() if len(lens) else []
    for a, b in zip(cut, cut[1:], strict=False):
        yield rows[a:b], texts.take(pa.array(np.arange(a, b)))  # a copy: Arrow splits a slice of lower-cased texts wrongly
