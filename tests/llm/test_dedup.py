import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from textloom.llm import runs
from textloom.llm.substring_dedup import op5
from textloom.llm.suffix_dedup import op10

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType()), T.StructField("bucket", T.LongType())])


def brute(rows, tokens, k):
    seen = {}
    for d, t in rows:
        if d is not None:
            w = tokens(t or "")
            for i in range(len(w) - k + 1):
                key = tuple(w[i : i + k])
                seen[key] = min(seen.get(key, d), d)
    out = []
    for d, t in rows:
        w, gone = tokens(t or ""), set()
        for i in range(len(w) - k + 1):
            if d is not None and seen[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out.append((d, len(w), gone, [x for i, x in enumerate(w) if i not in gone]))
    return out


def corpus(n=60, seed=1, words=400):
    r = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"v{i}" for i in range(words)]
    passage = [r.choice(vocab) for _ in range(70)]
    rows = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(1, 160))]
        if i % 3 == 0:
            at = r.randint(0, len(w))
            w[at:at] = passage[r.randint(0, 15) :]
        if i % 10 == 4:
            w = rows[r.randint(0, len(rows) - 1)][1].split()
            if r.random() < 0.6 and w:
                w[r.randint(0, len(w) - 1)] = "edit"
        rows.append((i * 7 % n, "  ".join(w[:5]) + "\n" + "\t".join(w[5:])))
    return [*rows, (200, None), (201, ""), (202, " \n"), (None, rows[0][1]), (203, "  x" * 60), (204, "  x" * 60), (205, "aaaa" * 100), (206, "ba" + "a" * 300), (207, "same words " * 300)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "extra", 3) for d, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("seed", "at_once"), [(1, 1 << 30), (2, 60)])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, seed, at_once):
    monkeypatch.setattr(runs, "SLICE", at_once)
    rows = corpus(seed=seed)
    got = sorted(map(str, (tuple(x) for x in op5(frame(spark, rows)).collect())))
    want = []
    for d, n, gone, kept in brute([(d, (t or "").encode()) for d, t in rows], lambda t: (t or b"").split(), 50):
        want.append(str((d, n, len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())))
    assert got == sorted(want)


@pytest.mark.parametrize("at_once", [1 << 30, 500])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(runs, "SLICE", at_once)
    rows = corpus(40)
    got = sorted(map(str, (tuple(x) for x in op10(frame(spark, rows)).collect())))
    want = []
    for d, n, gone, kept in brute([(d, (t or "").encode()) for d, t in rows], lambda t: list(t or b""), 50):
        spans = sum(1 for i in gone if i - 1 not in gone)
        want.append(str((d, n, len(gone), spans, hashlib.sha256(bytes(kept)).hexdigest())))
    assert got == sorted(want)


def test_windows_behind_the_last_place_meet_their_equals(monkeypatch):
    monkeypatch.setattr(runs, "PLACE_BITS", 8, raising=False)
    r = np.random.default_rng(5)
    tokens = runs.mix(r.integers(0, 50, 2000).astype(np.uint64))
    grams = runs.Rolled(tokens).every(4)
    low = runs.minimisers(grams, 47)
    assert [int(x) for x in low] == [i + min(range(47), key=lambda j: (int(grams[i + j]) >> 8, j)) for i in range(len(grams) - 46)]
    passage = tokens[:80]
    far = np.concatenate([passage, tokens[100:1500], passage])
    start, count, _, bucket, _ = runs.runs_of(far, np.array([80, 1480, 1560]), 50, 4, 1 << 40)
    of = np.repeat(bucket, count)[np.argsort(np.concatenate([np.arange(a, a + n) for a, n in zip(start, count, strict=True)]))]
    assert (of[:31] == of[-31:]).all()


def test_a_chunk_of_more_than_2_24_tokens():
    r = np.random.default_rng(6)
    tokens = r.integers(0, 1 << 63, (1 << 24) + 500).astype(np.uint64)
    tokens[-100:] = tokens[:100]
    start, count, _, bucket, _ = runs.runs_of(tokens, np.array([100, len(tokens) - 100, len(tokens)]), 50, 16, 1 << 40)
    assert sum(count[start < 100]) == sum(count[start >= len(tokens) - 100]) == 51
    assert bucket[start < 100].tolist() == bucket[start >= len(tokens) - 100].tolist()


@pytest.mark.parametrize("op", [op5, op10])
def test_repeated_ids_and_empty_tables(spark, op):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, long), (1, long), (1, "other " + long), (2, long)]
    got = sorted(tuple(x)[:3] for x in op(frame(spark, rows)).collect())
    assert [x[2] for x in got] == [0, 0, 0, got[3][1]]
    assert op(frame(spark, rows).limit(0)).collect() == []
