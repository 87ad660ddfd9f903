import random
import re

import pytest
from pyspark.sql import types as T

from textloom.llm import components as components_module
from textloom.llm import near_dedup
from textloom.llm.components import components
from textloom.llm.near_dedup import one_of_each, op7

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("component_id", T.LongType())])


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(rows, k):
    s = [(d, shingles(t, k)) for d, t in rows if d is not None]
    root = {d: d for d, _ in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((str(d), len(shingles(t, k)), str(None if d is None else find(d))) for d, t in rows)


def corpus(seed, n, spread=60, edits=12):
    r = random.Random(seed)
    vocab = [f"W{i}" for i in range(spread)]
    rows = [(1000, None), (1001, ""), (1002, " \t"), (None, "a b c"), (1003, "one"), (1004, "ONE"), (1005, "\x0bone "), (1006, "a b c")]
    bases = [[r.choice(vocab) for _ in range(r.randint(1, 120))] for _ in range(n // 6)]
    for i in range(n):
        w = list(r.choice(bases)) if r.random() < 0.7 else [r.choice(vocab) for _ in range(r.randint(1, 80))]
        for _ in range(r.randint(0, edits) if r.random() < 0.8 else 0):
            w[r.randrange(len(w))] = f"e{r.randint(0, 999)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "k", "small"), [(1, 2, 256), (2, 5, 256), (3, 2, 4)])
def test_components_equal_brute_force(spark, monkeypatch, seed, k, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rows = corpus(seed, 300)
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in op7(frame(spark, rows), k).collect())
    assert got == brute(rows, k)


def test_one_group_of_near_copies_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 16)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = random.Random(9)
    base = [f"v{r.randint(0, 500)}" for _ in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(200)] = f"e{r.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    rows += rows[:3]
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in op7(frame(spark, rows), 2).collect()) == brute(rows, 2)


def test_one_of_each_keeps_the_first(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (9, "x y z"), (10, ""), (11, None), (None, "a b c d e f g")]
    assert sorted(str(x.doc_id) for x in one_of_each(frame(spark, rows)).collect()) == ["10", "11", "3", "9", "None"]
    assert op7(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_of_a_path_a_hub_and_a_ring(spark, monkeypatch, one_task):
    monkeypatch.setattr(components_module, "ONE_TASK", one_task)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a bigint, b bigint").repartition(8)).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200 + i: 200 for i in range(7)}
