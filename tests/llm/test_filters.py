import math
import random
import time
from collections import Counter

import pytest
import xxhash
from pyspark.sql import types as T

from textloom.llm import decontamination as dc
from textloom.llm import quality_classifier as qc

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_regions", T.StringType()), T.StructField("key", T.LongType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)


def within(s, t, e):
    """Whether a stretch of t is within e edits of s."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(s):
        new = [i + 1]
        for j, d in enumerate(t):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row) <= e


def edited(r, text, n):
    t = list(text)
    for _ in range(n):
        i = r.randrange(len(t))
        t[i : i + 1] = r.choice([[], ["#"], [t[i], "~"]])
    return "".join(t)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(n))
    items = [(i, prose(r.choice([4, 12, 30, 60]))) for i in range(12)] + [(50, None), (51, ""), (52, "abc"), (None, "x" * 40), (53, "twice twice twice twice twice twice")]
    rows = [(0, None), (1, ""), (None, items[2][1]), (2, "short"), (3, "x" * 300), (3, "x" * 300)]
    for i in range(10, 130):
        t = prose(r.randint(0, 60))
        if i % 2:
            s = items[r.randrange(12)][1]
            if i % 3 == 0:
                s = s[len(s) // 3 :]
            t = t[: len(t) // 2] + edited(r, s, r.randint(0, 8)).upper() + "\n" + t[len(t) // 2 :]
        rows.append((i, t))
    index = dc.Index(items)
    got = sorted((str(x.doc_id), tuple(x["items"]), x.contaminated) for x in dc.decontaminate(frame(spark, rows), spark.createDataFrame(items, ITEMS)).collect())
    want = []
    for d, t in rows:
        x = dc.string(dc.plain((t or "").encode()))
        hit = tuple(sorted({item for item, s, e in index.segments if within(s, x, e)}))
        want.append((str(d), hit, bool(hit)))
    assert got == sorted(want)
    kept = sorted(str(x.doc_id) for x in dc.clean(frame(spark, rows), spark.createDataFrame(items, ITEMS)).collect())
    assert kept == sorted(d for d, _, c in want if not c)
    assert not any(x.contaminated for x in dc.decontaminate(frame(spark, rows), spark.createDataFrame([], ITEMS)).collect())
    assert dc.decontaminate(frame(spark, rows).limit(0), spark.createDataFrame(items, ITEMS)).collect() == []


@pytest.mark.parametrize("block", [1 << 30, 300])
def test_blocks_of_the_benchmark_do_not_change_rows(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    r = random.Random(5)
    items = [(i, " ".join("".join(r.choice("abcdé") for _ in range(6)) for _ in range(25))) for i in range(9)]
    rows = [(0, None), (1, ""), (2, items[0][1] + " and " + items[5][1]), (2, items[0][1] + " and " + items[5][1]), (3, "x " * 200 + items[8][1]), (None, items[3][1]), (4, "nothing of it")]
    got = sorted((str(x.doc_id), x.n_regions, tuple(x["items"]), x.contaminated, tuple(tuple(y) for y in x.regions)) for x in dc.decontaminate(frame(spark, rows), spark.createDataFrame(items, ITEMS)).collect())
    one = lambda i, at: (i, at, at + len(items[i][1]))
    two = (2, (0, 5), True, (one(0, 0), one(5, len(items[0][1]) + 5)))
    assert got == sorted([("0", 0, (), False, ()), ("1", 0, (), False, ()), ("2", *two), ("2", *two), ("3", 1, (8,), True, (one(8, 400),)), ("None", 1, (3,), True, (one(3, 0),)), ("4", 0, (), False, ())])
    assert sorted(str(x.doc_id) for x in dc.clean(frame(spark, rows), spark.createDataFrame(items, ITEMS)).collect()) == ["0", "1", "4"]


def test_edits_count_characters_not_bytes():
    item = "".join(chr(0x430 + i % 30) for i in range(96))
    text = list(item)
    for i in range(5, 96, 16):
        text[i] = "é"  # six changed characters, twelve changed bytes
    index = dc.Index([(1, item)])
    assert dc.found_in([("vor " + "".join(text) + " nach").encode()], index) == [[(1, 4, 100)]]


def test_a_repetitive_text_and_item():
    index = dc.Index([(1, "a" * 200), (2, "ab" * 60)])
    began = time.process_time()
    assert [x[0] for x in dc.found_in([b"a" * 300_000], index)[0]] == [1]
    assert time.process_time() - began < 30


def corpus(r, n):
    rows, labels = [(0, None), (1, ""), (2, " \n")], [(0, 1, 0), (1, None, None)]
    for i in range(10, n):
        kind = r.random()
        w = [f"w{min(r.randint(0, 400), r.randint(0, 400))}" for _ in range(r.randint(15, 120))]
        if kind < 0.15:
            w = [x + r.choice(["%%%", "&&&"]) for x in w]
        elif kind < 0.22:
            for _ in range(8):
                w.insert(r.randrange(len(w)), r.choice(["slur", "insult"]))
        rows.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, int(kind >= 0.15), int(0.15 <= kind < 0.22)))
    return rows, labels, {d: t for d, t in rows}


def test_classifier_on_held_out_documents(spark):
    rows, labels, text = corpus(random.Random(6), 3000)
    rows.append(rows[50])
    got = {x.doc_id: x for x in qc.classify(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    labelled = {d for d, _, _ in labels}
    assert not any(got[d].selected for d in (0, 1, 2))
    rest = [d for d in got if d is not None and d > 9 and d not in labelled]
    junk = [d for d in rest if "%%%" in text[d] or "&&&" in text[d]]
    toxic = [d for d in rest if "slur" in text[d] or "insult" in text[d]]
    good = [d for d in rest if d not in {*junk, *toxic}]
    share = lambda ds: sum(got[d].selected for d in ds) / len(ds)
    assert share(good) > 0.985 and share(junk) < 0.02 and share(toxic) < 0.5
    kept = {x.doc_id for x in qc.select(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert kept == {d for d, x in got.items() if x.selected}


def test_statistics_and_selection_equal_brute_force(spark):
    rows, labels, text = corpus(random.Random(11), 400)
    rows.append(rows[60])
    got = qc.classify(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    ids = lambda keep: sorted((d for d, q, t in labels if keep(q, t)), key=lambda d: (order[d], d))
    order = {x.doc_id: x.h for x in spark.createDataFrame(labels, LABELS).selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    good, bad = ids(lambda q, t: q == 1 and t == 0), ids(lambda q, t: t == 1)
    seen, toxic_seen = set(good[::2]), set(bad[::2])

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    words = lambda t: [w.lower().encode() for w in (t or "").split()]

    def grams(t):
        one = [mixed(xxhash.xxh64_intdigest(w)) for w in words(t)]
        return [x % qc.BUCKETS for x in one] + [mixed((a * 31 + b) % 2**64) % qc.BUCKETS for a, b in zip(one, one[1:], strict=False)]

    def signs(t):
        own = set(words(t))
        return [mixed(h) % qc.BUCKETS for h in {xxhash.xxh64_intdigest(w) for w in own} | {xxhash.xxh64_intdigest(w[:5] + b" ") for w in own if len(w) >= 5}]

    raw, target, n_good, n_toxic = Counter(), Counter(), Counter(), Counter()
    for d, t in rows:
        raw.update(grams(t))
        if d in seen:
            target.update(grams(t))
            n_good.update(signs(t))
        if d in toxic_seen:
            n_toxic.update(signs(t))
    scale = sum(target.values()) / sum(raw.values())
    ratio = lambda b, a: math.log((target[b] + a) / (raw[b] * scale + a))
    a, z = sum(d in seen for d, _ in rows), sum(d in toxic_seen for d, _ in rows)
    share = lambda c, n: (c + qc.SMOOTH_TOXIC * n / (a + z)) / (n + qc.SMOOTH_TOXIC)
    sign = lambda b: max(0.0, math.log(share(n_toxic[b], z) / share(n_good[b], a)) - qc.CLEAR)
    for x in got:
        g = grams(text.get(x.doc_id))
        assert x.n_grams == len(g)
        if g:
            assert x.mean_ratio == pytest.approx(sum(ratio(b, qc.SMOOTH_MEAN) for b in g) / len(g), abs=1e-5)
            assert x.rare_ratio == pytest.approx(sum(min(ratio(b, qc.SMOOTH_RARE) + 1, 0) for b in g) / math.sqrt(len(g)), abs=1e-4)
            assert x.toxic_signs == pytest.approx(sum(map(sign, signs(text[x.doc_id]))), abs=1e-4)
    # the k rows with the largest keys are selected, and the noise is Gumbel noise at the temperature
    for k in (1, 37, 200):
        rows_k = qc.classify(frame(spark, rows), spark.createDataFrame(labels, LABELS), k=k, temperature=1.0).collect()
        least = sorted((x.key for x in rows_k), reverse=True)[k - 1]
        assert {x.doc_id for x in rows_k if x.selected} == {x.doc_id for x in rows_k if x.key >= least}
    noise = [x.key - x.weight for x in rows_k if x.n_grams]
    assert abs(sum(noise) / len(noise) - 0.5772) < 0.2


def test_toxic_documents_are_caught_in_every_language(spark):
    r = random.Random(8)
    marks = {"fr": "réeux", "de": "achlich", "es": "ciónmal"}
    rows, labels, toxic = [], [], {}
    for i in range(3000):
        lang = ["en", *marks][i % 4]
        w = [f"{lang}{min(r.randint(0, 400), r.randint(0, 400))}" for _ in range(r.randint(15, 120))]
        toxic[i] = r.random() < 0.1
        if toxic[i]:
            for _ in range(5):
                w.insert(r.randrange(len(w)), r.choice(["slur", "insult"]) if lang == "en" else marks[lang] + "".join(r.choice("abcdeinorst") for _ in range(6)))
        rows.append((i, " ".join(w)))
        if i // 4 % 2:
            labels.append((i, 1, int(toxic[i])))
    kept = {x.doc_id for x in qc.classify(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect() if x.selected}
    rest = [i for i in toxic if not i // 4 % 2]
    recall = {lang: sum(i not in kept for i in rest if toxic[i] and i % 4 == n) / sum(toxic[i] and i % 4 == n for i in rest) for n, lang in enumerate(["en", *marks])}
    assert min(recall.values()) > 0.95, recall
    assert sum(i in kept for i in rest if not toxic[i]) > 0.985 * sum(not toxic[i] for i in rest)


def test_classifier_without_labels_or_documents(spark):
    none = spark.createDataFrame([], LABELS)
    got = qc.classify(frame(spark, [(1, "a b c"), (2, None), (None, "d e f")]), none).collect()
    assert sorted((str(x.doc_id), x.selected) for x in got) == [("1", True), ("2", False), ("None", True)]
    assert qc.classify(frame(spark, [(1, "a")]).limit(0), none).collect() == []


@pytest.mark.parametrize("k", [1, 2, 50, 199, 200])
def test_kth_largest(spark, k):
    df = spark.range(200).selectExpr("sqrt(cast(id as double)) as x")
    assert df.where(df.x >= qc.kth_largest(df, "x", k)).count() == k
