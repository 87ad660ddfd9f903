import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from textloom.llm import lm
from textloom.llm.gru import Lanes, Model
from textloom.llm.words import hashed_words

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("h", T.StringType()), T.StructField("rare", T.LongType())])


def corpus(n=300):
    r = random.Random(2)
    out = [(0, None), (1, ""), (2, " \n"), (None, "Aa bB"), (3, "ONLY é É x\x0by"), (3, "ONLY é É x\x0by")]
    follow = {f"w{i}": [f"w{r.randint(0, 60)}" for _ in range(2)] for i in range(61)}
    for i in range(10, n):
        w = ["w0"]
        for _ in range(r.randint(0, 300)):
            w.append(r.choice(follow[w[-1].lower()]) if r.random() < 0.95 else f"w{r.randint(0, 60)}")
        if i % 5 == 0:
            w.append(f"odd{i}")
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("frequent", [1 << 20, 20])
def test_base_scores_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = corpus()
    got = lm.op3(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter(w for d, t in rows if not out(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = {}
    for d, t in rows:
        w = tokens(t)
        want[d] = (out(d), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    for g in got:
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == want[g.doc_id][:4]
        assert g.base_score == pytest.approx(want[g.doc_id][4], rel=1e-9)
        assert g.score < 0
    if frequent > 1000:  # the model learns more than the unigram base knows, on documents it has not seen
        held = [g for g in got if g.held_out and g.n_tokens > 20]
        assert sum(g.score for g in held) > sum(g.base_score for g in held)


def small_model(kind=np.float32):
    m = Model(np.array([5.0, 3, 9, 1, 2, 2, 7]), hidden=5, width=4, seed=1)
    r = np.random.default_rng(0)
    for n in m.names:
        setattr(m, n, (getattr(m, n) + r.standard_normal(getattr(m, n).shape) * 0.5).astype(kind))
    return m


def test_probabilities_sum_to_one_and_lanes_do_not_change_scores():
    m = small_model()
    assert m.starts.tolist() == [0, 1, 2, 4, 5, 6, 7] or m.classes > 2
    h = np.random.default_rng(0).standard_normal((5, 1)).astype(np.float32)
    assert sum(math.exp(m.outputs(h, np.array([w]))[0][0]) for w in range(7)) == pytest.approx(1, abs=1e-5)
    docs = [np.array([3, 4, 2, 6, 0]), np.array([2, 2, 5, 0]), np.array([0]), np.array([1] * 40 + [0])]
    assert m.score(docs, lanes=1, window=2) == pytest.approx(m.score(docs, lanes=8, window=100), rel=1e-5)
    before = m.score(docs).sum()
    state = None
    for _ in range(30):
        state = m.train(docs, lanes=2, window=64, rate=0.05, state=state)
    assert m.score(docs).sum() > before + 3


def test_gradients_equal_finite_differences():
    m = small_model(np.float64)
    docs = [np.array([3, 4, 2, 6, 0]), np.array([2, 2, 5, 0]), np.array([6, 0])]
    dealt = Lanes.deal(docs, 2)
    at, there = next(dealt.windows(100))
    h = np.random.default_rng(1).standard_normal((5, 2))
    of = lambda: m.gradients(dealt.inputs[at], dealt.target[at], there, dealt.fresh[at], h.copy())
    loss, _, grads = of()
    assert there.sum() == sum(map(len, docs))
    for name in m.names:
        w = getattr(m, name)
        flat = w.reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 25)):
            old = flat[i]
            flat[i] = old + 1e-5
            up = of()[0]
            flat[i] = old - 1e-5
            down = of()[0]
            flat[i] = old
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-5, abs=1e-7, rel=1e-4), name


def reference_score(m, doc):
    """ln of a document's probability, word by word."""
    k, h, prev, total = m.hidden, np.zeros(m.hidden), 0, 0.0
    for w in doc:
        gx, gh = m.emb[prev] @ m.wx + m.b, h @ m.wh
        r, z = (1 / (1 + np.exp(-(gx + gh)[i * k : (i + 1) * k])) for i in (0, 1))
        n = np.tanh(gx[2 * k :] + r * gh[2 * k :])
        h = (1 - z) * n + z * h
        cls, c = h @ m.wc + m.bc, m.class_of[w]
        low, high = m.starts[c : c + 2]
        own = h @ m.wo[:, low:high] + m.bo[low:high]
        total += cls[c] - np.log(np.exp(cls).sum()) + own[w - low] - np.log(np.exp(own).sum())
        prev = w
    return total


def test_scores_equal_a_word_by_word_model():
    m, r = small_model(), np.random.default_rng(5)
    docs = [np.append(r.integers(1, 7, n), 0) for n in (0, 1, 5, 200, 3)]
    assert m.score(docs, lanes=3, window=7) == pytest.approx([reference_score(m, d) for d in docs], rel=1e-4)


def test_one_very_long_text_takes_memory_by_tokens():
    m = Model(np.ones(40), hidden=4, width=3)
    docs = [np.append(np.arange(1, 200_001) % 39 + 1, 0), *(np.array([2, 3, 0]) for _ in range(511))]
    tracemalloc.start()
    got = m.score(docs)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    assert np.isfinite(got).all() and len({round(x, 4) for x in got[1:]}) == 1


class Shared:
    def __init__(self, value):
        self.value = value


def trained(monkeypatch, texts, held=1 << 30):
    """What the trainer hands to the model, the model's weights before and the blocks that come out."""
    words = [w.split() for w in texts.values()]
    _, _, hashes = hashed_words([" ".join(sorted({x for w in words for x in w}))])
    model = Model(np.ones(2 + len(hashes)), hidden=4, width=3)
    handed, train = [], Model.train
    monkeypatch.setattr(lm, "HELD", held, raising=False)
    monkeypatch.setattr(lm.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    monkeypatch.setattr(Model, "train", lambda self, docs, **k: (handed.append(docs), train(self, docs, **k))[1])
    batch = pa.RecordBatch.from_arrays([pa.array([*texts], pa.int64()), pa.array([*texts.values()])], ["doc_id", "text"])
    blocks = [x for b in lm.learner(Shared(lm.Table(hashes, np.ones(len(hashes), np.int64), hashes)), Shared(model))([batch]) for x in b.to_pylist() if x["block"] is not None]
    return handed, model, blocks


def test_every_training_token_is_trained_on(monkeypatch):
    r = random.Random(3)
    texts = {i: " ".join(f"w{r.randint(0, 9)}" for _ in range(r.choice([3, 90, 300, 1500]))) for i in range(20)}
    want = sum(len(t.split()) + 1 for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10)
    handed, _, blocks = trained(monkeypatch, texts)
    assert sum(len(d) for docs in handed for d in docs) == want and blocks[0]["w"] == want


def test_the_state_is_carried_over_whole_documents(monkeypatch):
    texts = {i: " ".join(f"w{(i + j) % 7}" for j in range(n)) for i, n in enumerate([0, 1, 127, 128, 129, 700])}
    handed, _, _ = trained(monkeypatch, texts)
    docs = [d for some in handed for d in some]
    assert sorted(map(len, docs)) == sorted(len(t.split()) + 1 for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10)
    assert all(d[-1] == 0 and (d[:-1] != 0).all() for d in docs)


def test_few_tokens_move_the_weights(monkeypatch):
    _, model, blocks = trained(monkeypatch, {1: "w1 w2 w1 w2"})
    assert blocks and (np.frombuffer(blocks[0]["vec"]) / blocks[0]["w"] != model.flat()[: lm.BLOCK]).any()


def test_empty_table(spark):
    assert lm.op3(spark.createDataFrame([], SCHEMA)).collect() == []
