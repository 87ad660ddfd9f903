"""Document-scale fits, provenance, readers and splits against plain Python."""

import math
import random
import statistics

import numpy as np
import pytest

from textloom.operators import docshape as ds
from textloom.operators import models, provenance
from textloom.sources import readers


def spreads(spark, n, seed=3):
    r = random.Random(seed)
    rows = [(i, r.randint(2, 90), *(abs(r.gauss(3, 1)) for _ in ds.NAMES)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, n bigint, " + ", ".join(f"{x} double" for x in ds.NAMES))


def test_manifold_distances_equal_numpy(spark):
    rows, df = spreads(spark, 80)
    medians, center, inverse = ds.fit(df)
    x = np.array([r[2:] for r in rows])
    assert medians == pytest.approx(np.median(x, axis=0))
    v = np.clip(np.log(np.maximum(x, ds.EPS) / np.median(x, axis=0)), -6, 6)
    cov = np.cov(v.T)
    cov += np.eye(len(cov)) * 0.05 * np.trace(cov) / len(cov)
    want = {r[0]: math.sqrt((a - v.mean(0)) @ np.linalg.inv(cov) @ (a - v.mean(0))) for r, a in zip(rows, v, strict=True)}
    got = {r.doc_id: r.score for r in ds.mahalanobis(ds.log_ratios(df, medians), center, inverse).collect()}
    assert got == pytest.approx(want, rel=1e-6)
    assert ds.fit(df.limit(20)) is None


def test_mahalanobis_of_the_identity(spark):
    _, df = spreads(spark, 1)
    zero = np.zeros(len(ds.NAMES))
    row = df.select("doc_id", "n", *((ds.F.lit(float(i == 0) * 3 + float(i == 1) * 4)).alias(x) for i, x in enumerate(ds.NAMES)))
    assert ds.mahalanobis(row, zero, np.eye(len(ds.NAMES))).first().score == pytest.approx(5.0)


def test_role_coupling():
    r = np.random.default_rng(0)
    labels = np.repeat([0, 1, 2], 10)
    assert ds.coupling_z(np.full((30, 1), 2.0), labels) is None
    assert ds.coupling_z(labels[:, None] + r.normal(0, 0.1, (30, 1)), labels) > 5
    x = r.normal(size=(30, 2))
    groups = [x[labels == k, 0] for k in range(3)]
    between = sum(len(g) * (g.mean() - x[:, 0].mean()) ** 2 for g in groups)
    assert ds.eta_squared(x, labels)[0] == pytest.approx(between / ((x[:, 0] - x[:, 0].mean()) ** 2).sum())


def test_quantile_and_auc_of_counts():
    values = [1.0, 1.0, 2.0, 5.0, 5.0, 9.0]
    v, c = np.unique(values, return_counts=True)
    for p in (0.0, 0.1, 0.5, 0.95, 1.0):
        assert ds.quantile_of(v, c, p) == pytest.approx(np.quantile(values, p))
    pos, neg = [1, 2, 2, 3], [0, 2, 1]
    want = statistics.mean((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    steps = sorted({*pos, *neg})
    assert ds.auc_of(np.array([pos.count(s) for s in steps]), np.array([neg.count(s) for s in steps])) == pytest.approx(want)


def test_edit_labels(spark):
    old = spark.createDataFrame([(1, 0, "the map is drawn in red"), (1, 1, "nothing of it stays"), (2, 0, "other")], "doc_id bigint, unit bigint, text string")
    now = spark.createDataFrame([(1, 0, "the map is drawn in red"), (1, 5, "the map is drawn in blue now"), (1, 6, "wholly new words"), (3, 0, "alone")], "doc_id bigint, unit bigint, text string")
    got = {(r.doc_id, r.unit): (r.ancestor, r.ratio, r.label) for r in provenance.edits(now, old).collect()}
    assert got == {(1, 0): (0, 1.0, "ai_untouched"), (1, 5): (0, 0.769231, "light_edit"), (1, 6): (None, 0.0, "new"), (3, 0): (None, 0.0, "new")}
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 12))) for _ in range(30)]
    for t in texts[:10]:
        ratios = [provenance.edit_similarity(o, t) for o in texts[10:]]
        assert provenance.best_ancestor(t, list(enumerate(texts[10:])))[1] == max(ratios)


def test_assembly(tmp_path, spark):
    files = {"main.tex": "A \\input{b} C % \\input{old}\n\\include{gone}", "b.tex": "B1 \\input{sub/c} B2 \\input{main}", "sub/c.tex": "C1", "old.tex": "O"}
    assert readers.assemble("main.tex", files) == "A B1 C1 B2 \\input{main} C % \\input{old}\n\\include{gone}"
    with pytest.raises(FileNotFoundError):
        readers.assemble("none.tex", files)
    got = {r.bundle: r for r in readers.corpus_documents(readers.bundles(spark)).collect()}
    assert got["one"].root == "main.tex" and "Before Deep text. \\input{results} After" in got["one"].text and "Old text" not in got["one"].text
    assert got["two"].root == "a.tex" and got["three"].concatenated
    for name, text in files.items():
        (tmp_path / "x" / "one" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "x" / "one" / name).write_text(text)
    assert {(r.bundle, r.path): r.text for r in readers.read_bundles(spark, f"{tmp_path}/x").collect()} == {("one", k): v for k, v in files.items()}


def test_banks_and_sinks(tmp_path, spark):
    df = spark.createDataFrame([("intro", "s1", "a text", 2), ("data", None, "b", 1)], "section string, source string, text string, n_words int")
    readers.write_bank(df, f"{tmp_path}/bank")
    assert sorted(r.text for r in readers.read_bank(spark, f"{tmp_path}/bank").collect()) == ["a text", "b"]
    (tmp_path / "bad.jsonl").write_text('{"section": "x", "text": "ok"}\nnot json\n')
    assert [r.text for r in readers.read_bank(spark, f"{tmp_path}/bad.jsonl").collect()] == ["ok"]
    (tmp_path / "labels.csv").write_text("doc_id,label\n1,a\n2,\n")
    assert [(r.doc_id, r.label) for r in readers.read_labels(spark, f"{tmp_path}/labels.csv").collect()] == [(1, "a"), (2, None)]
    readers.write_baseline(df.groupBy("section").count(), f"{tmp_path}/base")
    assert spark.read.json(f"{tmp_path}/base").count() == 2
    assert readers.dossier(df.groupBy("section").count().orderBy("section"), "Bank") == "# Bank\n\n| section | count |\n|-|-|\n| data | 1 |\n| intro | 1 |\n"
    assert readers.negatives("# note\n[a]\none\ntwo\n\n\n# x\nthree\n[b]\nfour") == [("a", "one two"), ("a", "three"), ("b", "four")]


def test_splits_keep_groups_apart(spark):
    rows = [(i, f"s{i % 7}", float(i % 7 > 3 or i % 5 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, label double")
    seed = models.first_valid_split(df)
    test = df.where(models.bucket(seed) < models.TEST_SHARE)
    rest = df.where(models.bucket(seed) >= models.TEST_SHARE)
    assert not {r.source for r in test.collect()} & {r.source for r in rest.collect()}
    assert models.two_sided(test) and models.two_sided(rest)
    m = models.metrics(spark.createDataFrame([(1, 1.0, 0.9), (2, 0.0, 0.9), (3, 0.0, 0.1), (4, 1.0, 0.4)], "doc_id bigint, label double, p double")).first()
    assert (m.tp, m.fn, m.fp, m.tn, m.auc, m.bacc) == (1, 1, 1, 1, 0.625, 0.5)
