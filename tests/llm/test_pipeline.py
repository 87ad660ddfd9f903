"""The pipeline against plain Python: what each stage decides is applied to the rows by hand."""

import random
import zlib

from textloom.llm import decontamination as dc
from textloom.llm import packing, pii
from textloom.llm import quality_classifier as qc
from textloom.llm.near_dedup import op7

import corpus_pipeline


def tables(spark, path):
    r = random.Random(8)
    prose = lambda n: " ".join(f"w{min(r.randint(0, 400), r.randint(0, 400))}" for _ in range(n))
    items = [(i, prose(30)) for i in range(5)]
    rows, labels = [(0, None, "en", "s", 0), (1, "", "en", "s", 0)], []
    for i in range(2, 1200):
        t, junk = prose(r.randint(20, 90)), r.random() < 0.15
        if junk:
            t = " ".join(x + "%%%" for x in t.split())
        elif i % 9 == 0:
            t = rows[r.randint(2, len(rows) - 1)][1] + " end"
        elif i % 13 == 0:
            t += " " + items[i % 5][1] + " tail"
        elif i % 7 == 0:
            t += f" mail a{i}@example.org or +1 (487) 555-7209"
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
        if i % 2:
            labels.append((i, int("%%%" not in t), 0))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, items


def test_run_equals_the_stages_by_hand(spark, tmp_path):
    rows, items = tables(spark, tmp_path)
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    chosen = {x.doc_id for x in qc.classify(docs, labels).where("selected").collect()}
    left = [x for x in rows if x[0] in chosen]
    junk = lambda some: sum("%%%" in (x[1] or "") for x in some)
    assert junk(left) < 0.2 * junk(rows)  # test_filters.py measures the classifier
    first = {x.doc_id for x in op7(spark.createDataFrame(left, docs.schema), 5).where("kept").collect()}
    left = [x for x in left if x[0] in first]
    index = dc.Index(items)
    left = [x for x in left if not dc.found_in([x[1].encode()], index)[0]]
    assert not any(i[1] in x[1] for x in left for i in items)
    want = {}
    words = packing.Words(packing.tokenizer_path())
    for d, t, *_ in left:
        ids = next(words.ids([pii.mask(t)]))
        for s, n in packing.pieces(len(ids), 2048):
            want[d, s] = (n, zlib.crc32(ids[s : s + n].tobytes()))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {(x.doc_id, x.start): (x.length, x.ids_crc32) for x in got.collect()} == want
    redacted = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    assert redacted.columns == docs.columns and redacted.where("text like '%@%'").count() == 0
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in redacted.collect())


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rep bigint, comp string, `key` int, text_ string"


def test_stages_handle_nulls_repeats_and_clashing_columns(spark, tmp_path):
    r = random.Random(9)
    prose = lambda n: " ".join(f"w{min(r.randint(0, 300), r.randint(0, 300))}" for _ in range(n))
    rows = [(i, prose(40), "en", None, None, 1, "c", 2, "x") for i in range(300)]
    rows += [(None, prose(40), None, None, None, None, None, None, None), (5, rows[5][1], "en", "s", 3, 1, "c", 2, "x"), (5, prose(40), "en", "s", 3, 1, "c", 2, "x"), (700, None, "en", "s", 0, 1, "c", 2, "x"), (701, " \n", "en", "s", 2, 1, "c", 2, "x"), (702, prose(30_000), "en", "s", 3, 1, "c", 2, "x")]
    for name, some in (("full", rows), ("empty", [])):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(some, DOCS).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] if some else [], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([(None, "a"), (1, None), (2, "")] if some else [], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:4]:
            assert stage(spark, docs, path).columns == docs.columns
        pieces = corpus_pipeline.run(spark, path).collect()
        if not some:
            assert pieces == []
            continue
        ids = [x.doc_id for x in pieces]
        assert {None, 702} <= set(ids) and not {700, 701} & set(ids) and len(set(ids)) > 280
