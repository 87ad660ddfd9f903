"""Every catalogue query against its oracle on a small table with awkward texts: null, empty, blank, a word of 100,000 letters, repeats."""

import os
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from textloom.functions.dialect import Spark
from textloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def small(tmp_path_factory, spark):
    """The tables cut to a few rows, with the awkward documents added; plans are interpreted, since compiling them takes longer than running them."""
    path = tmp_path_factory.mktemp("small")
    for t in TABLES:
        rows = pq.read_table(f"{SF}/{t}.parquet").slice(0, 40)
        if t == "documents":
            texts = [None, "", " \n\t", "a" * 100_000 + " end. The " + "b" * 3000 + "'s word.", rows["text"][0].as_py(), "One two three four five six. Seven eight nine ten eleven twelve! Is it so? It is (so)."]
            more = pa.table({"doc_id": pa.array(range(9000, 9000 + len(texts))), "text": texts, "lang": ["en"] * len(texts), "source": [None, "", "src0", "src1", "src1", "src2"], "n_chars": pa.array([0 if x is None else len(x) for x in texts])}, schema=rows.schema)
            rows = pa.concat_tables([rows, more])
        pq.write_table(rows, path / f"{t}.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")}
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    yield str(path), con
    for k, v in before.items():
        spark.conf.set(k, v)


def plain(v):
    if isinstance(v, float):
        return round(v, 8) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def bag(names, rows):
    return Counter(str(sorted((n, str(plain(v))) for n, v in zip(names, r, strict=True))) for r in rows)


#: Queries whose SQL is longer than this take long to plan; of them these are run here.
SHORT = 15_000
LONG = {"d11_lexical_findings", "d12_sentence_templates", "a7_quantile_grid", "a22_w1_cohesion", "a23_hedging", "a24_salience", "a41_sentence_novelty", "j6_percentile_of", "j8_restatement", "x2_distribution_vector"}


@pytest.mark.parametrize("name", sorted(n for n, body in catalog.BODIES.items() if n in LONG or len(Spark().sql(body(Spark()))) <= SHORT))
def test_query_equals_its_oracle(spark, small, name):
    path, con = small
    got = catalog.queries()[name](spark, path)
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    a, b = bag(got.columns, map(tuple, got.collect())), bag(names, want.fetchall())
    assert a == b, (list((a - b).items())[:2], list((b - a).items())[:2])


def test_findings_take_one_scan_and_no_shuffle(spark, small):
    plan = catalog.queries()["d11_lexical_findings"](spark, small[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan
