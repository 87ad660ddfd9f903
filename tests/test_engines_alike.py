"""Cases in which the plan and the SQL once differed, on tables of a few rows."""

import random

import duckdb
import pytest

from textloom.plans import catalog

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def both(spark, tmp_path):
    """A query's rows as sorted tuples by plan and by SQL, on documents of the given texts."""

    def run(name, texts):
        path = f"{tmp_path}/documents.parquet"
        spark.createDataFrame([(i, x, "en", "src0", len(x)) for i, x in enumerate(texts)], DOCUMENTS).coalesce(1).write.mode("overwrite").parquet(path)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        want = con.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in want.description]
        return sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).select(*names).collect()), key=str), sorted(want.fetchall(), key=str)

    return run


def test_words_of_invariants_end_at_letters_beyond_ascii(both):
    got, want = both("x22_document_invariants", ["aresta noñmentellar ñno, no es más. ólower éthus, not"])
    assert got == want
    assert {(0, "negation", 4), (0, "comparison_direction", 1), (0, "causal_direction", 1)} <= set(got)


def test_deviations_halfway_between_two_rounded_ones(both):
    line = lambda n: "A word, " + "word " * (n - 3) + "end."
    got, want = both("a11_w7_dispersion", [f"{line(30)}\n{line(n)}" for n in range(31, 71)])
    assert len(got) >= 80 and got == want


def test_a_deviation_of_four_is_in_the_middle_bin(spark, tmp_path):
    r = random.Random(3)
    texts = []
    while len(texts) < 60:
        lengths = [r.randint(1, 16) for _ in range(r.choice([3, 6, 7, 9, 11]))]
        k = len(lengths)
        if k * sum(n * n for n in lengths) - sum(lengths) ** 2 == 16 * k * k:
            texts.append(" ".join("Word" + " word" * (n - 1) + "." for n in lengths))
    spark.createDataFrame([(i, x, "en", "src0", len(x)) for i, x in enumerate(texts)], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.queries()["x15_bins"](spark, str(tmp_path)).collect() == [("middle", 60)]


def test_openers_are_searched_once_a_line(spark, tmp_path):
    spark.createDataFrame([(0, "Recent advances in x.", "en", "src0", 21)], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalog.queries()["d3_openers"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("despite significant progress") == 2  # after a sentence, and at the start of a line


def test_roots_of_words_are_made_in_one_scan_of_them(spark, tmp_path):
    spark.createDataFrame([(0, "A word.", "en", "src0", 7)], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalog.queries()["p13_native_stems"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 6  # before, 156


def test_sentences_of_a_unit_are_compared_once(spark, tmp_path):
    spark.createDataFrame([(0, "A word.", "en", "src0", 7)], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalog.queries()["a22_w1_cohesion"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_intersect") == 1


def test_sentences_of_units_are_made_once_for_all_axes(spark):
    plan = catalog.queries()["axis_status"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_intersect") == 1  # before, 2
