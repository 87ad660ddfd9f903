"""Expected results, written out by hand, of projections, detectors and measures over small manuscripts."""

import pytest

from textloom.functions import dialect
from textloom.operators import findings, manuscript, measures


def run(spark, monkeypatch, query, *texts, documents=()):
    """Rows of a query over these manuscripts (doc_id -100, -101 ...) and documents."""
    monkeypatch.setattr(dialect, "MANUSCRIPTS", texts)
    q = dialect.Spark()
    spark.createDataFrame([(i, t, "s", "en", len(t or "")) for i, t in enumerate(documents)], "doc_id bigint, text string, source string, lang string, n_chars bigint").createOrReplaceTempView("documents")
    return [r.asDict() for r in spark.sql(q.sql(query(q))).collect()]


def test_plain_text(spark, monkeypatch):
    text = r"""A \textbf{bold}~word % gone
$x^2$ and \citep[see][]{K1,K2} or \nocite{Z} \label{a} in 5\% \begin{figure}\caption{c}\end{figure} \[ y \] end"""
    (row,) = run(spark, monkeypatch, manuscript.QUERIES["p1_latex_to_plain"], text)
    assert " ".join(row["plain"].split()) == r"A bold word [math] and [CITE] or in 5\% [FIGURE-OR-TABLE] [MATH] end"


def test_numerals_stay_in_the_numeral_text(spark, monkeypatch):
    (row,) = run(spark, monkeypatch, manuscript.QUERIES["p2_numeral_text"], r"We find $1{,}250 \pm 3\times 10^{4}$ of \cite{K} them.")
    assert row["plain"] == "We find 1,250 3 10^ 4 of them."


def test_blanks_keep_places(spark, monkeypatch):
    (row,) = run(spark, monkeypatch, manuscript.QUERIES["p4_blank_preserving"], "ab \\cite{x\ny} cd")
    assert row["same_length"] and row["blanked"] == "ab " + " " * 7 + "\n" + "  " + " cd"


def test_headings_and_buckets(spark, monkeypatch):
    text = "\\section{Results\\label{sec:res}}\nx\n\\section[Short]{\\texorpdfstring{$\\Lambda$CDM}{LCDM} methods}\n\\subsection{Odd title}\n\\section*{Acknowledgements}\n\\section{Discussion and Conclusions}"
    rows = run(spark, monkeypatch, manuscript.QUERIES["p6_clean_heading"], text)
    assert [(r["title"], r["bucket"]) for r in sorted(rows, key=lambda r: r["section"])] == [("Results", "results"), ("CDM methods", "method"), ("Odd title", "method"), ("Acknowledgements", "skip"), ("Discussion and Conclusions", "discussion")]


def test_numeric_macros(spark, monkeypatch):
    (row,) = run(spark, monkeypatch, manuscript.QUERIES["p7_expand_numeric"], "\\newcommand{\\Ns}{12}\\newcommand{\\Nsamples}{1,250}\\def\\Ns{14}\\newcommand{\\f}[1]{42}\\newcommand{\\g}{word}\nUse \\Ns{} of \\Nsamples, \\f and \\g.")
    assert row["expanded"].split("\n")[1] == "Use 14 of 1,250, \\f and \\g."


def test_markdown(spark, monkeypatch):
    (row,) = run(spark, monkeypatch, manuscript.QUERIES["p11_strip_markdown"], "# T\nA [link](http://x) and **bold** *it* `code` ![i](p.png).\n> q\n- item\n| a | b |\n```\nx\n```\n")
    assert row["plain"].split() == ["A", "link", "and", "bold", "it", "."]


@pytest.mark.parametrize(("text", "rules"), [
    ("We delve in. Notably, it is robust.", ["tier-a:delve"]),
    ("Notably, it works.", ["tier-a:paragraph-start:notably"]),
    ("Crucially, it works.", ["tier-a:paragraph-start:crucially"]),
    ("robust and robust and robust estimators and Robust", ["tier-b-excess:robust", "tier-b-excess:robust"]),
    ("robust\n\n\\section{A}\nrobust", []),
    ("It ends. In recent years it grew.", ["tier-a:opener"]),
    ("and so\nin recent years", []),
    ("It works --- well", ["em-dash"]),
    ("---", []),
    ("\\ref{sec:realm} \\cite{delve-2020}", []),
    ("It rose, highlighting this; the rule: it falls in order to stop.", ["colon-elaboration", "ing-tail:highlighting", "style-substitution:in order to"]),
])
def test_lexical_rules(spark, monkeypatch, text, rules):
    assert sorted(r["rule"] for r in run(spark, monkeypatch, findings.QUERIES["d11_lexical_findings"], text)) == rules


def test_sentence_templates(spark, monkeypatch):
    text = "It rests on two components. First, we see. Second, we go.\n\nWe must fit. He must test. They must stop.\n\nRings are red. Rings are blue. Rings are wide.\n\nOne is red and so on and another.\n\nThese two halves together form it. It is not red but blue, rather than green. It is not."
    rows = sorted(run(spark, monkeypatch, findings.QUERIES["d12_sentence_templates"], text), key=lambda r: r["unit"])
    assert [r["templates"] for r in rows] == ["announced-enumeration", "parallel-modal", "parallel-anaphora", "balanced-closer", "tricolon-wrapup"]
    (row,) = run(spark, monkeypatch, findings.QUERIES["d13_antithesis"], text)
    assert row["auxiliary"] == "antithesis-cluster,short-reversal"
    (row,) = run(spark, monkeypatch, findings.QUERIES["g18_modifier_stacks"], "We use a non-weighted 200-image stack fails here. A plain word.")
    assert row["n"] == 1


def test_residue(spark, monkeypatch):
    text = "We tried it. We now go. He tried it now. We no longer use [CITE] it. Nothing is lost. Never-masked tiles stay. It is not applied. No mask was used."
    assert [(r["word"], r["strong"]) for r in run(spark, monkeypatch, findings.QUERIES["d14_self_history"], text)] == [("we tried", True), ("now", False)]
    assert [(r["sent"], r["strong"]) for r in sorted(run(spark, monkeypatch, findings.QUERIES["d15_absence"], text), key=lambda r: r["sent"])] == [(4, True), (6, False), (7, True)]
    assert {(r["kind"], r["n"]) for r in run(spark, monkeypatch, findings.QUERIES["d16_edit_meta"], "TODO x (new) \\hl{y} we have added a short paragraph; we have added noise")} == {("case", 1), ("phrase", 3)}


def test_condensing(spark, monkeypatch):
    assert sorted((r["phrase"], r["shorter"], r["removable"]) for r in run(spark, monkeypatch, findings.QUERIES["d20_verbose_phrases"], "In order to see, it may possibly fail.")) == [("in order to", "to", 2), ("may possibly", "one hedge", 1)]
    cues = run(spark, monkeypatch, findings.QUERIES["d19_zero_gain"], "We describe the filter. In this section we describe the filter. In this paper we measure a galaxy mass of many solar units precisely.")
    assert sorted((r["cue"], r["whole"]) for r in cues) == [("in this paper", False), ("in this section", True)]
    text = "\\newcommand{\\unused}{7}\\newcommand{\\used}{8} \\used A (DES) and (HST) by HST. \\label{eq:dead} \\label{eq:live} \\eqref{eq:live}"
    assert {(r["kind"], r["name"]) for r in run(spark, monkeypatch, findings.QUERIES["d22_dead_artefacts"], text)} == {("macro", "unused"), ("acronym", "DES"), ("label", "eq:dead")}


def test_restatement(spark, monkeypatch):
    claim = "The tangential shear profile of every cluster was measured around bright central galaxies"
    of = lambda text: run(spark, monkeypatch, findings.QUERIES["j8_restatement"], text)
    assert [(r["place"], r["home"]) for r in of(f"{claim}. It grows. {claim}.")] == [(3, 1)]
    assert of(f"{claim}. {claim.replace('was', 'was not')}.") == []
    assert of(f"{claim} in 10 bins. {claim} in 12 bins.") == []


def test_content_pairs(spark, monkeypatch):
    got = {(r["a"], r["b"]) for r in run(spark, monkeypatch, measures.QUERIES["g15_content_pairs"], "The filter yields, separate profiles $x$ keeps (the) noise floor.")}
    assert {("separate", "profiles"), ("noise", "floor")} <= got and not {("yields", "separate"), ("profiles", "keeps")} & got


@pytest.mark.parametrize(("n", "want"), [(100, {0: 0, 10: 9, 50: 49, 90: 89, 100: 99}), (30, {10: 2, 90: 26}), (1, {0: 0, 37: 0, 100: 0})])
def test_quantile_grid(spark, n, want):
    spark.createDataFrame([("b", "f", float(i)) for i in range(n)], "bucket string, feature string, v double").createOrReplaceTempView("values_")
    q = dialect.Spark()
    got = {r.step: r.v for r in spark.sql(q.sql(measures.grid(q, "SELECT * FROM values_"))).collect()}
    assert len(got) == 101 and all(got[k] == v for k, v in want.items())
    ask = lambda v: spark.sql(q.sql(f"SELECT {measures.percentile(q, str(v))} AS p FROM ({measures.grid_arrays(q, 'SELECT * FROM values_')}) g")).first().p
    if n == 100:
        assert [round(ask(v), 6) for v in (-1.0, 9.0, 9.5, 98.0, 99.0, 200.0)] == [0.0, 0.1, 0.105, 0.99, 1.0, 1.0]


def test_cohesion_of_a_short_unit_is_missing(spark, monkeypatch):
    assert run(spark, monkeypatch, measures.QUERIES["a22_w1_cohesion"], "A short one.") == []
    s = "Red wide rings surround every distant bright galaxy that our camera has seen in these long cold nights."
    (row,) = run(spark, monkeypatch, measures.QUERIES["a22_w1_cohesion"], f"{s} {s} {s}")
    assert row["cohesion"] == 1.0


def test_negated_labels(spark, monkeypatch):
    got = run(spark, monkeypatch, manuscript.QUERIES["g20_negated_objects"], "\\caption{A map without truncated tiles and no outer ring, not a mass reconstruction. Solid spheres.}")
    assert sorted((r["object"], r["stem"]) for r in got if r["place"] == 0) == [("a mass reconstruction", "mas"), ("outer ring", "out"), ("truncated tiles", "trunc")]
