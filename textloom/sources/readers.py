"""Readers and sinks: assembled manuscripts, bundle roots, banks as JSON lines, labels as CSV, banks and reports as files.

Files are read by Spark's readers, so any file system it knows will do. Sinks write by Spark's writers.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .manuscripts import MANUSCRIPTS

# What marks a document and an include.
INCLUDE = re.compile(r"\\(?:include|input)(?![A-Za-z])\s*\{?\s*([^}\s\\]+)\s*\}?")
COMMENT = re.compile(r"(?<!\\)%[^\n]*")
MARKED = r"\\document(?:class|style)\b|\\begin\{document\}"
MIN_ROOT_SHARE = 0.5

#: Bundles of files: bundle, path, text. Beside plain includes: a cycle, a commented include, a missing child and an alternative root.
BUNDLES = (
    ("one", "main.tex", MANUSCRIPTS[0].replace(r"\section{Results}", "\\input{parts/results}\n\\section{Results}")),
    ("one", "parts/results.tex", "Before \\include{deeper} After %\\input{old}\n\\input{missing}"),
    ("one", "parts/deeper.tex", "Deep text. \\input{results}"),
    ("one", "old.tex", "Old text that nothing includes."),
    ("two", "a.tex", MANUSCRIPTS[1]),
    ("two", "b.tex", "A short note."),
    ("three", "root.tex", "\\documentclass{article}\\begin{document}Few words.\\end{document}"),
    ("three", "chapter.tex", MANUSCRIPTS[2]),
)


def bundles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUNDLES, "bundle string, path string, text string")


def read_bundles(spark: SparkSession, root: str) -> DataFrame:
    """Bundle, path, text of the .tex files below root/<bundle>/."""
    files = spark.read.text(f"{root}/*", wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.tex").select(F.col("value").alias("text"), F.input_file_name().alias("file"))
    below = F.regexp_extract("file", f"{re.escape(root.rstrip('/').rpartition('/')[2])}/([^/]+)/(.+)$", 1), F.regexp_extract("file", f"{re.escape(root.rstrip('/').rpartition('/')[2])}/([^/]+)/(.+)$", 2)
    return files.select(below[0].alias("bundle"), below[1].alias("path"), "text")


def candidates(target: str, base: str, current: str) -> list[str]:
    """S3: places of an include's target in the order in which they are tried: as written and with .tex below the root's folder, then beside the including file."""
    out = []
    for folder in (base, current):
        for name in (target, os.path.splitext(target)[0] + ".tex"):
            place = os.path.normpath(os.path.join(folder, name))
            if place not in out:
                out.append(place)
    return out


def includes(text: str) -> list[str]:
    """Targets of includes outside comments."""
    return INCLUDE.findall(COMMENT.sub("", text))


def assemble(path: str, files: dict[str, str], base: str = "", stack: tuple[str, ...] = ()) -> str:
    """A file with its includes spliced in place. A file on the current stack and one that isn't there stay as the literal call; a missing root raises."""
    if path not in files:
        raise FileNotFoundError(path)
    text, out, at = files[path], [], 0
    hidden = [m.span() for m in COMMENT.finditer(text)]
    for m in INCLUDE.finditer(text):
        if any(a <= m.start() < b for a, b in hidden):
            continue
        child = next((p for p in candidates(m[1], base, os.path.dirname(path)) if p in files), None)
        if child and child not in (*stack, path):
            out += [text[at : m.start()], assemble(child, files, base, (*stack, path))]
            at = m.end()
    return "".join([*out, text[at:]])


def included(path: str, files: dict[str, str]) -> set[str]:
    return {p for t in includes(files[path]) for p in candidates(t, "", os.path.dirname(path)) if p in files}


def roots(files: dict[str, str]) -> list[str]:
    """Files that no other includes; without a document marker only where no marked one is there."""
    used = set().union(*(included(p, files) - {p} for p in files)) if files else set()
    top = [p for p in sorted(files) if p not in used] or sorted(files)[:1]
    marked = [p for p in top if re.search(MARKED, files[p])]
    return marked or top


def words(text: str) -> int:
    return len(re.findall(r"[^\W\d_][^\W\d_'\-]*", COMMENT.sub("", text)))


DOCUMENTS = "bundle string, root string, text string, n_files bigint, concatenated boolean"


def corpus_documents(files: DataFrame) -> DataFrame:
    """One document a bundle: the root with most words, assembled; all files one after the other where it holds less than half of the words."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(rows["path"], rows["text"], strict=True))
        got = {r: assemble(r, own) for r in roots(own)}
        root = max(sorted(got), key=lambda r: words(got[r]))
        whole = "\n".join(own[p] for p in sorted(own))
        few = words(got[root]) < MIN_ROOT_SHARE * words(whole)
        return pd.DataFrame({"bundle": [rows["bundle"].iloc[0]], "root": [root], "text": [whole if few else got[root]], "n_files": [len(own)], "concatenated": [few]})

    return files.groupBy("bundle").applyInPandas(of, DOCUMENTS)


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """An exemplar bank as JSON lines; undecodable lines are skipped."""
    return spark.read.schema("section string, source string, text string, n_words int").option("mode", "DROPMALFORMED").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels by key as CSV with a header."""
    return spark.read.option("header", True).schema("doc_id bigint, label string").csv(path)


def write_bank(df: DataFrame, path: str) -> None:
    """An exemplar bank (section, source, text, ...) as JSON lines, a folder for each section."""
    df.write.mode("overwrite").partitionBy("section").json(path)


def write_baseline(df: DataFrame, path: str) -> None:
    """A calibration as one JSON file of few rows, replaced whole."""
    df.coalesce(1).write.mode("overwrite").json(path)


def report_json(findings: DataFrame) -> DataFrame:
    """Each document's findings as one JSON text, in order of rule and section."""
    return findings.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rule", "section", "hits")))).alias("report"), F.sum("hits").alias("total"))


def dossier(summary: DataFrame, title: str) -> str:
    """A small aggregate as a Markdown table; at most 1,000 rows come to the driver, and more raise."""
    rows = summary.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a dossier shows small aggregates")
    names = summary.columns
    return "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "-|" * len(names), *("| " + " | ".join(str(v) for v in r) + " |" for r in rows)]) + "\n"


def negatives(text: str) -> list[tuple[str, str]]:
    """(label, paragraph) of a list of negatives: `#` lines comment, `[label]` lines name what follows, blank lines part paragraphs."""
    out, label, held = [], "", []
    for line in [*text.splitlines(), ""]:
        mark = re.fullmatch(r"\[([^\]]+)\]\s*", line)
        if line.startswith("#"):
            continue
        if line.strip() and not mark:
            held.append(line.strip())
            continue
        if held:
            out.append((label, " ".join(held)))
            held = []
        label = mark[1] if mark else label
    return out


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.docshape import sql
    from ..operators.findings import ALL, lexical

    return report_json(sql(spark, sf_dir, lambda q: ALL.format(lexical(q))))


FRAMES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s1_s5_s6_assembled_documents": lambda spark, sf_dir: corpus_documents(bundles(spark)),
    "s21_reports": reports,
}
