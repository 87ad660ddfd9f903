"""Edit provenance between two versions, the personal baseline, the axes' status and the partition plan."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .docshape import NAMES, modelfree, sql

# Similarities of the edit labels, and the personal baseline's shares.
UNTOUCHED, LIGHT, HEAVY = 0.95, 0.65, 0.30
LOW_SHARE, FLAG, STRONG = 0.10, 0.40, 0.60
MAX_OPERATIONS, MERGE_BELOW, SPLIT_ABOVE = 5, 60, 220


def edit_similarity(a: str, b: str) -> float:
    """Ratio of matching tokens, in blocks, to all tokens."""
    return SequenceMatcher(None, a.split(), b.split(), autojunk=False).ratio()


def label(ratio: float) -> str:
    return "ai_untouched" if ratio >= UNTOUCHED else "light_edit" if ratio >= LIGHT else "heavy_edit" if ratio >= HEAVY else "new"


def upper_bound(a: Counter, b: Counter) -> float:
    """No ratio of two token bags is higher."""
    n = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / n if n else 1.0


def best_ancestor(text: str, earlier: list[tuple[int, str]]) -> tuple[int | None, float]:
    """The earlier paragraph most like this one, the first of equal ones; candidates in order of their bound, until none can be better."""
    own = Counter(text.split())
    bounds = sorted(((-upper_bound(own, Counter(t.split())), i, t) for i, t in earlier), key=lambda x: (x[0], x[1]))
    best: tuple[int | None, float] = (None, 0.0)
    for bound, i, t in bounds:
        if -bound < best[1]:
            break
        r = edit_similarity(t, text)
        if r > best[1] or r == best[1] and best[0] is not None and i < best[0]:
            best = (i, r)
    return best


EDITS = "doc_id bigint, unit bigint, n_words bigint, ancestor bigint, ratio double, label string"


def edits(now: DataFrame, before: DataFrame) -> DataFrame:
    """Each paragraph (doc_id, unit, text) with its best ancestor in the same document's earlier version."""

    def of(key: tuple, current: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        earlier = sorted(zip(old["unit"].tolist(), old["text"].tolist(), strict=True))
        rows = []
        for unit, text in sorted(zip(current["unit"].tolist(), current["text"].tolist(), strict=True)):
            i, r = best_ancestor(text, earlier)
            rows.append((key[0], unit, len(text.split()), i, round(r, 6), label(r)))
        return pd.DataFrame(rows, columns=["doc_id", "unit", "n_words", "ancestor", "ratio", "label"]).astype({"ancestor": "Int64"})

    return now.groupBy("doc_id").cogroup(before.groupBy("doc_id")).applyInPandas(of, EDITS)


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Units of the manuscripts and documents, and an earlier version of them: without every third unit and every fifth word."""
    def units() -> DataFrame:  # one for each side, so that they share no columns
        return sql(spark, sf_dir, lambda q: "SELECT doc_id, section * 100000 + unit AS unit, plain AS text FROM tex_units")

    fewer = F.array_join(F.filter(F.split("text", " "), lambda w, i: i % 5 != 4), " ")
    before = units().where("unit % 3 <> 2").select((F.col("doc_id") + 0).alias("doc_id"), (F.col("unit") + 0).alias("unit"), F.when(F.col("unit") % 2 == 1, fewer).otherwise(F.concat("text", F.lit(""))).alias("text"))
    return units(), before


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(*versions(spark, sf_dir))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs by label and the word-weighted mean depth of editing (0: untouched, 1: light, 2: heavy, 3: new)."""
    depth = F.when(F.col("label") == "ai_untouched", 0).when(F.col("label") == "light_edit", 1).when(F.col("label") == "heavy_edit", 2).otherwise(3)
    by_label = [F.count_if(F.col("label") == x).alias(x) for x in ("ai_untouched", "light_edit", "heavy_edit", "new")]
    return provenance(spark, sf_dir).groupBy("doc_id").agg(*by_label, F.round(F.sum(depth * F.col("n_words")) / F.greatest(F.sum("n_words"), F.lit(1)), 6).alias("depth"))


def personal_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, the share of features whose spread is at most that of a tenth of the other documents of its source; flagged from 40 %, strong from 60 %."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    rows = sql(spark, sf_dir, modelfree).groupBy("doc_id").agg(*(F.stddev_pop(x).alias(x) for x in NAMES), F.count("*").alias("n")).where("n >= 2").join(d, "doc_id")
    long = rows.select("doc_id", "source", F.explode(F.array(*(F.struct(F.lit(x).alias("feature"), F.round(x, 9).alias("v")) for x in NAMES))).alias("one_of")).select("doc_id", "source", "one_of.feature", "one_of.v")
    counts = long.groupBy("source", "feature", "v").count()
    counts.createOrReplaceTempView("spreads_by_source")
    share = spark.sql("SELECT source, feature, v, (sum(count) OVER (PARTITION BY source, feature ORDER BY v) - 1) / nullif(sum(count) OVER (PARTITION BY source, feature) - 1, 0) AS share FROM spreads_by_source")
    under = long.join(share, ["source", "feature", "v"]).groupBy("doc_id").agg(F.round(F.avg((F.col("share") <= LOW_SHARE).cast("int")), 6).alias("low_share"))
    return under.withColumn("flagged", F.col("low_share") >= FLAG).withColumn("strong", F.col("low_share") >= STRONG)


PLAN = "doc_id bigint, step bigint, operation string, unit bigint, with_unit bigint, words bigint"


def partition_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy plan of at most five merges and splits a document: the most extreme unit first, a short one merged with its shorter neighbour, a long one split in two."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        units = [(int(u), int(w)) for u, w in sorted(zip(rows["unit"], rows["word_count"], strict=True))]
        out = []
        for step in range(MAX_OPERATIONS):
            short = [(w - MERGE_BELOW, i) for i, (_, w) in enumerate(units) if w < MERGE_BELOW and len(units) > 1]
            long = [(SPLIT_ABOVE - w, i) for i, (_, w) in enumerate(units) if w > SPLIT_ABOVE]
            if not short and not long:
                break
            _, i = min(short + long)
            unit, words = units[i]
            if words > SPLIT_ABOVE:
                units[i : i + 1] = [(unit, words - words // 2), (unit, words // 2)]
                out.append((rows["doc_id"].iloc[0], step, "split", unit, None, words))
            else:
                j = min((k for k in (i - 1, i + 1) if 0 <= k < len(units)), key=lambda k: (units[k][1], k))
                out.append((rows["doc_id"].iloc[0], step, "merge", unit, units[j][0], words + units[j][1]))
                units[min(i, j) : max(i, j) + 1] = [(units[min(i, j)][0], words + units[j][1])]
        return pd.DataFrame(out, columns=["doc_id", "step", "operation", "unit", "with_unit", "words"]).astype({"with_unit": "Int64"})

    return sql(spark, sf_dir, lambda q: f"SELECT doc_id, section * 100000 + unit AS unit, word_count FROM ({modelfree(q)}) m").groupBy("doc_id").applyInPandas(of, PLAN)


FRAMES = {
    "j10_x17_provenance": provenance,
    "a43_provenance_summary": summary,
    "a44_personal_baseline": personal_baseline,
    "partition_plan": partition_plan,
}


