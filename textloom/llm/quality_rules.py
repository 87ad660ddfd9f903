"""Quality rules with host-level verdicts, in DataFrame functions only.

Document rules are counted from each whole text. Their failures are aggregated by host (source), each host's failure
rate is shrunk towards the corpus by a beta prior fitted to the hosts by moments, and hosts whose shrunk rate is far
above the prior mean fail as a whole; that verdict is joined back to the documents.

Null or empty text has no words and fails. A null host is judged for its documents alone: it never fails as a host.
Repeated rows count each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, staged

#: A host fails when its shrunk failure rate is at least HOST_RATE and HOST_SD prior deviations above the prior mean, or at least HOST_SURE.
HOST_RATE, HOST_SD, HOST_SURE = 0.5, 2.0, 0.9
#: Verdicts of up to so many hosts are broadcast (some 60 bytes each); more are joined.
BROADCAST_HOSTS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the document counts."""
    names = [c.lower() for c in docs.columns]
    base = documents(docs, host) if host in names else documents(docs).withColumn(host, F.lit(None).cast("string"))
    text = F.coalesce("text", F.lit(""))
    d = base.select("doc_id", F.col(host).cast("string").alias("host"), text.alias("text"))
    d = d.select("doc_id", "host", "text", words(F.col("text")).alias("w"))
    d = d.withColumn("n_words", F.size("w").cast("bigint"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("lines", lines).withColumn("hash", F.transform("w", lambda x: F.xxhash64(x)))
    window = F.when(F.col("n_words") >= 8, F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - 7), lambda i: F.xxhash64(*(F.get("hash", i + (j - 1)) for j in range(8)))))
    d = d.withColumn("h", window)
    by_hash = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.size("h") > F.size(F.array_distinct("h")), by_hash).otherwise(F.lit(None)))
    return d.select(
        "doc_id",
        "host",
        "n_words",
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(repeated(F.col("w"), F.col("s")), F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def repeated(w: Column, s: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more. s: windows' hashes and places, sorted, so equal ones stand side by side; they are confirmed on the words."""

    def pair(a: Column, b: Column) -> Column:
        return F.when(a["h"] == b["h"], F.when(F.slice(w, a["i"] + 1, 8) == F.slice(w, b["i"] + 1, 8), F.array(a["i"], b["i"])))

    pairs = F.filter(F.zip_with(s, F.slice(s, 2, F.size(s)), pair), lambda x: x.isNotNull())
    at = F.array_sort(F.array_distinct(F.flatten(pairs)))
    return F.aggregate(at, F.struct(F.lit(0).alias("sum"), F.lit(-8).alias("last")), lambda acc, x: F.struct((acc["sum"] + F.least(F.lit(8), x - acc["last"])).alias("sum"), x.alias("last")), lambda acc: acc["sum"])


def failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def host_verdicts(d: DataFrame) -> DataFrame:
    """host, n, failures, shrunk rate and verdict. The prior's mean and strength come from the hosts' rates, weighted by size."""
    hosts = d.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("x"))
    rate = F.col("x") / F.col("n")
    prior = hosts.agg(F.sum("x").alias("sx"), F.sum("n").alias("sn"), F.sum(F.col("n") * rate * rate).alias("s2"), F.count("*").alias("k")).select(
        ((F.col("sx") + 0.5) / (F.col("sn") + 1)).alias("mean"), F.greatest(F.col("s2") / F.col("sn") - (F.col("sx") / F.col("sn")) ** 2, F.lit(0.0)).alias("raw"), (F.col("sn") / F.col("k")).alias("typical")
    )
    spread = F.col("mean") * (1 - F.col("mean"))
    prior = prior.withColumn("var", F.greatest((F.col("raw") - spread / F.col("typical")) / (1 - 1 / F.greatest("typical", F.lit(2.0))), spread / 1000)).withColumn("strength", F.greatest(spread / F.col("var") - 1, F.lit(1.0)))
    return hosts.join(F.broadcast(prior)).select(
        "host",
        ((F.col("x") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("host_rate"),
        F.greatest(F.lit(HOST_RATE), F.least(F.lit(HOST_SURE), F.col("mean") + HOST_SD * F.sqrt(F.col("var")))).alias("host_limit"),
    )


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """The counts, base_failed, host_rate and kept of each document."""
    d = staged(measured(docs, host).withColumn("base_failed", failed()), "rules")
    v = staged(host_verdicts(d), "hosts")
    if v.count() <= BROADCAST_HOSTS:
        v = F.broadcast(v)
    return d.join(v, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce(F.col("host_rate") >= F.col("host_limit"), F.lit(False))).alias("kept"), F.round("host_rate", 9).alias("host_rate")
    )


op8 = quality_rules
