"""Quality classifier by importance resampling.

Texts are bags of hashed word unigrams and bigrams. Two generative models, of the target (documents labelled good and not
toxic) and of all raw text, give each bucket a smoothed log ratio. A document's weight is the lowest of three statistics,
each in units of its cut: the mean ratio, the sum of strongly negative ratios over the root of the length (a few words
that the target never uses), and the signs of toxic text: different words and word beginnings of PREFIX characters that
stand in a far larger share of the toxic labelled documents than of the good ones. The first two cuts are the CUT quantile
over labelled good documents that the target model has not seen. The cut on toxic signs is where the share of unseen toxic
documents kept, and GOOD_WORTH times the share of unseen good ones rejected, is smallest. The sample is drawn by Gumbel
top-k on the weights at a temperature; k is a parameter, by default the number of documents above the cut.

The target model and the cuts are fitted on at most FIT good and FIT toxic labelled rows (those with the smallest hashes of their ids);
everything else covers all documents. Null and empty texts have no n-gram and are rejected; without any fitting label
nothing else is. Noise depends on the doc_id alone. Repeated rows count each and share their verdict; rows tied at the
k-th key are all kept. Null labels don't count. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, mix, read, release, staged, trim
from .tree_sum import tree_sum
from .words import groups, hashed_words, signs

BUCKETS, FIT, CUT, SHARPNESS = 1 << 20, 20_000, 0.002, 200.0
SMOOTH_MEAN, SMOOTH_RARE = 10.0, 1.0
PART_BYTES = 1 << 20
PREFIX, SMOOTH_TOXIC, CLEAR, GOOD_WORTH = 5, 2.0, 2.0, 10.0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each unigram and bigram."""
    sizes, codes, hashes = hashed_words(texts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    one = mix(hashes.astype(np.uint64))[codes]
    two = mix(one[:-1] * np.uint64(31) + one[1:])
    same = doc[:-1] == doc[1:]
    return np.concatenate([doc, doc[:-1][same]]), (np.concatenate([one, two[same]]) % np.uint64(BUCKETS)).astype(np.int64)


def toxic_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each different word and word beginning."""
    doc, hashes = signs(texts, PREFIX)
    return doc, (mix(hashes) % np.uint64(BUCKETS)).astype(np.int64)


def counter(target, toxic) -> Callable:  # noqa: ANN001  broadcast sets of ids
    def run(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        release()
        total = np.zeros(COUNTS)
        for batch in batches:
            for ids, texts in groups(batch.column("doc_id").to_pylist(), batch.column("text"), PART_BYTES):
                doc, bucket = features(texts)
                total[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                good = np.fromiter((i in target.value for i in ids), bool, len(ids))
                mine = good[doc]
                if mine.any():
                    total[BUCKETS : 2 * BUCKETS] += np.bincount(bucket[mine], minlength=BUCKETS)
                for n, these in enumerate((good, np.fromiter((i in toxic.value for i in ids), bool, len(ids))), 2):
                    if these.any():
                        total[n * BUCKETS : (n + 1) * BUCKETS] += np.bincount(toxic_features(texts.filter(pa.array(these)))[1], minlength=BUCKETS)
                        total[4 * BUCKETS + n - 2] += these.sum()
        trim()
        return total

    return run


#: N-grams of raw and target by bucket, good and toxic documents by bucket of a sign, and their numbers.
COUNTS = 4 * BUCKETS + 2


@dataclass
class Ratios:
    """Smoothed log ratios of target to raw by bucket: a bucket with few expected target counts stays near 0. toxic: what a sign adds."""

    mean: np.ndarray
    rare: np.ndarray
    toxic: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Ratios:
        raw, target, good, toxic = counts[: 4 * BUCKETS].reshape(4, BUCKETS)
        n_good, n_toxic = counts[4 * BUCKETS :]
        expected = raw * (target.sum() / max(1.0, raw.sum()))
        ratio = lambda a: np.log((target + a) / (expected + a)).astype(np.float32)
        smooth = lambda c, n: (c + SMOOTH_TOXIC * n / max(1.0, n_good + n_toxic)) / (n + SMOOTH_TOXIC)
        signs_of = np.log(smooth(toxic, n_toxic) / smooth(good, n_good)) - CLEAR if n_good and n_toxic else np.zeros(BUCKETS)
        return cls(ratio(SMOOTH_MEAN), np.minimum(ratio(SMOOTH_RARE) + 1, 0), np.maximum(signs_of, 0).astype(np.float32))

    def statistics(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Number of n-grams, mean ratio, rare statistic and toxic signs of each text."""
        n = len(texts)
        count, mean, rare, toxic = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n)
        for at, some in groups(list(range(n)), texts, PART_BYTES):
            doc, bucket = features(some)
            c = np.bincount(doc, minlength=len(at))
            count[at] = c
            mean[at] = np.bincount(doc, self.mean[bucket], len(at)) / np.maximum(c, 1)
            rare[at] = np.bincount(doc, self.rare[bucket], len(at)) / np.sqrt(np.maximum(c, 1))
            if self.toxic.any():
                doc, bucket = toxic_features(some)
                toxic[at] = np.bincount(doc, self.toxic[bucket], len(at))
        return count, mean, rare, toxic


STATISTICS = "doc_id bigint, n_grams bigint, mean_ratio double, rare_ratio double, toxic_signs double"


def measure(ratios) -> Callable:  # noqa: ANN001  a broadcast
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            n, mean, rare, toxic = ratios.value.statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(mean), pa.array(rare), pa.array(toxic)], ["doc_id", "n_grams", "mean_ratio", "rare_ratio", "toxic_signs"])
        trim()

    return run


#: Weight of texts without n-grams, below any other.
NOTHING = -1e9


@dataclass
class Fitted:
    """What decides on a text: ratios, the cuts in units of which weights are, and the k-th key."""

    ratios: object
    mean_cut: float
    rare_cut: float
    toxic_cut: float
    temperature: float = 1 / SHARPNESS
    least_key: float = -1e300

    def weight(self, n: Column, mean: Column, rare: Column, toxic: Column) -> Column:
        return F.when(n == 0, F.lit(NOTHING)).otherwise(F.least(mean / self.mean_cut, rare / self.rare_cut, -toxic / self.toxic_cut))

    def key(self, doc_id: Column, weight: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.lit(20260726)), 11) + 0.5) / float(1 << 53)
        return weight + -F.log(-F.log(u)) * self.temperature


def best_cut(good: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the smallest share of toxic kept plus GOOD_WORTH times that of good rejected, halfway to the next value."""
    if not len(good) or not len(toxic):
        return 1e9
    values = np.unique(np.concatenate([[0.0], good, toxic]))
    kept = np.searchsorted(np.sort(toxic), values, side="right") / len(toxic)
    lost = 1 - np.searchsorted(np.sort(good), values, side="right") / len(good)
    i = int(np.argmin(kept + GOOD_WORTH * lost))
    return max(1e-3, float(values[i] + values[min(i + 1, len(values) - 1)]) / 2)


def fit(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = 1 / SHARPNESS) -> tuple[Fitted, DataFrame]:
    """The fitted decision, and doc_id, n_grams, mean_ratio, rare_ratio, toxic_signs, weight, key of every document."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    base = documents(docs)
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
    first = lambda where: [r.doc_id for r in rows.where(where).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT).collect()]
    ids, bad = first("quality = 1 and toxic = 0"), first("toxic = 1")
    seen, unseen = frozenset(ids[::2]), frozenset(ids[1::2])
    ratios = sc.broadcast(Ratios.of(tree_sum(base, counter(sc.broadcast(seen), sc.broadcast(frozenset(bad[::2]))), COUNTS)))
    measured = staged(base.mapInArrow(measure(ratios), STATISTICS), "weights")
    held = spark.createDataFrame([(i,) for i in unseen], "doc_id bigint")
    q = measured.join(F.broadcast(held), "doc_id").where("n_grams > 0").agg(F.percentile("mean_ratio", F.lit(CUT)).alias("m"), F.percentile("rare_ratio", F.lit(CUT)).alias("r")).first()
    signed = spark.createDataFrame([*((i, False) for i in unseen), *((i, True) for i in bad[1::2])], "doc_id bigint, bad boolean")
    found = measured.join(F.broadcast(signed), "doc_id").where("n_grams > 0").groupBy("doc_id", "bad").agg(F.first("toxic_signs").alias("t")).collect()
    toxic_cut = best_cut(np.array([x.t for x in found if not x.bad]), np.array([x.t for x in found if x.bad]))
    fitted = Fitted(ratios, max(-(q.m or 0.0), 1e-3) if q.m is not None else 1e9, max(-(q.r or 0.0), 1e-3) if q.r is not None else 1e9, toxic_cut, temperature)
    weighted = measured.withColumn("weight", fitted.weight(F.col("n_grams"), F.col("mean_ratio"), F.col("rare_ratio"), F.col("toxic_signs"))).withColumn("key", fitted.key(F.col("doc_id"), F.col("weight")))
    if k is None:
        k = weighted.where("weight >= -1").count()
    fitted.least_key = kth_largest(weighted, "key", k)
    return fitted, weighted


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """A value that k rows reach, by narrowing histograms; ties and values closer than the last bin are on the same side."""
    if k <= 0:
        return 1e300
    lo, hi = df.where(F.col(column) > NOTHING / 2).agg(F.min(column), F.max(column)).first()
    if lo is None:
        return 1e300
    for _ in range(5):
        width = (hi - lo) / bins
        if width <= 1e-13 * max(1.0, abs(lo)):
            break
        bin_of = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
        counts = dict(df.where(F.col(column).between(lo, hi)).groupBy(bin_of.alias("b")).count().collect())
        for b in sorted(counts, reverse=True):
            if counts[b] >= k:
                break
            k -= counts[b]
        else:
            break
        lo, hi, alone = lo + b * width, lo + (b + 1) * width, counts[b] == k
        if alone:
            break
    return lo


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = 1 / SHARPNESS) -> DataFrame:
    """One row a document: its n-grams, statistics, weight, key and whether it is selected. k: how many to select, by default as many as lie above the cut; temperature: of the Gumbel noise, in units of the cut."""
    fitted, weighted = fit(docs, labels, k, temperature)
    return weighted.withColumn("selected", F.col("key") >= fitted.least_key)


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The selected rows of docs, all their columns as they are. Texts are weighed again in place, so none is shuffled."""
    fitted, _ = fit(docs, labels)
    ratios = fitted.ratios

    mean_cut, rare_cut, toxic_cut = fitted.mean_cut, fitted.rare_cut, fitted.toxic_cut

    @F.arrow_udf("double")
    def weight(texts: pa.Array) -> pa.Array:
        n, mean, rare, toxic = ratios.value.statistics(texts)
        return pa.array(np.where(n == 0, NOTHING, np.minimum(np.minimum(mean / mean_cut, rare / rare_cut), -toxic / toxic_cut)), pa.float64())

    names = {c.lower(): c for c in docs.columns}
    return docs.where(fitted.key(F.col(f"`{names['doc_id']}`").cast("bigint"), weight(F.col(f"`{names['text']}`").cast("string"))) >= fitted.least_key)


def op4(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
