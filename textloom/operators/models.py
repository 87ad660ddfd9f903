"""Learned paragraph models over the labels: term weights, standardised features, grouped splits and their audit.

Groups are sources; a group's documents are never on both sides of a split. Fitting runs on the executors (Spark ML); the
driver holds coefficients and metrics.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .docshape import NAMES, modelfree, sql

# Fixed values of the models.
MAX_TERMS, MIN_DF, FOLDS, SPLITS, TEST_SHARE = 4000, 2, 5, 20, 0.2


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, source and label (1: bad) of the labelled documents, with weights that balance the classes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").select("doc_id", (1 - F.col("quality")).cast("double").alias("label"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source")).join(labels, "doc_id")
    share = F.broadcast(d.agg(F.avg("label").alias("share")))
    return d.crossJoin(share).withColumn("weight", F.when(F.col("label") == 1, 0.5 / F.greatest("share", F.lit(1e-6))).otherwise(0.5 / F.greatest(1 - F.col("share"), F.lit(1e-6)))).drop("share")


def bucket(seed: int, of: str = "source") -> Column:
    """A number from 0 to 1 for each group and seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(of))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def terms() -> Pipeline:
    """Sublinear TF-IDF of words and word pairs with balanced logistic regression."""
    sublinear = SQLTransformer(statement="SELECT *, concat(w1, w2) AS grams FROM __THIS__")
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="w1", pattern=r"\p{L}[\p{L}\x27\-]*", gaps=False),
            NGram(n=2, inputCol="w1", outputCol="w2"),
            sublinear,
            CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=MAX_TERMS, minDF=MIN_DF),
            IDF(inputCol="tf", outputCol="features"),
            LogisticRegression(weightCol="weight", regParam=0.01, maxIter=30),
        ]
    )


def features() -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(NAMES), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(weightCol="weight", regParam=0.001, maxIter=50)])


def two_sided(df: DataFrame) -> bool:
    return df.select("label").distinct().count() == 2


def scored(model, df: DataFrame, *keep: str) -> DataFrame:  # noqa: ANN001
    return model.transform(df).select("doc_id", *keep, "label", F.round(vector_to_array("probability")[1], 6).alias("p"))


SCORES = "doc_id bigint, fold int, label double, p double"


def term_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: five-fold grouped cross-validation; every labelled document is scored by the model of the other folds."""
    d = labelled(spark, sf_dir).withColumn("fold", F.floor(bucket(12345) * FOLDS).cast("int"))
    out = None
    for fold in range(FOLDS):
        train, test = d.where(F.col("fold") != fold), d.where(F.col("fold") == fold)
        if two_sided(train):
            part = scored(terms().fit(train), test, "fold")
            out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], SCORES)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, modelfree).join(labelled(spark, sf_dir).drop("text"), "doc_id")


def first_valid_split(d: DataFrame, seed: int = 12345, tries: int = 20) -> int:
    """M3: the first seed whose split has both classes on both sides."""
    sides = d.groupBy("source", "label").count()
    for s in range(seed, seed + tries):
        got = sides.groupBy((bucket(s) < TEST_SHARE).alias("test")).agg(F.count_distinct("label").alias("k")).collect()
        if len(got) == 2 and all(r.k == 2 for r in got):
            return s
    raise ValueError("no split has both classes on both sides")


def feature_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, M3: standardised shape features of units, fitted on the first valid grouped split; the other side's units are scored."""
    d = units(spark, sf_dir)
    s = first_valid_split(d)
    model = features().fit(d.where(bucket(s) >= TEST_SHARE))
    return scored(model, d.where(bucket(s) < TEST_SHARE), "section", "unit")


def metrics(df: DataFrame) -> DataFrame:
    """Counts and rates at 0.5, and the rank AUC with midranks from counts by score."""
    by_p = df.groupBy("p").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    by_p.createOrReplaceTempView("counts_by_score")
    auc = df.sparkSession.sql("SELECT sum(pos * (below + neg / 2)) / nullif(max(tp) * max(tn), 0) AS auc FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY p) - neg AS below, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM counts_by_score) x")
    c = df.agg(*(F.count_if((F.col("label") == y) & ((F.col("p") >= 0.5) == bool(z))).alias(n) for n, y, z in (("tp", 1, 1), ("fn", 1, 0), ("fp", 0, 1), ("tn", 0, 0))))
    rate = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return c.crossJoin(auc).withColumn("tpr", rate("tp", "fn")).withColumn("fpr", rate("fp", "tn")).withColumn("bacc", (F.col("tpr") + 1 - F.col("fpr")) / 2)


def audit(spark: SparkSession, sf_dir: str, splits: int = SPLITS) -> DataFrame:
    """M4: metrics of grouped splits; those without both classes on both sides are passed over."""
    d = units(spark, sf_dir).cache()
    rows = []
    for seed in range(100, 100 + splits):
        train, test = d.where(bucket(seed) >= TEST_SHARE), d.where(bucket(seed) < TEST_SHARE)
        if two_sided(train) and two_sided(test):
            m = metrics(scored(features().fit(train), test)).first()
            rows.append((seed, *(None if m[k] is None else float(m[k]) for k in ("auc", "tpr", "fpr", "bacc"))))
    d.unpersist()
    return spark.createDataFrame(rows, "seed int, auc double, tpr double, fpr double, bacc double")


FRAMES = {
    "m1_term_model": term_model,
    "m2_m3_feature_model": feature_model,
    "m4_grouped_audit": lambda spark, sf_dir: audit(spark, sf_dir, 4),  # 20 by default
}
