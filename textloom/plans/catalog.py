"""Every query by name: its Spark plan and, where SQL can express it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import Duck, Spark
from ..operators import aggregates, axes, docshape, findings, manuscript, measures, models, profiles, provenance, records, segmentation, windows_joins
from ..sources import readers
from ..sources.tables import register

#: Queries as SQL over relations that each dialect defines for itself.
BODIES = segmentation.QUERIES | aggregates.QUERIES | windows_joins.QUERIES | profiles.QUERIES | manuscript.QUERIES | findings.QUERIES | measures.QUERIES | records.QUERIES | docshape.QUERIES | axes.QUERIES
#: Queries as functions of a session and a folder, which SQL can't express.
FRAMES = docshape.FRAMES | models.FRAMES | provenance.FRAMES | readers.FRAMES


def plan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    q = Spark()
    for view, body in axes.VIEWS.get(name, {}).items():
        text = q.sql(body(q))
        register(spark, sf_dir, text)
        spark.sql(text).createOrReplaceTempView(view)
    text = q.sql(BODIES[name](q))
    register(spark, sf_dir, text)
    return spark.sql(text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, name=name: plan(spark, sf_dir, name) for name in BODIES} | FRAMES


def oracle_sql() -> dict[str, str]:
    q = Duck()
    return {name: q.sql(body(q)) for name, body in BODIES.items()}
