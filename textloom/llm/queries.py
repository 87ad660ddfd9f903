"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .decontamination import op1
from .lm import op3
from .near_dedup import op7
from .oracles import ORACLE_SQL  # noqa: F401  the queries' DuckDB SQL
from .packing import op9
from .pii import op2
from .quality_classifier import op4
from .quality_rules import op8
from .secrets import op6
from .substring_dedup import op5
from .suffix_dedup import op10


def on_documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1,
    "op2_pii": on_documents(op2),
    "op3_lm_score": on_documents(op3),
    "op4_quality_classifier": op4,
    "op6_secret_scan": on_documents(op6),
    "op7_near_dedup": on_documents(op7),
    "op8_quality_rules": on_documents(op8),
    "op9_packing": on_documents(op9),
    "op5_substring_dedup": on_documents(op5),
    "op10_suffix_dedup": on_documents(op10),
}

#: The contract's base columns of operators whose other columns SQL can't express, by the same operators.
QUERIES |= {
    "base_columns_of_pii": lambda spark, sf_dir: QUERIES["op2_pii"](spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"),
    "base_columns_of_secrets": lambda spark, sf_dir: QUERIES["op6_secret_scan"](spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"),
    "base_columns_of_lm": lambda spark, sf_dir: QUERIES["op3_lm_score"](spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score")),
}
