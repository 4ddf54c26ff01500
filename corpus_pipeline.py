"""Training-data pipeline over the documents table.

Quality rules, near-duplicates, benchmark decontamination and secrets are settled in this order, and
what is left is encoded. A stage gets all rows that the one before it kept; all stages but the last
return the columns of documents.

Defined results: rows with a null text, an empty one or fewer than ten words go in the first stage. Of
equal texts and of repeated rows one row stays, that of the smallest id. A row with a null id is kept like
others. Further columns, whatever their names, stay up to the last stage. Texts have no length limit; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, neardup, pieces, rules, secrets
from quillon.llm.common import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust outlier test reject go."""
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more over five-word shingles stays."""
    return neardup.keep_first(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated with benchmark items go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the secrets in them are replaced."""
    return secrets.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids with the end id, and digests of the ids and of the decoded text."""
    return pieces.encode_decode(docs, keep_text=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("encoding and decoding", encoding),
]

#: SQL cannot express the first and last stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
