"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, neardup, pieces, pii, ranking, rules, secrets, sharding, suffix, tokenbin, whitening, wordpiece
from .common import table
from pyspark.sql import functions as F

DOC = "documents"


def op1_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_bytes(table(spark, sf_dir, DOC), keep_spans=False)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, DOC))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, DOC), table(spark, sf_dir, "benchmark"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, DOC), keep_ids=False, keep_text=False)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(table(spark, sf_dir, DOC), keep_ids=False)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(table(spark, sf_dir, DOC))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, DOC))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, DOC))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, DOC))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, DOC), table(spark, sf_dir, "benchmark"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, DOC))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact deviation is a decimal; here it is a long, null where it is beyond one."""
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeated_bytes": op1_repeated_bytes,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_pieces": op4_pieces,
    "op5_token_files": op5_token_files,
    "op6_main_text": op6_main_text,
    "op7_shards": op7_shards,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_token_counts": op9_token_counts,
    "op10_secrets": op10_secrets,
    "op11_ranked_search": op11_ranked_search,
    "op12_personal_data": op12_personal_data,
    "op13_whitening": op13_whitening,
}
ORACLE: dict[str, str] = {"op1_repeated_bytes": suffix.SQL, "op3_decontamination": decontaminate.SQL, "op8_near_duplicates": neardup.SQL, "op11_ranked_search": ranking.SQL}
