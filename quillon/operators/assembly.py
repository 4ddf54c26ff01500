"""The result of a diff: matched, removed and added units, and counts by status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import display_status, entry_name, legacy_status
from quillon.operators.matching import open_units

STATUSES = ("identical", "changed", "added", "removed")
#: Columns of a result row.
RESULT = ("diff_id", "left_addr", "right_addr", "left_name", "right_name", "status", "similarity", "confidence", "algorithm", "bb_identical", "bb_changed", "bb_added", "bb_removed")


def residuals(units: DataFrame, matches: DataFrame) -> DataFrame:
    """Unmatched units: removed on the left, added on the right, with scores of 0 and all blocks counted."""
    left = F.col("side") == "L"
    none = F.lit(0).cast("long")
    return open_units(units, matches, lambda df: df.hint("merge")).select(  # not counted: these matches are no saved table
        "diff_id",
        F.when(left, F.col("addr")).alias("left_addr"),
        F.when(~left, F.col("addr")).alias("right_addr"),
        F.when(left, F.col("name")).alias("left_name"),
        F.when(~left, F.col("name")).alias("right_name"),
        F.when(left, "removed").otherwise("added").alias("status"),
        F.lit(0.0).alias("similarity"),
        F.lit(0.0).alias("confidence"),
        F.lit("unmatched").alias("algorithm"),
        none.alias("bb_identical"),
        none.alias("bb_changed"),
        F.when(left, none).otherwise(F.col("nodes")).alias("bb_added"),
        F.when(left, F.col("nodes")).otherwise(none).alias("bb_removed"),
    )


def assembled(scored: DataFrame, units: DataFrame) -> DataFrame:
    """All result rows: the scored pairs and the residuals."""
    return scored.select(*RESULT).unionByName(residuals(units, scored.select("diff_id", "left_addr", "right_addr")))


def summary(result: DataFrame, *, stored: bool = False) -> DataFrame:
    """Counts by status for each diff; stored=True judges rows that keep the old three statuses by their similarity."""
    status = display_status(F.col("status"), F.col("similarity")) if stored else F.col("status")
    rows = result.select("diff_id", status.alias("s"))
    return rows.groupBy("diff_id").agg(*(F.count_if(F.col("s") == s).alias(f"n_{s}") for s in STATUSES))


def entries(result: DataFrame, *, old_status: bool = False) -> DataFrame:
    """Rows of a stored document: one name (left, else right), addresses with 0 for none, and the status."""
    status = legacy_status(F.col("status")) if old_status else F.col("status")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return result.select("diff_id", entry_name(F.col("left_name"), F.col("right_name")).alias("name"), status.alias("status"), zero("left_addr"), zero("right_addr"), "similarity", "confidence", "algorithm", "bb_identical", "bb_changed", "bb_added", "bb_removed")
