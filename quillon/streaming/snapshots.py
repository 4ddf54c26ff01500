"""An extension: incremental snapshots. New text units that arrive as files are fingerprinted batch by batch.

The compared engine has no streams; this runs the batch operators over each micro-batch and appends, so
that a later diff reads fingerprints instead of texts. Batches are keyed by their number: a batch that
is run again after a failure overwrites its own partition, so results are written exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions.hashing import text_key

UNITS = "diff_id string, side string, addr long, name string, text string"


def fingerprints(units: DataFrame) -> DataFrame:
    """Exact and normalized fingerprints of text units."""
    lines = F.split("text", "\n")
    return units.select("diff_id", "side", "addr", "name", text_key(F.array_join(lines, "")).alias("byte_hash"), text_key(F.regexp_replace("text", "[0-9]+", "")).alias("norm_hash"), F.size(lines).cast("long").alias("nodes"))


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Fingerprints all units below source that are new since the checkpoint, as Parquet partitions below target."""

    def write(batch: DataFrame, number: int) -> None:
        fingerprints(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(UNITS).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
