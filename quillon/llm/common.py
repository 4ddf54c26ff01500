"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the shingle and rule operators: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that a text operator reads, under fixed names; other columns are pruned away."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other letter as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder's URI below spark.checkpoint.dir, which the driver and all executors share.

    Where the setting is missing on a single machine, as in tests, a temporary folder takes its place;
    on a cluster that is an error, since other machines would not find it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if not current and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = current or "file://" + tempfile.mkdtemp(prefix="quillon-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ready_checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: this cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file: QUILLON_TOKENIZERS if set, else that of the installed package."""
    if root := os.environ.get("QUILLON_TOKENIZERS"):
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)
