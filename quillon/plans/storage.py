"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast; it is counted first. The driver holds each some times over (as collected, as a
#: table of hashes, and in blocks) as long as its plan lives, and a whole diff has dozens of them.
BROADCAST_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset on a single machine; on a cluster it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@dataclass
class Run:
    """The tables of one run, numbered in the order in which they are made."""

    folder: str
    made: list[str] = field(default_factory=list)
    reused: int = 0


_run: ContextVar[Run | None] = ContextVar("run", default=None)


@contextmanager
def run_in(folder: str) -> Iterator[Run]:
    """Tables that are saved inside are kept below the folder, and those that an earlier run has finished there are read
    instead of made again. The same work makes the same tables in the same order, since all choices follow the data."""
    token = _run.set(run := Run(folder.rstrip("/")))
    try:
        yield run
    finally:
        _run.reset(token)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of the path, and the path as Hadoop has it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def tidy(spark: SparkSession, run: Run, *kept: DataFrame) -> None:
    """Deletes the run's tables but those that the kept frames read."""
    used = {f.rsplit("/", 1)[0].split(":", 1)[-1].replace("//", "/") for df in kept for f in df.inputFiles()}
    for path in run.made:
        if not any(u.startswith(path.split(":", 1)[-1].replace("//", "/")) for u in used):
            remove(spark, path)


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a table in the shared folder, read back; `by`: columns whose values get a folder each."""
    spark, run = df.sparkSession, _run.get()
    if run is None:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    else:
        path = f"{run.folder}/{len(run.made):05d}-{name}"
        run.made.append(path)
        fs, at = file_system(spark, f"{path}/_SUCCESS")
        if fs.exists(at):
            run.reused += 1
            return spark.read.schema(df.schema).parquet(path)
    out = df.write.mode("errorifexists" if run is None else "overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """df as a saved table, and its number of rows, counted while it is written."""
    run = _run.get()
    before = run.reused if run else 0
    seen = Observation()
    out = saved(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, out.count() if run and run.reused > before else seen.get["n"]


def small(df: DataFrame) -> DataFrame:
    """df for broadcast if it is counted to be small, else for a join that shuffles: by the size of its files Spark would
    broadcast a saved table of a million rows, which are few bytes each while they are compressed."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


#: Bits of a row's number inside its partition, in Spark's own numbering of rows.
ROW_BITS = 33


def in_ranges(df: DataFrame, *order: str | Column, name: str = "sorted") -> DataFrame:
    """df sorted by the order over range partitions, as a saved table, with `part` and `row` (from 0 inside a part).

    No task holds more than a range, and later parts hold later rows.
    """
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return saved(cut.withColumns({"part": F.shiftright(at, ROW_BITS), "row": at.bitwiseAND(F.lit((1 << ROW_BITS) - 1))}), name)


def ranks(df: DataFrame, *order: str | Column, rank: str = "rank", after: int = 0) -> DataFrame:
    """df with its rows' ranks (from `after` + 1) in the order, by prefix sums of the sizes of range partitions."""
    table = in_ranges(df, *order)
    offsets, seen = [], after
    for part, n in sorted(tuple(r) for r in table.groupBy("part").count().collect()):  # a row for each partition
        offsets.append((part, seen))
        seen += n
    starts = df.sparkSession.createDataFrame(offsets, "part long, start long")
    return table.join(F.broadcast(starts), "part").withColumn(rank, F.col("start") + F.col("row") + 1).drop("part", "row", "start")


def places(df: DataFrame, group: list[str], order: list[str | Column], place: str = "place") -> DataFrame:
    """df with each row's number (from 1) inside its group in the order. A group that is longer than a range lies in
    several parts; their sizes are summed up, so no task holds a group."""
    table = in_ranges(df, *group, *order)
    runs = table.groupBy(*group, "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    runs = small(saved(runs.select(*group, "part", (before - F.col("first") + 1).alias("start")), "runs"))
    return table.join(runs, [*group, "part"]).withColumn(place, F.col("row") + F.col("start")).drop("part", "row", "start")
