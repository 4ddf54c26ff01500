"""Whitening of embeddings: exact integer centring, Spark MLlib's Gramian, eigenvectors, projection.

An entry c becomes the whole number floor(1024 c) + 100000. n and the sums S per dimension are exact, and so is
the centred row n x - S, whose entries are whole numbers that a double holds. RowMatrix.computeGramianMatrix adds
up the products of these rows, partition by partition; divided by n (and by n squared, for the scale of the rows)
it is the covariance. It has as many rows as a vector has dimensions (at most MOST_DIMENSIONS), so its
eigenvectors are found on the driver, and they are broadcast; rows are projected in Arrow batches.

Defined results: rows whose vector is null, empty, holds null or non-finite entries, or has another length than
most vectors (of two lengths that are equally common, the longer) are dropped; rows with equal ids, or none, are
rows of their own. A component whose eigenvalue is below FLAT of the trace has no direction of its own; it gets a
null `whitened` and does not count for `identity_error` (null if there is no other). Of fewer dimensions than
components there are as many components as dimensions. An empty table gives an empty one; other columns are
ignored, whatever their names. `deviation` is exact as a decimal of 38 digits. Entries must be below 2^52 / n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
MOST_DIMENSIONS, FLAT = 8192, 1e-13


def fit_list(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """vec_id and x of the rows that count, their number and their dimension."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    sound = rows.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("v")).where((F.size("v") > 0) & F.forall("v", finite))
    sound = written(sound.select("vec_id", F.size("v").alias("d"), F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x")), "vectors")
    common = sound.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return sound.drop("d"), 0, 0
    if common.d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {common.d} dimensions; {MOST_DIMENSIONS} is the most")
    return sound.where(F.col("d") == common.d).drop("d"), common.n, common.d


def gramian(rows: DataFrame, d: int) -> np.ndarray:
    """Sum of the products of the rows' entries (column y: an array of doubles), by Spark MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("y").alias("y")), "y")
    return RowMatrix(vectors, numCols=d).computeGramianMatrix().toArray()


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row and component."""
    spark = rows.sparkSession
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fit, n, d = fit_list(rows)
    if not n:
        return spark.createDataFrame([], schema)
    sums = np.zeros(d, np.int64)
    for at, s in fit.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum("x")).collect():  # a row for each dimension
        sums[at] = s
    total = F.lit(sums.tolist())
    centred = fit.select(F.zip_with("x", total, lambda x, s: (x * n - s).cast("double")).alias("y"))
    covariance = gramian(centred, d) / n / n / n
    values, vectors = np.linalg.eigh(covariance)
    top = min(components, d)
    values, vectors = values[::-1][:top], vectors[:, ::-1][:, :top]
    trace = float(np.trace(covariance))
    full = values > FLAT * trace if trace > 0 else np.zeros(top, bool)
    explained = [float(v / trace) if trace > 0 else None for v in values]
    scale = np.where(full, 1 / np.sqrt(np.where(full, values, 1)), 0)
    shared = spark.sparkContext.broadcast((sums, vectors * scale))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, onto = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            y = np.stack(pdf.x.to_numpy()).astype(np.int64) * n - sums
            if float(np.abs(y).max()) ** 2 * d < 2**62:
                squares = (y * y).sum(1).tolist()
            else:  # in parts of 31 bits
                high, low = y >> 31, y & (2**31 - 1)
                squares = [(int(a) << 62) + (int(b) << 32) + int(c) for a, b, c in zip((high * high).astype(object).sum(1), (high * low).astype(object).sum(1), (low * low).astype(object).sum(1), strict=True)]
            yield pd.DataFrame({"vec_id": pdf.vec_id, "deviation": [str(s) for s in squares], "w": list((y / n) @ onto)})

    out = written(fit.mapInPandas(project, f"vec_id {kind}, deviation string, w array<double>"), "whitened")
    used = np.flatnonzero(full)
    error = None
    if len(used):
        means = out.agg(*(F.avg(F.get("w", F.lit(int(i)))).alias(f"m{i}") for i in used)).first()
        own = F.array(*(F.get("w", F.lit(int(i))) - means[f"m{i}"] for i in used))
        error = float(np.abs(gramian(out.select(own.alias("y")), len(used)) / n - np.eye(len(used))).max())
    per = F.array(*(F.struct(F.lit(i + 1).alias("component"), (F.get("w", F.lit(i)) if full[i] else F.lit(None).cast("double")).alias("whitened"), F.lit(explained[i]).cast("double").alias("explained")) for i in range(top)))
    each = out.select("vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.explode(per).alias("c"))
    return each.select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
