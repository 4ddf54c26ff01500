"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered from 0 in the order of their id (then size and checksum, so that repeated ids have
a fixed order too; null ids come first). A keyed Feistel network permutes the smallest even-bit
domain that holds all numbers; a number that falls outside the row count is permuted again until it
is inside (cycle walking), which leaves a permutation of exactly the row numbers. The permuted number
p then gives shard p mod n and slot p div n: shard sizes differ by one row at most, slots have no
gaps, and where any row goes can be computed from its number alone.

Global numbers come from a range sort on the id: each partition is counted, and the counts' prefix
sums (one number per partition) are the partitions' first numbers. Texts are not shuffled, only ids,
sizes and checksums.

Defined results: an empty table gives an empty result; a null text has size 1 and the checksum of no
bytes; equal texts are rows like any others; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, n_partitions, written

ROUNDS = 6
MASK = (1 << 64) - 1


def mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift) of x and the round's key."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The seed's permutation of 0..n-1, at the given row numbers."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, bits = np.uint64((1 << half) - 1), np.uint64(half)
    out = rows.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        a, b = x >> bits, x & low
        for r in range(ROUNDS):
            a, b = b, a ^ (mix(b, (seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & MASK) & low)
        out[todo] = (a << bits) | b
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        numbered = pa.array(np.arange(n, n + batch.num_rows, dtype=np.int64))
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), numbered], [*batch.schema.names, "part", "at"])


def _placed(bases: dict[int, int], n: int, n_shards: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.zeros(max(bases, default=0) + 1, np.int64)
        for k, v in bases.items():
            base[k] = v
        for batch in batches:
            row = base[batch.column("part").to_numpy()] + batch.column("at").to_numpy()
            p = permute(row, n, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array(row), pa.array((p % n_shards).astype(np.int32)), pa.array(p // n_shards)], ["doc_id", "size", "text_crc32", "row", "shard", "slot"])

    return run


def shards(docs: DataFrame, n_shards: int = 16, seed: int = 20240229, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row (the global number), shard and slot of every row."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    order = ["doc_id", "size", "text_crc32"]
    ranged = src.repartitionByRange(n_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    numbered = written(map_arrow(ranged, _tallied, f"doc_id {id_type}, size long, text_crc32 long, part int, at long"), "rows")
    sizes = dict(numbered.groupBy("part").count().collect())  # one number per partition
    bases, n = {}, 0
    for part in sorted(sizes):
        bases[part] = n
        n += sizes[part]
    return map_arrow(numbered, _placed(bases, n, n_shards, seed), f"doc_id {id_type}, size long, text_crc32 long, row long, shard int, slot long")
