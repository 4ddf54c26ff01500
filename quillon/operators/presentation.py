"""Filters, orders and look-ups over results and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.hashing import unsigned_order
from quillon.functions.text import hex_address, name_contains, normalized_name, score_text
from quillon.operators.features import SEMANTIC, line_tokens
from quillon.plans.storage import in_ranges, places, saved, small
from quillon.sources.corpora import BLOCK, Corpus

FILTERS = ("all", "differences", "changed", "added", "removed")


def filtered(rows: DataFrame, kind: str = "all") -> DataFrame:
    """Rows of one kind; differences are all that are not identical."""
    if kind not in FILTERS:
        raise ValueError(f"unknown filter: {kind}")
    return rows if kind == "all" else rows.where(F.col("status") != "identical") if kind == "differences" else rows.where(F.col("status") == kind)


def grid(entries: DataFrame) -> DataFrame:
    """Rows as they are shown: scores only for pairs, addresses in hexadecimal."""
    c = F.col
    return entries.select("diff_id", "status", "name", score_text(c("status"), c("similarity")).alias("similarity"), score_text(c("status"), c("confidence")).alias("confidence"), "algorithm", hex_address(c("left_addr"), "—").alias("left_addr"), hex_address(c("right_addr"), "—").alias("right_addr"), F.concat_ws("/", "bb_identical", "bb_changed", "bb_added", "bb_removed").alias("blocks"))


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """pos: the place of every row within its diff in the shown order, by range partitions and sums of their sizes."""
    return places(rows, ["diff_id"], list(order), "pos").withColumn("pos", F.col("pos").cast("int"))


def steps(placed: DataFrame) -> DataFrame:
    """For every row the place of the next and the previous one that is not identical, without wrapping around.

    A segmented scan: rows are sorted into ranges; inside a range and diff a window finds the neighbours, and what lies
    beyond its ends is carried over from the first and last changes of the diff's other ranges.
    """
    rows = in_ranges(placed, "diff_id", "pos").drop("row")
    change = F.when(F.col("status") != "identical", F.col("pos"))
    ends = rows.groupBy("diff_id", "part").agg(F.min(change).alias("first"), F.max(change).alias("last"))  # a row for each range and diff
    # What follows is what precedes in falling order: a frame that grows costs a step for a row, one that shrinks is read anew for each.
    over = lambda *by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("diff_id", "part", F.min("first").over(over("diff_id", order=F.desc("part"))).alias("after"), F.max("last").over(over("diff_id", order=F.asc("part"))).alias("before"))
    inside = rows.withColumns({"next_change": F.min(change).over(over("diff_id", "part", order=F.desc("pos"))), "previous_change": F.max(change).over(over("diff_id", "part", order=F.asc("pos")))})
    joined = inside.join(small(saved(carried, "carried")), ["diff_id", "part"])
    return joined.withColumns({"next_change": F.coalesce("next_change", "after"), "previous_change": F.coalesce("previous_change", "before")}).drop("part", "after", "before")


def first_change(placed: DataFrame, *, last: bool = False) -> DataFrame:
    """Where stepping begins without a selection: the first (or last) row that is not identical."""
    return placed.where("status <> 'identical'").groupBy("diff_id").agg((F.max if last else F.min)("pos").alias("pos"))


def list_units(units: list[DataFrame], part: str = "") -> DataFrame:
    """Units of several corpora (corpus, name, addr) whose names contain the part, by corpus."""
    out = units[0]
    for u in units[1:]:
        out = out.unionByName(u)
    return (out.where(name_contains(F.col("name"), part)) if part else out).orderBy("corpus", "name", "addr")


def resolve_by_name(candidates: DataFrame, name: str) -> DataFrame:
    """The candidate (position, name, path, analysed) whose normalized name fits: analysed ones first, then by position."""
    score = F.when(F.col("analysed"), 2).otherwise(1)
    fit = candidates.where(normalized_name(F.col("name")) == normalized_name(F.lit(name))).withColumn("score", score)
    return fit.orderBy(F.desc("score"), "position").limit(1)


def resolve_by_path(candidates: DataFrame, path: str) -> DataFrame:
    return candidates.where(F.col("path") == path).orderBy("position").limit(1)


def unit_at(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The unit at each wanted address (diff_id, side, at): one that begins there, else the first that has a block around it.

    blocks: diff_id, side, func_addr, begin, end. A block is entered under the one or two buckets of addresses that it
    touches, in buckets of the least power of two that is not below its length; an address looks into its bucket of every
    power in use, of which there are 63 at most. So both look-ups are joins on equal keys.
    """
    key = ["diff_id", "side"]
    bucket = lambda at: F.call_function("shiftright", at, F.col("bits"))
    last = F.col("end") - 1
    # A length beyond the largest number gets buckets of 2^63.
    bits = F.coalesce(F.least(F.length(F.bin(F.try_subtract(last, F.col("begin")))), F.lit(63)), F.lit(63))
    spans = blocks.where("begin < end").select(*key, "func_addr", "begin", "end", bits.alias("bits"))
    entered = spans.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.col("begin")), bucket(last)))))
    asked = wanted.crossJoin(F.broadcast(spans.select("bits").distinct()))
    around = asked.withColumn("bucket", bucket(F.col("at"))).join(entered, [*key, "bits", "bucket"]).where("at >= begin and at < end")
    begins = wanted.join(blocks.select(*key, "func_addr", F.col("func_addr").alias("at")).distinct(), [*key, "at"])
    hit = around.select(*wanted.columns, "func_addr").unionByName(begins.select(*wanted.columns, "func_addr"))
    order = [F.desc(F.col("func_addr") == F.col("at")), unsigned_order(F.col("func_addr"))]
    return hit.withColumn("n", F.row_number().over(Window.partitionBy("diff_id", "side", "at").orderBy(*order))).where("n = 1").drop("n")


def signatures(corpus: Corpus) -> DataFrame:
    """Meaningful tokens of every block that has any, in order."""
    if corpus.lines is not None:
        kept = F.transform(F.filter(line_tokens(), lambda t: t["tok_type"].isin(*SEMANTIC)), lambda t: t["text"])
        # A filter is not put before explode, where it would evaluate the tokens once more.
        return corpus.lines.select(*BLOCK, F.explode_outer(F.array(kept)).alias("kept")).where("size(kept) > 0").select(*BLOCK, F.array_join("kept", " ").alias("signature"))
    kept = corpus.tokens.where(F.col("tok_type").isin(*SEMANTIC))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "tok_no", "text"))), lambda t: t["text"])
    return kept.groupBy(*BLOCK).agg(F.array_join(ordered, " ").alias("signature"))
