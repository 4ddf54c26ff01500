"""Ranked lexical search by three phases of uniform thresholds (TPUT) over term-partitioned postings.

Documents are cut into terms once; only the terms of the items become postings (term, row, impact), where the
impact is the term's share of a score. Postings lie sorted by term and falling impact, in ranges of equal size,
so that a list that is longer than a range is in several.

1. The head of every list, its k largest impacts, is fetched. The sums of heads are lower bounds of scores; the
   k-th highest of an item is its first bound.
2. With T = bound / lists, every list gives all impacts from T on. A document in none of them stays below the
   bound. They meet by document, where the items' partial sums are added up; a sum plus T - 1 for each list that
   did not give the document is the upper bound of its score. The k-th highest sum is the second bound;
   documents whose upper bound reaches it are candidates, ties included.
3. The candidates' impacts in all lists are looked up; the exact scores are ranked.

No list, document or item is capped: where thresholds prune little, more is fetched. In phase 2 a task adds up the
postings of its documents for all items at once, if the items have at most MOST_PAIRS terms altogether; beyond it
the same sums are made by a join and an aggregation. Terms go to the tasks that cut the documents if there are at
most MOST_TERMS; beyond it all terms of the documents are joined with them.

Defined results: null or empty texts have no terms and count for nothing; rows of documents with equal ids are
documents of their own, and so are those with a null id, which rank before others of equal score; items with a
null id are ignored, those with the same id are one item with the terms of all; terms that no document has are
left out; tables may be empty; other columns are ignored, whatever their names; texts have no length limit. Sums
are exact up to 2^53, which is over 100,000 terms an item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, n_partitions, written
from .decontaminate import words

TOP = 50
MOST_TERMS, MOST_PAIRS = 1_000_000, 2_000_000
#: Rows of a side that is broadcast; they are counted first.
BROADCAST_ROWS = 200_000
#: Cells of the table of sums that a task keeps at a time.
CELLS = 4_000_000
#: Every byte that separates terms becomes a blank, A-Z become a-z.
PLAIN = bytes(ord(c.lower()) if (c := chr(i)).isalnum() and i < 128 else i if i >= 128 else 32 for i in range(256))


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def lists_of(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """item_no and item_id; item_no and term, without repeats."""
    known = items.where("item_id is not null")
    ids = written(known.select("item_id").distinct().withColumn("item_no", F.monotonically_increasing_id()), "items")
    lists = known.select("item_id", F.explode(F.array_distinct(words(lower_ascii(F.col("text"))))).alias("term")).join(_side(ids), "item_id")
    return ids, written(lists.select("item_no", "term").distinct(), "lists")


def counted_terms(docs: DataFrame, known: frozenset[bytes] | None) -> DataFrame:
    """A row for each document that has terms (row, doc_id, n), and one for each of its known terms (row, term, tf, n)."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            rows, ids = batch.column("row"), batch.column("doc_id")
            at, term, tf, n, own, total = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                found = (text.as_py() or "").encode().translate(PLAIN).split()
                if not found:
                    continue
                own.append(i)
                total.append(len(found))
                counts = Counter(found)
                for t in counts if wanted is None else wanted & counts.keys():
                    at.append(i)
                    term.append(t)
                    tf.append(counts[t])
                    n.append(len(found))
            none = lambda kind, k: pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(own, pa.int32())), ids.take(pa.array(own, pa.int32())), none(pa.string(), len(own)), none(pa.int64(), len(own)), pa.array(total, pa.int64())], names)
            for k in range(0, len(at), 500_000):
                part = slice(k, k + 500_000)
                here = pa.array(at[part], pa.int32())
                yield pa.RecordBatch.from_arrays([rows.take(here), none(ids.type, len(here)), pa.array(term[part], pa.binary()).cast(pa.string()), pa.array(tf[part], pa.int64()), pa.array(n[part], pa.int64())], names)

    names = ["row", "doc_id", "term", "tf", "n"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut, f"row long, doc_id {kind}, term string, tf long, n long")


def partial_sums(fetched: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """item_no, row, part and upper of documents that can be among the k best, from fetched (row, term_id, impact).

    Within a task documents whose upper bound is below the k-th highest sum met so far are left out.
    """
    known = lists.limit(MOST_PAIRS + 1).count()
    if known > MOST_PAIRS:
        met = fetched.join(lists, "term_id").where("impact >= least").groupBy("item_no", "row").agg(F.sum("impact").alias("part"), (F.max("m") - F.count("*")).alias("open"), F.max("least").alias("least"))
        return met.select("item_no", "row", "part", (F.col("part") + F.col("open") * (F.col("least") - 1)).alias("upper"))
    pdf = lists.select("term_id", "item_no", "least", "m", "bound").toPandas().sort_values(["term_id", "item_no"])
    items, item_at = np.unique(pdf.item_no.to_numpy(np.int64), return_inverse=True)
    terms, first, fan = np.unique(pdf.term_id.to_numpy(np.int64), return_index=True, return_counts=True)
    per = {c: np.zeros(len(items), np.int64) for c in ("least", "m", "bound")}
    for c, v in per.items():
        v[item_at] = pdf[c]
    shared = fetched.sparkSession.sparkContext.broadcast((items, item_at, terms, first, fan, per))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, item_at, terms, first, fan, per = shared.value
        least, m, floor = (per[c][:, None] for c in ("least", "m", "bound"))
        most = max(1, CELLS // max(1, len(items)))
        best = np.zeros((len(items), k))

        def block(row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal best, floor
            docs, doc_at = np.unique(row, return_inverse=True)
            list_at = np.searchsorted(terms, term)
            times = fan[list_at]
            part, seen = np.zeros(len(items) * len(docs)), np.zeros(len(items) * len(docs))
            ends = np.cumsum(times)
            cuts = [0, *np.searchsorted(ends, np.arange(CELLS, ends[-1], CELLS)), len(row)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                t = times[a:b]
                inside = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
                item = item_at[np.repeat(first[list_at[a:b]], t) + inside]
                share = np.repeat(impact[a:b], t)
                given = share >= per["least"][item]
                cell = item[given] * len(docs) + np.repeat(doc_at[a:b], t)[given]
                part += np.bincount(cell, share[given], len(part))
                seen += np.bincount(cell, minlength=len(part))
            part, seen = part.reshape(len(items), -1), seen.reshape(len(items), -1)
            best = np.partition(np.hstack((best, part)), -k, axis=1)[:, -k:]
            floor = np.maximum(floor, best[:, :1])
            upper = part + (m - seen) * (least - 1)
            i, d = np.nonzero((part > 0) & (upper >= floor))
            yield pa.RecordBatch.from_arrays([pa.array(items[i]), pa.array(docs[d]), pa.array(part[i, d].astype(np.int64)), pa.array(upper[i, d].astype(np.int64))], ["item_no", "row", "part", "upper"])

        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:  # rows come sorted by document
            kept.append(tuple(batch.column(c).to_numpy() for c in ("row", "term_id", "impact")))
            row = kept[-1][0]
            if len(row) and row[-1] != kept[0][0][0] and sum(len(x[0]) for x in kept) >= 200_000:
                row, term, impact = (np.concatenate(x) for x in zip(*kept, strict=True))
                starts = np.flatnonzero(np.diff(row)) + 1
                ends = [*starts[most - 1 :: most], starts[-1]]
                a = 0
                for b in sorted(set(ends)):
                    yield from block(row[a:b], term[a:b], impact[a:b])
                    a = b
                kept = [(row[a:], term[a:], impact[a:])]
        if kept and sum(len(x[0]) for x in kept):
            row, term, impact = (np.concatenate(x) for x in zip(*kept, strict=True))
            starts = np.flatnonzero(np.diff(row)) + 1
            a = 0
            for b in [*starts[most - 1 :: most], len(row)]:
                if b > a:
                    yield from block(row[a:b], term[a:b], impact[a:b])
                a = b

    return fetched.repartition(n_partitions(fetched.sparkSession), "row").sortWithinPartitions("row").mapInArrow(add, "item_no long, row long, part long, upper long")


def kth(sums: DataFrame, k: int, name: str) -> DataFrame:
    """item_no and its k-th highest sum, where there are so many."""
    place = F.row_number().over(Window.partitionBy("item_no").orderBy(F.desc("part"), "row"))
    return sums.select("item_no", "part", place.alias("place")).where(F.col("place") <= k).where(F.col("place") == k).select("item_no", F.col("part").alias(name))


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents."""
    spark = docs.sparkSession
    ids, wanted = lists_of(items)
    vocabulary = wanted.select("term").distinct()
    known = None
    if vocabulary.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        known = frozenset(r[0].encode() for r in vocabulary.collect())
    raw = written(counted_terms(docs.select("doc_id", "text"), known), "terms")
    of_docs = raw.where("term is null")
    n_docs, n_terms = of_docs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = raw.where("term is not null").join(_side(vocabulary), "term", "left_semi") if known is None else raw.where("term is not null")
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = found.groupBy("term").agg(F.count("*").alias("df")).select("term", F.monotonically_increasing_id().alias("term_id"), weight.alias("w")).where("w > 0")
    weights = written(weights, "weights")
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {max(n_terms, 1)}L")
    shares = found.join(_side(weights), "term").withColumn("m", m).select("term_id", "row", F.expr("w * ((1000000000 * tf) div (1000 * tf + 20 * m))").alias("impact"))
    order = [F.col("term_id"), F.desc("impact"), F.col("row")]
    postings = written(shares.where("impact > 0").repartitionByRange(n_partitions(spark), *order).sortWithinPartitions(*order), "postings")
    # 1: heads of the lists
    lists = wanted.join(_side(weights), "term").select("item_no", "term_id")
    lists = written(lists.join(_side(lists.groupBy("item_no").agg(F.count("*").alias("m"))), "item_no"), "lists")
    place = F.row_number().over(Window.partitionBy("term_id").orderBy(F.desc("impact"), "row"))
    heads = postings.withColumn("place", place).where(F.col("place") <= k)
    sums = heads.join(_side(lists), "term_id").groupBy("item_no", "row").agg(F.sum("impact").alias("part"))
    first = _side(written(kth(sums, k, "bound"), "bounds"))
    bound = F.coalesce("bound", F.lit(0).cast("long"))
    lists = lists.join(first, "item_no", "left").select("item_no", "term_id", "m", bound.alias("bound"), F.greatest(F.lit(1), F.ceil(bound / F.col("m"))).cast("long").alias("least"))
    lists = written(lists, "thresholds")
    # 2: what the thresholds let through, and its sums
    lowest = lists.groupBy("term_id").agg(F.min("least").alias("lowest"))
    fetched = postings.join(_side(written(lowest, "lowest")), "term_id").where("impact >= lowest").select("row", "term_id", "impact")
    met = written(partial_sums(fetched, lists, k), "sums")
    second = _side(written(kth(met, k, "bound"), "bounds"))
    pairs = written(met.join(second, "item_no", "left").where(F.col("upper") >= F.coalesce("bound", F.lit(0).cast("long"))).select("item_no", "row"), "candidates")
    # 3: exact scores of the candidates
    exact = postings.join(_side(pairs), "row").join(_side(lists.select("item_no", "term_id")), ["item_no", "term_id"], "left_semi").groupBy("item_no", "row").agg(F.sum("impact").alias("score"))
    exact = exact.join(of_docs.select("row", "doc_id"), "row").where("score > 0")
    rank = F.row_number().over(Window.partitionBy("item_no").orderBy(F.desc("score"), "doc_id", "row"))
    best = exact.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(_side(ids), "item_no").select("item_id", "rank", "doc_id", "score")


#: The same scores for all pairs, for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(sum(len(w)) AS BIGINT) AS l_all FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
v AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM p, g GROUP BY term, n_all),
s AS (SELECT item_id, doc_id, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // l_all)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN v USING (term), g GROUP BY ALL)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0) WHERE place <= 50
"""
