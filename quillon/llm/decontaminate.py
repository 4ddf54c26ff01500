"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words. From every window of 9 successive 5-word grams the
least gram hash is kept as a fingerprint; any 13 successive words contain such a window whole, so a
document that shares 13 words with a benchmark item shares a fingerprint with it. Fingerprints of
documents and items are joined; documents with a hit are then extended: all their 13-word windows
are compared with the items' windows, word for word. Items of fewer than 13 words are one window of
their own length; for each such length the same is done with grams and windows that fit it.

The benchmark side of a join is broadcast only if it has at most BROADCAST_ROWS rows (counted
first); a larger one is joined by shuffle. Benchmark windows that many items share are grouped
first, so that they do not multiply matches. Hit positions are gathered per document only.

Defined results: null or empty texts have no words and no hits; null item ids and items without
words are ignored; items with the same id count once; documents with the same id and text are rows
of their own with the same result; either table may be empty; extra columns are ignored, and kept
with their names by keep_clean; texts have no length limit (a text's words and grams are arrays in
one row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPAN, GRAM = 13, 5
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text, in the case that they have there."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def _indexes(last: Column) -> Column:
    """0..last, or nothing if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def steps(size: int) -> list[int]:
    """Shifts whose doubling reaches over exactly `size` elements."""
    out, reach = [], 1
    while reach < size:
        out.append(min(reach, size - reach))
        reach += out[-1]
    return out


def _beside(values: str, shift: int, other: str | None = None) -> tuple[Column, Column]:
    """The array, and the other (or the same) one from `shift` on."""
    return F.col(values), F.slice(other or values, shift + 1, F.size(other or values) + 1)


def with_fingerprints(df: DataFrame, span: int, name: str = "prints") -> DataFrame:
    """df (words) with the distinct fingerprints that stand for all runs of `span` words.

    Arrays are paired with their own tails; near its end a text gets a few more fingerprints, of
    shorter runs, which only add candidates.
    """
    gram = min(GRAM, span)
    # Words that are equal but for A-Z are equal in full lower case too, which has a fast path; it is taken word by word,
    # since the lower case of some letters depends on what stands beside them.
    df = df.withColumn("gram1", F.transform("words", lambda w: F.xxhash64(F.lower(w))))
    for k in range(2, gram + 1):
        df = df.withColumn(f"gram{k}", F.zip_with(*_beside(f"gram{k - 1}", k - 1, "gram1"), lambda x, y: F.xxhash64(x, y)))
    least = f"gram{gram}"
    for k, shift in enumerate(steps(span - gram + 1)):
        df = df.withColumn(f"least{k}", F.zip_with(*_beside(least, shift), lambda x, y: F.least(x, y)))
        least = f"least{k}"
    return df.withColumn(name, F.array_distinct(least)).drop(*(c for c in df.columns if c.startswith(("gram", "least"))))


def windows(n: Column, span: int) -> Column:
    """Start positions and texts of all runs of `span` words."""
    return F.transform(_indexes(n - span), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("words", i + 1, span), " ").alias("run")))


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, words and span (the window length) of the items that have words."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words(lower_ascii(F.col("text"))).alias("words")).where(F.size("words") > 0)
    return written(items.withColumn("span", F.least(F.size("words"), F.lit(SPAN))), "items")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row_key, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs."""
    items = items_of(benchmark)
    spans = sorted(r[0] for r in items.select("span").distinct().collect())  # 13 values at most
    src = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("row_id"), F.xxhash64("doc_id", "text").alias("row_hash"), "doc_id", "text")
    loose = src.select("row_id", "row_hash", words(F.col("text")).alias("words"))
    found = None
    for span in spans:  # explode_outer: the filter that is inferred from explode would compute the arrays twice
        own = items.where(F.col("span") == span)
        prints = written(with_fingerprints(own.select("words"), span).select(F.explode_outer("prints").alias("print")).distinct(), "prints")
        hits = with_fingerprints(loose, span).select("row_id", "row_hash", F.explode_outer("prints").alias("print")).join(_side(prints), "print", "left_semi").select("row_id", "row_hash").distinct()
        found = hits if found is None else found.union(hits)
    plain = src.select("doc_id", "row_id", "row_hash", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    if found is None:
        return plain.select("doc_id", "row_id", "row_hash", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    candidates = written(found.distinct(), "candidates")
    texts = src.join(_side(candidates), ["row_id", "row_hash"], "left_semi").dropDuplicates(["row_id", "row_hash"]).select("row_id", "row_hash", words(lower_ascii(F.col("text"))).alias("words"))
    texts = written(texts, "texts")
    runs = met = None
    for span in spans:
        of = items.where(F.col("span") == span).select("item_id", F.explode(windows(F.size("words"), span)).alias("w")).groupBy(F.col("w.run").alias("run")).agg(F.collect_set("item_id").alias("items"))
        of = _side(written(of, "windows"))
        hit = texts.select("row_id", "row_hash", F.explode(windows(F.size("words"), span)).alias("w")).select("row_id", "row_hash", "w.at", "w.run").join(of, "run").select("row_id", "row_hash", "at", F.lit(span).alias("span"), "items")
        met = hit if met is None else met.union(hit)
    met = written(met, "met")
    place = met.groupBy("row_id", "row_hash").agg(F.array_sort(F.collect_set(F.struct("at", "span"))).alias("runs"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, r: F.struct(F.greatest(acc["end"], r["at"] + r["span"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), r["at"] + r["span"] - F.greatest(acc["end"], r["at"]))).cast("long").alias("n"))
    place = place.select("row_id", "row_hash", F.aggregate("runs", zero, step)["n"].alias("n_hit"))
    which = met.select("row_id", "row_hash", F.explode("items").alias("item_id")).distinct().groupBy("row_id", "row_hash").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    which = which.select("row_id", "row_hash", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"))
    hits = _side(written(place.join(which, ["row_id", "row_hash"]), "hits"))
    out = plain.join(hits, ["row_id", "row_hash"], "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(
        "doc_id", "row_id", "row_hash", "n_words", n_hit.alias("n_hit"), F.coalesce(F.col("n_items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.col("items_sha256"), none).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return report(docs, benchmark).drop("row_id", "row_hash")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with their own columns, whatever their names."""
    bad = written(report(docs, benchmark).where("contaminated").select("row_id", "row_hash").distinct(), "contaminated")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("row_id"), F.xxhash64("doc_id", "text").alias("row_hash"))
    return whole.join(_side(bad), ["row_id", "row_hash"], "left_anti").select("own.*")


#: The same result by brute force over every window, for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 13) AS m FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT m, item_id, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bs)),
ms AS (SELECT DISTINCT m FROM bs),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT doc_id, dw.m, i, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
