"""Near-duplicates by an LSH forest over MinHash signatures.

A text's set is its distinct word shingles; texts with equal sets are one node from the start. Each
node has a signature of SIGNATURE minima. A tree of the forest is a sorted order of all nodes by a
sequence of DEPTH of these minima, taken in the tree's own order; TREES such orders are made by one
range sort. Nodes that agree in the first BASE minima of a tree form a region. In a small region all
nodes are candidates of each other; in a larger one, where many nodes agree, the sort goes deeper:
a node's candidates are its neighbours in the order, which are those with the longest common prefix,
and the region's first node. So the number of candidates stays in proportion to the nodes.

Candidate links are confirmed on the full sets in three rounds. First every node is compared with the
least node that its candidates lead to and with its most frequent candidate; then all candidates
that are not yet in one component are compared. What large regions still hold apart is settled
without candidates: their outsiders, the nodes that are not in the region's main component, are
compared with all nodes of the region, blocks of the one against blocks of the other, however large
the region is. Components are found by
distributed stars. Hot groups are never gathered: regions are split by the range sort, equal texts
are combined on the map side, and blocks of a region are dealt to different tasks.

A pair at similarity 0.8 agrees in a tree's first BASE minima with chance 0.51, so that it is in no
common region of any tree with chance 4e-8. (Range boundaries part a few neighbours in one tree.)

Defined results: texts without words are linked with nothing; so are rows without an id, whose
component is null and which are kept; texts of fewer words than a shingle are one shingle; rows that
repeat an id and text are in one component; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow, n_partitions, written
from .components import BROADCAST_ROWS, components, side

SIGNATURE, TREES, BASE, DEPTH = 128, 24, 3, 7
#: Regions up to this size have all pairs as candidates; in larger ones the neighbours up to REACH.
SMALL_REGION, REACH = 12, 3
#: Nodes in a block of the third round; a pair of blocks is unpacked at a time.
BLOCK = 128

_rng = np.random.default_rng(20240607)
FACTORS = _rng.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _rng.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)
PLACES = _rng.integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The minima that each tree sorts by: disjoint ones as far as they go, then a new deal.
ORDERS = np.concatenate([np.random.default_rng(k).permutation(SIGNATURE)[: SIGNATURE // DEPTH * DEPTH].reshape(-1, DEPTH) for k in range(1 + TREES // (SIGNATURE // DEPTH))])[:TREES]


def finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases A-Z and cuts at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    n = len(h) - k + 1
    total = np.full(n, k if k < size else 0, np.uint64)
    for i in range(k):
        total += h[i : i + n] * PLACES[i]
    return np.unique(finish(total))


def signature(found: np.ndarray) -> np.ndarray:
    """16 bits of each minimum."""
    low = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        part = (found[at : at + 512, None] ^ MASKS) * FACTORS
        np.minimum(low, part.min(0), out=low)
    return (finish(low) & np.uint64(0xFFFF)).astype("<u2")


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [shingles(t or "", size) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "n_shingles", "digest", "sig"],
                )

    return run


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per tree: key (tree and the first BASE minima), rest (the further ones), nid."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(-1, SIGNATURE).astype(np.int64)
            nid = part.column("nid").to_numpy()
            keys, rests = [], []
            for t, order in enumerate(ORDERS):
                m = sig[:, order]
                key, rest = np.full(len(nid), t, np.int64), np.zeros(len(nid), np.int64)
                for k in range(BASE):
                    key = key << 16 | m[:, k]
                for k in range(BASE, DEPTH):
                    rest = rest << 16 | m[:, k]
                keys.append(key)
                rests.append(rest)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(rests)), pa.array(np.tile(nid, TREES))], ["key", "rest", "nid"])


def neighbours(key: np.ndarray, nid: np.ndarray) -> np.ndarray:
    """Candidate pairs (smaller, larger) of a sorted piece that holds whole regions."""
    n = len(key)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, n))
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    pairs = []
    for o in range(1, SMALL_REGION):
        same = first[:-o] == first[o:] if o < n else np.zeros(0, bool)
        if o > REACH:
            same = same & (size[:-o] <= SMALL_REGION) if o < n else same
        i = np.flatnonzero(same)
        pairs.append(np.stack([nid[i], nid[i + o]], 1))
    i = np.flatnonzero((size > SMALL_REGION) & (first != np.arange(n)))
    pairs.append(np.stack([nid[i], nid[first[i]]], 1))
    return np.sort(np.concatenate(pairs), axis=1)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a candidate pair a, b and its votes; kind 1: a node a of the large region b (c is 0)."""
    key, nid = (np.zeros(0, np.int64) for _ in range(2))

    def table(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in (a, b, c))], ["kind", "a", "b", "c"])

    def out(key: np.ndarray, nid: np.ndarray, edge: bool) -> Iterator[pa.RecordBatch]:
        pairs, votes = np.unique(neighbours(key, nid), axis=0, return_counts=True)
        if len(pairs):
            yield table(0, pairs[:, 0], pairs[:, 1], votes.astype(np.int64))
        _, at, sizes = np.unique(key, return_inverse=True, return_counts=True)
        large = sizes > SMALL_REGION
        if edge and len(sizes):  # a region at the partition's edge may go on in the next one
            large[[0, -1]] = True
        own = np.flatnonzero(large[at])
        if len(own):
            yield table(1, nid[own], key[own], np.zeros(len(own), np.int64))

    first = True
    for batch in batches:
        key, nid = (np.concatenate([x, batch.column(n).to_numpy()]) for x, n in ((key, "key"), (nid, "nid")))
        end = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last region may go on in the next batch
        yield from out(key[:end], nid[:end], first)
        first = first and not end
        key, nid = key[end:], nid[end:]
    yield from out(key, nid, True)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingles(t or "", size) for t in batch.column("text").slice(at, 512).to_pylist()]
                raw = [s.tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())], ["digest", "set"])

    return run


def unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint64)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("set_a"), batch.column("set_b")
            last, own, keep = None, None, []
            for i in range(batch.num_rows):
                raw = left[i].as_py()
                if raw != last:
                    last, own = raw, unpacked(raw)
                if alike(own, unpacked(right[i].as_py()), percent):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _packed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])


def _across(percent: int):
    """Links between the nodes of two blocks that are in different components: one for each node and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                left, right = row["outside"], row["inside"]
                x, xi = _packed([unpacked(r["set"]) for r in left])
                y, yi = _packed([unpacked(r["set"]) for r in right])
                known, at = np.unique(x, return_inverse=True)
                where = np.searchsorted(known, y)
                where[where == len(known)] = 0
                both = known[where] == y
                # dense incidence is small: known holds the outsiders' shingles only; it is walked in pieces
                common = np.zeros((len(left), len(right)), np.float32)
                for s in range(0, len(known), 4096):
                    a = np.zeros((len(left), min(4096, len(known) - s)), np.float32)
                    b = np.zeros((len(right), a.shape[1]), np.float32)
                    own = (at >= s) & (at < s + 4096)
                    a[xi[own], at[own] - s] = 1
                    own = both & (where >= s) & (where < s + 4096)
                    b[yi[own], where[own] - s] = 1
                    common += a @ b.T
                total = np.bincount(xi, minlength=len(left))[:, None] + np.bincount(yi, minlength=len(right))
                roots = [np.array([r["root"] for r in side_], np.int64) for side_ in (left, right)]
                hit = (100 * common >= percent * (total - common)) & (roots[0][:, None] != roots[1])
                i, j = np.nonzero(hit)
                if len(i):
                    _, first = np.unique(np.stack([i, roots[1][j]]), axis=1, return_index=True)
                    found += [(left[i[k]]["nid"], right[j[k]]["nid"]) for k in first]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

    return run


def outsiders(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b of the nodes that are not in their large region's main component, of comparisons with all of the region. members: nid, key."""
    own = written(members.select("nid", F.col("key").alias("region")).join(side(roots.withColumnRenamed("node", "nid")), "nid", "left").withColumn("root", F.coalesce("root", "nid")), "members")
    per = own.groupBy("region", "root").count().groupBy("region").agg(F.sum("count").alias("size"), F.max(F.struct("count", "root")).alias("main"))
    main = per.select("region", "size", F.col("main.root").alias("main"), (F.col("size") - F.col("main.count")).alias("outside")).where("outside > 0")
    here = own.join(side(written(main, "mains")), "region").select("region", "nid", "root", (F.col("root") != F.col("main")).alias("out"), "size", "outside")
    node = F.struct("nid", "root", "set")
    deal = lambda n: F.pmod(F.xxhash64("nid"), F.ceil(F.col(n) / BLOCK))
    full = here.join(sets, "nid")
    inside = full.withColumn("block", deal("size")).groupBy("region", "block").agg(F.collect_list(node).alias("inside"))
    outside = full.where("out").withColumn("o", deal("outside")).groupBy("region", "o").agg(F.collect_list(node).alias("outside"), F.first("size").alias("size"))
    outside = outside.select("region", "outside", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("size") / BLOCK) - 1)).alias("block"))
    met = outside.join(inside, ["region", "block"]).select("outside", "inside")
    return written(map_arrow(met, _across(percent), "a bigint, b bigint"), "outsiders")  # Arrow batches are bounded by bytes as well as by rows


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Those pairs (a, b) whose full sets are alike."""
    with_b = pairs.select("a", "b").join(sets.select(F.col("nid").alias("b"), F.col("set").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("nid").alias("a"), F.col("set").alias("set_a")), "a")
    return written(map_arrow(both.select("a", "b", "set_a", "set_b"), _confirmed(percent), "a bigint, b bigint"), name)


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def links(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links a, b between nodes (nid, digest, rep, sig), enough of them to connect what is alike."""
    spark = docs.sparkSession
    forest = map_arrow(nodes.select("nid", "sig"), _trees, "key bigint, rest bigint, nid bigint")
    ranged = forest.repartitionByRange(2 * n_partitions(spark), "key", "rest", "nid").sortWithinPartitions("key", "rest", "nid")
    sorted_ = written(map_arrow(ranged, _candidates, "kind int, a bigint, b bigint, c bigint"), "forest")
    found = written(sorted_.where("kind = 0").groupBy("a", "b").agg(F.sum("c").alias("votes")), "candidates")
    both = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "votes"))
    best = written(both.groupBy("a").agg(F.min("b").alias("least"), F.max_by("b", F.struct("votes", -F.col("b"))).alias("likely")).withColumn("least", F.least("a", "least")), "best")
    hop = best.select(F.col("a").alias("likely_of"), F.col("least").alias("further"))
    tried = best.join(side(hop), F.col("least") == F.col("likely_of")).select("a", "likely", "further")
    first = tried.select(*_ordered("a", "likely")).union(tried.select(*_ordered("a", "further"))).where("a <> b").distinct()
    # The sets of candidate nodes only: their representatives' texts are read again.
    wanted = written(nodes.join(side(best.select(F.col("a").alias("nid"))), "nid", "left_semi").select("nid", "digest", "rep"), "wanted")
    again = id_text(docs).join(side(wanted.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = map_arrow(again, _sets(size), "digest binary, set binary").join(side(wanted.select("digest", "nid")), "digest").select("nid", "set")
    sets = written(sets.dropDuplicates(["nid"]), "sets")
    sure = confirmed(written(first, "first"), sets, percent, "links")
    root = written(components(sure), "roots")
    by = lambda c: side(root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")))
    open_ = found.join(by("a"), "a", "left").join(by("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    tested = first.select("a", "b")
    sure = sure.union(confirmed(written(open_.join(tested, ["a", "b"], "left_anti"), "open"), sets, percent, "links"))
    members = sorted_.where("kind = 1").select(F.col("a").alias("nid"), F.col("b").alias("key"))
    return sure.union(outsiders(members, written(components(sure), "roots"), sets, percent))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text)."""
    src = id_text(docs)
    id_type = src.schema["doc_id"].dataType.simpleString()
    signed = written(map_arrow(src, _signed(size), f"doc_id {id_type}, n_shingles bigint, digest binary, sig binary"), "signed")
    real = signed.where("doc_id is not null and n_shingles > 0")
    groups = real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("sig").alias("sig"))
    nodes = written(groups.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    root = components(links(docs, nodes, size, percent))
    joined = nodes.select("nid", "digest", "rep", "copies").join(side(written(root, "roots")).withColumnRenamed("node", "nid"), "nid", "left").where("copies > 1 or root is not null")
    joined = written(joined.withColumn("root", F.coalesce("root", "nid")), "joined")
    least = side(written(joined.groupBy("root").agg(F.min("rep").alias("component_id")), "least"))
    known = side(written(joined.join(least, "root").select("digest", "component_id"), "known"))
    out = signed.join(known, "digest", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == own)).alias("kept"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, with its own columns. Of rows that repeat an id and text one stays."""
    found = written(near_duplicates(docs, size, percent), "found")
    drop = side(written(found.where("not kept").select("doc_id").distinct(), "drop"))
    kept = docs.join(drop, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    again = written(found.where("kept").groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "again")
    if again.limit(1).count():
        again = side(again)
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*(F.col(f"`{c}`") for c in docs.columns))
    return kept


#: The same result by counting common shingles of all pairs, for DuckDB.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN c ca ON a = ca.doc_id JOIN c cb ON b = cb.doc_id WHERE 100 * k >= 80 * (ca.n + cb.n - k)),
r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT l.b, r.m FROM r JOIN l ON r.doc_id = l.a)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, min(m) AS component_id, min(m) = d.doc_id AS kept
FROM d LEFT JOIN c USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, c.n
"""
