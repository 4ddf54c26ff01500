"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every byte that lies in a WIDTH-byte string which also starts in a text with a smaller id is removed.
Two suffixes that share a string tie over WIDTH bytes, so it is enough to sort those suffixes that may
have such ties, and to take the least id of each run of ties.

1. Whole blocks first: each text's suffixes are cut into blocks at content-defined places. A block
   whose bytes (with those that its last suffix reaches) are also a block of an earlier text (by a
   128-bit digest) ties as a whole; its suffixes are settled and are sorted no further.
2. Anchors: the anchor of another suffix is the GRAM-byte string with the least fingerprint of those
   that begin in its first WIDTH - GRAM + 1 places. Suffixes that tie have the same anchor at the same
   distance, so a suffix whose anchor is in no other text cannot tie and is dropped.
3. The rest are sorted one suffix bucket at a time. A bucket holds the suffixes of a range of anchor
   fingerprints, whose bytes travel as stretches of successive suffixes with a common anchor. Within a
   bucket, the places of a difference cover modulo PERIOD are ranked by their first
   WIDTH - PERIOD + 1 bytes. Suffixes are then sorted block by block (ranges between sampled first
   words) by their first PERIOD bytes; longer ties are resolved by cover ranks: for any two suffixes
   i and j there is an offset d below PERIOD with i + d and j + d both in the cover. Ties are thus
   exact over all WIDTH bytes, and memory is bounded by a bucket's stretches and one block's keys.

Texts are dealt into groups by a hash; within a group equal strings are settled without a shuffle
(found by fingerprints, compared byte by byte), and only the least text of each goes on, so a string
that is in a third of all texts sends one record per group at most (and one per repeat in that text).
Stretches of anchors that occur more than HOT times go suffix by suffix to the bucket of their own
fingerprint, so that what merely surrounds a frequent passage does not gather in one bucket.
Records travel packed and compressed, a row per group and bucket, and texts compressed as well.

Defined results: null and short texts keep all their bytes; rows with the same id do not remove each
other's strings; a null id counts as larger than any; repeated rows give repeated results; bytes are
UTF-8, and strings may begin inside a character; an empty table gives an empty result; a text is held
whole by one task, with its group; extra columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions

WIDTH, GRAM = 50, 34
REACH = WIDTH - GRAM + 1
#: Period and size of the cover: with k residues a perfect cover has period k (k - 1) + 1.
PERIOD, COVER = 13, 4
#: One suffix in so many, on average, begins a block of whole ties.
BLOCK = 128
#: Groups per partition; there is one bucket per partition.
GROUPS = 2
#: Bytes of text in a partition, about: a task holds a group of half as many with some dozens of bytes for each.
TASK_BYTES = 1 << 24
#: Occurrences from which an anchor's suffixes are dealt one by one.
HOT = 4096
#: Suffixes of a bucket that are sorted at a time, about; places that are fingerprinted at a time.
SORT_BLOCK, CHUNK = 1 << 18, 1 << 16
LAST = (1 << 63) - 1
U = np.uint64


def difference_cover(period: int) -> list[int]:
    """A small set of residues whose differences are all residues: greedily, then without what is not needed."""
    chosen, missing = [0], set(range(1, period))
    while missing:
        best = max(range(period), key=lambda x: (len({(x - c) % period for c in chosen} & missing) + len({(c - x) % period for c in chosen} & missing), -x))
        chosen.append(best)
        missing -= {(a - b) % period for a in chosen for b in chosen}
    return sorted(chosen)


def perfect_cover(period: int, size: int) -> list[int] | None:
    """A set of `size` residues with every difference exactly once, by backtracking."""

    def grow(chosen: list[int], seen: set[int]) -> list[int] | None:
        if len(chosen) == size:
            return chosen
        for x in range(chosen[-1] + 1, period):
            new = [d for c in chosen for d in ((x - c) % period, (c - x) % period)]
            if len(set(new)) == len(new) and seen.isdisjoint(new) and (found := grow([*chosen, x], seen | set(new))):
                return found
        return None

    return grow([0], set())


CHOSEN = np.zeros(PERIOD, bool)
CHOSEN[perfect_cover(PERIOD, COVER) or difference_cover(PERIOD)] = True
#: For two residues, the least offset that takes both into the cover.
OFFSET = np.array([[next(d for d in range(PERIOD) if CHOSEN[(a + d) % PERIOD] and CHOSEN[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])

_rng = np.random.default_rng(5)
ODD = _rng.integers(0, 1 << 63, 32, dtype=np.uint64) * U(2) + U(1)


def _join(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    out = a * ODD[2 * k]
    out += b * ODD[2 * k + 1]
    out ^= out >> U(29)
    return out


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * ODD[30]
    return x ^ (x >> U(31))


# -- suffix order ------------------------------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as whole numbers in the order of the bytes."""
    rows = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    return np.ascontiguousarray(rows).view(">u8").ravel().astype(np.uint64)


def _keys(words: np.ndarray, places: np.ndarray, width: int) -> list[np.ndarray]:
    """The first `width` bytes (8 or more) of each place as words; the last may overlap the one before."""
    return [words[places + at] for at in [*range(0, width - 8, 8), width - 8]]


def _runs(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the keys (the first counts most), and whether a run of equal keys begins at each place of it."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def cover_ranks(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """By place, the rank of the cover samples that the suffixes reach, by their first WIDTH - PERIOD + 1 bytes."""
    reached = _spread(places, places + PERIOD, len(words))
    sample = np.flatnonzero(reached & np.resize(CHOSEN, len(words)))
    order, new = _runs(_keys(words, sample, WIDTH - PERIOD + 1))
    ranks = np.full(len(words), -1, np.int32)
    ranks[sample[order]] = np.cumsum(new)
    return ranks


def _resolved(words: np.ndarray, places: np.ndarray, new: np.ndarray, ranks: np.ndarray) -> None:
    """Sorts, in place, runs that tie over PERIOD bytes: three-way partitions of all open runs at once.

    Two suffixes are compared by their cover ranks at a common offset d, which tell bytes d to
    d + WIDTH - PERIOD + 1, and where these tie by the last PERIOD - 1 bytes.
    """
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    at = np.flatnonzero(size[run] > 1)
    while len(at):
        own = places[at]
        first = np.flatnonzero(new[at])
        sizes = np.diff(np.append(first, len(at)))
        pivot = np.repeat(own[first + sizes // 2], sizes)
        d = OFFSET[own % PERIOD, pivot % PERIOD]
        side = np.sign(ranks[own + d] - ranks[pivot + d]).astype(np.int64)
        for at_end in (WIDTH - PERIOD + 1, WIDTH - 8):
            tie = np.flatnonzero(side == 0)
            x, y = words[own[tie] + at_end], words[pivot[tie] + at_end]
            side[tie] = (x > y).astype(np.int64) - (x < y)
        key = np.repeat(np.arange(len(first)) * 3, sizes) + side + 1
        order = np.argsort(key, kind="stable")
        places[at], key = own[order], key[order]
        begins = np.ones(len(at), bool)
        begins[1:] = key[1:] != key[:-1]
        new[at] = begins
        size = np.bincount(np.cumsum(begins) - 1)
        at = at[(key % 3 != 1) & (np.repeat(size, size) > 1)]


def sorted_blocks(data: np.ndarray, places: np.ndarray, block: int = SORT_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes at the places (WIDTH bytes each, and 8 more in data) in order, block by block: places, and whether a run of ties begins."""
    if not len(places):
        return
    words = _words(data)
    ranks = cover_ranks(words, places)
    head = words[places]
    picked = np.sort(head[:: max(1, len(head) // 4096)])
    splitters = np.unique(picked[:: max(1, len(picked) * block // len(head))])[1:]
    deal = np.searchsorted(splitters, head, "right")
    order = np.argsort(deal, kind="stable")
    for part in np.split(order, np.cumsum(np.bincount(deal, minlength=len(splitters) + 1))[:-1]):
        own = places[part]
        by, new = _runs([head[part], *_keys(words, own, PERIOD)[1:]])
        own = own[by]
        _resolved(words, own, new, ranks)
        yield own, new


# -- groups of texts ---------------------------------------------------------------------------------


class Group:
    """The texts of one group in a fixed order, as one array of bytes."""

    def __init__(self, table: pa.Table):
        ids = table.column("id").to_pylist()
        marks = table.column("mark").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], marks[i]))
        unpack = zstandard.ZstdDecompressor().decompress
        raw = table.column("raw").to_pylist()
        self.doc_ids = [table.column("doc_id")[i].as_py() for i in order]
        self.raw = [unpack(raw[i]) if raw[i] else b"" for i in order]
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.lengths = np.array([len(r) for r in self.raw], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.data = np.frombuffer(b"".join(self.raw) + bytes(128), np.uint8)
        self.n = int(self.starts[-1])

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def open(self, back: pa.Table) -> np.ndarray:
        """Where a suffix of WIDTH bytes or more begins that its block did not settle."""
        long = self.lengths >= WIDTH
        here = _spread(self.starts[:-1][long], self.starts[1:][long] - WIDTH + 1, self.n)
        begin, size = _settled(back, TIED_BLOCKS)
        return here & ~_spread(begin, begin + size, self.n) if len(begin) else here

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end places of the blocks of suffixes, and their texts."""
        long = self.lengths >= WIDTH
        first, end = self.starts[:-1][long], self.starts[1:][long] - WIDTH + 1
        if not len(first):
            return first, end, first
        cut = [lo + np.flatnonzero((h >> U(40)) % U(BLOCK) == 0) for lo in range(0, self.n, CHUNK) for h in [self._fingerprints(lo, min(lo + CHUNK, self.n), 16)[16]]]
        places = np.concatenate(cut)
        t = np.searchsorted(first, places, "right") - 1
        begin = np.union1d(first, places[(t >= 0) & (places < end[np.maximum(t, 0)])])
        t = np.searchsorted(first, begin, "right") - 1
        stop = np.append(begin[1:], 0)
        last = np.append(t[1:] != t[:-1], True)
        return begin, np.where(last, end[t], stop), np.flatnonzero(long)[t]

    def _fingerprints(self, lo: int, hi: int, upto: int) -> dict[int, np.ndarray]:
        """Fingerprints of the 16 (and 32) bytes from each place of lo to hi on."""
        n = hi - lo
        rows = np.lib.stride_tricks.as_strided(self.data[lo:], (n + upto - 8, 8), (1, 1))
        words = np.ascontiguousarray(rows).view(np.uint64).ravel()
        h = {16: _join(words[:-8], words[8:], 0)}
        if upto > 16:
            h[32] = _join(h[16][:-16], h[16][16:], 1)
        return {k: v[: n + (upto - k)] for k, v in h.items()}

    def anchored(self, here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The open suffixes, the distinct places of their anchors, and each suffix's anchor among those."""
        suffixes, anchors = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, self.n, CHUNK):
            hi = min(lo + CHUNK, self.n)
            own = np.flatnonzero(here[lo:hi])
            if not len(own):
                continue
            h = self._fingerprints(lo, hi + WIDTH - 32, 32)[32]
            least = _join(h[: hi - lo + REACH - 1], h[2 : hi - lo + REACH + 1], 2)
            least >>= U(20)
            least <<= U(20)
            least |= np.arange(len(least), dtype=np.uint64)  # of equal fingerprints the leftmost
            size = 1
            while size < REACH:
                step = min(size, REACH - size)
                least = np.minimum(least[:-step], least[step:])
                size += step
            suffixes.append(own + lo)
            anchors.append((least[own] & U((1 << 20) - 1)).astype(np.int64) + lo)
        at = np.concatenate(anchors)
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]  # anchors never go back from one suffix to the next
        return np.concatenate(suffixes), at[new], np.cumsum(new) - 1

    def prints(self, places: np.ndarray, width: int) -> np.ndarray:
        """Fingerprints of that many bytes at the places."""
        rows = np.lib.stride_tricks.as_strided(self.data, (len(self.data) - 7, 8), (1, 1))
        out = np.zeros(len(places), np.uint64)
        for k, at in enumerate([*range(0, width - 8, 8), width - 8]):
            out = _join(out, np.ascontiguousarray(rows[places + at]).view(np.uint64).ravel(), 4 + k)
        return _finish(out)

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the WIDTH bytes at two lists of places are equal."""
        rows = np.lib.stride_tricks.as_strided(self.data, (len(self.data) - 7, 8), (1, 1))
        out = np.ones(len(a), bool)
        for at in [*range(0, WIDTH - 8, 8), WIDTH - 8]:
            out &= np.ascontiguousarray(rows[a + at]).view(np.uint64).ravel() == np.ascontiguousarray(rows[b + at]).view(np.uint64).ravel()
        return out


# -- packed rows -------------------------------------------------------------------------------------


def _planes(values: np.ndarray, width: int) -> bytes:
    """Whole numbers byte plane by byte plane: high planes of small numbers are zeros and compress away."""
    wide = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(wide[:, :width].T).tobytes()


def _packed(*columns: tuple[np.ndarray, int, bool]) -> bytes:
    """Columns of equal length: values, bytes of each, and whether as steps from one to the next."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(_planes(np.diff(c, prepend=c[:0].dtype.type(0)) if steps else c, width) for c, width, steps in columns))


def _unpacked(raw: bytes, *columns: tuple[int, bool]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n, at, out = len(raw) // sum(width for width, _ in columns), 0, []
    for width, steps in columns:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        values = wide.view("<u8").ravel()
        if steps:
            values = np.cumsum(values, dtype=np.uint64) & U((1 << 8 * width) - 1)
        out.append(values)
    return out


def _spread(begin: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """True from each begin to its stop."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, begin, 1)
    np.add.at(steps, stop, -1)
    return np.cumsum(steps, dtype=np.int32)[:n] > 0


def _stretches(places: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of successive places (that agree in the other columns) begin, and their sizes."""
    new = np.ones(len(places), bool)
    new[1:] = places[1:] != places[:-1] + 1
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(places)))


def _bucket(prints: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of a fingerprint by its highest 24 bits."""
    return ((prints >> U(40)) * U(n_buckets) >> U(24)).astype(np.int64)


DEALT = pa.schema([("bucket", pa.int32()), ("pk", pa.int64()), ("data", pa.binary()), ("bytes", pa.binary()), ("done", pa.binary())])
DEALT_SQL = "bucket int, pk bigint, data binary, bytes binary, done binary"
#: What a bucket returns to a group. kind: suffixes that are settled by blocks or by sorting, or the standing of anchors.
BACK = pa.schema([("pk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
BACK_SQL = "pk bigint, kind int, bucket int, data binary"
TIED_BLOCKS, TIED, ANCHORS = 0, 1, 2
ALONE, SHARED, FREQUENT = 0, 1, 2
#: Columns of packed rows: (bytes, as steps).
BLOCK_ROW = ((8, False), (8, False), (8, True), (8, True), (8, False))
ANCHOR_ROW = ((5, True), (4, False), (1, False))
STRETCH_ROW = ((8, True), (8, True), (4, False))
PLACES = ((8, True), (8, False))
LOW = U((1 << 40) - 1)


def _settled(back: pa.Table, *kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and sizes of the stretches that rows of these kinds settle."""
    found = [_unpacked(raw, *PLACES) for k, raw in zip(back.column("kind").to_pylist(), back.column("data").to_pylist(), strict=True) if k in kinds]
    begin, size = (np.concatenate([x[c] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64) for c in (0, 1))
    return begin, size


def _dealt(pk: int, n_buckets: int, buckets: np.ndarray, row: Callable[[np.ndarray], tuple[bytes, bytes]], done: bytes = b"") -> pa.Table:
    """A row per bucket of the records in it; `done`, what the group settled by itself, goes with bucket pk mod n_buckets."""
    order = np.argsort(buckets, kind="stable")
    bounds = np.searchsorted(buckets[order], np.arange(n_buckets + 1))
    rows: dict[str, list] = {k: [] for k in DEALT.names}
    for b in range(n_buckets):
        s, e = bounds[b], bounds[b + 1]
        here = done if b == pk % n_buckets else b""
        if e > s or here:
            data, raw = row(order[s:e])
            for name, value in zip(DEALT.names, (b, pk, data, raw, here), strict=True):
                rows[name].append(value)
    return pa.Table.from_pydict(rows, DEALT)


def _block_ties(n_buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        g = Group(table)
        begin, stop, text = g.blocks()
        data = memoryview(g.data)
        digests = np.frombuffer(b"".join([blake2b(data[s : e + WIDTH - 1], digest_size=16).digest() for s, e in zip(begin.tolist(), stop.tolist(), strict=True)]), "<u8").reshape(-1, 2)
        a, b, ids, size = digests[:, 0], digests[:, 1], g.ids[text], stop - begin
        done = ids > _least(ids, *_runs([a, b]))
        go = np.flatnonzero(~done)

        def row(own: np.ndarray) -> tuple[bytes, bytes]:
            k = go[own]
            return _packed(*((c[k], *how) for c, how in zip((a, b, ids, begin, size), BLOCK_ROW, strict=True))), b""

        return _dealt(key[0].as_py(), n_buckets, _bucket(a[go], n_buckets), row, _packed((begin[done], 8, True), (size[done], 8, False)) if done.any() else b"")

    return run


def _least(ids: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each record the least id of its run, in the records' own order."""
    out = np.empty(len(ids), np.int64)
    if len(ids):
        begin = np.flatnonzero(new)
        out[order] = np.repeat(np.minimum.reduceat(ids[order], begin), np.diff(np.append(begin, len(order))))
    return out


def _per_bucket(fn: Callable[[int, list[dict]], Iterator[tuple]]):
    """A partition's rows, bucket after bucket (a bucket is in one partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = defaultdict(list)
        for batch in batches:
            for r in batch.to_pylist():
                rows[r["bucket"]].append(r)
        for bucket in sorted(rows):
            own = sorted(rows.pop(bucket), key=lambda r: r["pk"])
            found = [*fn(bucket, own)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], f.type) for k, f in enumerate(BACK)], schema=BACK)

    return run


def _answers(rows: list[dict], kind: int, begins: list[np.ndarray], sizes: list[np.ndarray]) -> Iterator[tuple]:
    """Each row's settled stretches, with those that its group settled by itself."""
    for r, begin, size in zip(rows, begins, sizes, strict=True):
        if r["done"]:
            mine = _unpacked(r["done"], *PLACES)
            begin, size = (np.concatenate([x.astype(np.int64), y.astype(np.int64)]) for x, y in zip((begin, size), mine, strict=True))
            order = np.argsort(begin, kind="stable")
            begin, size = begin[order], size[order]
        if len(begin):
            yield r["pk"], kind, 0, _packed((begin, *PLACES[0]), (size, *PLACES[1]))


def _block_bucket(bucket: int, rows: list[dict]) -> Iterator[tuple]:
    parts = [_unpacked(r["data"], *BLOCK_ROW) for r in rows]
    a, b, ids = (np.concatenate([p[c] for p in parts]) for c in range(3))
    ids = ids.astype(np.int64)
    tied = ids > _least(ids, *_runs([a, b]))
    cuts = np.split(tied, np.cumsum([len(p[0]) for p in parts])[:-1])
    yield from _answers(rows, TIED_BLOCKS, [p[3][t].astype(np.int64) for p, t in zip(parts, cuts, strict=True)], [p[4][t].astype(np.int64) for p, t in zip(parts, cuts, strict=True)])


def _anchors(n_buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, back: pa.Table) -> pa.Table:
        g = Group(table)
        _, places, _ = g.anchored(g.open(back))
        prints, index = np.unique(g.prints(places, GRAM), return_inverse=True)
        text = g.text_of(places)
        low, high = np.full(len(prints), len(g.ids)), np.full(len(prints), -1)
        np.minimum.at(low, index, text)
        np.maximum.at(high, index, text)
        shared, times = (low < high).astype(np.int64), np.bincount(index, minlength=len(prints))

        def row(own: np.ndarray) -> tuple[bytes, bytes]:
            return _packed(*((c[own], *how) for c, how in zip((prints & LOW, times, shared), ANCHOR_ROW, strict=True))), b""

        return _dealt(key[0].as_py(), n_buckets, _bucket(prints, n_buckets), row)

    return run


def _anchor_bucket(bucket: int, rows: list[dict]) -> Iterator[tuple]:
    """For each row, the standing of its anchors in their order."""
    parts = [_unpacked(r["data"], *ANCHOR_ROW) for r in rows]
    prints, times, shared = (np.concatenate([p[c] for p in parts]) for c in range(3))
    order, new = _runs([prints])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(order)))
    total = np.add.reduceat(times[order], begin)
    more = (size > 1) | (np.maximum.reduceat(shared[order], begin) > 0)
    standing = np.empty(len(order), np.uint8)
    standing[order] = np.repeat(np.where(more, np.where(total > HOT, FREQUENT, SHARED), ALONE).astype(np.uint8), size)
    for r, own in zip(rows, np.split(standing, np.cumsum([len(p[0]) for p in parts])[:-1]), strict=True):
        if own.any():
            yield r["pk"], ANCHORS, bucket, zstandard.ZstdCompressor(level=1).compress(own.tobytes())


def _suffix_ties(n_buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, back: pa.Table) -> pa.Table:
        g = Group(table)
        here, places, at = g.anchored(g.open(back))
        grams, index = np.unique(g.prints(places, GRAM), return_inverse=True)
        standing = np.zeros(len(grams), np.uint8)
        bounds = np.searchsorted(_bucket(grams, n_buckets), np.arange(n_buckets + 1))
        for kind, b, raw in zip(*(back.column(c).to_pylist() for c in ("kind", "bucket", "data")), strict=True):
            if kind == ANCHORS:
                standing[bounds[b] : bounds[b + 1]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
        keep = (standing[index] != ALONE)[at]
        here, at = here[keep], at[keep]
        anchor, prints, ids = index[at], g.prints(here, WIDTH), g.ids[g.text_of(here)]
        order, new = _runs([prints])
        s = here[order]
        new[1:] |= ~g.equal(s[1:], s[:-1])
        done = ids > _least(ids, order, new)
        first, size = _stretches(here[done])
        settled = _packed((here[done][first], 8, True), (size, 8, False)) if len(first) else b""
        go = np.flatnonzero(~done)
        here, prints, at, anchor, ids = here[go], prints[go], at[go], anchor[go], ids[go]
        frequent = standing[anchor] == FREQUENT
        first, size = _stretches(here, at, frequent * np.arange(len(here)))
        begin, owner = here[first], ids[first]
        bucket = _bucket(np.where(frequent[first], _finish(prints[first]), grams[anchor[first]]), n_buckets)
        data = memoryview(g.data)

        def row(own: np.ndarray) -> tuple[bytes, bytes]:
            raw = b"".join([data[b : b + n + WIDTH - 1] for b, n in zip(begin[own].tolist(), size[own].tolist(), strict=True)])
            return _packed(*((c[own], *how) for c, how in zip((begin, owner, size), STRETCH_ROW, strict=True))), zstandard.ZstdCompressor(level=1).compress(raw)

        return _dealt(key[0].as_py(), n_buckets, bucket, row, settled)

    return run


def _suffix_bucket(bucket: int, rows: list[dict]) -> Iterator[tuple]:
    parts = [_unpacked(r["data"], *STRETCH_ROW) for r in rows]
    begin, ids, size = (np.concatenate([p[c] for p in parts]).astype(np.int64) for c in range(3))
    unpack = zstandard.ZstdDecompressor().decompress
    data = np.frombuffer(b"".join([*(unpack(r["bytes"]) for r in rows if r["bytes"]), bytes(64)]), np.uint8)
    record = np.repeat(np.arange(len(size)), size)
    ahead = np.cumsum(size) - size
    within = np.arange(len(record)) - ahead[record]
    places = (np.cumsum(size + WIDTH - 1) - size - WIDTH + 1)[record] + within
    tied = np.zeros(len(data), bool)
    owner = np.zeros(len(data), np.int64)
    owner[places] = ids[record]
    for own, new in sorted_blocks(data, places):
        mine = owner[own]
        first = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(mine, first), np.diff(np.append(first, len(own))))
        tied[own] = mine > least
    hit = tied[places]
    found = begin[record] + within
    cuts = np.cumsum([int(p[2].sum()) for p in parts])[:-1]
    begins, sizes = [], []
    for here, h in zip(np.split(found, cuts), np.split(hit, cuts), strict=True):
        here = np.sort(here[h])
        first, n = _stretches(here)
        begins.append(here[first])
        sizes.append(n)
    yield from _answers(rows, TIED, begins, sizes)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
RESULT_SQL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>"


def _cut(key: tuple[pa.Scalar, ...], table: pa.Table, back: pa.Table) -> pa.Table:
    g = Group(table)
    begin, size = _settled(back, TIED_BLOCKS, TIED)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], (begin + size + WIDTH - 1)[order]
    rows: dict[str, list] = {k: [] for k in RESULT.names}
    bounds = np.searchsorted(begin, g.starts)
    for i, raw in enumerate(g.raw):
        b, e = begin[bounds[i] : bounds[i + 1]] - g.starts[i], end[bounds[i] : bounds[i + 1]] - g.starts[i]
        spans, removed = [], 0
        if len(b):
            upto = np.maximum.accumulate(e)
            new = np.append(True, b[1:] > upto[:-1])
            b, e = b[new], np.append(upto[:-1][new[1:]], upto[-1])
            removed, kept, at = int((e - b).sum()), [], 0
            for x, y in zip(b.tolist(), e.tolist(), strict=True):
                kept.append(raw[at:x])
                spans += [x, y]
                at = y
            raw = b"".join([*kept, raw[at:]])
        for name, value in (("doc_id", g.doc_ids[i]), ("n_bytes", int(g.lengths[i])), ("n_removed", removed), ("n_spans", len(spans) // 2), ("kept_sha256", hashlib.sha256(raw).hexdigest()), ("spans", spans)):
            rows[name].append(value)
    return pa.Table.from_pydict(rows, RESULT)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        raw = [pack(t.encode("utf-8", "surrogatepass")) if t else None for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "id", "mark")), pa.array(raw, pa.binary()), batch.column("pk")], ["doc_id", "id", "mark", "raw", "pk"])


def n_tasks(docs: DataFrame) -> int:
    """Partitions by the bytes of the texts, whatever number the session shuffles into: fewer would hold more than a worker's
    memory, and more would make rows that grow with their square."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(min(n_partitions(spark), spark.sparkContext.defaultParallelism), -(-n_bytes // TASK_BYTES))


def repeated_bytes(docs: DataFrame, *, keep_spans: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and spans: begin, end, begin, ... in bytes) of every row of docs."""
    n = n_tasks(docs)
    number = F.col("doc_id").cast("long")
    src = docs.select(number.alias("doc_id"), F.coalesce(number, F.lit(LAST)).alias("id"), F.xxhash64("text").alias("mark"), "text")
    # Rows without an id are told apart by their place, so that copies of one text are dealt to many groups.
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    src = src.withColumn("pk", F.pmod(F.xxhash64("id", "mark", spread), F.lit(GROUPS * n)))
    src = src.mapInArrow(_compressed, "doc_id bigint, id bigint, mark bigint, raw binary, pk bigint").repartition(n, "pk")

    def deal(fn, back: DataFrame) -> DataFrame:
        return src.groupBy("pk").cogroup(back.groupBy("pk")).applyInArrow(fn, DEALT_SQL)

    def sort(dealt: DataFrame, fn) -> DataFrame:
        return dealt.repartitionById(n, "bucket").mapInArrow(_per_bucket(fn), BACK_SQL).repartition(n, "pk")

    blocks = sort(src.groupBy("pk").applyInArrow(_block_ties(n), DEALT_SQL), _block_bucket)
    anchors = sort(deal(_anchors(n), blocks), _anchor_bucket)
    ties = sort(deal(_suffix_ties(n), blocks.union(anchors)), _suffix_bucket)
    out = src.groupBy("pk").cogroup(blocks.union(ties).groupBy("pk")).applyInArrow(_cut, RESULT_SQL)
    return out if keep_spans else out.drop("spans")


#: The same result by brute force over every window of the texts' bytes in hexadecimal, for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d WHERE length(x) >= 100)),
m AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT w.doc_id, w.i FROM w JOIN m ON w.s = m.s AND w.doc_id > m.first_id),
g AS (SELECT doc_id, i, i > coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000) + 50 AS fresh FROM h),
k AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, run, min(i) AS b, max(i) + 50 AS e FROM k GROUP BY doc_id, run),
a AS (SELECT doc_id, CAST(sum(e - b) AS BIGINT) AS n_removed, CAST(count(*) AS BIGINT) AS n_spans FROM r GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(part, '' ORDER BY b) AS x FROM (
  SELECT d.doc_id, r.b AS b, substr(d.x, 2 * coalesce(lag(r.e) OVER (PARTITION BY d.doc_id ORDER BY r.b), 0) + 1, 2 * (r.b - coalesce(lag(r.e) OVER (PARTITION BY d.doc_id ORDER BY r.b), 0))) AS part FROM r JOIN d ON r.doc_id = d.doc_id
  UNION ALL SELECT d.doc_id, 1000000000, substr(d.x, 2 * max(r.e) + 1) FROM r JOIN d ON r.doc_id = d.doc_id GROUP BY d.doc_id, d.x) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, coalesce(a.n_removed, 0) AS n_removed, coalesce(a.n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
