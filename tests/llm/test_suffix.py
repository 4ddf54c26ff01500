import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard

from quillon.llm import suffix


def brute(rows, width=50):
    first = {}
    raw = sorted(((d, (t or "").encode()) for d, t in rows), key=lambda x: x[0])
    for d, b in raw:
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], d)
    out = {}
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_cover_has_all_differences():
    c = np.flatnonzero(suffix.CHOSEN)
    assert {(a - b) % suffix.PERIOD for a in c for b in c} == set(range(suffix.PERIOD)) and len(c) == suffix.COVER
    for period in (7, 10, 40):
        c = suffix.difference_cover(period)
        assert {(a - b) % period for a in c for b in c} == set(range(period))


def test_bucket_is_in_suffix_order():
    """Blocks of a bucket against a plain sort of the strings, with long ties and few letters."""
    rng = random.Random(1)
    units = [bytes(rng.choices(b"ab\x00\xff", k=rng.randint(5, 70))) for _ in range(30)]
    raw = b"".join(rng.choices(units, k=1500)) + bytes(64)
    places = np.array(sorted(rng.sample(range(len(raw) - 114), 6000)))
    found = [(int(p), bool(f)) for own, new in suffix.sorted_blocks(np.frombuffer(raw, np.uint8), places, 700) for p, f in zip(own, new, strict=True)]
    keys = [raw[p : p + 50] for p, _ in found]
    assert keys == sorted(keys) and sorted(p for p, _ in found) == places.tolist()
    assert [f for _, f in found] == [True] + [a != b for a, b in zip(keys, keys[1:], strict=False)]


def test_places_beyond_four_gigabytes():
    begin, size = np.array([5, 1 << 33, (1 << 40) + 7]), np.array([1, 1 << 34, 3])
    got = suffix._unpacked(suffix._packed((begin, *suffix.PLACES[0]), (size, *suffix.PLACES[1])), *suffix.PLACES)
    assert [x.tolist() for x in got] == [begin.tolist(), size.tolist()]


def test_frequent_anchors(monkeypatch):
    """Group and bucket functions by themselves, with every shared anchor dealt suffix by suffix."""
    monkeypatch.setattr(suffix, "HOT", 1)
    rng = random.Random(4)
    passage = "".join(rng.choices("abcd", k=120))
    texts = [(i, "".join(rng.choices("xyz", k=40)) + passage[: rng.randint(60, 120)] + "".join(rng.choices("uvw", k=40))) for i in range(40)]
    n, groups = 3, [[], []]
    for i, t in texts:
        groups[i % 2].append({"doc_id": i, "id": i, "mark": 0, "raw": zstandard.compress(t.encode())})
    tables = [pa.Table.from_pylist(g) for g in groups]
    key = lambda pk: (pa.scalar(pk),)

    def sort(dealt, fn):
        batches = [b for t in dealt for b in t.to_batches()]
        return pa.Table.from_batches(list(suffix._per_bucket(fn)(iter(batches))), suffix.BACK)

    own = lambda back, pk: back.filter(pa.compute.equal(back["pk"], pk))
    blocks = sort([suffix._block_ties(n)(key(k), t) for k, t in enumerate(tables)], suffix._block_bucket)
    anchors = sort([suffix._anchors(n)(key(k), t, own(blocks, k)) for k, t in enumerate(tables)], suffix._anchor_bucket)
    known = pa.concat_tables([blocks, anchors])
    ties = sort([suffix._suffix_ties(n)(key(k), t, own(known, k)) for k, t in enumerate(tables)], suffix._suffix_bucket)
    every = pa.concat_tables([blocks, ties])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, t in enumerate(tables) for r in suffix._cut(key(k), t, own(every, k)).to_pylist()}
    assert got == brute(texts)


def test_against_brute_force(docs, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated_bytes(docs).collect()}
    assert got == brute([(r[0], r[1]) for r in rows])
    assert sum(v[1] for v in got.values()) > 1000


def test_shifted_passages_and_runs(spark):
    rng = random.Random(9)
    s = "".join(rng.choices("abcdefgh é", k=400))
    rows = [(i, "".join(rng.choices("xyz", k=rng.randint(0, 80))) + s[a : a + n] + "".join(rng.choices("uvw", k=5))) for i, (a, n) in enumerate([(0, 400), (3, 49), (7, 50), (100, 51), (1, 200), (333, 60), (0, 400)] * 3)]
    rows += [(100 + i, "ab" * k) for i, k in enumerate((24, 25, 26, 200, 200))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_odd_rows(odd, none):
    assert suffix.repeated_bytes(none).count() == 0
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix.repeated_bytes(odd).collect())
    assert got == [(0, 24, 0), (5, 24, 0), (5, 24, 0), (6, 0, 0)]


def test_partitions_follow_the_bytes_of_the_texts(spark, monkeypatch):
    """They were the session's shuffle partitions, so few of those put any number of texts into one task."""
    docs = spark.createDataFrame([(i, f"{i:04d}" * 100 + "the same passage in all of the texts, of over fifty bytes" * (i % 2)) for i in range(40)], "doc_id long, text string")
    want = sorted(map(tuple, suffix.repeated_bytes(docs).collect()))
    monkeypatch.setattr(suffix, "TASK_BYTES", 1000)
    found = suffix.repeated_bytes(docs)
    assert found.rdd.getNumPartitions() == -(-(40 * 400 + 20 * 57) // 1000)
    assert sorted(map(tuple, found.collect())) == want and sum(r[2] for r in want) > 19 * 57
