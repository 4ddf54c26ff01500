import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import sharding


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation(n, seed):
    p = sharding.permute(np.arange(n), n, seed)
    assert sorted(p.tolist()) == list(range(n))


def test_place_is_computable():
    whole = sharding.permute(np.arange(1000), 1000, 5)
    assert sharding.permute(np.array([17, 999]), 1000, 5).tolist() == [whole[17], whole[999]]
    assert (whole != np.arange(1000)).mean() > 0.9


def test_rows(docs, rows):
    text = {r[0]: r[1] or "" for r in rows}
    got = sharding.shards(docs).collect()
    sizes = {}
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        sizes.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert len(sizes) == 16 and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert [r.row for r in sorted(got, key=lambda r: r.doc_id)] == list(range(len(rows)))
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shards(docs.repartition(5)).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}


def test_odd_rows(odd, none):
    assert sharding.shards(none).count() == 0
    assert sorted((r.doc_id or 0, r.row) for r in sharding.shards(odd).collect()) == [(0, 0), (5, 1), (5, 2), (6, 3)]


def plain_place(row, n, seed, rounds=6):
    """Feistel rounds with cycle walking on Python's own whole numbers."""
    word = 2**64
    bits = 2
    while 2**bits < n:
        bits += 2
    half = 2 ** (bits // 2)
    at = row
    while True:
        left, right = divmod(at, half)
        for k in range(rounds):
            x = (right + (seed * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03)) % word
            x = (x ^ x // 2**30) * 0xBF58476D1CE4E5B9 % word
            x = (x ^ x // 2**27) * 0x94D049BB133111EB % word
            x ^= x // 2**31
            left, right = right, left ^ x % half
        at = left * half + right
        if at < n:
            return at


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**40), st.data())
def test_permutation_against_plain_numbers(n, seed, data):
    row = data.draw(st.integers(0, n - 1))
    assert sharding.permute(np.array([row]), n, seed).tolist() == [plain_place(row, n, seed)]


def test_shards_and_slots_against_brute_force(spark, rows):
    """A text of over a megabyte, null, empty and repeated texts, and an extra column with the name of a result."""
    whole = [(r[0], r[1], "mine") for r in rows] + [(2000, "long é " * 200_000, "mine")]
    docs = spark.createDataFrame(whole, "doc_id long, text string, slot string").repartition(4)
    want = {}
    for row, (i, text, _) in enumerate(sorted(whole, key=lambda r: r[0])):
        raw = (text or "").encode()
        at = plain_place(row, len(whole), 20240229)
        want[i] = (len(raw) + 1, zlib.crc32(raw), at % 16, at // 16)
    assert {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shards(docs).collect()} == want
