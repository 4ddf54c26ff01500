import random
import re

import numpy as np

from quillon.llm import components, neardup


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k=4):
    sets = [(d, shingle_set(t, k)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets}


def test_against_brute_force(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute([(r[0], r[1]) for r in rows])


def test_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(60))) for i in range(50)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    loose = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain + star + loose, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in chain + star + loose:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    lone = {a for a, b in loose if a == b}
    assert got == {x: find(x) for x in root if x in got} and set(root) - set(got) <= lone
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_regions_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_neighbours_of_long_regions():
    key, nid = np.repeat([1, 2, 3], [3, 40, 1]), np.arange(44)
    pairs = {tuple(p) for p in neardup.neighbours(key, nid)}
    assert {(0, 1), (1, 2), (0, 2), (3, 42), (10, 13)} <= pairs and (10, 20) not in pairs and not any(43 in p for p in pairs)


def test_odd_rows(odd, none, spark):
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(odd).collect())
    assert got == [(0, 0, True), (5, 5, True), (5, 5, True), (6, 6, True)]
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 5, 6]
    same = spark.createDataFrame([(i, "a b c d e f") for i in range(50)], "doc_id long, text string")
    assert [r.doc_id for r in neardup.keep_first(same).collect()] == [0]


def test_outsiders_meet_all_of_a_region_however_large(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    packed = lambda k: b"".join((k * 100 + i).to_bytes(8, "little") for i in range(20))
    rows = [(i, 1, i << 32 | i, packed(7 if i == 49 else i)) for i in range(50)]  # node 49 is as node 7; no two agree in further minima
    df = spark.createDataFrame(rows, "nid long, key long, rest long, set binary")
    roots = spark.createDataFrame([(i, 0) for i in range(49)], "node long, root long")
    got = neardup.outsiders(df.select("nid", "key", "rest"), roots, df.select("nid", "set"), 80)
    assert [tuple(r) for r in got.collect()] == [(49, 7)]
