import math
import random
import re
from collections import Counter, defaultdict

from quillon.llm import ranking

DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k=50):
    cut = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n_all, l_all = len(cut), sum(n for _, _, n in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    wanted, out = defaultdict(set), []
    for i, t in items:
        if i is not None:
            wanted[i] |= set(terms(t))
    for item, ts in wanted.items():
        rows = []
        for i, c, n in cut:
            m = 50 + (50 * n * n_all) // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts & c.keys())
            if s > 0:
                rows.append((-s, -1 if i is None else i))
        out += [(item, r, None if i < 0 else i, -s) for r, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, k=50):
    df = ranking.ranked(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, ITEM), k)
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def some(seed, n=150):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(60)] + ["Éa", "Σ", "the", "The", "x1"]
    text = lambda k: " ".join(rng.choices(pool, [1 / (j + 1) for j in range(len(pool))], k=k))
    docs = [(i, text(rng.randint(0, 60))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(20)]
    return docs, [(i, text(rng.randint(1, 12))) for i in range(9)]


def test_against_brute_force(spark, rows):
    docs, items = some(1)
    assert run(spark, docs, items, 7) == brute(docs, items, 7)
    docs = [(r[0], r[1]) for r in rows]
    items = [(1, docs[3][1]), (2, "one"), (3, "nowhere at all"), (4, None), (5, ""), (None, "one"), (6, docs[5][1][:40]), (6, "one"), (7, "ONE?")]
    assert run(spark, docs, items) == brute(docs, items)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b"), (4, "b c " * 200_000), (5, "... !!")]
    items = [(1, "a"), (2, "b c d")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, "a")], [(1, "z")]) == []
    odd = spark.createDataFrame([(1, "a a", 5, "x", 2), (2, "b", 5, "x", 2)], "doc_id long, text string, row int, term string, n int")
    assert [r.doc_id for r in ranking.ranked(odd, spark.createDataFrame([(1, "a", "y")], ITEM + ", w string")).collect()] == [1]


def test_small_blocks_and_the_ways_without_broadcasts(spark, monkeypatch):
    docs, items = some(2)
    want = brute(docs, items, 5)
    monkeypatch.setattr(ranking, "CELLS", 40)  # a few documents at a time, and cuts inside them
    assert run(spark, docs, items, 5) == want
    monkeypatch.setattr(ranking, "MOST_PAIRS", 3)
    monkeypatch.setattr(ranking, "MOST_TERMS", 3)
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 3)
    assert run(spark, docs, items, 5) == want
