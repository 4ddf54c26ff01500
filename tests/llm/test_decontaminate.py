import hashlib
import random
import re

from quillon.llm import decontaminate

ITEM = "item_id long, text string"


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for k, x in items:
            v = words(x)
            m = min(13, len(v))
            wins = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
            for i in range(len(w) - m + 1) if m else ():
                if tuple(w[i : i + m]) in wins:
                    hit |= set(range(i, i + m))
                    ids.add(str(k))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    df = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM))
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


def test_against_brute_force(spark, rows):
    docs = [(r[0], r[1]) for r in rows]
    long = (rows[1][1] or "").split()
    items = [(1, " ".join(long[3:20])), (2, " ".join(long[5:30]).upper()), (10, " ".join(long[2:6])), (3, "one"), (4, None), (5, ""), (6, " ".join((rows[-3][1] or "").split()[100:140])), (6, "never seen words at all"), (7, "... ,,, !!!")]
    assert run(spark, docs, items) == brute(docs, items)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x a b c y"), (4, "A-B_C " * 50)]
    items = [(1, "a b c"), (None, "a b c")]
    assert run(spark, docs, items) == brute(docs, items[:1])
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == []


def test_filter_keeps_columns(spark, docs):
    text = docs.where("doc_id = 4").first().text
    kept = decontaminate.keep_clean(docs, spark.createDataFrame([(1, " ".join(text.split()[:40]))], ITEM))
    assert kept.columns == docs.columns and 4 not in {r.doc_id for r in kept.collect()} and kept.count() >= docs.count() - 4


def test_filter_with_clashing_names_and_no_rows(spark):
    names = ["bad_id", "bad_hash", "row_id", "row_hash", "own", "words", "n_hit"]
    rows = [(1, "a b c", *names), (1, "a b c", *names), (None, "x y", *names), (2, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(1, "a b c")], ITEM)
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0 for r in kept.collect())) == [0, 2]
    assert decontaminate.keep_clean(docs.limit(0), items).count() == 0


def test_letters_whose_lower_case_depends_on_their_neighbours(spark):
    item = "ΑΣ Β " * 10
    docs = [(i, sep.join(item.split()) + sep + " ".join(f"w{k}" for k in range(20))) for i, sep in enumerate([" ", "'", ".", "·", "_"])]
    got = run(spark, docs, [(1, item)])
    assert got == brute(docs, [(1, item)]) and [r[2] for r in got[:3]] == [20, 20, 20]


def test_special_casing_at_random(spark):
    rng = random.Random(11)
    parts = ["Σ", "ς", "σ", "İ", "i\u0307", "I", "ß", "ẞ", "K", "K", "Å", "Ǆ", "ﬀ", "a", "Z", "\u00ad", "\u0345", "Ωm", "7"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 3)))
    items = [(k, " ".join(word() for _ in range(rng.choice([2, 5, 13, 17])))) for k in range(12)]
    docs = []
    for i in range(80):
        t = rng.choice(items)[1]
        t = "".join(c.upper() if "a" <= c <= "z" and rng.random() < 0.5 else c for c in t)
        docs.append((i, " ".join(word() for _ in range(rng.randint(0, 9))) + rng.choice([" ", "'", ". "]) + rng.choice([" ", "'", "-", "."]).join(t.split(" ")) + rng.choice([" ", "'"]) + word()))
    assert run(spark, docs, items) == brute(docs, items)
