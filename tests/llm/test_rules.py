import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import rules


def base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_base_counts(docs, rows):
    text = {r[0]: r[1] for r in rows}
    for r in rules.quality(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(text[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def corpus(spark, n=400):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    rows = []
    for i in range(n):
        t = " ".join(word() for _ in range(rng.randint(60, 150))) + "."
        junk = i % 8 == 0
        if junk:
            t = t.replace(" ", "*** ") if i % 16 else t.upper().replace(" ", "!! ")
        rows.append((i, t, "en" if i % 3 else "de", "hot" if i % 2 else f"s{i % 20}", len(t)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_outliers_go_and_clean_texts_stay(spark):
    got = {r.doc_id: r for r in rules.quality(corpus(spark)).collect()}
    assert [i for i, r in got.items() if not r.kept] == [i for i in got if i % 8 == 0]


def test_estimates_do_not_depend_on_partitions(spark):
    df = corpus(spark, 200)
    a = sorted((r.doc_id, r.distance2) for r in rules.quality(df.repartition(1)).collect())
    b = sorted((r.doc_id, r.distance2) for r in rules.quality(df.repartition(7)).collect())
    assert a == b


def test_filter_keeps_columns(spark, odd, none):
    df = corpus(spark, 120).withColumn("all", F.lit(1)).withColumn("g", F.lit("x")).withColumn("n", F.lit(2))
    out = rules.keep_good(df)
    kept = {r.doc_id for r in rules.quality(df).where("kept").collect()}
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == kept and 105 <= len(kept) < 120
    assert rules.quality(none).count() == 0 and rules.keep_good(none).count() == 0
    assert rules.keep_good(odd).count() == 0 and rules.quality(odd).count() == 4


def test_a_third_of_copies_goes(spark):
    """Copies and near copies of one junk text, a third of a group, are rejected, and the clean texts stay."""
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    words = [word().upper() + "!!" for _ in range(100)]
    rows = []
    for i in range(600):
        t = " ".join(word() for _ in range(rng.randint(60, 150))) + "."
        junk = i % 3 == 0
        if junk and i % 2:
            t = " ".join([*words[:-3], *(word().upper() + "!!" for _ in range(3))])
        elif junk:
            t = " ".join(words)
        rows.append((i, t, "en", "copies" if i < 300 else "both"))
    rows = [(i, " ".join(words) if i % 3 == 0 and s == "copies" else t, g, s) for i, t, g, s in rows]
    got = {r.doc_id: r for r in rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i, r in got.items() if r.kept == (i % 3 == 0)] == []


def plain(vectors):
    """Minimum covariance determinant of one group's distinct vectors in numpy: centre, inverse scatter and scale."""
    P, v = rules.P, np.array(sorted(set(vectors)), float)
    n, x = len(v), v / rules.STEPS
    solved = lambda cov: (np.linalg.inv(cov + np.diag(np.square(rules.FLOOR))), np.linalg.slogdet(cov + np.diag(np.square(rules.FLOOR)))[1])
    bins = lambda c, inv: np.floor(np.log2(np.maximum(np.einsum("ij,jk,ik->i", x - c, inv, x - c), 0) + 2.0**-20) * rules.BINS)

    def step(c, inv):
        b = bins(c, inv)
        ranked = np.sort(b)
        half = x[b <= ranked[-(-min(n + P + 1, 2 * n) // 2) - 1]]
        return half.mean(0), *solved(np.cov(half.T, bias=True))

    q = np.sort(x, axis=0)[[int(np.ceil(n * s)) - 1 for s in (0.25, 0.5, 0.75)]]
    spread = (q[2] - q[0]) / 1.349
    scale = np.maximum(spread, rules.FLOOR)
    z = (x - q[1]) / scale
    signs = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    tanh = np.cov(np.tanh(z).T, bias=True)
    size = np.sqrt(np.maximum(np.diag(tanh), 1e-9))
    starts = [np.diag(spread**2), np.eye(P) * max((spread**2).mean(), 0.01), tanh / np.outer(size, size) * np.outer(scale, scale), P * (signs.T @ signs / n) * np.outer(scale, scale)]
    ends = []
    for cov in starts:
        now = (q[1], *solved(cov))
        for _ in range(rules.FIRST_STEPS):
            now = step(*now[:2])
        ends.append(now)
    now = min(ends, key=lambda e: e[2])
    while (new := step(*now[:2]))[2] < now[2] - rules.TOLERANCE:
        now = new
    middle = np.sort(bins(*now[:2]))[-(-n // 2) - 1]
    return now[0], now[1], max(2 ** ((middle + 1) / rules.BINS) / rules.CHI2_MEDIAN, 0.25)


def test_verdicts_against_a_plain_estimate(spark):
    df = corpus(spark, 300).withColumn("lang", F.lit("en")).withColumn("source", F.lit("one"))
    found = {r.doc_id: rules.statistics(r.text) for r in df.collect()}
    centre, inverse, scale = plain([v[5:] for v in found.values()])
    for r in rules.quality(df).collect():
        d = np.array(found[r.doc_id][5:]) / rules.STEPS - centre
        expected = d @ inverse @ d / scale / (1 + rules.NOISE / max(r.n_words, 1))
        assert abs(r.distance2 - expected) <= 1e-6 * max(1, expected) and r.kept == (not r.base_failed and expected <= rules.CUTOFF)


def plain_verdicts(rows):
    """Kept or not for each (text, lang, source): groups, what is too small pooled by language, and what is still too small over all."""
    found = [rules.statistics(t or "") for t, _, _ in rows]
    groups, rest = {}, Counter()
    for f, (_, lang, source) in zip(found, rows, strict=True):
        groups.setdefault((lang, source), set()).add(f[5:])
    for (lang, _), vectors in groups.items():
        rest[lang] += len(vectors) if len(vectors) < rules.MIN_GROUP else 0
    pool_of = {g: g if len(v) >= rules.MIN_GROUP else (g[0],) if rest[g[0]] >= rules.MIN_GROUP else () for g, v in groups.items()}
    pools = {}
    for g, vectors in groups.items():
        pools.setdefault(pool_of[g], set()).update(vectors)
    fits = {p: plain(v) for p, v in pools.items() if len(v) >= rules.MIN_GROUP}
    out = []
    for f, (_, lang, source) in zip(found, rows, strict=True):
        kept = f[0] >= 10 and 100 * f[4] <= 20 * f[0]
        if kept and (fit := fits.get(pool_of[lang, source])):
            d = np.array(f[5:]) / rules.STEPS - fit[0]
            kept = d @ fit[1] @ d / fit[2] / (1 + rules.NOISE / f[0]) <= rules.CUTOFF
        out.append(bool(kept))
    return out, set(pool_of.values()), fits


def test_pools_against_plain_estimates(spark):
    """A group of its own, a language's small groups, and small groups of three languages together, nulls among them."""
    found = corpus(spark, 300).select("doc_id", "text").collect()
    place = lambda i: ("en", "own") if i < 100 else ("de", f"s{i % 5}") if i < 200 else ((None, "fr", "es")[i % 3], (None, "x")[i % 2])
    rows = [(r.doc_id, r.text, *place(r.doc_id)) for r in found]
    want, pools, fits = plain_verdicts([r[1:] for r in rows])
    assert pools == {("en", "own"), ("de",), ()} == set(fits) and 30 <= want.count(False) <= 45
    got = {r.doc_id: r.kept for r in rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {r[0]: k for r, k in zip(rows, want, strict=True)}
