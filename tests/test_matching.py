"""The matching core against independent plain versions."""

import heapq
import random
import time
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import blocks, features, fuzzy, matching, presentation, propagation
from quillon.plans import storage
from quillon.sources import corpora
from tests.test_engine import python_score, unit, units


def some_units(seed, n=120, words=3):
    rng = random.Random(seed)
    return [unit("LR"[i % 2], i, rng.choice(["", "a", "b", f"n{i // 2}"]), rng.randint(1, 7), rng.randint(1, 3), rng.randint(0, 2), rng.randint(3, 9), rng.choice([0.5, 1.0, 1.1]), rng.choice([2, 3, 5, 7]), rng.choice([None, 7, 11]), rng.choice([(), (1,), (1, 2), (3, 4)])) for i in range(n)]


def full(spark, rows):
    return units(spark, rows).withColumns({"byte_hash": F.concat(F.col("spp").cast("string"), F.col("instr_count").cast("string"), F.col("nodes").cast("string")), "norm_hash": F.concat("name", F.col("nodes").cast("string")), "pseudo_hash": F.col("pseudo_primes").cast("string"), "string_hashes": F.array().cast("array<bigint>")})


@pytest.mark.parametrize("seed", [1, 2])
def test_cascade_against_pass_after_pass(spark, seed):
    u = full(spark, some_units(seed)).cache()
    want, seen = [], set()
    for p in matching.PASSES:
        for r in matching.match_unique(u.where(~F.concat("side", F.col("addr").cast("string")).isin([*seen, ""])), p).collect():
            want.append(tuple(r))
            seen |= {f"L{r.left_addr}", f"R{r.right_addr}"}
    asked = []
    got = [tuple(r) for r in matching.cascade(u, progress=lambda name, i, n: asked.append(name) or True).select(*matching.MATCHES.replace(",", "").split()[::2]).collect()]
    assert sorted(got) == sorted(want) and len({r[4] for r in want}) > 4 and asked == [p.name for p in matching.PASSES]


def plain_greedy(rows):
    left, right = ([r for r in rows if r[1] == s] for s in "LR")
    pairs = sorted((-s, a[2], b[2]) for a in left for b in right if (s := python_score(a, b)) >= 0.75)
    out, seen = set(), set()
    for _, a, b in pairs:
        if ("L", a) not in seen and ("R", b) not in seen:
            out.add((a, b))
            seen |= {("L", a), ("R", b)}
    return out


@pytest.mark.parametrize(("rounds", "most"), [(3, 1_000_000), (1, 1_000_000), (1, 0)])
def test_fuzzy_with_copies_ties_and_parts(spark, monkeypatch, rounds, most):
    """A third of all units are equal, others come in copies; by rounds only, and with parts solved in order."""
    monkeypatch.setattr(fuzzy, "ROUNDS", rounds)
    monkeypatch.setattr(fuzzy, "SOLVED", most)
    rng = random.Random(5)
    rows = [unit("LR"[i % 2], i, "", rng.choice([4, 8]), 4, 2, rng.choice([8, 10]), 1.0, rng.choice([2, 3]), rng.choice([None, 7]), rng.choice([(), (1,), (1, 2)])) for i in range(60)]
    rows += [unit("LR"[i % 3 > 1], 100 + i, "", 9, 9, 9, 9, 1.0, 1) for i in range(40)]
    assert {(r.left_addr, r.right_addr) for r in fuzzy.fuzzy_matches(units(spark, rows), None).collect()} == plain_greedy(rows)


def test_a_chain_of_falling_scores(spark):
    """Each unit's best is a little worse than its neighbour's best: rounds alone would take one for each link."""
    rows = [unit("LR"[i % 2], i, "", 100, 100, 100, round(1000 * 1.004 ** (i * i / 40 + i)), 1.0, 2) for i in range(60)]
    assert {(r.left_addr, r.right_addr) for r in fuzzy.fuzzy_matches(units(spark, rows), None).collect()} == plain_greedy(rows)


def test_candidates_of_hot_keys(spark):
    """One product and one constant that all share bring no product of the two sides."""
    rows = [unit("LR"[i % 2], i, "", 2 ** (i % 20), 2 ** (i % 19), 2 ** (i % 17), 2 ** (i % 23), 1.0, 1, None, (0, i // 2)) for i in range(400)]
    kinds, _ = fuzzy.classes(units(spark, rows))
    assert fuzzy.candidates(kinds).count() < 200 * 200 * 0.6  # the loss bound leaves no more to prune by one count
    rows = [unit("LR"[i % 2], i, "", 2 ** (i % 20), 1, 1, 2 ** (i % 23), 1.0, i + 2, None, (0,)) for i in range(400)]
    kinds, _ = fuzzy.classes(units(spark, rows))
    assert fuzzy.candidates(kinds).count() < 200 * 200 / 20


def plain_propagation(matches, feats, calls, rounds=16):
    """All anchors propose in every step of every round."""
    keys = [
        lambda u: u["name"] or None, lambda u: u["pseudo_hash"], lambda u: u["md_q"] if u["nodes"] >= 2 else None,
        lambda u: u["spp"] if u["instr_count"] >= 2 else None, lambda u: (u["nodes"], u["edges"], u["calls"]),
    ]
    known, down, up = set(feats), defaultdict(set), defaultdict(set)
    for s, a, b in calls:
        if (s, a) in known and (s, b) in known:
            down[s, a].add(b)
            up[s, b].add(a)
    got = dict(matches)
    for _ in range(rounds):
        anchors, before = dict(got), len(got)
        for links in (down, up):
            for key in keys:
                taken = {("L", a) for a, _ in got} | {("R", b) for _, b in got}
                offers = {}
                for (a, b), c in anchors.items():
                    near = {}
                    for s, x in (("L", a), ("R", b)):
                        near[s] = defaultdict(list)
                        for y in links[s, x]:
                            if (s, y) not in taken and (k := key(feats[s, y])) is not None:
                                near[s][k].append(y)
                    for k, v in near["L"].items():
                        if len(v) == 1 and len(near["R"].get(k, [])) == 1:
                            pair = v[0], near["R"][k][0]
                            offers[pair] = max(offers.get(pair, 0), 0.7 * c)
                best = defaultdict(list)
                for (x, y), c in offers.items():
                    best["L", x].append((-c, x, y))
                    best["R", y].append((-c, x, y))
                for (x, y), c in offers.items():
                    if min(best["L", x]) == min(best["R", y]) == (-c, x, y):
                        got[x, y] = c
        if len(got) == before:
            break
    return {k: round(v, 9) for k, v in got.items()}


@pytest.mark.parametrize("seed", [4])
def test_propagation_against_all_anchors_in_every_step(spark, seed):
    rng = random.Random(seed)
    rows = [unit("LR"[i % 2], i, rng.choice(["", "", "a", "b", "c"]), rng.randint(1, 4), rng.randint(1, 3), rng.randint(0, 1), rng.randint(1, 4), rng.choice([0.5, 1.0]), rng.choice([2, 3, 5])) for i in range(90)]
    calls = sorted({("LR"[a % 2], a, b) for a, b in ((rng.randrange(90), rng.randrange(95)) for _ in range(300)) if a % 2 == b % 2})
    first = [("d", 2 * k, 2 * k + 1, 0.9 - 0.01 * k, "seed") for k in range(5)]
    u = units(spark, rows)
    got = propagation.propagate(spark.createDataFrame(first, matching.MATCHES), u, spark.createDataFrame([("d", *c) for c in calls], "diff_id string, side string, caller long, callee long"))
    feats = {(r.side, r.addr): r.asDict() for r in u.collect()}
    want = plain_propagation({(r[1], r[2]): r[3] for r in first}, feats, calls)
    assert {(r.left_addr, r.right_addr): round(r.confidence, 9) for r in got.collect()} == want and len(want) > 12


def plain_nearest(pdf):
    left, right = (pdf[pdf.side == s].sort_values("pos") for s in "LR")
    free, out = list(right[["block_addr", "in_degree", "out_degree", "instr_count"]].itertuples(index=False)), []
    for a in left.itertuples(index=False):
        if free:
            b = min(free, key=lambda b: 1000 * (abs(a.in_degree - b.in_degree) + abs(a.out_degree - b.out_degree)) + abs(a.instr_count - b.instr_count))
            free.remove(b)
            out.append((a.block_addr, b.block_addr))
    return out


def shapes(rng, n, m, degrees, counts):
    rows = [(s, k, 10 * k + (s == "R"), rng.randrange(degrees), rng.randrange(degrees), rng.randrange(counts)) for s, size in (("L", n), ("R", m)) for k in range(size)]
    return pd.DataFrame(rows, columns=["side", "pos", "block_addr", "in_degree", "out_degree", "instr_count"]).assign(diff_id="d", left_func=1, right_func=2)


def test_nearest_blocks():
    rng = random.Random(6)
    for n, m, d, c in ((0, 3, 2, 2), (1, 1, 1, 1), (40, 40, 3, 5), (60, 30, 4, 3000), (30, 60, 40, 2500), (80, 80, 1, 6)):
        pdf = shapes(rng, n, m, d, c)
        if n:
            assert [(r.left_addr, r.right_addr) for r in blocks.nearest(pdf).itertuples()] == plain_nearest(pdf)
    began = time.perf_counter()
    assert len(blocks.nearest(shapes(rng, 100_000, 100_000, 4, 400))) == 100_000 and time.perf_counter() - began < 60


def test_places_and_steps_over_ranges(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.choice(["identical", "identical", "changed"]), k) for k in range(500)]
    placed = presentation.positions(spark.createDataFrame(rows, "diff_id string, status string, k int").repartition(5), "k")
    got = {(r.diff_id, r.pos): (r.next_change, r.previous_change, r.status) for r in presentation.steps(placed).collect()}
    for d in "ab":
        own = [s for x, s, _ in rows if x == d]
        changed = [i for i, s in enumerate(own, 1) if s != "identical"]
        for i, s in enumerate(own, 1):
            assert got[d, i] == (min((c for c in changed if c > i), default=None), max((c for c in changed if c < i), default=None), s)


def test_dictionary_only_appends(spark):
    of = lambda words: spark.createDataFrame([(w,) for w in words], "mnemonic string")
    first = features.prime_dictionary(of(["mov", "add", "mov", "jmp"]))
    assert {tuple(r) for r in first.collect()} == {("add", 2), ("jmp", 3), ("mov", 5)}
    more = features.prime_dictionary(of(["mov", "aaa", "zzz"]), known=first)
    assert {tuple(r) for r in more.collect()} == {("add", 2), ("jmp", 3), ("mov", 5), ("aaa", 7), ("zzz", 11)}
    features.SEGMENT, kept = 64, features.SEGMENT
    try:
        found = sorted(r[0] for r in features.primes(spark, 200).collect())
    finally:
        features.SEGMENT = kept
    assert found[:200] == [p for p in range(2, 1224) if all(p % d for d in range(2, int(p**0.5) + 1))]


def test_packed_units_have_the_features_of_their_tables(spark, tmp_path):
    texts = ["one two. 3\n\nfour a@b 12345678901234567890", "", None, "x", "#12 7\n\n", "same same. same", "é ü\n 9\t9 \n0007"]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts * 3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpora.document_corpus(spark, str(tmp_path))
    tables = corpora.document_corpus(spark, str(tmp_path))
    tables.packed = None
    rows = lambda df, cols: sorted((repr(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols))) for r in df.collect()))
    a, b = features.unit_features(packed), features.unit_features(tables)
    assert set(a.columns) == set(b.columns) and rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))
    a, b = features.block_features(packed), features.block_features(tables)
    assert rows(a, sorted(b.columns)) == rows(b, sorted(b.columns))
    only = features.unit_features(packed, only=frozenset(("byte_hash", "norm_hash", "md_q", "calls")))
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "hashpartitioning" not in plan  # a small table may be spread over the cores


def test_a_single_pass_evaluates_no_feature_in_its_filters(spark, tmp_path):
    """Filters on features took their expressions along: degrees of all blocks were made again for every link."""
    from quillon.plans import catalog

    lines = "\n".join(f"line {i} of many" for i in range(400))
    spark.createDataFrame([(i, f"{lines}\n{i} " * (i + 1), "en", "s", 0) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.QUERIES["match_mdindex"](spark, str(tmp_path))
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.left_addr, r.right_addr) for r in found.collect()} == {(2, 2)}  # 0 is on one side only, 2 has a line more on the right
    packed = corpora.document_packed(corpora.document_units(spark, str(tmp_path)))
    for links, n in packed.selectExpr("links", "size(blocks) n").collect():
        assert [tuple(k) for k in links] == [(i, i + 1, int(i > 1), 1, 1, int(i + 1 < n)) for i in range(1, n)]


def test_block_tokens_are_counted_and_shown_inside_their_row(spark, tmp_path):
    texts = ["one two. 3\n\nfour a@b 12", "", None, "x", "#12 7\n\n", "same same. same one"]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts * 2)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    rows, tables = corpora.document_corpus(spark, str(tmp_path)), corpora.document_corpus(spark, str(tmp_path))
    tables.packed = tables.lines = None
    shown = presentation.signatures(rows)
    assert "hashpartitioning" not in shown._jdf.queryExecution().executedPlan().toString()
    plan = features.unit_features(rows, only=frozenset(("pseudo_hash",)))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan
    sort = lambda df, *cols: sorted(map(tuple, df.select("diff_id", "side", "func_addr", *cols).collect()))
    assert sort(shown, "block_addr", "signature") == sort(presentation.signatures(tables), "block_addr", "signature")
    units, parts = sort(features.unit_products(tables), "spp", "pseudo_primes", "pseudo_hash"), sort(features.block_products(tables), "block_addr", "spp")
    for most in (features.BROADCAST_ROWS, 0):  # a small dictionary is looked up in the row, a large one is joined
        features.BROADCAST_ROWS, kept = most, features.BROADCAST_ROWS
        try:
            assert sort(features.unit_products(rows), "spp", "pseudo_primes", "pseudo_hash") == units
            assert sort(features.block_products(rows), "block_addr", "spp") == parts
        finally:
            features.BROADCAST_ROWS = kept


def test_lines_of_equal_blocks_are_not_dealt_out(spark, tmp_path):
    texts = ["one two. 3\nfour a@b 12\nfour a@b 12", "x 1\nx 2", "same"]
    spark.createDataFrame([(i + 2, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    rows, tables = corpora.document_corpus(spark, str(tmp_path)), corpora.document_corpus(spark, str(tmp_path))
    tables.lines = None
    shown = blocks.shown_lines(rows)
    assert "hashpartitioning" not in shown._jdf.queryExecution().executedPlan().toString()
    sort = lambda df: sorted(map(str, df.collect()))
    assert sort(shown.where("size(lines) > 0")) == sort(blocks.shown_lines(tables))
    pairs = spark.createDataFrame([("en", 4, 4, 1, 1, "changed"), ("en", 4, 4, 1, 2, "identical"), ("en", 5, 5, 1, None, "removed")], blocks.BLOCK_MATCHES)
    for c in (rows, tables):
        assert [tuple(r)[3:] for r in blocks.line_changes(pairs, blocks.shown_lines(c)).collect()] == [(1, 1, 1, "1", "2")]  # the right side has the lines in reverse


def test_stepping_reads_no_range_anew_for_each_row(spark):
    """A frame that shrinks (to the end of its range) is read anew for every row: quadratic in a range."""
    rows = spark.range(60_000).select(F.lit("d").alias("diff_id"), (F.col("id") + 1).cast("int").alias("pos"), F.when(F.col("id") % 7 == 0, "added").otherwise("identical").alias("status"))
    found = presentation.steps(rows)
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().replace(" ", "").lower()
    want = rows.select("pos", ((F.floor((F.col("pos") - 1) / 7) + 1) * 7 + 1).alias("next"), (F.floor((F.col("pos") - 2) / 7) * 7 + 1).alias("previous"))
    met = found.join(want, "pos")
    assert met.where(~F.col("next_change").eqNullSafe(F.when(F.col("next") <= 60_000, F.col("next")))).count() == 0
    assert met.where(~F.col("previous_change").eqNullSafe(F.when(F.col("pos") > 1, F.col("previous")))).count() == 0


def test_propagation_asks_only_keys_that_open_units_have(spark, monkeypatch):
    """A chain of calls without names or products: each round has a table of neighbours a direction, and one step for the one key."""
    made = []
    kept = storage.saved
    monkeypatch.setattr(storage, "saved", lambda df, name, *by: made.append(name) or kept(df, name, *by))
    monkeypatch.setattr(propagation, "saved", lambda df, name, *by: made.append(name) or kept(df, name, *by))
    u = units(spark, [unit(s, k, "", 1, 1, 1, 0, 0.0, 1) for s in "LR" for k in range(4)])
    calls = spark.createDataFrame([("d", s, k, k + 1) for s in "LR" for k in range(3)], "diff_id string, side string, caller long, callee long")
    got = propagation.propagate(spark.createDataFrame([("d", 0, 0, 1.0, "seed")], matching.MATCHES), u, calls)
    assert {(r.left_addr, r.right_addr): round(r.confidence, 6) for r in got.collect()} == {(0, 0): 1.0, (1, 1): 0.7, (2, 2): 0.49, (3, 3): 0.343}
    assert made.count("round") == made.count("beside") == 2 * 4 and len(made) < 30


def test_neighbours_lie_in_rows_of_units(spark, monkeypatch):
    """A round looks a unit up, not each of its links; the neighbours of a hub are spread over several rows."""
    tables, kept = {}, storage.saved

    def noted(df, name, *by):
        out = kept(df, name, *by)
        tables.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(propagation, "CHUNK", 4, raising=False)
    monkeypatch.setattr(propagation, "saved", noted)
    u = units(spark, [unit(s, k, "", k + 1, 1, 1, 0, 0.0, 1) for s in "LR" for k in range(13)])
    calls = spark.createDataFrame([("d", s, 0, k) for s in "LR" for k in range(1, 13)], "diff_id string, side string, caller long, callee long")
    got = propagation.propagate(spark.createDataFrame([("d", 0, 0, 1.0, "seed")], matching.MATCHES), u, calls)
    assert {(r.left_addr, r.right_addr): r.confidence for r in got.collect()} == {(k, k): 0.7 if k else 1.0 for k in range(13)}
    rows = [(r.side, r.addr, len(r.down), len(r.up)) for r in tables["nodes"][0].collect()]
    assert sum(x[2] for x in rows) == sum(x[3] for x in rows) == 24 and sorted(x[1] for x in rows if x[1]) == sorted([*range(1, 13)] * 2)
    assert all(sum(1 for x in rows if x[:2] == (s, 0)) > 1 for s in "LR")


def test_trade_calls_are_dealt_out_by_their_number(spark, monkeypatch):
    """The number of partitions follows the rows, not the session's setting, and no row is lost or repeated."""
    monkeypatch.setattr(corpora, "TASK_ROWS", 100)
    found = features.callees(corpora.trade_calls(spark, "/root/testdata/sf0.001"))
    items, orders = (pd.read_parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("lineitem", "orders"))
    assert found.rdd.getNumPartitions() >= 2 * len(items) // 100
    rows = items.merge(orders, left_on="l_orderkey", right_on="o_orderkey")
    want = set()
    for key, part, supplier, customer in rows[["l_orderkey", "l_partkey", "l_suppkey", "o_custkey"]].itertuples(index=False):
        side = "LR"[key % 2]
        want |= {(side, customer + 1, part + corpora.PARTS), (side, part + corpora.PARTS, supplier + corpora.SUPPLIERS)}
    got = [(r.side, r.caller, r.callee) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_large_side_is_not_broadcast_by_the_size_of_its_files(spark, monkeypatch):
    """Saved matches are a few bytes a row; what the driver would hold of them follows from their number."""
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 10)
    u = storage.saved(units(spark, [unit(s, k, "", 1, 1, 1, 0, 0.0, 1) for s in "LR" for k in range(40)]), "units")
    plan = lambda n: matching.open_units(u, storage.saved(spark.createDataFrame([("d", k, k, 1.0, "x") for k in range(n)], matching.MATCHES), "matches"))
    large, few = plan(30), plan(3)
    assert "BroadcastExchange" not in large._jdf.queryExecution().executedPlan().toString() and large.count() == 20
    assert "BroadcastExchange" in few._jdf.queryExecution().executedPlan().toString() and few.count() == 74


def test_classes_meet_only_under_a_product_or_beside_one_without_a_tree(spark):
    """All classes without constants met under one key, and a class had a key for each count of each way."""
    rows = [unit(s, 2 * i + (s == "R") + 1, spp=1000 + i, pp=2000 + i) for i in range(150) for s in "LR"]
    met, holds = fuzzy.meetings(fuzzy.vectors(units(spark, rows))[0])
    assert met.count() == 2 * 150 and met.where(holds).count() == 150
    rows += [unit("LR"[i % 2], 1000 + i, spp=1) for i in range(2)]
    rows += [unit("LR"[i % 2], 2000 + i, spp=7 + i, pp=(None, 3)[i // 2], constants=[5]) for i in range(4)]
    want = {(a[2], b[2]) for a in rows for b in rows if a[1] == "L" and b[1] == "R" and python_score(a, b) >= 0.75}
    assert {(r.left_addr, r.right_addr) for r in fuzzy.scored(units(spark, rows)).collect()} == want and len(want) > 150


def test_word_features_come_with_the_products_of_their_row(spark, tmp_path):
    texts = ["12\r 3\u0085 #4\u2028\n5\r\r x\r", " \n \nMov. mOv, É. a@b 7@", ".\n..\n#1", "\n", "ΑΣ 1\t2 é. @", "9" * 20 + " " * 9]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts * 3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    packed, tables = (corpora.document_corpus(spark, str(tmp_path)) for _ in range(2))
    tables.packed = None
    rows = lambda df, cols: sorted((repr(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols))) for r in df.collect()))
    a, b = features.unit_features(packed), features.unit_features(tables)
    assert "Join" not in a._jdf.queryExecution().executedPlan().toString()
    assert set(a.columns) == set(b.columns) and rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))
    some = ["addr", "calls", "instr_count", "norm_hash", "pseudo_hash", "side", "string_hashes"]
    assert rows(features.unit_features(packed, only=frozenset(some[1:])), some) == rows(a, some)
    whole = features.packed_products(packed.packed, mnemonic=lambda w: w)
    assert rows(whole, ["func_addr", "side", "spp"]) == rows(features.unit_products(tables, mnemonic=lambda w: w).where("spp > 1 or pseudo_hash is not null"), ["func_addr", "side", "spp"])
