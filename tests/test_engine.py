import json

import pytest
from pyspark.sql import functions as F

from quillon.operators import blocks, features, fuzzy, matching, presentation, propagation
from quillon.plans import engine
from quillon.sources import export, store
from quillon.sources.corpora import Corpus
from quillon.streaming import snapshots

#: Units as lists of blocks, blocks as lists of words; a number is an immediate.
V1 = {
    "same": ["push mov 1", "xor add", "ret"], "edited": ["load mul 3", "store div", "jump", "leave now"], "renamed": ["alpha beta", "gamma delta", "ret"],
    "moved": ["one two three", "four five", "six seven"], "gone": ["only left here", "bye"], "gone2": ["just left too now", "and", "so", "it goes on", "end"],
}
V2 = {
    "same": ["push mov 1", "xor add", "ret"], "edited": ["load mul 3", "store sub", "jump", "leave now"], "fresh": ["alpha beta", "gamma delta", "ret"],
    "moved": ["six seven", "one two three", "four five"], "new": ["quite other words live", "in this new one", "hello"], "new2": ["zig zag zog zug"],
}


def corpus(spark, left, right, names=True):
    u, b, t, e, c = [], [], [], [], []
    for side, units in (("L", left), ("R", right)):
        for i, (name, lines) in enumerate(units.items()):
            addr = 100 + i * 10
            u.append(("d", side, addr, name if names else ""))
            for k, line in enumerate(lines):
                b.append(("d", side, addr, addr * 100 + k, line.encode()))
                if k:
                    e.append(("d", side, addr, addr * 100 + k - 1, addr * 100 + k))
                for n, w in enumerate(line.split()):
                    t.append(("d", side, addr, addr * 100 + k, n, 0, "integer" if w.isdigit() else "opcode", w))
    key = "diff_id string, side string"
    return Corpus(
        spark.createDataFrame(u, f"{key}, addr long, name string"), spark.createDataFrame(b, f"{key}, func_addr long, block_addr long, bytes binary"),
        spark.createDataFrame(t, f"{key}, func_addr long, block_addr long, line_no int, tok_no int, tok_type string, text string"),
        spark.createDataFrame(e, f"{key}, func_addr long, src_block long, dst_block long"), spark.createDataFrame(c, f"{key}, caller long, site long, callee long"),
    )


@pytest.fixture(scope="module")
def diff(spark):
    return engine.compute(corpus(spark, V1, V2))


def test_scenarios(diff):
    rows = {(r.left_name, r.right_name): r for r in diff.result.collect()}
    assert rows["same", "same"].status == "identical" and rows["same", "same"].similarity == 1.0
    assert rows["edited", "edited"].status == "changed" and rows["edited", "edited"].bb_changed == 1
    assert rows["renamed", "fresh"].status == "identical" and rows["renamed", "fresh"].algorithm == "bytehash"
    assert rows["moved", "moved"].status == "changed" and rows["moved", "moved"].similarity == 0.999
    assert {k for k, r in rows.items() if r.status == "removed"} == {("gone", None), ("gone2", None)}
    assert {k for k, r in rows.items() if r.status == "added"} == {(None, "new"), (None, "new2")}
    assert diff.summary.first().asDict() == {"diff_id": "d", "n_identical": 2, "n_changed": 2, "n_added": 2, "n_removed": 2}


def test_each_block_is_there_once(diff):
    m = diff.block_matches
    for end, func in (("left_addr", "left_func"), ("right_addr", "right_func")):
        rows = m.where(F.col(end).isNotNull()).groupBy("diff_id", func, end).count()
        assert rows.where("count > 1").count() == 0
    assert blocks.highlights(m).where("colour = 'yellow'").count() > 0


def test_blocks_of_unmatched_units_are_listed(diff):
    """All blocks of a removed unit are removed and shown in red, those of an added one added and green."""
    result = {(r.left_addr, r.right_addr): r for r in diff.result.where("algorithm = 'unmatched'").collect()}
    listed = {}
    for m in diff.block_matches.where("left_func is null or right_func is null").collect():
        listed.setdefault((m.left_func, m.right_func), []).append(m)
    assert {k: (len(v), {m.status for m in v}) for k, v in listed.items()} == {k: (r.bb_added + r.bb_removed, {r.status}) for k, r in result.items()}
    shown = {(r.side, r.func_addr): r.colour for r in blocks.highlights(diff.block_matches).collect()}
    assert all(shown["L" if a else "R", a or b] == ("red" if a else "green") for a, b in result)


def test_only_the_features_asked_for(spark):
    c = corpus(spark, V1, V2)
    whole = features.unit_features(c)
    for p in matching.PASSES:
        part = features.unit_features(c, only=p.columns())
        assert len(part.columns) < len(whole.columns)
        same = lambda df: sorted((r.diff_id, r.left_addr, r.right_addr) for r in matching.match_unique(df, p).collect())
        assert same(part) == same(whole)


def test_a_corpus_against_itself(spark):
    assert {r.status for r in engine.compute(corpus(spark, V1, V1, names=False)).result.collect()} == {"identical"}


def test_cancel(spark):
    with pytest.raises(matching.Cancelled):
        engine.compute(corpus(spark, V1, V2), progress=lambda name, i, n: name != "name")


def test_async(spark):
    done = []
    run = engine.compute_async(spark, corpus(spark, {"a": ["x y"]}, {"a": ["x y"]}), done.append)
    assert run.result(300).result.count() == 1 and len(done) == 1


def units(spark, rows):
    cols = "diff_id string, side string, addr long, name string, nodes long, edges long, calls long, instr_count long, md_q long, md_index double, spp decimal(38,0), pseudo_hash string, pseudo_primes decimal(38,0), constants array<bigint>"
    return spark.createDataFrame(rows, cols)


def unit(side, addr, name="", nodes=1, edges=0, calls=0, n=1, md=0.0, spp=1, pp=None, constants=()):
    from decimal import Decimal

    return ("d", side, addr, name, nodes, edges, calls, n, round(md * 1e6), md, Decimal(spp), None, None if pp is None else Decimal(pp), list(constants))


def test_unique_keys_only(spark):
    u = units(spark, [unit("L", 1, "a"), unit("L", 2, "b"), unit("L", 3, "b"), unit("L", 4, "", 7), unit("R", 5, "a"), unit("R", 6, "b"), unit("R", 7, "c"), unit("R", 8, "", 7)])
    got = matching.match_unique(u, matching.BY_NAME["name"]).collect()
    assert [(r.left_addr, r.right_addr) for r in got] == [(1, 5)]


def test_propagation_compounds_and_stops(spark):
    u = units(spark, [unit("L", 1, "root"), unit("L", 2, "", 3), unit("L", 3, "", 4), unit("R", 11, "root"), unit("R", 12, "", 3), unit("R", 13, "", 4), unit("R", 14, "", 9)])
    calls = spark.createDataFrame([("d", "L", 1, 2), ("d", "L", 2, 3), ("d", "R", 11, 12), ("d", "R", 12, 13), ("d", "R", 12, 99)], "diff_id string, side string, caller long, callee long")
    first = matching.match_unique(u.where("name <> ''"), matching.BY_NAME["name"])
    got = {(r.left_addr, r.right_addr): round(r.confidence, 6) for r in propagation.propagate(first, u, calls).collect()}
    assert got == {(1, 11): 0.92, (2, 12): 0.644, (3, 13): 0.4508}


def python_score(a, b):
    rel = lambda x, y: 1 - abs(x - y) / max(x, y, 1)
    s = sum(rel(a[i], b[i]) for i in (4, 5, 6, 7))
    s += 1 - min(1.0, abs(a[9] - b[9]) / (max(a[9], b[9]) + 1e-9)) + (2 if a[10] == b[10] else 0)
    x, y = set(a[13]), set(b[13])
    s += 2 * (1.0 if not x and not y else 0.0 if not x or not y else len(x & y) / len(x | y))
    if a[12] is not None and b[12] is not None:
        return (s + (2 if a[12] == b[12] else 0)) / 11
    return s / 9


def test_fuzzy_pruning_is_exact_and_choice_is_greedy(spark):
    import random

    rng = random.Random(8)
    rows = [unit("LR"[i % 2], i, "", rng.randint(1, 6), rng.randint(1, 6), rng.randint(0, 3), rng.randint(3, 9), rng.choice([0.5, 1.0, 1.1]), rng.choice([2, 3, 5]), rng.choice([None, 7, 11]), rng.choice([(), (), (1,), (1, 2), (3,)])) for i in range(160)]
    pairs = {(a[2], b[2]): s for a in rows if a[1] == "L" for b in rows if b[1] == "R" if (s := python_score(a, b)) >= 0.75 - 1e-12}
    got = {(r.left_addr, r.right_addr): r.score for r in fuzzy.scored(units(spark, rows)).collect()}
    assert {k for k, s in pairs.items() if s > 0.75 + 1e-9} <= set(got) <= set(pairs)
    want, seen = set(), set()
    for (a, b), s in sorted(got.items(), key=lambda x: (-x[1], x[0])):
        if ("L", a) not in seen and ("R", b) not in seen:
            want.add((a, b))
            seen |= {("L", a), ("R", b)}
    assert {(r.left_addr, r.right_addr) for r in fuzzy.fuzzy_matches(units(spark, rows)).collect()} == want
    assert fuzzy.fuzzy_matches(units(spark, rows), max_side=10).count() == 0


def test_store(spark, diff, tmp_path):
    s = store.DiffStore(spark, "file://" + str(tmp_path / "store"))
    assert s.list().count() == 0 and s.load("x") is None and not s.delete("x")
    rows = store.function_rows(diff.result, diff.block_matches)
    for name in ("x", "y/z=1:2", "x"):
        s.save(name, rows, "v1", "v2", "2024-01-01T00:00:00")
    assert [(r.position, r.name) for r in s.list().collect()] == [(0, "x"), (1, "y/z=1:2")]
    back = s.load("x").collect()
    assert len(back) == diff.result.count() and sum(len(r.blocks) for r in back) == diff.block_matches.count()
    assert s.titles().first().subtitle == "v1 → v2 · 2024-01-01T00:00:00"
    assert len(list((tmp_path / "store/data").iterdir())) == 2
    assert s.delete("y/z=1:2") and [r.name for r in s.list().collect()] == ["x"] and s.load("y/z=1:2") is None
    assert len(list((tmp_path / "store/data").iterdir())) == 1 and not s.delete("y/z=1:2")
    doc = store.documents(diff.result, diff.block_matches, "v1", "v2", "2024-01-01T00:00:00")
    assert doc.first().schema == 2 and len(doc.first().functions) == len(back)
    path = "file://" + str(tmp_path / "one")
    store.save_file(doc, path)
    with pytest.raises(store.AlreadyThere):
        store.save_file(doc, path)
    assert len(store.read_file(spark, path)["functions"]) == diff.result.count()


def test_old_documents(spark):
    raw = [("a", json.dumps({"functions": [{"name": "f", "status": "matched", "left_addr": 5}, {"name": "g", "status": "added", "similarity": "high", "right_addr": "x"}]})), ("b", "{}")]
    rows = {r.name: r for r in store.functions_of(spark.createDataFrame(raw, "name string, document string")).collect()}
    assert rows["f"].similarity == 1.0 and rows["f"].left_addr == 5 and rows["g"].similarity == 1.0 and rows["g"].right_addr == 0 and len(rows) == 2


def test_exports(spark, diff, tmp_path):
    from quillon.operators.assembly import entries

    rows = entries(diff.result)
    out = json.loads(open(export.export(rows, str(tmp_path / "r"), "a", "b", "t")).read())
    assert out["summary"] == {"identical": 2, "changed": 2, "added": 2, "removed": 2}
    assert {f["name"] for f in out["functions"]} >= {"same", "gone", "new"}
    page = open(export.export(rows, str(tmp_path / "r.html"), "a<", "b", "t")).read()
    assert "a&lt;" in page and page.count("<tr class=") == diff.result.count() and "—" in page


def test_presentation(spark):
    rows = spark.createDataFrame([("d", s, i) for i, s in enumerate(["identical", "changed", "identical", "added", "identical"])], "diff_id string, status string, k int")
    placed = presentation.positions(rows, "k")
    assert [(r.next_change, r.previous_change) for r in presentation.steps(placed).orderBy("k").collect()] == [(2, None), (4, None), (4, 2), (None, 2), (None, 4)]
    assert presentation.first_change(placed).first().pos == 2 and presentation.first_change(placed, last=True).first().pos == 4
    assert presentation.filtered(rows, "differences").count() == 2 and presentation.filtered(rows).count() == 5
    corpora = spark.createDataFrame([(0, "a.so", "/1", False), (1, "A.so", "/2", True), (2, "a.exe", "/3", True)], "position int, name string, path string, analysed boolean")
    assert presentation.resolve_by_name(corpora, "a").first().path == "/3" and presentation.resolve_by_path(corpora, "/2").first().position == 1


def test_one_unit_and_block(spark):
    c = corpus(spark, V1, V2)
    one = features.unit_features(features.one_unit(c, "d", "L", 100)).first()
    assert (one.name, one.nodes, one.edges, one.instr_count, one.cyclomatic) == ("same", 3, 2, 6, 2)
    assert features.one_block(c, "d", "L", 100, 10000).first().mnemonic_sig == "push \nmov \n\n"


def test_new_snapshots_are_followed(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k in range(2):
        spark.createDataFrame([("d", "L", k, "n", "a 1\nb")], snapshots.UNITS).write.mode("append").parquet(source)
        snapshots.follow(spark, source, target, check).awaitTermination()
    rows = spark.read.parquet(target)
    assert rows.count() == 2 and rows.select("norm_hash").distinct().count() == 1


def test_unit_at_whole_tables_and_any_ranges(spark, tmp_path):
    import random

    from quillon.plans import catalog

    def by_hand(blocks, at):
        exact = [f for f, _, _ in blocks if f == at]
        around = [f for f, b, e in blocks if b <= at < e]
        return min(exact or around, key=lambda f: f % 2**64, default=None)

    keys = [1, 7, 1999, 2000, 2001, 5000, 20005, 70000]
    lines = [(k, n) for k in keys for n in (1, 3, 7)]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    blocks = [(k, k * 10, k * 10 + 7) for k in keys]
    want = {(a, f) for k, n in lines if (f := by_hand(blocks, a := k * 10 + n)) is not None}
    assert {tuple(r) for r in catalog.QUERIES["unit_at_address"](spark, str(tmp_path)).collect()} == want and max(want)[0] > 700000

    rng = random.Random(4)
    top = 2**63 - 1
    blocks = [(rng.randint(-300, 300), b := rng.randint(-300, 300), b + rng.choice((-1, 0, 1, 2, 7, 8, 9, 200))) for _ in range(60)] + [(500, -top, top), (600, 700, top)]
    at = [*range(-320, 320), -top - 1, -top, top - 1, top, 699, 700]
    rows = spark.createDataFrame([("d", s, *b) for s in "LR" for b in (blocks if s == "L" else blocks[:9])], "diff_id string, side string, func_addr long, begin long, end long")
    got = presentation.unit_at(rows, spark.createDataFrame([("d", s, a) for s in "LR" for a in at], "diff_id string, side string, at long"))
    want = {(s, a, f) for s in "LR" for a in at if (f := by_hand(blocks if s == "L" else blocks[:9], a)) is not None}
    assert {(r.side, r.at, r.func_addr) for r in got.collect()} == want


def test_v1_documents_of_all_orders(spark, tmp_path):
    from quillon.plans import catalog

    keys = [3, 4, 2999, 3000, 3001, 3002, 900000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    want = {(str(k), 1.0 if k % 3 == 0 else 0.5, 1.0, "identical" if k % 3 == 0 else "changed") for k in keys}
    assert {tuple(r) for r in catalog.QUERIES["v1_compat"](spark, str(tmp_path)).collect()} == want


def test_line_changes_of_the_whole_engine(spark, diff, monkeypatch):
    from quillon.plans import catalog

    monkeypatch.setattr(catalog, "_full", lambda spark, sf_dir: diff)
    monkeypatch.setattr(catalog.corpora, "document_corpus", lambda spark, sf_dir: corpus(spark, V1, V2))
    words = [{(100 + i * 10) * 100 + k: line.split() for i, lines in enumerate(v.values()) for k, line in enumerate(lines)} for v in (V1, V2)]
    want = set()
    for m in diff.block_matches.where("left_addr is not null and right_addr is not null").collect():
        a, b = words[0][m.left_addr], words[1][m.right_addr]
        for n in range(max(len(a), len(b))):
            x, y = (w[n] if n < len(w) else None for w in (a, b))
            if x != y:
                want.add((m.left_addr, m.right_addr, n, x, y))
    got = catalog.QUERIES["instr_diff_full"](spark, "").collect()
    assert {(r.left_addr, r.right_addr, r.line_no, r.left_line, r.right_line) for r in got} == want and len(got) == len(want)
    assert ("div", "sub") in {(r.left_line, r.right_line) for r in got}


def test_line_changes_make_no_other_part_of_the_result(spark, diff, monkeypatch):
    from quillon.plans import catalog

    made, kept = [], engine.saved
    monkeypatch.setattr(engine, "saved", lambda df, name, *by: made.append(name) or kept(df, name, *by))
    monkeypatch.setattr(catalog.corpora, "document_corpus", lambda spark, sf_dir: corpus(spark, V1, V2))
    got = catalog.QUERIES["instr_diff_full"](spark, "")
    assert "units" in made and not {"result", "residual"} & set(made)
    want = blocks.line_changes(diff.block_matches, blocks.shown_lines(corpus(spark, V1, V2)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_two_writers_and_a_killed_save(spark, diff, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    folder = "file://" + str(tmp_path / "store")
    rows = store.function_rows(diff.result, None).limit(2)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: store.DiffStore(spark, folder).save(f"n{k}", rows), range(6)))
    s = store.DiffStore(spark, folder)
    assert sorted(r.name for r in s.list().collect()) == [f"n{k}" for k in range(6)] and sorted(r.position for r in s.list().collect()) == list(range(6))
    assert not s._publish(s._read()[0], [])  # a version is given once only
    with monkeypatch.context() as m:
        m.setattr(store.DiffStore, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            s.save("late", rows)
    assert s.load("late") is None and s.list().count() == 6 and s.clean() == 1 and s.clean() == 0 and s.load("n3").count() == 2


def test_a_run_goes_on_where_it_was_cancelled(spark, diff, tmp_path):
    from quillon.plans.storage import run_in

    folder, c = "file://" + str(tmp_path / "run"), corpus(spark, V1, V2)
    with pytest.raises(matching.Cancelled):
        engine.compute(c, progress=lambda name, i, n: name != "nec", folder=folder)
    before = len(list((tmp_path / "run").iterdir()))
    with run_in(folder) as run:
        again = engine._compute(c, engine.Options(), None)
    assert run.reused == before > 3
    done = engine.compute(c, folder=folder)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(done.result) == rows(diff.result) == rows(again.result) and rows(done.block_matches) == rows(diff.block_matches)
    assert {p.name.split("-")[1] for p in (tmp_path / "run").iterdir()} == {"units", "blocks", "residual", "result"}
    with pytest.raises(matching.Cancelled):
        engine.compute(c, progress=lambda name, i, n: name != "features", folder=folder + "2")
    assert not (tmp_path / "run2").exists()


#: Ten scenarios: two units as they were, two changed, one renamed, one with its blocks in another order, two gone, two new.
OLD = {
    "scan": ["load a b", "test b", "jump out", "add a one", "loop back"], "encode": ["push x", "shift x four", "mask x", "store low", "store high", "ret"],
    "mix": ["load k", "xor k v", "rotate v", "store v", "next v", "again k", "ret"], "sum": ["zero s", "add s v", "fold s", "ret s"],
    "wipe": ["fill p zero", "step p", "ret p p"], "sort": ["case one", "case two three", "case four five six", "default", "join", "leave q", "halt q", "done"],
    "decode": [f"part {w} of many" for w in "abcdefghijkl"], "turn": [" ".join(f"swap{k}" for k in range(60))],
}
NEW = {
    "scan": OLD["scan"], "encode": OLD["encode"], "mix": [*OLD["mix"][:2], "rotate w", *OLD["mix"][3:]], "sum": [*OLD["sum"][:2], "bend s", "ret s"],
    "blank": OLD["wipe"], "sort": [*OLD["sort"][2:], *OLD["sort"][:2]],
    "count": [f"bit {k} and then more of it" for k in range(30)], "spin": ["ror"],
}


def test_the_ten_scenarios_with_and_without_names(spark, tmp_path):
    from quillon.operators.assembly import entries, summary

    found = engine.compute(corpus(spark, OLD, NEW))
    rows = {(r.left_name, r.right_name): r for r in found.result.collect()}
    assert rows["scan", "scan"].status == rows["encode", "encode"].status == rows["wipe", "blank"].status == "identical"
    assert rows["mix", "mix"].status == rows["sum", "sum"].status == rows["sort", "sort"].status == "changed"
    assert {k for k, r in rows.items() if r.status == "removed"} == {("decode", None), ("turn", None)}
    assert {k for k, r in rows.items() if r.status == "added"} == {(None, "count"), (None, "spin")}
    listed = entries(found.result)
    text = json.loads(open(export.export(listed, str(tmp_path / "r"), "a", "b", "t")).read())
    assert {"functions", "summary"} <= set(text) and "scan" in {f["name"] for f in text["functions"]}
    page = open(export.export(listed, str(tmp_path / "r.html"), "a", "b", "t")).read()
    assert "<table" in page and "scan" in page and "changed" in page
    again = summary(entries(found.result, old_status=True), stored=True).first()
    assert (again.n_identical, again.n_changed, again.n_added, again.n_removed) == (4, 2, 2, 2)  # the reordered one has 0.999
    bare = engine.compute(corpus(spark, OLD, NEW, names=False)).summary.first()
    assert bare.n_added == 2 and bare.n_removed == 2 and bare.n_identical + bare.n_changed == 6


def test_pairs_and_blocks_against_plain_python(spark, diff):
    """Similarity, status and block matches of every matched pair, by loops over the two corpora."""
    shape = lambda n, k: (int(k > 0), int(k < n - 1))
    side = [{100 + i * 10: lines for i, lines in enumerate(v.values())} for v in (V1, V2)]
    skeleton = lambda line: [w for w in line.split() if not w.isdigit()] + [len(line.split())]
    got = {}
    for m in diff.block_matches.collect():
        got.setdefault((m.left_func, m.right_func), set()).add((m.left_addr, m.right_addr, m.status))
    for r in diff.result.where("left_addr is not null and right_addr is not null").collect():
        a, b = side[0][r.left_addr], side[1][r.right_addr]
        left, right, out = list(range(len(a))), list(range(len(b))), set()
        for key, status in ((lambda x: x, "identical"), (skeleton, "changed")):
            for i in list(left):
                j = next((j for j in right if key(a[i]) == key(b[j])), None)
                if j is not None:
                    out.add((i, j, status))
                    left.remove(i)
                    right.remove(j)
        for i in list(left):
            if right:
                j = min(right, key=lambda j: 1000 * sum(abs(x - y) for x, y in zip(shape(len(a), i), shape(len(b), j), strict=True)) + abs(len(a[i].split()) - len(b[j].split())))
                out.add((i, j, "changed"))
                left.remove(i)
                right.remove(j)
        out |= {(i, None, "removed") for i in left} | {(None, j, "added") for j in right}
        place = lambda f, k: None if k is None else f * 100 + k
        assert got[r.left_addr, r.right_addr] == {(place(r.left_addr, i), place(r.right_addr, j), s) for i, j, s in out}
        n = [sum(s == want for _, _, s in out) for want in ("identical", "changed", "added", "removed")]
        assert [r.bb_identical, r.bb_changed, r.bb_added, r.bb_removed] == n
        edges = 1 - abs(len(a) - len(b)) / max(len(a) - 1, len(b) - 1, 1)
        want = 1.0 if a == b else min(0.999, 0.8 * (2 * n[0] + n[1]) / (len(a) + len(b)) + 0.2 * edges)
        assert abs(r.similarity - want) < 1e-9 and r.status == ("identical" if a == b else "changed")
