import corpus_pipeline
from test_decontaminate import brute as contamination
from test_neardup import brute as groups
from test_rules import plain_verdicts

from quillon.llm import pieces, rules, secrets
from quillon.llm.common import tokenizer_path


def test_stages_against_brute_force(spark, tmp_path, rows):
    token = "password = Zk3nQ8vXw2LrT7yB5mJ1"
    more = [(2000 + i, f"{' '.join(reversed(r[1].split()))} {token}", r[2], r[3], None) for i, r in enumerate(rows[:3])]
    docs = [*rows, *more]
    bench = [(1, " ".join(rows[9][1].split()[:30]))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    good, pools, _ = plain_verdicts([d[1:4] for d in docs])
    assert () in pools and len(docs) >= rules.MIN_GROUP
    left = [(d[0], d[1]) for d, k in zip(docs, good, strict=True) if k]
    left = [(d, t) for d, t in left if groups(left, 5)[d][2]]
    bad = {r[0] for r in contamination(left, bench) if r[5]}
    left = [(d, secrets.redacted(t, secrets.all_spans(t, secrets.default_models())[1])) for d, t in left if d not in bad]
    assert bad and any("[secret]" in t for _, t in left)
    m = pieces.model(tokenizer_path("piece_bpe_32k.model"))
    want = {d: m.library.encode(t, add_eos=True) for d, t in left}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "benchmark decontamination", "secret scans", "encoding and decoding"]


def test_stages_over_hard_cases_and_an_empty_table(spark, tmp_path):
    names = ["all", "g", "n", "kept", "count", "bad_id", "bad_hash", "distance2", "component_id", "ids"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [(1, words(1, 40)), (2, words(1, 40)), (3, None), (4, ""), (5, words(5, 120_000)), (6, words(6, 9)), (7, words(7, 10)), (None, words(8, 30)), (1, words(1, 40))]
    assert len(texts[4][1]) > 1_000_000
    rows = [(d, t, "en", None, None, *names) for d, t in texts]
    spark.createDataFrame([(1, words(9, 20)), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs, want in ((rows, [None, 1, 5, 7]), ([], [])):
        now = spark.createDataFrame(docs, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            now.write.mode("overwrite").parquet(str(tmp_path / f"stage{k}"))
            now = spark.read.parquet(str(tmp_path / f"stage{k}"))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
                assert all(r[5:] == tuple(names) for r in now.drop("text").select("doc_id", "lang", "source", "n_chars", "doc_id", *(f"`{n}`" for n in names)).collect())
        got = [r.doc_id for r in now.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
