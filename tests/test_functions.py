import math

from pyspark.sql import functions as F

from quillon.functions import hashing, scores, text

M64 = (1 << 64) - 1


def fnv(data, h=0xCBF29CE484222325):
    for b in data:
        h = (h ^ b) * 0x100000001B3 & M64
    return h


def test_hashes(spark):
    rows = [("",), ("hello",), ("né\n",), ("x" * 40,)]
    df = spark.createDataFrame(rows, "s string").select("s", hashing.unsigned(hashing.fnv1a_text(F.col("s"))).alias("h"), hashing.unsigned(hashing.fnv1a_text(F.lit("b"), hashing.fnv1a_text(F.col("s")))).alias("c"))
    for r in df.collect():
        assert (int(r.h), int(r.c)) == (fnv(r.s.encode()), fnv((r.s + "b").encode()))


def test_combination_and_products(spark):
    values = [1, -5, 2**62, -(2**63), 77]
    h = 0x243F6A8885A308D3
    for v in values:
        h ^= ((v & M64) + 0x9E3779B97F4A7C15 + (h << 6 & M64) + (h >> 2)) & M64
    primes = [2, 3, 99991, 104729] * 12
    p = 1
    for x in primes:
        p = p * x % (2**64 - 59)
    r = spark.range(1).select(hashing.unsigned(hashing.combined(F.array(*map(F.lit, values)).cast("array<bigint>"))).alias("h"), hashing.prime_product(F.array(*map(F.lit, primes)).cast("array<bigint>")).cast("string").alias("p"), hashing.prime_product(F.array().cast("array<bigint>")).cast("string").alias("one")).first()
    assert (int(r.h), int(r.p), r.one) == (h, p, "1")


def test_unsigned_order_and_rounding(spark):
    df = spark.createDataFrame([(1,), (-1,), (5,)], "a long").orderBy(hashing.unsigned_order(F.col("a")))
    assert [r.a for r in df.collect()] == [1, 5, -1]
    assert spark.range(1).select(hashing.quantize(F.lit(1.0000005))).first()[0] == 1000001


def test_scores(spark):
    a, b, e = F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3), F.lit(4)), F.array().cast("array<int>")
    r = spark.range(1).select(scores.jaccard(a, b), scores.jaccard(e, e), scores.jaccard(a, e), scores.relative_agreement(F.lit(3), F.lit(4)), scores.relative_agreement(F.lit(0), F.lit(0))).first()
    assert list(r) == [0.25, 1.0, 0.0, 0.75, 1.0]
    c = lambda n: F.lit(n)
    r = spark.range(1).select(scores.pair_similarity(c(10), c(10), c(10), c(0), c(9), c(9), F.lit(False)), scores.pair_similarity(c(4), c(4), c(0), c(4), c(3), c(3), F.lit(False)), scores.pair_similarity(c(0), c(0), c(0), c(0), c(0), c(0), F.lit(True))).first()
    assert r[0] == 0.999 and math.isclose(r[1], 0.6) and r[2] == 1.0


def test_text(spark):
    rows = [("a.so.exe", "", "/x/y.bin", 'q"<&>\n\x01'), ("b.txt", "n", "", "plain")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    c = F.col
    got = df.select(text.normalized_name(c("a")), text.display_name(c("b"), c("c")), text.diff_name(c("a"), c("c")), text.html_escape(c("d")), text.json_escape(c("d")), text.subtitle(c("a"), c("b"), F.lit("t"))).collect()
    assert list(got[0]) == ["a", "y.bin", "a-vs-/x/y", "q&quot;&lt;&amp;&gt;\n\x01", 'q\\"<&>\\n\\u0001', "a.so.exe · t"]
    assert list(got[1]) == ["b.txt", "n", "b.txt-vs-", "plain", "plain", "b.txt → n · t"]
    r = spark.range(1).select(text.hex_address(F.lit(0)), text.hex_address(F.lit(255)), text.display_status(F.lit("matched"), F.lit(0.999)), text.display_status(F.lit("matched"), F.lit(0.5)), text.legacy_status(F.lit("changed")), text.score_text(F.lit("added"), F.lit(1.0)), text.score_text(F.lit("changed"), F.lit(0.456))).first()
    assert list(r) == ["", "0xff", "identical", "changed", "matched", "—", "0.46"]
