"""Corpora made from relational tables, in the engine's input form.

units:  diff_id, side (L or R), addr, name
blocks: diff_id, side, func_addr, block_addr, bytes
tokens: diff_id, side, func_addr, block_addr, line_no, tok_no, tok_type, text
edges:  diff_id, side, func_addr, src_block, dst_block (null: unknown target)
calls:  diff_id, side, caller, site, callee (null: unresolved)
refs:   diff_id, side, func_addr, kind (const or string), value, bytes
ast:    diff_id, side, func_addr, seq, op
packed: a row for each unit (diff_id, side, addr, name) with what the tables above hold of it, where a source can make
        that in one go: blocks in address order (block_addr, bytes, in_degree, out_degree, instr_count, mnemonic_sig),
        links between known blocks (src, dst: places in the array, and the degrees of both ends), nodes, edges, instr_count, calls (sites),
        ops and ast in order, bytes and skeleton (bytes and mnemonic_sig of all blocks, one after the other), constants, strings, and the text
        (words between spaces and newlines). Features are then computed inside the row; else they are aggregated from the tables.
lines:  a row for each block (diff_id, side, func_addr, block_addr) with its tokens, where a source can make that in one go: lines
        (line_no, tokens in order), of which each token has tok_type and text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = ["diff_id", "side", "func_addr"]
BLOCK = [*UNIT, "block_addr"]


@dataclass
class Corpus:
    units: DataFrame
    blocks: DataFrame
    tokens: DataFrame
    edges: DataFrame
    calls: DataFrame
    refs: DataFrame | None = None
    ast: DataFrame | None = None
    packed: DataFrame | None = None
    lines: DataFrame | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores; a table that a scan splits into so many stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of the documents: one diff for each language. By the last digit of the id a document
    is dropped from a side (0, 9), renamed (1), appended to (2), reversed by lines (3) or given another number (4)."""
    docs = spread(table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("?")).alias("diff_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text")))
    d, text = F.col("doc_id") % 10, F.col("text")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    changed = (
        F.when(d == 2, F.concat(text, F.lit("\nappended tail line")))
        .when(d == 3, F.array_join(F.reverse(F.split(text, "\n")), "\n"))
        .when(d == 4, F.concat(text, F.lit(" #2")))
        .otherwise(text)
    )
    of = lambda side, name, text: F.struct(F.lit(side).alias("side"), name.alias("name"), text.alias("text"))
    left = F.when(~(d == 9), of("L", name, F.when(d == 4, F.concat(text, F.lit(" #1"))).otherwise(text)))
    right = F.when(~(d == 0), of("R", F.when(d == 1, F.concat(F.lit("ren_"), F.col("doc_id").cast("string"))).otherwise(name), changed))
    # Both sides come out of one scan; explode_outer, since a filter inferred from explode would compute the texts twice.
    both = docs.select("diff_id", (F.col("doc_id") + 1).alias("addr"), F.explode_outer(F.array(left, right)).alias("u")).where("u.side is not null")
    return both.select("diff_id", "u.side", "addr", "u.name", "u.text")


def long_constant(digits: Column) -> Column:
    """A number of at most 18 digits as it is; a longer one stands for itself by 60 bits of its hash."""
    return F.when(F.length(digits) <= 18, digits.try_cast("long")).otherwise(F.conv(F.substring(F.md5(digits.cast("binary")), 1, 15), 16, 10).cast("long"))


def document_packed(units: DataFrame) -> DataFrame:
    """A row for each document unit with all that its features need, by functions on the row; what the whole text tells is not
    put together from its words."""
    number = lambda w: w.rlike("^#?[0-9]+$")
    rows = units.withColumn("lines", F.split("text", "\n"))
    rows = rows.withColumn("words", F.transform("lines", lambda line: F.filter(F.split(line, " "), lambda w: w != "")))
    shown = lambda ws: F.when(F.size(ws) == 0, "").otherwise(F.concat(F.array_join(F.transform(ws, lambda w: F.when(number(w), "").otherwise(F.concat(w, F.lit(" ")))), "\n"), F.lit("\n")))
    block = lambda line, ws: F.struct(F.encode(line, "UTF-8").alias("bytes"), F.size(ws).cast("long").alias("instr_count"), shown(ws).alias("mnemonic_sig"))
    rows = rows.withColumns({"n": F.size("lines"), "flat": F.flatten("words"), "blocks": F.zip_with("lines", "words", block)})
    rows = rows.withColumns({"ops": F.filter("flat", lambda w: ~number(w)), "at": F.sequence(F.lit(1), F.col("n")), "constants": F.transform(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), long_constant)})
    one = lambda when: F.when(when, 1).otherwise(0).cast("long")
    # A function of array elements must not refer to another column: Spark may put that column's expression in its place, for every element.
    near = F.transform("at", lambda i: F.struct(i.cast("long").alias("i"), one(i > 1).alias("in")))
    rows = rows.withColumn("near", F.zip_with(near, F.reverse("at"), lambda x, rest: x.withField("out", one(rest > 1))))
    placed = lambda b, x: F.struct(x["i"].alias("block_addr"), b["bytes"].alias("bytes"), x["in"].alias("in_degree"), x["out"].alias("out_degree"), b["instr_count"].alias("instr_count"), b["mnemonic_sig"].alias("mnemonic_sig"))
    link = lambda a, b: F.struct(a["i"].alias("src"), b["i"].alias("dst"), *(x[d].alias(f"{d}_{end}") for x, end in ((a, "src"), (b, "dst")) for d in ("in", "out")))
    links = F.zip_with(F.slice("near", 1, F.col("n") - 1), F.slice("near", 2, F.col("n") - 1), link)
    # Words with a space and a newline behind each. A number may end in what Java takes for the end of a line.
    rows = rows.withColumn("trimmed", F.trim("text", F.lit(" \n")))
    rows = rows.withColumn("listed", F.when(F.col("trimmed") == "", "").otherwise(F.concat(F.regexp_replace("trimmed", "[ \n]+", " \n"), F.lit(" \n"))))
    times = lambda text, part: F.floor((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")
    return rows.select(
        "diff_id", "side", "addr", "name", F.zip_with("blocks", "near", placed).alias("blocks"), links.alias("links"),
        (times(F.col("text"), "\n") + 1).alias("nodes"), times(F.col("text"), "\n").alias("edges"), times(F.col("listed"), "\n").alias("instr_count"), times(F.col("listed"), ". \n").alias("calls"),
        "ops", F.transform("ops", lambda w: F.length(w)).alias("ast"),
        F.encode(F.replace("text", F.lit("\n"), F.lit("")), "UTF-8").alias("bytes"), F.regexp_replace("listed", "(?<![^\n])#?[0-9]+[\r\u0085\u2028\u2029]? \n", "\n").alias("skeleton"),
        "constants", F.regexp_extract_all("text", F.lit("(?<![^ \n])[^ \n@]*+@[^ \n]*+"), F.lit(0)).alias("strings"), "text",
    )


def document_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Units are documents, blocks are lines, instructions are words; numbers are immediates. A word that ends a sentence is
    a call of the unit at half the address."""
    units = document_units(spark, sf_dir)
    key = [F.col("diff_id"), F.col("side"), F.col("addr").alias("func_addr")]
    blocks = units.select(*key, F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(*UNIT, (F.col("pos") + 1).cast("long").alias("block_addr"), F.encode("line", "UTF-8").alias("bytes"))
    words = blocks.select(*BLOCK, F.posexplode(F.filter(F.split(F.decode("bytes", "UTF-8"), " "), lambda w: w != "")).alias("line_no", "text"))
    tokens = words.select(*BLOCK, "line_no", F.lit(0).alias("tok_no"), F.when(F.col("text").rlike("^#?[0-9]+$"), "integer").otherwise("opcode").alias("tok_type"), "text")
    kind = lambda w: F.when(w.rlike("^#?[0-9]+$"), "integer").otherwise("opcode").alias("tok_type")
    one = lambda w, i: F.struct(i.cast("int").alias("line_no"), F.array(F.struct(kind(w), w.alias("text"))).alias("tokens"))
    lines = blocks.select(*BLOCK, F.transform(F.filter(F.split(F.decode("bytes", "UTF-8"), " "), lambda w: w != ""), one).alias("lines"))
    edges = units.select(*key, F.size(F.split("text", "\n")).alias("n")).where("n > 1").select(*UNIT, F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("i")).select(*UNIT, F.col("i").cast("long").alias("src_block"), (F.col("i") + 1).cast("long").alias("dst_block"))
    calls = tokens.where(F.col("text").endswith(".")).select("diff_id", "side", F.col("func_addr").alias("caller"), (F.col("block_addr") * 1_000_000 + F.col("line_no")).alias("site"), F.when(F.col("func_addr") > 1, F.expr("func_addr div 2")).alias("callee"))
    const = units.select(*key, F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("v")).select(*UNIT, F.lit("const").alias("kind"), long_constant(F.col("v")).alias("value"), F.lit(None).cast("binary").alias("bytes"))
    strings = tokens.where(F.col("text").contains("@")).select(*UNIT, F.lit("string").alias("kind"), F.lit(None).cast("long").alias("value"), F.encode("text", "UTF-8").alias("bytes"))
    ast = tokens.where("tok_type = 'opcode'").select(*UNIT, (F.col("block_addr") * 1_000_000 + F.col("line_no")).alias("seq"), F.length("text").alias("op"))
    return Corpus(units.drop("text"), blocks, tokens, edges, calls, const.unionByName(strings), ast, document_packed(units), lines)


def event_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Units are users, the two halves of their events are the sides; blocks are event types, edges the distinct transitions."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    ranked = events.withColumn("half", F.ntile(2).over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    e = ranked.select(F.lit("events").alias("diff_id"), F.when(F.col("half") == 1, "L").otherwise("R").alias("side"), (F.col("user_id") + 1).alias("func_addr"), "ts", "event_id", "event_type")
    code = F.crc32(F.encode("event_type", "UTF-8")) + 1
    e = e.withColumn("block_addr", code)
    units = e.select("diff_id", "side", F.col("func_addr").alias("addr")).distinct().withColumn("name", F.lit(None).cast("string"))
    step = F.lead("block_addr").over(Window.partitionBy(*UNIT).orderBy("ts", "event_id"))
    edges = e.select(*UNIT, F.col("block_addr").alias("src_block"), step.alias("dst_block")).where("dst_block is not null").distinct()
    blocks = e.select(*BLOCK, F.encode("event_type", "UTF-8").alias("bytes")).distinct()
    line = F.row_number().over(Window.partitionBy(*BLOCK).orderBy("ts", "event_id"))
    tokens = e.select(*BLOCK, line.alias("line_no"), F.lit(0).alias("tok_no"), F.lit("opcode").alias("tok_type"), F.col("event_type").alias("text"))
    calls = spark.createDataFrame([], "diff_id string, side string, caller long, site long, callee long")
    return Corpus(units, blocks, tokens, edges, calls)


#: Address ranges of the trade graph's customers, parts and suppliers.
PARTS, SUPPLIERS = 1_000_000_000_000, 2_000_000_000_000
#: Rows of the trade tables that a task sorts or keeps apart, about.
TASK_ROWS = 500_000


def trade_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call graph customer → part → supplier; orders with even keys are the left side, odd ones the right.

    Its rows are dealt out by the whole call, so repeats meet in one of as many partitions as the number of rows asks for.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    n, cores = items.count(), spark.sparkContext.defaultParallelism
    if n > cores * TASK_ROWS:  # else a share of it is small whatever it is joined by
        items, orders = (df.repartition(-(-n // TASK_ROWS), key) for df, key in ((items, "l_orderkey"), (orders, "o_orderkey")))
    lines = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    side = F.when(F.col("l_orderkey") % 2 == 0, "L").otherwise("R").alias("side")
    part, supplier, customer = F.col("l_partkey") + PARTS, F.col("l_suppkey") + SUPPLIERS, F.col("o_custkey") + 1
    buys = lines.select(F.lit("trade").alias("diff_id"), side, customer.alias("caller"), part.alias("callee"))
    made = lines.select(F.lit("trade").alias("diff_id"), side, part.alias("caller"), supplier.alias("callee"))
    return buys.union(made).repartition(max(cores, -(-2 * n // TASK_ROWS)), "diff_id", "side", "caller", "callee")


def conversation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a second workload: conversations are units, turns are blocks; the right side lacks every fifth turn."""
    turns = table(spark, sf_dir, "conversations").select(F.lit("talk").alias("diff_id"), (F.col("conv_id") + 1).alias("func_addr"), (F.col("turn") + 1).alias("block_addr"), F.coalesce("text", F.lit("")).alias("line"))
    return turns.withColumn("side", F.lit("L")).unionByName(turns.where("block_addr % 5 <> 0").withColumn("side", F.lit("R")))
