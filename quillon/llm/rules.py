"""Quality rules: robust multivariate outliers per language and source.

Every text becomes a vector of transformed statistics (DIMENSIONS). For each (language, source) the
minimum covariance determinant is sought by deterministic starts (quartile ranges, a round scatter,
and the scatters of squashed coordinates and of spatial signs) and concentration steps: take the
distances under the present centre and scatter, keep the (n + P + 1) / 2 of n rows that are nearest,
and estimate anew from those. After FIRST_STEPS steps the start with the smallest determinant goes on
alone. A group keeps its estimate, and takes no more part, once a step no longer lowers the logarithm of
its determinant by more than TOLERANCE; the steps go on until that holds for every group, however many it
takes (each lowers a figure that FLOOR bounds from below). Determinants are those of the scatter plus a small
diagonal (FLOOR), so that a statistic that is constant in half of a group has a scale. A text whose
Mahalanobis distance under that estimate is too large is rejected. Fixed base rules reject first.

Equal vectors of a group count once in its estimate: copies of a text, however many, weigh no more
than one, so they cannot draw the estimate to themselves. All distinct vectors take part in every
step. Distances and coordinates are tallied in fixed bins, so a quantile
is a cumulative sum over one row per bin, and the moments of the nearest half are sums over the bins up to
that quantile: a step is one aggregation over the vectors. Moments are sums of whole numbers (coordinates are
quantized), so they come out alike however rows are spread over tasks. A hot source is combined on
the map side and never gathered. Only per-group estimates move, and they are broadcast only if there
are at most BROADCAST_GROUPS groups; beyond, a shuffled join with AQE's skew handling takes its place.

Groups with fewer than MIN_GROUP distinct vectors are pooled by language, and what is still too small
over all languages; a pool below MIN_GROUP rejects nothing beyond the base rules.

Defined results: a null or empty text has no words and fails the base rule; null languages and
sources are groups of their own; repeated rows are judged alike, each of them; empty tables give
empty results; extra columns, of any name, are left alone; texts have no length limit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Transformed statistics: logarithm of the mean word length; square roots of the shares of symbols, repeated lines, words in repeated windows, capitals, other marks, and words equal to the one before.
DIMENSIONS = ("length", "symbols", "lines", "repeats", "capitals", "marks", "stutter")
P = len(DIMENSIONS)
#: Steps of a coordinate's unit in the quantized vectors, and the least standard deviation of each coordinate, so that a statistic that is 0 nearly everywhere still has a scale.
STEPS = 512
FLOOR = (0.06, 0.05, 0.30, 0.30, 0.06, 0.06, 0.06)
#: Concentration steps of all starts, and the least fall of a determinant's logarithm for which the one that goes on takes another step.
FIRST_STEPS, TOLERANCE = 2, 1e-6
#: Least group, and the largest squared distance that is kept (in units in which the median text of a group has the chi-square median). Text statistics have longer tails than a normal distribution: 60 is far beyond its 0.999 quantile of 24.3, so that clean texts stay.
MIN_GROUP, CUTOFF = 60, 60.0
CHI2_MEDIAN = 6.346  # for 7 dimensions
#: A statistic of few words is noisy: squared distances are divided by 1 + NOISE / words.
NOISE = 30.0
BROADCAST_GROUPS = 50_000
#: Bins of a squared distance per doubling.
BINS = 256
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
VECTOR = ", ".join(f"q{i} long" for i in range(P))


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that are in a window of `size` words which occurs twice or more."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    twice: set[int] = set()
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            twice |= {i, j}
    n, end = 0, 0
    for i in sorted(twice):
        n += i + size - max(i, end)
        end = i + size
    return n


def statistics(text: str) -> tuple[int, ...]:
    """The five counts of the base rules, then the quantized vector."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    if not n:
        return (0,) * (5 + P)
    low = text.lower()
    capitals = sum(a != b for a, b in zip(text, low, strict=False)) if len(low) == len(text) and low != text else 0
    marks = sum(map(text.count, "!?.,;:-_=+~^@/\\\"'()[]{}"))
    share = lambda a, b: round(math.sqrt(a / b) * STEPS) if b else 0
    return n, chars, symbols, dup, repeat, round(math.log(chars / n) * STEPS), share(symbols, chars), share(dup, len(lines)), share(repeat, n), share(capitals, chars), share(marks, chars), share(sum(map(eq, words, words[1:])), n)


def _with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The statistics of a column text, or of the field text of a column all, which is then kept."""
    names = [f.split(" ")[0] for f in f"{STATS}, {VECTOR}".split(", ")]
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), 1024):
            part = batch.slice(at, 1024)
            whole = "all" in part.schema.names
            found = part.column("all").flatten()[part.schema.field("all").type.get_field_index("text")] if whole else part.column("text")
            rows = [statistics(t or "") for t in found.to_pylist()]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5 + P)]
            keep = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), *cols], [*keep, *names])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts and the quantized vector of every row."""
    src = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("\0")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source"), "text")
    return map_arrow(src, _with_statistics, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, source string, {STATS}, {VECTOR}")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _attached(rows: DataFrame, groups: DataFrame, on: list[str], n_groups: int) -> DataFrame:
    """rows joined with one row per group: by broadcast if the groups' number allows it."""
    return rows.join(F.broadcast(groups) if n_groups <= BROADCAST_GROUPS else groups, on, "left")


def grouped(rows: DataFrame) -> tuple[DataFrame, int]:
    """The pool (lang, source -> g) of every group, and the number of groups."""
    sizes = rows.groupBy("lang", "source").count()  # of distinct vectors
    own = F.col("count") >= MIN_GROUP
    by_lang = F.sum(F.when(~own, F.col("count")).otherwise(0)).over(Window.partitionBy("lang"))
    pool = (
        sizes.withColumn("rest", by_lang)
        .withColumn("g", F.when(own, F.concat_ws("\x1f", F.lit("s"), "lang", "source")).when(F.col("rest") >= MIN_GROUP, F.concat_ws("\x1f", F.lit("l"), "lang")).otherwise("all"))
        .select("lang", "source", "g")
    )
    pool = written(pool, "pools")
    return pool, pool.count()


def _quantiles(rows: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """Per group, `quantiles`: for each coordinate the quantized values at the shares."""
    tall = rows.select("g", F.posexplode(F.array(*(F.col(f"q{i}") for i in range(P)))).alias("i", "q")).groupBy("g", "i", "q").agg(F.count("*").alias("c"))
    w = Window.partitionBy("g", "i")
    ranked = tall.withColumns({"upto": F.sum("c").over(w.orderBy("q")), "n": F.sum("c").over(w)})
    at = ranked.groupBy("g", "i").agg(F.first("n").alias("n"), *(F.min(F.when(F.col("upto") >= F.col("n") * s, F.col("q"))).alias(f"at{k}") for k, s in enumerate(shares)))
    return at.groupBy("g").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", F.array(*(f"at{k}" for k in range(len(shares))))))), lambda x: x["col2"]).alias("quantiles"))


PARAMS = "g string, start int, n long, centre array<double>, inverse array<double>, logdet double, middle int, moves boolean"


def _solved(n: float, mean: np.ndarray, cov: np.ndarray) -> tuple[list[float], list[float], float]:
    cov = (cov + cov.T) / 2 + np.diag(np.square(FLOOR))
    return mean.tolist(), np.linalg.inv(cov)[np.triu_indices(P)].tolist(), float(np.linalg.slogdet(cov)[1])


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
UPPER = np.triu_indices(P)
#: Steps of a unit in squashed coordinates and signs.
FINE = 1024


def _moments(names: list[str], values: list[Column]) -> list[Column]:
    """Sums of whole-number values and of their products, under the names with _i and _i_j."""
    return [F.sum(v).alias(n) for n, v in zip(names, values, strict=True)] + [F.sum(values[i] * values[j]).alias(f"{names[i]}_{names[j]}") for i, j in PAIRS]


def _scatter(row: dict, name: str, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scatter from the sums of `m` rows."""
    mean = np.array([row[f"{name}{i}"] for i in range(P)], float) / row["m"] / unit
    second = np.zeros((P, P))
    second[UPPER] = [row[f"{name}{i}_{name}{j}"] / row["m"] / unit**2 for i, j in PAIRS]
    second += np.triu(second, 1).T
    return mean, second - np.outer(mean, mean)


def _squashed(rows: DataFrame, quantiles: DataFrame, n_groups: int) -> DataFrame:
    """Per group, the sums of tanh (t) and of spatial signs (u) of coordinates that are centred and scaled by quartiles."""
    met = _attached(rows, quantiles, ["g"], n_groups)
    z = [(F.col(f"q{i}") - F.col("quantiles")[i][1]) / F.greatest((F.col("quantiles")[i][2] - F.col("quantiles")[i][0]) / 1.349, F.lit(FLOOR[i] * STEPS)) for i in range(P)]
    met = met.select("g", *(x.alias(f"z{i}") for i, x in enumerate(z)))
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0)))
    met = met.withColumn("length", F.when(length > 0, length).otherwise(1.0))
    fine = lambda x: F.round(x * FINE).cast("long")
    met = met.select("g", *(fine(F.tanh(f"z{i}")).alias(f"t{i}") for i in range(P)), *(fine(F.col(f"z{i}") / F.col("length")).alias(f"u{i}") for i in range(P)))
    sums = [c for k in "tu" for c in _moments([f"{k}{i}" for i in range(P)], [F.col(f"{k}{i}") for i in range(P)])]
    return quantiles.join(met.groupBy("g").agg(F.count("*").alias("m"), *sums), "g")


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All from the medians. 0: quartile ranges. 1: a wide round scatter, which ranks rows by plain distance. 2, 3: correlations of squashed coordinates, and of spatial signs."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            q = np.array(r["quantiles"], float) / STEPS
            spread = (q[:, 2] - q[:, 0]) / 1.349
            scale = np.maximum(spread, FLOOR)
            tanh = _scatter(r, "t", FINE)[1]
            size = np.sqrt(np.maximum(np.diag(tanh), 1e-9))
            mean, signs = _scatter(r, "u", FINE)
            for start, cov in enumerate((np.diag(spread**2), np.eye(P) * max(float((spread**2).mean()), 0.01), tanh / np.outer(size, size) * np.outer(scale, scale), P * (signs + np.outer(mean, mean)) * np.outer(scale, scale))):
                centre, inverse, logdet = _solved(r["n"], q[:, 1], cov)
                out.append({"g": r["g"], "start": start, "n": r["n"], "centre": centre, "inverse": inverse, "logdet": logdet, "middle": None, "moves": True})
        yield pa.RecordBatch.from_pylist(out, PARAM_TYPE)


PARAM_TYPE = pa.schema([("g", pa.string()), ("start", pa.int32()), ("n", pa.int64()), ("centre", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64())), ("logdet", pa.float64()), ("middle", pa.int32()), ("moves", pa.bool_())])


def _estimated(falling: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The estimate from the nearest half's sums. If `falling`, only one that lowers the determinant is taken; else the old one stays for good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                old = {k: r[k] for k in PARAM_TYPE.names} | {"moves": False}
                if r["moves"]:
                    centre, inverse, logdet = _solved(r["n"], *_scatter(r, "q", STEPS))
                    taken = not falling or logdet < r["logdet"] - TOLERANCE
                    old = old | {"centre": centre, "inverse": inverse, "logdet": logdet, "moves": True} if taken else old
                out.append(old)
            yield pa.RecordBatch.from_pylist(out, PARAM_TYPE)

    return run


def distance2() -> Column:
    """Squared Mahalanobis distance of the vector under the row's estimate."""
    d = [F.col(f"q{i}") / F.lit(float(STEPS)) - F.col("centre")[i] for i in range(P)]
    terms, k = [], 0
    for i in range(P):
        for j in range(i, P):
            terms.append(d[i] * d[j] * F.col("inverse")[k] * F.lit(1.0 if i == j else 2.0))
            k += 1
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 2.0**-20) * BINS).cast("int")


def _halves(rows: DataFrame, params: DataFrame, n_groups: int) -> DataFrame:
    """Per group and start, the sums of the nearest (n + P + 1) / 2 of the n rows or, to the bin, a few more, and the bin of the middle row (now)."""
    moving = params.where("moves").select("g", "start", "centre", "inverse")
    far = rows.join(F.broadcast(moving) if n_groups <= BROADCAST_GROUPS else moving, "g").withColumn("bin", _bin(distance2()))
    sums = _moments([f"q{i}" for i in range(P)], [F.col(f"q{i}") for i in range(P)])
    bins = far.groupBy("g", "start", "bin").agg(F.count("*").alias("m"), *sums)
    w = Window.partitionBy("g", "start")
    ranked = bins.withColumns({"upto": F.sum("m").over(w.orderBy("bin")), "all": F.sum("m").over(w)})
    near = ranked.where(2 * (F.col("upto") - F.col("m")) < F.least(F.col("all") + P + 1, 2 * F.col("all")))
    return near.groupBy("g", "start").agg(F.min(F.when(2 * F.col("upto") >= F.col("all"), F.col("bin"))).alias("now"), *(F.sum(c).alias(c) for c in bins.columns[3:]))


def estimates(rows: DataFrame, n_groups: int) -> DataFrame:
    """One row per group: centre, inverse scatter (upper triangle) and scale, by minimum covariance determinant. rows: g and the vector."""
    quantiles = written(_quantiles(rows, (0.25, 0.5, 0.75)), "quantiles")
    params = written(map_arrow(_squashed(rows, quantiles, n_groups), _starts, PARAMS), "start")

    def step(params: DataFrame, falling: bool) -> DataFrame:
        met = params.join(_halves(rows, params, n_groups), ["g", "start"], "left").withColumn("middle", F.coalesce("now", "middle"))
        return written(map_arrow(met, _estimated(falling), PARAMS), "step")

    for _ in range(FIRST_STEPS):
        params = step(params, falling=False)
    rest = [c for c in params.columns if c not in ("g", "logdet", "start")]
    best = params.groupBy("g").agg(F.min(F.struct("logdet", "start", *rest)).alias("b")).select("g", *(f"b.{c}" for c in params.columns[1:]))
    best = step(best, falling=True)
    while not best.where("moves").isEmpty():
        best = step(best, falling=True)
    # The last step of a group has found its middle distance under the estimate that stayed. The floor keeps a group whose texts are all alike from getting a scale of nearly nothing.
    median2 = F.pow(F.lit(2.0), (F.col("middle") + 1) / F.lit(float(BINS)))
    return best.select("g", "n", "centre", "inverse", F.greatest(median2 / CHI2_MEDIAN, F.lit(0.25)).alias("scale"))


def fitted(rows: DataFrame) -> tuple[DataFrame, int]:
    """(lang, source) with its pool's estimate, and the number of those rows. rows: the measured table."""
    vector = [f"q{i}" for i in range(P)]
    once = written(rows.select("lang", "source", *vector).distinct(), "vectors")
    pool, n = grouped(once)
    est = estimates(written(_attached(once, pool, ["lang", "source"], n).select("g", *vector).distinct(), "pooled"), n)
    return written(pool.join(est, "g", "left"), "fitted"), n


def judged(rows: DataFrame, fit: DataFrame, n_groups: int, cutoff: float = CUTOFF) -> DataFrame:
    """rows with base_failed, distance2 (null without an estimate) and kept."""
    met = _attached(rows, fit, ["lang", "source"], n_groups)
    d2 = F.when(F.col("n") >= MIN_GROUP, distance2() / F.col("scale") / (1 + NOISE / F.greatest(F.col("n_words"), F.lit(1))))
    return met.withColumns({"base_failed": base_failed(), "distance2": d2}).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= cutoff))


def quality(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the counts, base_failed, distance2 and kept of every row of docs (doc_id, text, lang, source)."""
    rows = written(measured(docs), "statistics")
    fit, n = fitted(rows)
    return judged(rows, fit, n, cutoff).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs that pass, with their own columns. Texts are measured once and written beside their statistics."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all"))
    rows = map_arrow(whole, _with_statistics, f"all {whole.schema[0].dataType.simpleString()}, {STATS}, {VECTOR}")
    group = lambda c: F.coalesce(F.col(f"all.{c}").cast("string"), F.lit("\0")).alias(c)
    rows = written(rows.select("all", group("lang"), group("source"), *(c.name for c in rows.schema[1:])), "statistics")
    fit, n = fitted(rows)
    return judged(rows, fit, n, cutoff).where("kept").select("all.*")
