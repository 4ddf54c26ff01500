"""Unique-key matching and the ordered cascade of passes."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.storage import BROADCAST_ROWS, counted, saved, small


@dataclass(frozen=True)
class MatchPass:
    """A pass: units that are eligible are matched where all keys are equal and unique on both sides."""

    name: str
    confidence: float
    keys: tuple[str | Column, ...]
    eligible: str = "true"

    def columns(self) -> frozenset[str]:
        """The features that the pass uses."""
        return frozenset(k for k in self.keys if isinstance(k, str)) | frozenset(re.findall("[a-z_]+", self.eligible))


class Cancelled(Exception):
    """A progress callback returned False."""


Progress = Callable[[str, int, int], bool]
MATCHES = "diff_id string, left_addr long, right_addr long, confidence double, algorithm string"

#: Passes in execution order, which is not the order of confidence (fixed values).
PASSES = (
    MatchPass("bytehash", 1.00, ("byte_hash",)),
    MatchPass("normhash", 0.99, ("norm_hash",)),
    MatchPass("name+shape", 0.98, ("name", "nodes", "edges", "calls"), "name <> ''"),
    MatchPass("name", 0.92, ("name",), "name <> ''"),
    MatchPass("mdindex", 0.95, ("md_q",), "nodes >= 5"),
    MatchPass("mdindex+spp", 0.90, ("md_q", "spp"), "nodes >= 2"),
    MatchPass("pseudocode", 0.88, ("pseudo_hash",), "pseudo_hash is not null"),
    MatchPass("pseudoprimes", 0.85, ("pseudo_primes", "nodes"), "pseudo_primes > 1"),
    MatchPass("nec", 0.82, ("nodes", "edges", "calls"), "nodes >= 5"),
    MatchPass("spp", 0.80, ("spp",), "instr_count >= 8"),
    # constants and strings are joined without a separator, so that it does not matter which of the two a value is in
    MatchPass("constants+strings", 0.65, (F.concat, "constants", "string_hashes"), "size(constants) + size(string_hashes) >= 2"),
)
BY_NAME = {p.name: p for p in PASSES}


def _keys(p: MatchPass) -> list[Column]:
    if callable(p.keys[0]):
        return [p.keys[0](*p.keys[1:]).alias("k0")]
    return [F.col(k).alias(f"k{i}") if isinstance(k, str) else k.alias(f"k{i}") for i, k in enumerate(p.keys)]


def match_unique(units: DataFrame, p: MatchPass, within: tuple[str, ...] = ("diff_id",)) -> DataFrame:
    """Pairs of units whose key is there exactly once on each side of a diff. One aggregation does for both sides;
    it combines on the map side, so a key that very many units share is no burden."""
    keys = _keys(p)
    names = [f"k{i}" for i in range(len(keys))]
    rows = units.where(p.eligible).select(*within, "side", "addr", *keys).dropna(subset=names)
    left, right = F.col("side") == "L", F.col("side") == "R"
    met = rows.groupBy(*within, *names).agg(F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"), F.max(F.when(left, F.col("addr"))).alias("left_addr"), F.max(F.when(right, F.col("addr"))).alias("right_addr"))
    return met.where("n_left = 1 and n_right = 1").select(*within, "left_addr", "right_addr", F.lit(p.confidence).alias("confidence"), F.lit(p.name).alias("algorithm"))


def taken(matches: DataFrame) -> DataFrame:
    """diff_id, side, addr of all matched units."""
    return matches.select("diff_id", F.lit("L").alias("side"), F.col("left_addr").alias("addr")).union(matches.select("diff_id", F.lit("R").alias("side"), F.col("right_addr").alias("addr")))


def open_units(units: DataFrame, matches: DataFrame, side: Callable[[DataFrame], DataFrame] = small) -> DataFrame:
    """Units without a match. The matches are saved tables, which are broadcast only if they are counted to be small."""
    return units.join(side(taken(matches)), ["diff_id", "side", "addr"], "left_anti")


def keyed(units: DataFrame, passes: tuple[MatchPass, ...]) -> DataFrame:
    """diff_id, side, addr, and a struct k<i> of two hashes of the unit's key for each pass, null where it has none."""
    out = []
    for i, p in enumerate(passes):
        keys = _keys(p)
        whole = F.when(F.expr(p.eligible), F.lit(True))
        for k in keys:
            whole = F.when(k.isNotNull(), whole)
        out.append(F.when(whole, F.struct(F.xxhash64(F.lit(i), *keys).alias("a"), F.xxhash64(F.lit(~i), *keys).alias("b"))).alias(f"k{i}"))
    return units.select("diff_id", "side", "addr", *out)


def sides(rows: DataFrame, *by: str) -> DataFrame:
    """For each key the number of its members on each side and the xor of their addresses, which is the address of one."""
    on = lambda side: F.col("side") == side
    return rows.groupBy(*by).agg(*(c for s, n in (("L", "left"), ("R", "right")) for c in (F.count_if(on(s)).alias(f"n_{n}"), F.coalesce(F.bit_xor(F.when(on(s), F.col("addr"))), F.lit(0).cast("long")).alias(f"{n}_addr"))))


def cascade(units: DataFrame, passes: tuple[MatchPass, ...] = PASSES, progress: Progress | None = None) -> DataFrame:
    """Matches of all passes in turn; each pass sees only what is still unmatched.

    The keys of all passes are counted once, in one aggregation that combines on the map side; keys that are on one
    side only can never match and are left out. A pass subtracts from its counts the members that earlier passes have
    taken: number and xor of addresses, so that the one that is left is known without another look at the units. What
    a pass takes is looked up once for its later keys. So a pass moves its keys at most, never the units.
    """
    spark = units.sparkSession
    matches = spark.createDataFrame([], MATCHES)
    if len(passes) == 1:
        if progress and progress(passes[0].name, 0, 1) is False:
            raise Cancelled(passes[0].name)
        return saved(match_unique(units, passes[0]), "pass")
    keys = saved(keyed(units, passes), "keys")
    each = F.array(*(F.struct(F.lit(i).alias("pass"), F.col(f"k{i}").alias("k")) for i in range(len(passes))))
    entries = keys.select("diff_id", "side", "addr", F.explode(each).alias("e")).select("diff_id", "side", "addr", "e.pass", "e.k.a", "e.k.b").where("a is not null")
    counts = saved(sides(entries, "diff_id", "pass", "a", "b").where("n_left > 0 and n_right > 0"), "counts", "pass")
    gone: list[DataFrame] = []
    for i, p in enumerate(passes):
        if progress and progress(p.name, i, len(passes)) is False:
            raise Cancelled(p.name)
        own = counts.where(F.col("pass") == i).drop("pass")
        if gone:
            rows = gone[0]
            for g in gone[1:]:
                rows = rows.unionByName(g, allowMissingColumns=True)
            rows = rows.select("diff_id", "side", "addr", f"k{i}.a", f"k{i}.b").where("a is not null")
            less = sides(rows, "diff_id", "a", "b").withColumnsRenamed({c: f"{c}_gone" for c in ("n_left", "n_right", "left_addr", "right_addr")})
            zero = lambda c: F.coalesce(f"{c}_gone", F.lit(0).cast("long"))
            left = own.join(less, ["diff_id", "a", "b"], "left")
            own = left.select("diff_id", *((F.col(c) - zero(c)).alias(c) for c in ("n_left", "n_right")), *(F.col(c).bitwiseXOR(zero(c)).alias(c) for c in ("left_addr", "right_addr")))
        found = own.where("n_left = 1 and n_right = 1").select("diff_id", "left_addr", "right_addr", F.lit(p.confidence).alias("confidence"), F.lit(p.name).alias("algorithm"))
        found, n = counted(found, "pass")
        matches = found if not i else matches.unionByName(found)
        if n and i + 1 < len(passes):
            ends = taken(found)
            gone.append(saved(keys.join(F.broadcast(ends) if n <= BROADCAST_ROWS // 2 else ends.hint("merge"), ["diff_id", "side", "addr"]).drop(*(f"k{j}" for j in range(i + 1))), "taken"))
    return matches
