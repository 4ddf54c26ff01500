"""Wrapping 64-bit arithmetic and fingerprints as column expressions.

A bigint holds the 64 bits of an unsigned value. ANSI mode raises on overflow, so sums and products
are made from 32-bit halves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a (64 bits) and of the hash combination; signed where over 2^63.
FNV_SEED = -3750763034362895579  # 0xcbf29ce484222325
FNV_LOW = 0x1B3  # the prime is 2^40 + 0x1b3
GOLDEN = -7046029254386353131  # 0x9e3779b97f4a7c15
COMBINE_SEED = 2611923443488327891  # 0x243f6a8885a308d3
PRIME_MODULUS = "18446744073709551557"  # 2^64 - 59
MASK32 = 0xFFFFFFFF


def wrapping_add(a: Column, b: Column) -> Column:
    low = a.bitwiseAND(F.lit(MASK32)) + b.bitwiseAND(F.lit(MASK32))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high.bitwiseAND(F.lit(MASK32)), 32).bitwiseOR(low.bitwiseAND(F.lit(MASK32)))


def byte_values(data: Column) -> Column:
    """The bytes of a binary column as an array of numbers."""
    code = F.hex(data)
    at = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(code, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))


def fnv_step(h: Column, byte: Column) -> Column:
    y = h.bitwiseXOR(byte)
    low = y.bitwiseAND(F.lit(MASK32))
    a = low * FNV_LOW
    high = (low * 256 + F.shiftrightunsigned(y, 32) * FNV_LOW + F.shiftrightunsigned(a, 32)).bitwiseAND(F.lit(MASK32))
    return F.shiftleft(high, 32).bitwiseOR(a.bitwiseAND(F.lit(MASK32)))


def fnv1a(data: Column, seed: Column | None = None) -> Column:
    """FNV-1a of a binary column; chaining is done by passing a hash as the seed."""
    return F.aggregate(byte_values(data), F.lit(FNV_SEED) if seed is None else seed, fnv_step)


def fnv1a_text(text: Column, seed: Column | None = None) -> Column:
    return fnv1a(F.encode(text, "UTF-8"), seed)


def hash_combine(h: Column, v: Column) -> Column:
    return h.bitwiseXOR(wrapping_add(wrapping_add(wrapping_add(v, F.lit(GOLDEN)), F.shiftleft(h, 6)), F.shiftrightunsigned(h, 2)))


def combined(values: Column) -> Column:
    """hash_combine folded over an array; two arrays that are folded after each other have no separator."""
    return F.aggregate(values, F.lit(COMBINE_SEED), hash_combine)


def prime_product(primes: Column) -> Column:
    """Product of an array of small primes modulo 2^64 - 59; a product of 0 counts as 1."""
    one, modulus = F.lit("1").cast("decimal(38,0)"), F.lit(PRIME_MODULUS).cast("decimal(38,0)")
    # Small primes are multiplied as 64-bit numbers for as long as they fit; decimals take what that gives.
    state = lambda p, b: F.struct(p.alias("p"), b.alias("b"))
    whole = lambda s: ((s["p"] * s["b"].cast("decimal(18,0)")) % modulus).cast("decimal(38,0)")
    step = lambda s, x: F.when(s["b"] < F.lit(10**17) / x, state(s["p"], s["b"] * x)).otherwise(state(whole(s), x))
    return F.aggregate(F.transform(primes, lambda x: x.cast("long")), state(one, F.lit(1).cast("long")), step, lambda s: F.when(whole(s) == 0, one).otherwise(whole(s)))


def unsigned(h: Column) -> Column:
    """Decimal text of the unsigned value."""
    wide = h.cast("decimal(20,0)")
    return F.when(h < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)").cast("string")


def unsigned_order(address: Column) -> Column:
    """A key that sorts addresses as unsigned numbers."""
    return address.bitwiseXOR(F.lit(-9223372036854775808))


def text_key(text: Column) -> Column:
    """Equality key of a text or binary column: matching uses nothing but equality."""
    return F.md5(text.cast("binary"))


def quantize(value: Column) -> Column:
    return F.round(value * 1e6).cast("long")
