"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

All is column expressions inside a document's row: no shuffle, no Python. A text is cut at the matches of a
kind's expression; running sums of the lengths of its pieces and matches give the places in code points.
Expressions are possessive and begin only where a match can begin, so that they find what the plain
expressions of the contract find, leftmost and non-overlapping, in time linear in the text and without
recursion, in texts of any length.

Kinds, in the order of `spans`: email, ip, card, phone and then iban and ssn.

A confirmed span of the first four (the base) always stays. Other spans are proposals with a score: the
weight of their form, plus CHECKED for those with a checksum, which must hold, plus CONTEXT where a word that names the kind
stands within REACH characters before or AFTER behind it, minus CONTEXT where a word that names another
sort of number does (order, invoice, version). They are reported from THRESHOLD on:

- iban: two letters, two digits, 11 to 30 letters and digits, in groups or not, remainder 1 modulo 97;
- ssn: three, two and four digits with hyphens, no impossible group; never without a context word;
- card: numbers of 12 to 15 digits that pass Luhn; never without a context word;
- phone: seven to 15 digits in groups without a plus; never without a context word. An ip, card, iban,
  ssn or phone span is not reported as a phone a second time.

Defined results: a null text is empty; rows with equal ids, or none, are rows of their own; an empty table
gives an empty one; other columns are ignored, whatever their names; texts have no length limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

THRESHOLD, CHECKED, CONTEXT = 0.6, 0.4, 0.3
REACH, AFTER = 48, 16
#: Elements that running sums take in one go.
BLOCK = 128


@dataclass(frozen=True)
class Kind:
    """A sort of personal data. hint: a text without it has no match (it spares the expression)."""

    name: str
    pattern: str
    hint: str
    weight: float = 1.0
    words: str = ""


LOCAL = r"A-Za-z0-9._%+-"
#: The contract's four kinds.
EMAIL = Kind("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@")
IP = Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]")
CARD = Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", 0.1, r"card|credit|debit|visa|master|amex|karte|kredit|tarjeta|carte|\bcc\b")
PHONE = Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]")
#: What the method adds.
IBAN = Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "[A-Z][A-Z][0-9][0-9]", 0.4, r"iban|bank|konto|cuenta|compte|account|swift|\bbic\b")
SSN = Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9][0-9]-[0-9]", 0.35, r"\bssn\b|social|security|insurance|tax")
LOCAL_PHONE = Kind("phone", r"(?<![0-9+.(-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]{1,3}[0-9]{2,8}){1,5}+(?![0-9-])", r"[0-9][0-9][).\x20/-]", 0.35, r"\btel|phone|mobil|\bcell|\bcall\b|\bfax\b|handy|anruf|ruf|móvil|appel|portable")
#: Words of other sorts of numbers.
OTHER = r"order|invoice|version|serial|\bisbn\b|tracking|reference|rechnung|factura|facture"
ORDER = ("email", "ip", "card", "phone", "iban", "ssn")
SPAN = "struct<at:bigint,end:bigint>"


def _sums(start: Column, values: Column) -> Column:
    """start, and start plus each of the first elements but the last."""
    first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(values, first, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])


def with_running(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with a column of running sums (of all earlier elements) for each column of arrays of numbers.

    Blocks are summed first, so that the cost is near linear in the number of elements. What a function of array
    elements refers to is a column of its own, so that it is not computed again for each element.
    """
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def blocks(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / BLOCK).cast("int")), lambda b: F.slice(c, b * BLOCK + 1, F.lit(BLOCK)))

    none = F.array().cast("array<array<bigint>>")
    df = df.withColumns({f"{out}_b": F.when(F.size(c) > 0, blocks(c)).otherwise(none) for c, out in columns.items()})
    df = df.withColumns({f"{out}_s": _sums(F.lit(0).cast("long"), F.transform(f"{out}_b", total)) for out in columns.values()})
    df = df.withColumns({out: F.flatten(F.zip_with(f"{out}_s", f"{out}_b", _sums)) for out in columns.values()})
    return df.drop(*(f"{out}_{x}" for out in columns.values() for x in "bs"))


def with_proposals(df: DataFrame, kinds: dict[str, Kind]) -> DataFrame:
    """df (text) with `p_<name>` for each kind: its matches as structs of the match, what stands around it, and its place."""
    t, none = F.col("text"), F.array().cast("array<string>")
    there = {c: t.contains(k.hint) if k is EMAIL else t.rlike(k.hint) for c, k in kinds.items()}
    length = lambda s: F.char_length(s).cast("long")
    df = df.withColumns({f"hits_{c}": F.when(there[c], F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))).otherwise(none) for c, k in kinds.items()})
    df = df.withColumns({f"gaps_{c}": F.when(F.size(f"hits_{c}") > 0, F.split(t, k.pattern, -1)).otherwise(none) for c, k in kinds.items()})
    df = df.withColumns({f"steps_{c}": F.zip_with(f"gaps_{c}", f"hits_{c}", lambda g, h: length(g) + F.coalesce(length(h), F.lit(0).cast("long"))) for c in kinds})
    df = with_running(df, {f"steps_{c}": f"at_{c}" for c in kinds})
    around = lambda g, a: F.struct(F.right(g, F.lit(REACH)).alias("before"), F.left(g, F.lit(AFTER)).alias("after"), (a + length(g)).alias("at"))
    df = df.withColumns({f"around_{c}": F.zip_with(f"gaps_{c}", f"at_{c}", around) for c in kinds})
    placed = lambda h, w: F.struct(h.alias("hit"), w["before"].alias("before"), w["at"].alias("at"), (w["at"] + length(h)).alias("end"))
    whole = lambda p, w: p.withField("after", w["after"])
    df = df.withColumns({f"p_{c}": F.filter(F.zip_with(F.zip_with(f"hits_{c}", f"around_{c}", placed), F.slice(f"around_{c}", 2, F.size(f"around_{c}")), whole), lambda p: p["hit"].isNotNull()) for c in kinds})
    return df.drop(*(f"{x}_{c}" for x in ("hits", "gaps", "steps", "at", "around") for c in kinds))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Every second digit from the right, doubled, with its digits added, and the others sum up to a multiple of ten."""
    one = F.transform(F.reverse(F.split(number, "(?!^)(?!$)")), lambda c, i: F.when(i % 2 == 1, F.ascii(c) * 2 - 96).otherwise(F.ascii(c) - 48))
    return F.aggregate(one, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def mod97(code: Column) -> Column:
    """Remainder 1 modulo 97 of the code with its first four characters moved behind, letters counting from 10 on."""
    moved = F.concat(F.substring(code, F.lit(5), F.char_length(code)), F.substring(code, F.lit(1), F.lit(4)))
    step = lambda r, c: F.when(F.ascii(c) < 65, (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), step) == 1


def byte_parts(hit: Column) -> Column:
    """All four numbers are at most 255, however many zeros lead them."""
    return hit.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")


def score(p: Column, kind: Kind, checked: bool = False) -> Column:
    """The weight of the form, of the checksum that holds, and of words nearby."""
    near = lambda words: p["before"].rlike(f"(?i){words}") | p["after"].rlike(f"(?i){words}")
    return F.lit(kind.weight + CHECKED * checked) + F.when(near(kind.words), CONTEXT).otherwise(0.0) - F.when(near(OTHER), CONTEXT).otherwise(0.0)


def _places(found: Column) -> Column:
    return F.transform(found, lambda p: F.struct(p["at"].alias("at"), p["end"].alias("end")))


def _apart(found: Column, others: Column) -> Column:
    return F.filter(found, lambda p: ~F.exists(others, lambda o: (p["at"] < o["end"]) & (o["at"] < p["end"])))


def _between(n: Column, least: int, most: int) -> Column:
    return (n >= least) & (n <= most)


def spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with an array of places for each of `base_<kind>` and `more_<kind>`."""
    size = lambda p: F.length(digits(p["hit"]))
    df = with_proposals(docs.withColumn("text", F.coalesce("text", F.lit(""))), {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN, "local": LOCAL_PHONE})
    df = df.withColumns({
        "base_email": _places(F.col("p_email")),
        "base_ip": _places(F.filter("p_ip", lambda p: byte_parts(p["hit"]))),
        "base_card": _places(F.filter("p_card", lambda p: _between(size(p), 16, 19) & luhn(digits(p["hit"])))),
        "base_phone": _places(F.filter("p_phone", lambda p: _between(size(p), 8, 15))),
        "more_iban": _places(F.filter("p_iban", lambda p: mod97(F.replace(p["hit"], F.lit(" "), F.lit(""))) & (score(p, IBAN, True) >= THRESHOLD))),
        "more_ssn": _places(F.filter("p_ssn", lambda p: ~p["hit"].rlike("^(000|666|9)|-00-|0000$") & (score(p, SSN) >= THRESHOLD))),
        "more_card": _places(F.filter("p_card", lambda p: _between(size(p), 12, 15) & luhn(digits(p["hit"])) & (score(p, CARD, True) >= THRESHOLD))),
        "local": F.filter("p_local", lambda p: _between(size(p), 7, 15) & (score(p, LOCAL_PHONE) >= THRESHOLD)),
    })
    taken = F.concat("base_ip", "base_card", "base_phone", "more_iban", "more_ssn", "more_card")
    df = df.withColumn("more_phone", F.when(F.size("local") > 0, _apart(_places(F.col("local")), taken)).otherwise(F.array().cast(f"array<{SPAN}>")))
    none = F.array().cast(f"array<{SPAN}>")
    return df.withColumns({f"{of}_{k}": none for of in ("base", "more") for k in ORDER if f"{of}_{k}" not in df.columns})


def listed(*of: str) -> Column:
    """kind:start:end of the arrays, by kind and then by start, joined by commas."""

    def lines(kind: str) -> Column:
        places = F.col(f"{of[0]}_{kind}") if len(of) == 1 else F.array_sort(F.concat(*(F.col(f"{o}_{kind}") for o in of)))
        return F.transform(places, lambda p: F.concat_ws(":", F.lit(kind), p["at"].cast("string"), p["end"].cast("string")))

    return F.array_join(F.concat(*map(lines, ORDER)), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans, their digest, and all spans."""
    found = spans(id_text(docs))
    count = lambda k: F.size(f"base_{k}").cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in ORDER[:4]), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("base", "more").alias("spans"))
