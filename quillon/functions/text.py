"""Names, addresses, escapes and display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
#: Endings of corpus names that do not count (fixed values).
ENDINGS = ("bndb", "dylib", "so", "exe", "dll", "o", "bin")


def normalized_name(name: Column) -> Column:
    return F.regexp_replace(name, rf"(?i)(\.({'|'.join(ENDINGS)}))+$", "")


def display_name(name: Column, path: Column) -> Column:
    """The name, else the path's last part, else (none)."""
    given = lambda c: F.when(c != "", c)
    return F.coalesce(given(name), given(F.substring_index(path, "/", -1)), F.lit("(none)"))


def diff_name(left: Column, right: Column, fallback: str = "diff") -> Column:
    a, b = normalized_name(left), normalized_name(right)
    return F.when((F.coalesce(a, F.lit("")) == "") & (F.coalesce(b, F.lit("")) == ""), fallback).otherwise(F.concat(a, F.lit("-vs-"), b))


def raw_diff_name(left: Column, right: Column) -> Column:
    """The name of a diff that is saved from the list of diffs: both names as they are."""
    return F.concat(F.coalesce(left, F.lit("")), F.lit("-vs-"), F.coalesce(right, F.lit("")))


def hex_address(address: Column, none: str = "") -> Column:
    return F.when(F.coalesce(address, F.lit(0)) == 0, none).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(address))))


def display_status(status: Column, similarity: Column) -> Column:
    """The four statuses pass; any other is judged by the similarity."""
    return F.when(status.isin("added", "removed", "identical", "changed"), status).when(similarity >= 0.999, "identical").otherwise("changed")


def legacy_status(status: Column) -> Column:
    return F.when(status.isin("added", "removed"), status).otherwise("matched")


def score_text(status: Column, score: Column) -> Column:
    return F.when(status.isin("added", "removed"), DASH).otherwise(F.format_string("%.2f", score))


def entry_name(left: Column, right: Column) -> Column:
    return F.coalesce(F.when(left != "", left), right, F.lit(""))


def name_contains(name: Column, part: str) -> Column:
    """Case-insensitive; an empty part is in every name."""
    return F.lower(name).contains(part.lower())


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def json_escape(text: Column) -> Column:
    """The text as the inside of a JSON string, by Spark's own JSON writer."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(7), F.length(whole) - 8)


def timestamp_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def subtitle(left: Column, right: Column, stamp: Column) -> Column:
    """left → right · time, without what is empty."""
    pair = F.concat_ws(" → ", F.when(left != "", left), F.when(right != "", right))
    return F.concat_ws(" · ", F.when(pair != "", pair), F.when(stamp != "", stamp))
