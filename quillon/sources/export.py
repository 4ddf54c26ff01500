"""Reports of one diff: JSON and HTML."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import display_status, hex_address, html_escape
from quillon.operators.assembly import STATUSES
from quillon.operators.presentation import grid


def json_rows(entries: DataFrame) -> DataFrame:
    """A JSON object for each row; addresses are hexadecimal texts, the status is the shown one. Blocks are not written."""
    c = F.col
    shown = F.struct(
        "name", display_status(c("status"), c("similarity")).alias("status"), "similarity", "confidence", "algorithm",
        hex_address(c("left_addr")).alias("leftAddr"), hex_address(c("right_addr")).alias("rightAddr"),
        F.struct(*(c(f"bb_{s}").alias(s) for s in STATUSES)).alias("bb"),
    )
    return entries.select("diff_id", "name", "left_addr", "right_addr", F.to_json(shown).alias("json"))


def _counts(entries: DataFrame) -> dict[str, int]:
    status = display_status(F.col("status"), F.col("similarity"))
    return entries.select(*(F.count_if(status == s).alias(s) for s in STATUSES)).first().asDict()


def export_json(entries: DataFrame, path: str, left: str, right: str, timestamp: str) -> None:
    """One file for one diff: header, counts and rows. Rows come to the driver a partition at a time."""
    import json

    head = {"left": left, "right": right, "timestamp": timestamp, "summary": _counts(entries)}
    rows = json_rows(entries).orderBy("name", "left_addr", "right_addr").select("json").toLocalIterator()
    with Path(path).open("w", encoding="utf-8") as f:
        f.write(json.dumps(head, ensure_ascii=False)[:-1] + ', "functions": [')
        for i, r in enumerate(rows):
            f.write(("," if i else "") + "\n" + r[0])
        f.write("\n]}\n")


COLUMNS = (("status", "Status"), ("name", "Unit"), ("similarity", "Similarity"), ("confidence", "Confidence"), ("algorithm", "Algorithm"), ("left_addr", "Left"), ("right_addr", "Right"), ("blocks", "Blocks =/~/+/-"))


def html_rows(entries: DataFrame) -> DataFrame:
    """A table row for each entry."""
    shown = grid(entries.withColumn("status", display_status(F.col("status"), F.col("similarity"))))
    cells = [F.concat(F.lit("<td>"), html_escape(F.col(c)), F.lit("</td>")) for c, _ in COLUMNS]
    return shown.select("diff_id", "name", "status", F.concat(F.lit('<tr class="'), F.col("status"), F.lit('">'), *cells, F.lit("</tr>")).alias("html"))


def export_html(entries: DataFrame, path: str, left: str, right: str, timestamp: str) -> None:
    spark = entries.sparkSession
    a, b, t = spark.range(1).select(*(html_escape(F.lit(x)) for x in (left, right, timestamp))).first()
    counts = " ".join(f'<b class="{s}">{n} {s}</b>' for s, n in _counts(entries).items())
    with Path(path).open("w", encoding="utf-8") as f:
        f.write(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{a} vs {b}</title></head><body>\n')
        f.write(f"<h1>{a} &rarr; {b}</h1><p>{t}</p><p>{counts}</p>\n<table><tr>{''.join(f'<th>{h}</th>' for _, h in COLUMNS)}</tr>\n")
        for r in html_rows(entries).orderBy("status", "name").select("html").toLocalIterator():
            f.write(r[0] + "\n")
        f.write("</table></body></html>\n")


def export(entries: DataFrame, path: str, left: str = "", right: str = "", timestamp: str = "") -> str:
    """Writes HTML if the path ends so, else JSON (the ending is added if there is none); returns the path."""
    if not path.endswith((".html", ".htm", ".json")):
        path += ".json"
    (export_json if path.endswith(".json") else export_html)(entries, path, left, right, timestamp)
    return path
