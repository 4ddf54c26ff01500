"""Stored diffs: a row for each function in Parquet, and a catalog in insertion order.

A save writes its rows to a folder of its own and then publishes a new version of the catalog, which is a small file.
The version's name can be given once only, so of two writers one has to read the catalog again and retry; a save that is
killed before that leaves the catalog as it was. Names stand in the catalog only, never in a path.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from quillon.functions.text import subtitle
from quillon.operators.assembly import entries
from quillon.plans.storage import file_system, remove

SCHEMA = 2
BLOCK = "struct<l:bigint,r:bigint,s:string>"
#: Fields of a stored function, as a schema of rows and as the element of a document.
FIELDS = {
    "name": "string", "status": "string", "left_addr": "bigint", "right_addr": "bigint", "similarity": "double", "confidence": "double", "algorithm": "string",
    "bb_identical": "bigint", "bb_changed": "bigint", "bb_added": "bigint", "bb_removed": "bigint", "blocks": f"array<{BLOCK}>",
}
ROW = ", ".join(f"{c} {kind}" for c, kind in FIELDS.items())
#: Versions of the catalog that are kept.
KEPT = 20
CATALOG = "position long, name string, left string, right string, timestamp string"
#: Defaults of fields that an older document lacks.
DEFAULTS = {"similarity": 1.0, "confidence": 1.0, "algorithm": "", "bb_identical": 0, "bb_changed": 0, "bb_added": 0, "bb_removed": 0, "name": "", "status": "", "left_addr": 0, "right_addr": 0}


def function_rows(result: DataFrame, block_matches: DataFrame | None, *, old_status: bool = False) -> DataFrame:
    """diff_id and the fields of a stored function, with its own blocks."""
    rows = entries(result, old_status=old_status)
    key = ["diff_id", "left_addr", "right_addr"]
    if block_matches is None:
        return rows.withColumn("blocks", F.array().cast(f"array<{BLOCK}>"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    own = block_matches.groupBy("diff_id", zero("left_func").alias("left_addr"), zero("right_func").alias("right_addr")).agg(F.array_sort(F.collect_list(F.struct(zero("left_addr").alias("l"), zero("right_addr").alias("r"), F.col("status").alias("s")))).alias("blocks"))
    return rows.join(own, key, "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>")))


def documents(result: DataFrame, block_matches: DataFrame | None, left: str, right: str, timestamp: str, *, old_status: bool = False) -> DataFrame:
    """One nested document for each diff_id, as standalone files have it."""
    rows = function_rows(result, block_matches, old_status=old_status)
    packed = rows.groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("functions"))
    return packed.select("diff_id", F.lit(SCHEMA).alias("schema"), F.lit(left).alias("left"), F.lit(right).alias("right"), F.lit(timestamp).alias("timestamp"), "functions")


def field(raw: Column, name: str, kind: str) -> Column:
    """A field of a document in JSON: its default where it is missing or of another type."""
    value = F.get_json_object(raw, f"$.{name}")
    default = F.lit(DEFAULTS[name])
    if kind == "string":
        return F.coalesce(value, default.cast("string"))
    return F.coalesce(value.try_cast(kind), default.cast(kind))


def functions_of(raw: DataFrame) -> DataFrame:
    """Rows of documents in JSON text (name, document) of any version; guarded field by field, never an error."""
    one = raw.select("name", F.explode(F.from_json(F.get_json_object("document", "$.functions"), "array<string>")).alias("f"))
    kinds = {"name": "string", "status": "string", "algorithm": "string", "similarity": "double", "confidence": "double"}
    return one.select(F.col("name").alias("diff_id"), *(field(F.col("f"), c, kinds.get(c, "bigint")).alias(c) for c in ("name", "status", "left_addr", "right_addr", "similarity", "confidence", "algorithm", "bb_identical", "bb_changed", "bb_added", "bb_removed")))


class DiffStore:
    """Named diffs below a folder: rows in data/<id>, catalog versions in catalog/<number>.json."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[int]:
        fs, at = file_system(self.spark, f"{self.folder}/catalog")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self) -> tuple[int, list[dict]]:
        """The last version's number (0: none) and entries: one for each stored diff, in order."""
        last = max(self._versions(), default=0)
        if not last:
            return 0, []
        fs, at = file_system(self.spark, f"{self.folder}/catalog/{last}.json")
        stream = fs.open(at)
        try:
            return last, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, rows: list[dict]) -> bool:
        """Gives the version its entries; False if another writer has given it some already."""
        draft, final = f"{self.folder}/catalog/draft-{uuid.uuid4().hex}", f"{self.folder}/catalog/{version}.json"
        fs, at = file_system(self.spark, draft)
        stream = fs.create(at)
        stream.write(bytearray(json.dumps(rows).encode()))
        stream.close()
        try:
            if fs.getScheme() == "file":  # here a rename would replace what is there; a link does not
                local = lambda p: self.spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath()
                os.link(local(draft), local(final))
                return True
            return bool(fs.rename(at, file_system(self.spark, final)[1]))
        except (FileExistsError, Py4JJavaError) as e:
            if isinstance(e, Py4JJavaError) and "AlreadyExists" not in str(e):
                raise
            return False
        finally:
            remove(self.spark, draft)

    def _change(self, change: Callable[[list[dict]], list[dict]]) -> None:
        """Publishes what `change` makes of the last version, again and again until no other writer comes between."""
        while True:
            version, rows = self._read()
            if self._publish(version + 1, change(rows)):
                break
        for old in self._versions()[:-KEPT]:
            remove(self.spark, f"{self.folder}/catalog/{old}.json")

    def list(self) -> DataFrame:
        """The catalog in insertion order."""
        rows = [tuple(r[c] for c in ("position", "name", "left", "right", "timestamp")) for r in self._read()[1]]
        return self.spark.createDataFrame(rows, CATALOG).orderBy("position")

    def titles(self) -> DataFrame:
        c = F.col
        return self.list().select("position", "name", subtitle(c("left"), c("right"), c("timestamp")).alias("subtitle"))

    def save(self, name: str, rows: DataFrame, left: str = "", right: str = "", timestamp: str = "") -> None:
        """Stores function_rows under the name, in place of an older diff; the name keeps its place in the catalog."""
        path, replaced = f"data/{uuid.uuid4().hex}", []
        rows.select(*FIELDS).write.parquet(f"{self.folder}/{path}")

        def put(known: list[dict]) -> list[dict]:
            old = next((r for r in known if r["name"] == name), None)
            replaced[:] = [old["path"]] if old else []
            place = old["position"] if old else max((r["position"] for r in known), default=-1) + 1
            entry = {"position": place, "name": name, "left": left, "right": right, "timestamp": timestamp, "schema": SCHEMA, "path": path}
            return sorted([*(r for r in known if r["name"] != name), entry], key=lambda r: r["position"])

        self._change(put)
        for old in replaced:
            remove(self.spark, f"{self.folder}/{old}")

    def load(self, name: str) -> DataFrame | None:
        """The function rows of a diff; None if there is none of that name."""
        found = next((r for r in self._read()[1] if r["name"] == name), None)
        return self.spark.read.schema(ROW).parquet(f"{self.folder}/{found['path']}") if found else None

    def delete(self, name: str) -> bool:
        gone: list[dict] = []

        def drop(known: list[dict]) -> list[dict]:
            gone[:] = [r for r in known if r["name"] == name]
            return [r for r in known if r["name"] != name]

        if all(r["name"] != name for r in self._read()[1]):
            return False
        self._change(drop)
        for r in gone:
            remove(self.spark, f"{self.folder}/{r['path']}")
        return bool(gone)

    def clean(self) -> int:
        """Deletes rows that the catalog does not name: those of saves that were killed. Not for use beside a running save."""
        fs, at = file_system(self.spark, f"{self.folder}/data")
        named = {r["path"] for r in self._read()[1]}
        lost = [f"data/{x.getPath().getName()}" for x in (fs.listStatus(at) if fs.exists(at) else []) if f"data/{x.getPath().getName()}" not in named]
        for path in lost:
            remove(self.spark, f"{self.folder}/{path}")
        return len(lost)


class AlreadyThere(Exception):
    """A standalone file of that name exists."""


def save_file(document: DataFrame, path: str) -> None:
    """Writes one document as a file of its own; unlike the store it never overwrites."""
    try:
        document.select("schema", "left", "right", "timestamp", "functions").coalesce(1).write.mode("errorifexists").json(path)
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" in str(e):
            raise AlreadyThere(path) from e
        raise


def read_file(spark: SparkSession, path: str) -> dict | None:
    """The document of a standalone file; None if the file is no diff."""
    text = "\n".join(r[0] for r in spark.read.text(path).limit(2).collect())
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) and "functions" in found else None
