"""Token ids as flat unsigned integer files with 64-bit document offsets.

File format, per partition k in id order:

- ``k.bin``: the ids of its documents one after the other, little-endian unsigned integers of the
  smallest width (2 or 4 bytes) that holds the vocabulary, without any header;
- ``k.idx``: for n documents n + 1 little-endian 64-bit offsets into the .bin file, counted in ids
  from 0, then the n 64-bit document ids, then n bytes that are 1 where the document id is null.

A manifest table lists the partitions with their number of ids and documents and their base, the
number of ids in all partitions before; the bases are prefix sums of one count per partition.
Readers map the files into memory.

Encoding uses the tokenizers library. The vocabulary's normalizer drops white space and no token
spans it, so distinct parts of words are encoded once per worker and remembered (the memory is bounded).
Texts with rarer white space or format characters go to the library as a whole, as do all texts if
the tokenizer file is of another form.

Files are written under a task's own name and then renamed, so a repeated task after a lost executor
leaves whole files only; they go to the shared folder, never to a machine's own.

Rows are range-sorted by id, then by text and row, so that null or repeated ids are dealt to several
files; equal rows are interchangeable.

Defined results: a null or empty text has the end id only; null ids come first; repeated ids keep
all their rows, in the order of a hash of their texts; texts have no length limit (one text is held
at a time beside its batch); an empty table gives no files and an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow, n_partitions, shared_dir, texts, tokenizer_path

#: Remembered parts and words per worker, and the longest that is remembered.
MEMORY, LONGEST = 800_000, 48
#: White space and format characters on which str.split and the vocabulary's pattern might differ.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
ODD_ASCII = re.compile("[\x1c-\x1f]")
#: Letters and numbers below U+0300. U+0130 alone has a lower case with a combining mark, so it is not taken here.
LETTERS = "".join(c for c in map(chr, range(0x300)) if c.isalpha() and c != "\u0130")
NUMBERS = "".join(c for c in map(chr, range(0x300)) if unicodedata.category(c)[0] == "N")
LATIN = re.compile("[\x21-\u012f\u0131-\u02ff\u2c65\u2c66]+").fullmatch
LATIN_TEXT = re.compile("[\x00-\u012f\u0131-\u02ff]+").fullmatch
#: The vocabulary's pattern (a fixed value), and the same for words of the characters above; lower-casing can lead to U+2C65 and U+2C66.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}\u2c65\u2c66]+|[{NUMBERS}]|[^\\s{LETTERS}\u2c65\u2c66{NUMBERS}]+")
WRITE_AT = 4 << 20


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is visible, else the next from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return dict(zip([*seen, *(b for b in range(256) if b not in seen)], [*seen, *range(256, 512 - len(seen))], strict=True))


BYTE_LETTERS = _byte_letters()


def _cuts_at_spaces(spec: dict) -> bool:
    """Whether the tokenizer drops white space, lower-cases, cuts by PATTERN and merges bytes, so that words can be encoded apart."""
    normal = [(n["type"], n.get("pattern"), n.get("content")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
    before = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    model = spec["model"]
    return (
        normal == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and [p["type"] for p in before] == ["Split", "ByteLevel"]
        and (before[0]["pattern"], before[0]["behavior"], before[0]["invert"]) == ({"Regex": PATTERN}, "Removed", True)
        and not before[1]["add_prefix_space"] and not before[1]["use_regex"]
        and model["type"] == "BPE" and not model["dropout"] and not model["continuing_subword_prefix"]
        and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        and spec["truncation"] is None and spec["padding"] is None
    )


class WordEncoder:
    """Ids of whole texts through remembered ids of their parts.

    Text is lower-cased and cut into parts by the vocabulary's own pattern, and each distinct part is
    merged once, by the library's model. This holds for Latin letters, where lower-casing is free of
    context and nothing composes; words with other letters go to the library as they are. Where the
    tokenizer file is not of the form that this needs (`by_words`), whole texts do.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_words = _cuts_at_spaces(spec)
        self.marked = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.merged = self.library.model.tokenize
        self.memory: dict[str, bytes] = {}

    def _packed(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _merged(self, part: str) -> bytes:
        letters = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(BYTE_LETTERS)
        return np.array([t.id for t in self.merged(letters)], self.type).tobytes()

    def _learn(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of new parts and words; the short ones are remembered."""
        out = {k: self._merged(k) for k in keys if LATIN(k)}
        other = [k for k in keys if k not in out]
        for at in range(0, len(other), 1024):
            out.update(zip(other[at : at + 1024], self._packed(other[at : at + 1024]), strict=True))
        if len(self.memory) + len(out) > MEMORY:
            self.memory = {}  # anew, so that a batch under way keeps those it has
        self.memory.update((k, p) for k, p in out.items() if len(k) <= LONGEST)
        return out

    def _cut(self, text: str) -> list[str] | None:
        """The text's parts, or its words if it has other than Latin letters; None if it is to be encoded as a whole."""
        plain = text.isascii()
        if not self.by_words or self.marked.search(text) or (ODD_ASCII if plain else ODD).search(text):
            return None
        if plain or LATIN_TEXT(text):
            return PARTS.findall(text.lower())
        return [p for w in text.split() for p in (PARTS.findall(w.lower()) if LATIN(w) else (w,))]

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        cut = [*map(self._cut, batch)]
        whole = iter(self._packed([t for t, keys in zip(batch, cut, strict=True) if keys is None]))
        found = [[*map(self.memory.get, keys or ())] for keys in cut]
        new = {k for keys, rows in zip(cut, found, strict=True) if None in rows for k, r in zip(keys, rows, strict=True) if r is None}
        if new:
            fresh = self._learn([*new])
            found = [[fresh[k] if r is None else r for k, r in zip(keys, rows, strict=True)] if None in rows else rows for keys, rows in zip(cut, found, strict=True)]
        return [next(whole) if keys is None else b"".join(rows) for keys, rows in zip(cut, found, strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _writer(path: str, end_id: int, uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(path)
        end = np.array([end_id], enc.type).tobytes()
        store, root = fs.FileSystem.from_uri(uri)
        own = f"{root}/.{part:06d}-{uuid.uuid4().hex}"
        lengths, ids, nulls, out, held, size = [], [], [], None, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                packed = enc.encode(texts(piece))
                if out is None:
                    out = store.open_output_stream(own + ".bin")
                for p in packed:
                    held += [p, end]
                    size += len(p)
                    lengths.append(len(p) // enc.type.itemsize + 1)
                if size >= WRITE_AT:
                    out.write(b"".join(held))
                    held, size = [], 0
                column = piece.column("doc_id")
                ids.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls.append(column.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        if out is None:
            return
        out.write(b"".join(held))
        out.close()
        offsets = np.zeros(len(lengths) + 1, "<i8")
        np.cumsum(lengths, out=offsets[1:])
        with store.open_output_stream(own + ".idx") as f:
            f.write(offsets.tobytes() + np.concatenate(ids).tobytes() + np.concatenate(nulls).tobytes())
        for kind in (".bin", ".idx"):
            store.move(own + kind, f"{root}/{part:06d}{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_tokens": pa.array([int(offsets[-1])], pa.int64()), "n_docs": pa.array([len(lengths)], pa.int64())})

    return run


def write(docs: DataFrame, uri: str, end_id: int, tokenizer_file: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files below uri in ascending id order; returns the manifest (part, n_tokens, n_docs, base)."""
    spark = docs.sparkSession
    path = tokenizer_file or tokenizer_path("word_bpe_49k.json")
    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    src = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    src = src.withColumns({"h": F.xxhash64("text"), "c": F.crc32(F.col("text").cast("binary")), "row": F.monotonically_increasing_id()})
    order = ["doc_id", "h", "c", "row"]
    ranged = src.repartitionByRange(n_partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    counts = map_arrow(ranged, _writer(path, end_id, uri), "part int, n_tokens long, n_docs long").collect()  # one row per partition
    rows, base = [], 0
    for part, n_tokens, n_docs in sorted(map(tuple, counts)):
        rows.append((part, n_tokens, n_docs, base))
        base += n_tokens
    manifest = spark.createDataFrame(rows, "part int, n_tokens long, n_docs long, base long")
    manifest.write.mode("overwrite").parquet(f"{uri}/manifest")
    return manifest


def mapped(store: fs.FileSystem, path: str) -> np.ndarray:
    """The file's bytes, memory-mapped if it is on a file system of the machine, else read."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


def _reader(uri: str, kind: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for part, n_docs, base in zip(*(batch.column(c).to_pylist() for c in ("part", "n_docs", "base")), strict=True):
                flat = mapped(store, f"{root}/{part:06d}.bin").view(kind)
                index = mapped(store, f"{root}/{part:06d}.idx")
                offsets = index[: 8 * (n_docs + 1)].view("<i8")
                doc_ids = index[8 * (n_docs + 1) : 8 * (2 * n_docs + 1)].view("<i8")
                nulls = index[8 * (2 * n_docs + 1) :].view(np.bool_)
                for at in range(0, n_docs, 4096):
                    to = min(at + 4096, n_docs)
                    own = [flat[offsets[i] : offsets[i + 1]] for i in range(at, to)]
                    cols = [
                        pa.array(doc_ids[at:to], pa.int64(), mask=nulls[at:to]),
                        pa.array(offsets[at:to] + base),
                        pa.array(np.diff(offsets[at : to + 1])),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if keep_ids:
                        cols.append(pa.array([x.astype(np.int64).tolist() for x in own], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)

    return run


def read(manifest: DataFrame, uri: str, tokenizer_file: str | None = None, *, keep_ids: bool = True) -> DataFrame:
    """A row per document from the files: doc_id, start (over all partitions), n_tokens, ids_crc32, and its ids."""
    kind = encoder(tokenizer_file or tokenizer_path("word_bpe_49k.json")).type.str
    spread = manifest.repartition(n_partitions(manifest.sparkSession), "part")
    return map_arrow(spread, _reader(uri, kind, keep_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids)


def round_trip(docs: DataFrame, end_id: int = 1, tokenizer_file: str | None = None, *, keep_ids: bool = True) -> DataFrame:
    """Writes docs to a fresh folder of the shared store and reads the files back."""
    uri = shared_dir(docs.sparkSession, "tokens")
    return read(write(docs, uri, end_id, tokenizer_file), uri, tokenizer_file, keep_ids=keep_ids)
