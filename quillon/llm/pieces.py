"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A symbol list starts as single characters. All adjacent pairs whose joined text is a piece wait on
an agenda, highest score first and leftmost first among equals; taking one merges the pair and puts
the two new neighbours on the agenda. Characters without a piece fall back to their UTF-8 bytes.

No piece spans a boundary between a character and a following space mark, some characters are in no
longer piece at all, and no piece has certain marks behind a letter. A text is therefore cut there,
and each distinct segment is encoded once per worker and remembered (the memory is bounded). Decoding spells a segment
from its ids, once as well, and puts the spelt segments together. Ids and spelling of every segment
that enters the memory are checked against the sentencepiece library, one call of each kind per
Arrow batch.

Defined results: a null or empty text has no pieces, only the end id, and decodes to an empty
text; space marks in a text are spaces. A null id is kept. Extra columns are ignored, whatever their
names. Repeated rows give repeated results; an empty table gives an empty one. Texts have no length
limit; a text without any place to cut is one segment, which is not remembered.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_arrow, texts, tokenizer_path

SPACE = "▁"
#: Remembered segments per worker, and the longest that is remembered.
MEMORY, LONGEST = 300_000, 48
#: Latin letters; a segment of them ends before a mark that no longer piece has behind one.
LETTER = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")
#: Types of a piece in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTES = 1, 2, 3, 4, 5, 6


class PieceModel:
    """Vocabulary of a merge-type model, with its own encoder and decoder."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(model_file, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only merge-type models without text normalization are supported")
        if any(p.type in (USER, UNUSED) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.library = SentencePieceProcessor(model_file=model_file)
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.text_of = [p.piece for p in spec.pieces]
        self.kind = [p.type for p in spec.pieces]
        self.id_of = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        order = {score: k for k, score in enumerate(sorted({p.score for p in spec.pieces if p.type == NORMAL}, reverse=True))}
        self.rank = {p.piece: order[p.score] for p in spec.pieces if p.type == NORMAL}
        self.byte_id = {int(BYTE.match(p.piece)[1], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTES}
        self.unk = next(i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN)
        self.end = self.library.eos_id()
        longer = [p for p in self.rank if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("pieces with a space mark after another character are not supported")
        #: "\n" can be cut at if it is in no longer piece.
        self.cuts = "" if any("\n" in p for p in longer) else "\n"
        follow = {b for p in longer for a, b in zip(p, p[1:], strict=False) if LETTER.match(a)}
        tails = "".join(re.escape(c) for c in string.punctuation if c not in follow)
        self.segment = re.compile((f" *{LETTER.pattern}++(?=[{tails}])|" if tails else "") + f" *[^ {self.cuts}]+| +" + "|\n" * bool(self.cuts))
        self.plain = [p.piece.replace(SPACE, " ") if p.type == NORMAL else None for p in spec.pieces]
        #: The decimal ids of remembered segments, those of the generation before, and what ids spell where that is not the segment itself.
        self.memory: dict[str, str] = {}
        self.former: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    # -- one segment -------------------------------------------------------------------------
    def merge(self, chars: str) -> list[int]:
        """Ids of one segment by the agenda. An entry is the pair's score rank above the left symbol's place."""
        rank = self.rank.get
        sym: list[str] = list(chars)
        n = len(sym)
        bits = n.bit_length()
        low = (1 << bits) - 1
        agenda = [r << bits | i for i, r in enumerate(map(rank, map(add, sym, sym[1:]))) if r is not None]
        if agenda:
            left, right = list(range(-1, n - 1)), list(range(1, n + 1))
            heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i = entry & low
            a, j = sym[i], right[i]
            if not a or j >= n or rank(joined := a + sym[j]) != entry >> bits:
                continue  # one of the two was merged meanwhile
            sym[i], sym[j] = joined, ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank(joined + sym[k])) is not None:
                    heappush(agenda, r << bits | i)
            if (h := left[i]) >= 0 and (r := rank(sym[h] + joined)) is not None:
                heappush(agenda, r << bits | h)
        ids: list[int] = []
        for s in sym:
            if s:
                if (at := self.id_of.get(s)) is not None:
                    ids.append(at)
                elif self.byte_id:
                    ids += [self.byte_id[b] for b in s.encode()]
                else:
                    ids.append(self.unk)
        return ids

    def spell(self, ids: list[int]) -> str:
        """Text of ids with space marks turned into spaces; runs of byte pieces are read as UTF-8."""
        found = [self.plain[i] for i in ids]
        if None not in found:
            return "".join(found)
        out, run = [], bytearray()
        for i in ids:
            if self.kind[i] == BYTES:
                run += bytes([int(self.text_of[i][3:5], 16)])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if self.kind[i] == NORMAL:
                out.append(self.text_of[i].replace(SPACE, " "))
            elif self.kind[i] == UNKNOWN:
                out.append(" ⁇ ")
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    # -- whole texts -------------------------------------------------------------------------
    def segments(self, text: str) -> list[str]:
        """Segments of the text, with spaces for space marks."""
        if not text:
            return []
        return self.segment.findall((" " if self.prefix else "") + text.replace(SPACE, " "))

    def ids_of(self, segment: str) -> list[int]:
        return self.merge(segment.replace(" ", SPACE))

    def encode(self, text: str, end: bool = False) -> list[int]:
        return [i for s in self.segments(text) for i in self.ids_of(s)] + [self.end] * end

    def decode(self, ids: list[int]) -> str:
        text = self.spell(ids)
        first = next((i for i in ids if self.kind[i] != CONTROL), None)
        return text[1:] if self.prefix and first is not None and self.text_of[first].startswith(SPACE) else text

    def learn(self, found: set[str]) -> dict[str, str]:
        """Encodes and spells the segments, checks both against the library, and remembers the short ones."""
        order = list(found)
        ids = [*map(self.ids_of, order)]
        spelt = [*map(self.spell, ids)]
        # The library puts the space mark before each text: it gets segments with a mark without it, and those that have none are checked behind a cut.
        head = " " if self.prefix else ""
        marked = [k for k, s in enumerate(order) if s.startswith(head) and s != head]
        bare = [k for k, s in enumerate(order) if not s.startswith(head) and s != "\n" and self.cuts]
        lead = self.library.encode("\n") if bare else []
        cases = [order[k][len(head) :] for k in marked] + ["\n" + order[k] for k in bare]
        mine = [ids[k] for k in marked] + [lead + ids[k] for k in bare]
        texts_ = [spelt[k] for k in marked] + [head + "\n" + spelt[k] for k in bare]
        if mine != (theirs := self.library.encode(cases, num_threads=1)):
            raise AssertionError(f"the agenda and the library differ on {next((c for c, a, b in zip(cases, mine, theirs, strict=True) if a != b), '')!r}")
        if mine and "".join(texts_)[len(head) :] != self.library.decode([i for one in mine for i in one]):
            raise AssertionError(f"decoding differs from the library's for {next((t for a, t in zip(mine, texts_, strict=True) if self.library.decode(a) != t[len(head) :]), '')!r}")
        entries = {s: " ".join(map(str, i)) for s, i in zip(order, ids, strict=True)}
        self.odd.update((s, t) for s, t in zip(order, spelt, strict=True) if t != s)
        self.remember({s: e for s, e in entries.items() if len(s) <= LONGEST})
        return entries

    def remember(self, entries: dict[str, str]) -> None:
        """Adds the entries; a full memory becomes the former one, so that what is met again soon is kept."""
        if 2 * (len(self.memory) + len(entries)) > MEMORY:
            self.former, self.memory = self.memory, {}
            self.odd = {s: t for s, t in self.odd.items() if s in self.former or s in entries}
        self.memory.update(entries)

    def known(self, cut: list[list[str]]) -> tuple[list[list[str]], dict[str, str]]:
        """The entries of the texts' segments, and what odd ones spell."""
        found = [[*map(self.memory.get, segs)] for segs in cut]
        new = {s for segs, rows in zip(cut, found, strict=True) if None in rows for s, r in zip(segs, rows, strict=True) if r is None}
        odd = self.odd
        if new:
            again = {s: e for s in new if (e := self.former.get(s)) is not None}
            fresh = again | (self.learn(new.difference(again)) if len(again) < len(new) else {})
            odd = odd | self.odd
            self.remember(again)
            found = [[fresh[s] if r is None else r for s, r in zip(segs, rows, strict=True)] if None in rows else rows for segs, rows in zip(cut, found, strict=True)]
        return found, odd


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _batches(path: str, keep_ids: bool, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        mark = 1 if m.prefix else 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cut = [m.segments(t) for t in texts(part)]
                found, odd = m.known(cut)
                n, shas, dec, ids, spelt = [], [], [], [], []
                for segs, rows in zip(cut, found, strict=True):
                    line = " ".join([*rows, str(m.end)])
                    text = "".join([odd.get(s, s) for s in segs] if odd else segs)
                    text = text[mark:] if rows and segs[0].startswith(" ") else text
                    n.append(line.count(" ") + 1)
                    shas.append(hashlib.sha256(line.encode()).hexdigest())
                    dec.append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_ids:
                        ids.append(np.fromstring(line, np.int32, sep=" "))
                    if keep_text:
                        spelt.append(text)
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(dec, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(ends, np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                    names.append("ids")
                if keep_text:
                    cols.append(pa.array(spelt, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode_decode(docs: DataFrame, model_file: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """Ids with the end id, the decoded text, and digests of both, a row for each input row.

    keep_ids=False and keep_text=False leave out the id lists and the texts themselves.
    """
    path = model_file or tokenizer_path("piece_bpe_32k.model")
    src = id_text(docs, id_col, text_col)
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return map_arrow(src, _batches(path, keep_ids, keep_text), schema)
