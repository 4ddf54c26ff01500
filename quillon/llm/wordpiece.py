"""Word-piece token counts by a linear longest-match automaton.

The vocabulary's trie gets failure links, and each node the number of pieces that are popped when
its link is taken. One walk over a word's characters then gives the number of pieces of the greedy
longest-match-first cut, without building a piece and without going back in the word.

A word is a run of anything but ASCII white space. A word that the vocabulary cannot cut counts as
one unknown token. Defined results: a null or empty text has 0 words and 0 tokens; a null id is
kept; extra columns, of any name, are ignored; repeated rows give repeated results; an empty table
gives an empty result; neither texts nor words have a length limit (only short words are remembered).
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD, id_text, map_arrow, texts, tokenizer_path

#: Remembered words per worker, and the longest that is remembered.
MEMORY, LONGEST = 400_000, 48


class LongestMatch:
    """Trie of the pieces with failure links and popped-piece counts.

    `first` are the pieces that begin a word, `further` those that go on inside one.
    """

    START, INNER = 0, 1

    def __init__(self, first: Iterable[str], further: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for at, chars in [*((self.START, p) for p in first if p), *((self.INNER, p) for p in further if p)]:
            for c in chars:
                to = self.next[at].get(c)
                if to is None:
                    to = len(self.next)
                    self.next[at][c] = to
                    self.next.append({})
                    final.append(False)
                at = to
            final[at] = True
        n = len(self.next)
        self.fail, self.pops = [-1] * n, [0] * n
        todo = deque((root, c, to) for root in (self.START, self.INNER) for c, to in self.next[root].items())
        while todo:  # by depth, so that every link that is followed is there already
            parent, c, v = todo.popleft()
            todo.extend((v, d, w) for d, w in self.next[v].items())
            if final[v]:
                self.fail[v], self.pops[v] = self.INNER, 1
                continue
            z, popped = self.fail[parent], self.pops[parent]
            while z >= 0 and c not in self.next[z]:
                popped += self.pops[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.pops[v] = self.next[z][c], popped

    def count(self, word: str) -> int:
        """Pieces of the word, or -1 if it cannot be cut."""
        nxt, fail, pops = self.next, self.fail, self.pops
        at, n = self.START, 0
        for c in word:
            while c not in nxt[at]:
                if fail[at] < 0:
                    return -1
                n += pops[at]
                at = fail[at]
            at = nxt[at][c]
        while at != self.INNER:
            if fail[at] < 0:
                return -1
            n += pops[at]
            at = fail[at]
        return n


def vocabulary(model_file: str) -> tuple[set[str], set[str]]:
    """A word-piece vocabulary from a public piece model: pieces with a space mark begin a word, others go on inside one."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    plain = [p for p in plain if p.strip("▁")]
    return {p[1:] for p in plain if p.startswith("▁")}, {p for p in plain if not p.startswith("▁")}


_automata: dict[str, LongestMatch] = {}


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _automata:
            _automata[path] = LongestMatch(*vocabulary(path))
        count, words = _automata[path].count, re.compile(WORD).findall
        memory: dict[str, int] = {}
        for batch in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for text in texts(batch):
                found = words(text)
                if len(memory) > MEMORY:
                    memory.clear()
                long = {}
                for w in set(found).difference(memory):
                    (memory if len(w) <= LONGEST else long)[w] = count(w)
                per = [memory[w] if w in memory else long[w] for w in found] if long else [*map(memory.__getitem__, found)]
                lost = per.count(-1)
                n_words.append(len(per))
                n_tokens.append(sum(per) + 2 * lost)
                n_unknown.append(lost)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, model_file: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every row."""
    src = id_text(docs, id_col, text_col)
    return map_arrow(src, _counts(model_file or tokenizer_path("piece_bpe_32k.model")), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")
