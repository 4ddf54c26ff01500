import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import pieces, tokenbin, wordpiece
from quillon.llm.common import shared_dir, tokenizer_path

MODEL, WORDS = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
TRICKY = ["", " ", "   a", "a  b", "\n\na", " \n ", "▁", "▁▁x", "a▁b", "\x00a", "é　b", "<s></s><0x41>", "日本語 テキスト", "😀 😀😀", "\t\tfoo", "a" * 300, "x\r\n", "  \n  y  "]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_agenda_equals_library(library):
    m = pieces.PieceModel(MODEL)
    for t in TRICKY:
        ids = library.encode(t, add_eos=True)
        assert m.encode(t, end=True) == ids, t
        assert m.decode(ids) == library.decode(ids), t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_agenda_equals_library_on_any_text(t):
    m = pieces.model(MODEL)
    assert m.encode(t) == m.library.encode(t) and m.decode(m.encode(t)) == m.library.decode(m.library.encode(t))


def test_piece_rows(docs, rows, library, none, odd):
    text = {r[0]: r[1] or "" for r in rows}
    for r in pieces.encode_decode(docs, MODEL).collect():
        ids = library.encode(text[r.doc_id], add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode_decode(none, MODEL).count() == 0 and pieces.encode_decode(odd, MODEL).count() == 4


def test_small_memory_gives_the_same(monkeypatch, library):
    import pyarrow as pa

    monkeypatch.setattr(pieces, "MEMORY", 3)
    monkeypatch.setattr(pieces, "LONGEST", 4)
    monkeypatch.setattr(pieces, "_models", {})
    texts = ["some words and more words here", "words and some\nmore", "here here here", None]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": texts})
    for _ in range(2):
        (out,) = pieces._batches(MODEL, True, True)(iter([batch]))
        assert out.column("ids").to_pylist() == [library.encode(t or "", add_eos=True) for t in texts]


def greedy(word, starts, inner):
    at, n = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (inner if at else starts)), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab#", min_size=1, max_size=5), max_size=12), st.sets(st.text("ab#", min_size=1, max_size=5), max_size=12), st.lists(st.text("ab#d", min_size=1, max_size=14), max_size=8))
def test_automaton_equals_greedy_cut(starts, inner, words):
    a = wordpiece.LongestMatch(starts, inner)
    assert [a.count(w) for w in words] == [greedy(w, starts, inner) for w in words]


def test_pieces_of_number_signs_count_once():
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=MODEL)
    every = {library.id_to_piece(i) for i in range(library.get_piece_size())}
    a = wordpiece.LongestMatch(*wordpiece.vocabulary(MODEL))
    for w in ("##", "###", "####"):
        assert "\u2581" + w in every and a.count(w) == 1


def test_word_piece_rows(docs, rows, none, odd):
    text, (starts, inner) = {r[0]: r[1] or "" for r in rows}, wordpiece.vocabulary(MODEL)
    for r in wordpiece.token_counts(docs, MODEL).collect():
        per = [greedy(w, starts, inner) for w in re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(per), sum(1 if x < 0 else x for x in per), per.count(-1))
    assert wordpiece.token_counts(none, MODEL).count() == 0 and wordpiece.token_counts(odd, MODEL).count() == 4


def test_token_files(spark, docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    got = sorted(tokenbin.round_trip(docs, 1, WORDS).collect())
    start = 0
    for r, (doc_id, text) in zip(got, sorted((r[0], r[1] or "") for r in rows), strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc_id, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_words_in_lines_equal_whole_texts():
    enc = tokenbin.WordEncoder(WORDS)
    texts = [*TRICKY, "don't 123 x--y é ́x", "ΣΑΣ \x1c a\xa0b", "<|endoftext|>x <|startoftext|> y", "a ́b c ½ ² Ⅷ"]
    for t, raw in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(raw, enc.type).tolist() == enc.library.encode(t, add_special_tokens=False).ids, t


def test_odd_token_files(spark, none, odd):
    uri = shared_dir(spark, "empty")
    assert tokenbin.read(tokenbin.write(none, uri, 1, WORDS), uri, WORDS).count() == 0
    got = tokenbin.round_trip(odd, 1, WORDS).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 5, 5, 6] and got[-1].ids == [1]


def test_other_tokenizers_get_whole_texts():
    enc = tokenbin.WordEncoder(tokenizer_path("byte_bpe_50k.json"))
    texts = ["hello  world", "", " a\nb"]
    assert not enc.by_words and [np.frombuffer(x, enc.type).tolist() for x in enc.encode(texts)] == [e.ids for e in enc.library.encode_batch(texts, add_special_tokens=False)]


def test_texts_of_a_megabyte():
    """One word, many words, and no place to cut."""
    enc = tokenbin.WordEncoder(WORDS)
    m = pieces.PieceModel(MODEL)
    a = wordpiece.LongestMatch(*wordpiece.vocabulary(MODEL))
    for t in ("\u00e9t\u00e9 " * 250_000, "x" * 200_000, "word, " * 200_000):
        assert np.frombuffer(enc.encode([t])[0], enc.type).tolist() == enc.library.encode(t, add_special_tokens=False).ids
        assert sum(a.count(w) > 0 for w in t.split()) == len(t.split())
        rows, _ = m.known([m.segments(t)])
        assert [int(i) for r in rows[0] for i in r.split(" ")] == m.library.encode(t)
