"""Ids and decoded texts against the public tokenizers library; the lexicon against a dict."""

import random
from array import array

import pytest

from sunmeter.llm import bpe
from sunmeter.llm.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
PATH = vocabulary_path()


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def texts():
    rnd = random.Random(1)
    parts = list("ab cd  '!?.9½²٣中ñé\n\t\r\x0b\x1c\x85\xa0  ​　﻿\x00")
    parts += ["<|endoftext|>", "'s", "'ll", " the", " hello", "😀", "é", "don't", "\n\n", "<|endof"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(6000)]
    return out + ["", " ", "  ", "a ", " a", "x" * 3000, " " * 500, "ab" * 900, "word, other; more: yes!"]


def test_ids_and_texts_are_the_librarys(vocabulary, library):
    words = {w: bpe.merge(w, vocabulary) for w in (b" the", b" hello", b"a", b"do", b"\n")}
    codec = bpe.Codec(vocabulary, bpe.Lexicon(bpe.mapped(bpe.compile_lexicon(words))))
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = array("I")
        got.frombytes(codec.encode(text))
        assert got.tolist() == want, text
        assert codec.decode(got.tobytes()) == library.decode(want, skip_special_tokens=False) == text


def test_long_words_merge_like_short_ones(vocabulary, monkeypatch):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("aeinorst") for _ in range(60)).encode() for _ in range(50)]
    short = [bpe.merge(word, vocabulary) for word in words]
    monkeypatch.setattr(bpe, "SCANNED_BYTES", 0)
    assert [bpe.merge(word, vocabulary) for word in words] == short


def test_few_cached_pieces_change_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_CACHED_PIECES", 1)
    codec = bpe.Codec(vocabulary, bpe.Lexicon(bpe.mapped(bpe.compile_lexicon({}))))
    text = "some words, some more words. end"
    assert codec.encode(text) == codec.encode(text) and codec.decode(codec.encode(text)) == text


def test_lexicon_holds_its_words_and_no_others():
    rnd = random.Random(3)
    words = {bytes(rnd.choices(b"abc\xff\x00", k=rnd.randint(1, 7))): [rnd.randint(0, 50_000)]
             * rnd.randint(1, 4) for _ in range(800)}
    lexicon = bpe.Lexicon(bpe.mapped(bpe.compile_lexicon(words)))
    for word, ids in words.items():
        assert lexicon.get(word) == ids
    for _ in range(2000):
        word = bytes(rnd.choices(b"abcd\xff", k=rnd.randint(0, 8)))
        assert lexicon.get(word) == words.get(word)


def test_common_endings_share_states():
    words = {stem + b"ation": [1] for stem in (b"n", b"st", b"rel", b"cre", b"don", b"loc")}
    lexicon = bpe.Lexicon(bpe.mapped(bpe.compile_lexicon(words)))
    assert len(lexicon.final) <= 5 + 1 + 11  # the ending once, the start, and the stems


def test_frequent_pieces(spark):
    docs = spark.createDataFrame([("a a a b b c",), ("a b d d",), (None,), ("",)], "text string")
    for size, want in ((1, {"a"}), (2, {"a", "b"}), (10, {"a", "b", "d"}), (0, set())):
        assert {r["piece"] for r in bpe.frequent_pieces(docs, size).collect()} <= want
    assert {r["piece"] for r in bpe.frequent_pieces(docs, 10).collect()} == {"a", "b", "d"}


def test_encode(spark, vocabulary, library):
    rows = [(1, "the cat, the dog"), (2, None), (2, None), (3, ""), (None, "é" * 1000),
            (4, "<|endoftext|> x"), (5, "very long " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids")
    for size in (0, 3, 1000):
        got = bpe.encode(docs, vocabulary, size).collect()
        assert len(got) == len(rows)
        found = {r["doc_id"]: (bytes(r["ids"]), r["decoded"]) for r in got}
        for key, text in rows:
            ids = library.encode(text or "", add_special_tokens=False).ids
            assert found[key] == (array("I", ids).tobytes(), text or "")
    assert bpe.encode(docs.limit(0), vocabulary).count() == 0


def test_words_that_begin_alike_or_stand_in_many_pieces_are_looked_up_once(vocabulary, library):
    words = {w: bpe.merge(w, vocabulary) for w in (b" the", b" then", b" thenar", b"the", b" t")}
    lexicon = bpe.Lexicon(bpe.mapped(bpe.compile_lexicon(words)))
    asked, walk, stored = [], lexicon._walk, lexicon.stored
    lexicon._walk = lambda word, *at: asked.append(word) or walk(word, *at)
    assert [lexicon.get(w) for w in (b" the", b" then", b" th", b" then", b" thenars", b"")] == [
        words[b" the"], words[b" then"], None, words[b" then"], None, None]
    assert asked.count(b" the") == 1
    sought = []
    lexicon.stored = lambda word: sought.append(word) or stored(word)
    codec = bpe.Codec(vocabulary, lexicon)
    text = "then\nthe--then then\nthe then--the then\n\nthe"
    got = array("I")
    got.frombytes(codec.encode(text))
    assert got.tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(sought) == len(set(sought))
