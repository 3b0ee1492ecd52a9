import hashlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe


@lru_cache(maxsize=1)
def loaded():
    return Tokenizer.from_file(bpe.vocabulary_path())


@lru_cache(maxsize=1)
def both():
    return bpe.Codec(bpe.vocabulary_path()), bpe.Codec(bpe.vocabulary_path(), library=True)


@pytest.fixture(scope="module")
def library():
    return loaded()


def check(text):
    # not a fixture: hypothesis would write out the whole vocabulary for each example
    library, codecs = loaded(), both()
    want = library.encode(text, add_special_tokens=False).ids
    for codec in codecs:
        got = codec.encode(text.encode())
        assert got.tolist() == want
    assert codecs[0].decode(got) == library.decode(want, skip_special_tokens=False).encode()


ALPHABET = st.sampled_from([*"abcdefghinorst", *"ABÉéß ΣσİñáЖ中ひ0123.,!?'-", "\n", "\t", "\x1c", "\x85", "\xa0", "́", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "😀", "the", "ing", ".", ",", "é", "«", "÷", "\u0300", "\u0130"])


@settings(max_examples=500, deadline=None)
@given(st.lists(ALPHABET, max_size=30).map("".join))
def test_equals_the_library(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text("abno", min_size=1, max_size=60))
def test_long_words_with_few_letters(text):
    check(text)


def test_every_token_encodes_to_itself(library):
    words = bpe._Words(__import__("json").load(open(bpe.vocabulary_path()))["model"])
    for t in range(300, 49406, 37):
        token = library.id_to_token(t)
        if token.endswith("</w>") and token.isascii():
            assert words.encode(token[:-4].encode()) == [t]


def test_whole_table(library, docs, odd, empty):
    for df in (docs, odd):
        want = []
        for r in df.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
            want.append(str((r.doc_id, len(ids), *sha)))
        assert sorted(str(tuple(r)) for r in bpe.token_digests(df).collect()) == sorted(want)
    assert bpe.token_digests(empty).count() == 0


def test_decode_of_a_column(docs):
    coded = bpe.encode(docs, decoded=True)
    again = bpe.decode(coded.withColumnRenamed("decoded", "one"), keep=("doc_id", "one")).withColumnRenamed("decoded", "two")
    assert again.where("one <> two").count() == 0


def test_tables_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_PIECES", 5)
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 5)
    small, large = bpe.Codec(bpe.vocabulary_path()), bpe.codec(bpe.vocabulary_path())
    text = b"one two three four five six seven one two eight nine ten one"
    assert np.array_equal(small.encode(text), large.encode(text)) and len(small.memory) <= 5 and len(small.seen) <= 5


@pytest.mark.parametrize("text", ["a <|ENDOFTEXT|> b", "<|EndOfText|>", "so it ends<|endoftext|>, or not <|ENDoftext|>.", "<|STARTOFTEXT|>Hello, world. <|startoftext|>"])
def test_special_tokens_in_another_case_are_text(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", " ", ",", ".", "<|", "|>", "<|EndOfText|>", "<|ENDOFTEXT|>", "<|endoftext|>", "<|StartOfText|>", "é", "ひ"]), max_size=12).map("".join))
def test_special_tokens_of_any_case_equal_the_library(text):
    check(text)


@pytest.mark.parametrize("form", ["{c}", "a{c}", "{c}1", "!{c}a", "\u0130{c}", "A{c}\u0130\u0317", "{c}, {c}.{c}"])
def test_every_code_point_beside_others(form):
    library, codecs = loaded(), both()
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x110000, 997))]
    for at in range(0, len(points), 512):
        texts = [form.format(c=c) for c in points[at : at + 512]]
        want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
        for codec in codecs:
            assert [codec.encode(t.encode()).tolist() for t in texts] == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=12))
def test_any_text_equals_the_library(text):
    check(text)
