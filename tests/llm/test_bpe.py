import hashlib
import random
import string

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronoweave.llm import bpe_lexicon as b
from tests.llm.conftest import clashing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_padding()
LIBRARY.no_truncation()
LEXICON = b.Lexicon(b.compile_lexicon({w.encode(): b.merges(PATH).merge(w.encode()) for w in (" the", "the", " house", "ing", " houses", "é")}.items()))


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def own(texts):
    return list(b.Encoder(b.merges(PATH), LEXICON).encode(texts))


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aehst 'INé漢😀\n\t1½\u00a0\u0558\u2028\x1c\x85<|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_like_the_library(text):
    ids = own([text])[0]
    assert ids == library(text)
    assert b.merges(PATH).decode(ids) == text


@pytest.mark.parametrize("text", ["", " ", "the house's houses", "a<|endoftext|>b<|endoftext|>", " <|endoftext|> ", "<|endoftext", "a" * 500, "ab" * 3000, "\n\n  x  \n", "'S's't'", "\u0558\u088f x", "e\u0301", "\x00\x01"])
def test_given_texts(text):
    assert own([text])[0] == library(text)


def test_settled_characters():
    m = b.merges(PATH)
    for c in range(b.SETTLED_END):
        text = f"a{chr(c)}{chr(c)}b 1{chr(c)}  {chr(c)}"
        assert m.words(text) == [text[x:y] for _, (x, y) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def test_merging_many_words():
    r = random.Random(2)
    words = ["".join(r.choice("abcdehilnorst é漢") for _ in range(r.randint(1, 70))).encode() for _ in range(800)]
    m = b.merges(PATH)
    many = m.merge_all(words)
    assert many == [m._merge_long([m.single[x] for x in w]) for w in words] == [m.merge(w) for w in words]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(min_size=0, max_size=6), st.lists(st.integers(0, 50_000), max_size=4).map(tuple), max_size=30), st.lists(st.binary(max_size=7), max_size=20))
def test_lexicon(entries, others):
    lexicon = b.Lexicon.mapped(b.compile_lexicon(entries.items()))
    words = [*entries, *others]
    for w, p in zip(words, lexicon.find(words).tolist(), strict=True):
        got = None if p < 0 else tuple(lexicon.ids[lexicon.offsets[p] : lexicon.offsets[p + 1]].tolist())
        assert got == entries.get(w)


def test_lexicon_shares_suffixes():
    words = [(a + e).encode() for a in ("walk", "talk", "jump") for e in ("", "s", "ed", "ing")]
    lexicon = b.Lexicon(b.compile_lexicon((w, (i,)) for i, w in enumerate(words)))
    # walk and talk share all but their first letter; the endings are the same states for all three
    assert len(lexicon.final) <= 14
    assert lexicon.find([b"walks", b"wal", b"jumping", b"jumpin", b""]).tolist().count(-1) == 3


def test_documents(docs_of):
    r = random.Random(1)
    texts = [" ".join(r.choices(["the", "houses", "Ünwort", "xyzzy", "12", "don't"], k=40)), None, "", "<|endoftext|>", "word " * 30_000, "word " * 30_000, "\ufffd\u0558"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x"), (3, "<|endoftext|>")]
    for limit in (0, 3, 1000):
        got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, r.decoded) for r in b.encode_documents(clashing(docs_of(*rows)), PATH, limit, keep=True).collect()), key=str)
        want = []
        for doc, t in rows:
            ids = library(t or "")
            text = LIBRARY.decode(ids, skip_special_tokens=False)
            want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
        assert got == sorted(want, key=str)
    assert b.encode_documents(docs_of((1, "x")).where("false"), PATH).collect() == []


def test_frequent_words(docs_of):
    documents = docs_of("a a a a a a a a b b b b c c d", None)
    assert set(b.frequent_words(documents, 2)) <= {" a", " b"}
    assert set(b.frequent_words(documents, 100)) == {"a", " a", " b", " c", " d"}


def test_small_caches(monkeypatch):
    monkeypatch.setattr(b, "RARE_WORDS", 5)
    monkeypatch.setattr(b, "GROUP_WORDS", 7)
    r = random.Random(9)
    texts = [" ".join("".join(r.choices(string.ascii_lowercase, k=4)) for _ in range(r.randint(0, 30))) for _ in range(30)]
    assert own(texts) == [library(t) for t in texts]
