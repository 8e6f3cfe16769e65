"""Token counts against the library that owns the vocabulary."""

from __future__ import annotations

import random
import sys

import pytest

from rankweave.llm import tokens
from tests.llm.conftest import ODD

public = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def counter(vocabulary):
    return tokens.Counter(vocabulary)


def true_count(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_whole_tokens_are_proved(library, vocabulary):
    """The table holds exactly the strings of the vocabulary that the model encodes as one token."""
    for letters in list(library.get_vocab())[::7]:
        if letters in vocabulary.specials:
            continue
        assert (letters in vocabulary.whole) == (len(library.model.tokenize(letters)) == 1)


def test_merges_against_the_library(library, vocabulary):
    rng = random.Random(5)
    letters = tokens.byte_letters()
    for n in [*range(0, 40), 300]:
        for alphabet in (letters, "ab", "etaoin", "Ġthe "[:4]):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert vocabulary.length(text) == len(library.model.tokenize(text)), text
            assert tokens._merged_by_heap(text, vocabulary.merges) == len(library.model.tokenize(text)), text


TEXTS = [
    "", " ", "  ", "\n\n \t", "a", "Hello world", "it's they'll WE'VE 'd 's", "  leading and trailing  ", "tabs\t\tand\n\nlines \n x",
    "naïve façade Straße Ærø", "汉字漢字 かな 한글", "😀👍🏽 emoji 👨‍👩‍👧", "123 4567 ١٢٣ ½ Ⅷ", "x" * 3000, "ab" * 2000, "=" * 777,
    "a b c　d", "\u0085​﻿", "\x00\x01\x1c\x1d\x1e\x1f x", "<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|endoftext|>",
    " <|endoftext|> ", "<|endoftext|", "<|startoftext|>", "def f(x):\n    return x  # no\n", "՘࢏꟎ new letters \U00010940x⿠",
]


def test_texts(library, counter):
    for text in TEXTS:
        assert counter.count(text) == true_count(library, text), repr(text)


def test_random_texts(library, counter):
    rng = random.Random(11)
    pool = [" ", " ", "\n", "'s", "'", "a", "the", "T", "é", "ß", "漢", "7", "42", "!", "...", "😀", "\t", " ", "<|endoftext|>", "࢏"]
    for _ in range(1500):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(30)))
        assert counter.count(text) == true_count(library, text), repr(text)


def test_every_code_point_falls_into_the_class_the_library_gives_it(library, counter):
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and not 0x3400 <= c <= 0xD7A3 and c < 0x20000]
    for lo in range(0, len(points), 512):
        text = "".join(f"a{chr(c)}1{chr(c)}. {chr(c)}" for c in points[lo:lo + 512])
        assert counter.pre_tokens(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_pieces_end_where_pre_tokens_end(library, vocabulary, monkeypatch):
    counter = tokens.Counter(vocabulary)
    rng = random.Random(3)
    texts = ["".join(rng.choice(["  ", " ", "\n", "word", "it's", "é", "99", "--"]) for _ in range(300)) for _ in range(40)]
    for size in (1, 2, 7, 50):
        monkeypatch.setattr(tokens, "PIECE", size)
        for text in texts:
            assert counter.count(text) == true_count(library, text)


def test_memory_for_merged_tokens_is_bounded(library, vocabulary, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    counter = tokens.Counter(vocabulary)
    text = " ".join(f"zq{i}xv" for i in range(50))
    assert counter.count(text) == true_count(library, text)
    assert len(counter.known) <= len(counter.proved) + 3


def test_table(table, library, vocabulary):
    docs = table([*ODD, (20, "over " * 1025), (21, "a" + " over" * 1023)], "ID", "N_BYTES", "n_tokens")
    found = [tuple(r) for r in tokens.token_counts(docs, vocabulary).collect()]
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := true_count(library, r["text"]), n > 1024) for r in docs.collect()]
    key = repr
    assert sorted(found, key=key) == sorted(want, key=key)
    assert tokens.token_counts(table([]), vocabulary).collect() == []


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokens.read_vocabulary(public.path("word_bpe_49k.json"))
