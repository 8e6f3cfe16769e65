"""Spelling variants against a plain account of the rule."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from rankweave.llm import spelling
from tests.llm.conftest import ODD


def plain_words(docs, least=3, shortest=5, slips=97):
    counts = Counter()
    for ident, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if slips and h % slips == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least and len(w) >= shortest}


def edits(word, alphabet):
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in alphabet}
    for i in range(len(word)):
        out |= {word[:i] + c + word[i + 1:] for c in alphabet}
    return out - {word}


def one_edit(a, b):
    """For long words: what is left between the first and the last difference."""
    a, b = sorted((a, b), key=len)
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a != b and (a[p:] == b[p + 1:] or a[p + 1:] == b[p + 1:])


def plain_variants(counts, ratio=2):
    alphabet = sorted({c for w in counts for c in w})
    rows = {}
    for word, n in counts.items():
        if len(word) < 100:
            near = [w for w in edits(word, alphabet) if w in counts]
        else:
            near = [w for w in counts if one_edit(word, w)]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        rows[word] = [form, None, n, len(near), counts[form] if form is not None else None]
    for word, row in rows.items():
        end = word
        while rows[end][0] is not None:
            end = rows[end][0]
        row[1] = end
    return sorted((w, *row) for w, row in rows.items())


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def found(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return rows(spelling.variants(df))


def test_words_of_texts(table):
    rng = random.Random(1)
    vocabulary = ["colour", "color", "Straße", "señor", "the", "ÀÉÎ", "über", "naïve", "wörter", "word"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(40)) + "'s 12x") for i in range(120)]
    docs += [(7, "colour"), (7, "COLOUR colour ColoUr"), (None, "nulls nulls nulls nulls")]
    got = {r["word"]: r["n"] for r in spelling.count_words(table([*docs, *ODD], "ID", "word", "n")).collect()}
    assert got == plain_words([*docs, *[r[:2] for r in ODD]])
    assert any(w not in {v.lower() for v in vocabulary} for w in got)      # some did lose a letter


def test_pieces(table, monkeypatch):
    docs = [(i, "alpha beta gamma delta " * 30 + "omega" * i) for i in range(40)]
    want = plain_words(docs)
    monkeypatch.setattr(spelling, "PIECE", 3)
    assert "".join(spelling._pieces(docs[3][1])) == docs[3][1]
    got = {r["word"]: r["n"] for r in spelling.count_words(table(docs)).collect()}
    assert got == want


def some_words(rng, k, alphabet, longest=9):
    return {"".join(rng.choice(alphabet) for _ in range(rng.randrange(4, longest))): rng.randrange(1, 60) for _ in range(k)}


@pytest.mark.parametrize("alphabet", ["ab", "abc", "etaoinsé", "aÿ漢😀"])
def test_random_words(spark, alphabet):
    counts = some_words(random.Random(len(alphabet)), 400, alphabet)
    assert found(spark, counts) == plain_variants(counts)


def test_hot_keys_are_split(spark, monkeypatch):
    """Thousands of words with the same beginning and end."""
    rng = random.Random(9)
    counts = {f"prefix{a}{b}{c}suffix": rng.randrange(1, 500) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}
    counts |= {f"prefix{a}{b}suffix": rng.randrange(1, 500) for a in "abcdefgh" for b in "abcdefgh"}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert spelling._cells(spelling._keys(df)).agg({"high": "max"}).first()[0] > 0
    assert found(spark, counts) == plain_variants(counts)


def test_long_words(spark):
    base = "lorem" * 3000
    counts = {base: 50, base[:7000] + base[7001:]: 4, base[:100] + "X" + base[100:]: 5, base[:-1] + "z": 6, "a" + base[1:]: 30,
              base * 20: 9, (base * 20)[:-1]: 3, base + "mm": 8}
    assert found(spark, counts) == plain_variants(counts)


def test_repeats_are_one_pair(spark):
    """aaaaa and aaaaaa are near by any of six edits, and count once."""
    counts = {"a" * k: 3 ** k for k in range(5, 12)}
    assert found(spark, counts) == plain_variants(counts)


def test_ties_and_chains(spark):
    counts = {"house": 1, "hoise": 4, "hoose": 4, "hoosy": 8, "hoosys": 16, "moosys": 32, "moosyss": 63, "zzzzz": 5}
    got = found(spark, counts)
    assert got == plain_variants(counts)
    assert dict((r[0], r[1:3]) for r in got)["house"] == ("hoise", "hoise")
    assert dict((r[0], r[1:3]) for r in got)["hoose"] == ("hoosy", "moosys")


def test_small_tiles(spark, monkeypatch):
    counts = some_words(random.Random(4), 150, "abc", 8)
    want = plain_variants(counts)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(spelling, "TILE", 3)
    try:
        assert found(spark, counts) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_empty(spark, table):
    words = spelling.count_words(table([]))
    assert rows(spelling.variants(words)) == []
    assert rows(spelling.variants(spark.createDataFrame([("alone", 3)], "word string, n long"))) == [("alone", None, "alone", 3, 0, None)]
    with pytest.raises(ValueError):
        spelling.variants(words, ratio=1)
