"""Kneser-Ney models: they are distributions, and they tell planted words."""

import random

import numpy as np
import pyarrow as pa
import pytest

from rankweave.llm import toxicity as X
from rankweave.llm.words import column_bytes
from tests.llm.conftest import ODD

BAD = ["blarg", "snorfle", "zwacket"]


def texts(n, seed):
    rng = random.Random(seed)
    parts = ["an", "er", "lo", "ti", "mo", "sa", "re", "in", "ka", "du"]
    out = []
    for k in range(n):
        words = ["".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(rng.randrange(8, 80))]
        toxic = k % 4 == 0
        for _ in range(max(1, len(words) // 30) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "ing"]))
        out.append((k, " ".join(words).capitalize() + ".", int(toxic)))
    return out


def plain_grams(text, order):
    found = []
    word = b""
    for c in text.encode().lower() + b" ":
        solid = 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
        if solid or word:
            word += bytes([c if solid else 32])
            found.append(int.from_bytes((b" " + word)[-order:], "big"))
        if not solid:
            word = b""
    return found


@pytest.mark.parametrize("text", ["", "a", "Ab, c-d é9", "  x  ", "word " * 9, "x" * 30])
def test_grams(text):
    grams, first, where = X.word_grams(*column_bytes(pa.array([text, None, text])), 5)
    assert grams.tolist() == plain_grams(text, 5) * 2
    assert where.tolist() == [0, len(grams) // 2, len(grams) // 2, len(grams)] and first[0] == 0


def test_each_level_is_a_distribution():
    grams, _, _ = X.word_grams(*column_bytes(pa.array([t for _, t, _ in texts(60, 1)])), 3)
    found, n = X._counted(grams)
    levels = X._levels(found, n, 3, 1)
    assert len(levels) == 3
    for context in np.unique(found >> np.uint64(8))[:40]:
        asked = (context << np.uint64(8)) | np.arange(1, 256, dtype=np.uint64)
        base = np.full(255, 1 / 255)
        for k, level in enumerate(levels, 1):
            base = level.mix(asked & X._FULL[k], base)
            assert abs(base.sum() - 1) < 1e-9


def plain_kneser_ney(words, order):
    """P(byte | the bytes before it) by dictionaries, with interpolated Kneser-Ney counts, bytes uniform below."""
    counts = {order: {}}
    for word in words:
        line = b" " + word + b" "
        for k in range(1, len(line)):
            gram = line[max(0, k + 1 - order):k + 1]
            counts[order][gram] = counts[order].get(gram, 0) + 1
    for k in range(order, 1, -1):
        lower = {g: n for g, n in counts[k].items() if len(g) < k}
        for gram in counts[k]:
            if len(gram) == k:
                lower[gram[1:]] = lower.get(gram[1:], 0) + 1
        counts[k - 1] = lower

    def share(gram):
        p = 1 / 256
        for k in range(1, min(order, len(gram)) + 1):
            level = {g: n for g, n in counts[k].items() if len(g) == k}
            ones, twos = (sum(n == m for n in level.values()) for m in (1, 2))
            discount = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)
            follow = [n for g, n in level.items() if g[:-1] == gram[-k:-1]]
            if follow:
                p = (max(level.get(gram[-k:], 0) - discount, 0) + discount * len(follow) * p) / sum(follow)
        return p

    return share


def test_levels_are_plain_kneser_ney():
    text = "the cat sat on the mat a cat that sat on that hat"
    share = plain_kneser_ney([w.encode() for w in text.split()], 3)
    grams, _, _ = X.word_grams(*column_bytes(pa.array([text])), 3)
    levels = X._levels(*X._counted(grams), 3, 1)
    asked = [b" th", b"hat", b"at ", b"cat", b" xa", b"zzz", b"tha", b" c", b" q"]
    for gram in asked:
        code = np.array([int.from_bytes(gram, "big")], np.uint64)
        p = np.full(1, 1 / 256)
        for k, level in enumerate(levels[:len(gram)], 1):
            p = level.mix(code & X._FULL[k], p)
        assert abs(p[0] - share(gram)) < 1e-12


def test_facts_of_texts():
    class Plain:
        def __call__(self, grams):
            return (grams & np.uint64(255)).astype(float) / 100

    words = "b a c d e f g h i j k".split()
    data, at = column_bytes(pa.array([" ".join(words), "", None, "a", "..."]))
    facts = X.facts_of(Plain(), data, at)
    assert np.isnan(facts[[1, 2, 4]]).all() and not np.isnan(facts[[0, 3]]).any()
    sums = sorted(((ord(w) + 32) / 100 for w in words), reverse=True)
    want = [np.mean(sums), *(np.log1p(sum(sums[:k])) for k in (1, 3, 8)), np.log(11), np.log(sums[5] - sums[9] + 0.05)]
    assert np.allclose(facts[0], want)


def test_a_curve_follows_products_of_facts():
    draw = np.random.default_rng(3)
    facts = draw.normal(size=(800, 6))
    toxic = (facts[:, 0] * facts[:, 1] > 0.3).astype(float)
    curve = X.Curve(facts, toxic, np.ones(800))
    assert ((curve(facts) > 0) == toxic).mean() > 0.95
    assert np.isfinite(curve(facts * 1e6)).all()


def test_planted_words_are_told(spark, table):
    rows = texts(900, 2)
    docs = table([r[:2] for r in rows])
    labels = spark.createDataFrame([(i, t, None) for i, _, t in rows if i < 600], "doc_id long, toxic int, text string")
    model = X.fit(docs, labels)
    got = {r.id: r.score for r in X.score(docs, model).collect()}
    held = [(got[i] >= 0.5) == bool(t) for i, _, t in rows if i >= 600]
    assert sum(held) >= 0.97 * len(held) and all(0 <= s <= 1 for s in got.values())
    stay = X.keep_ordinary(docs, model)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == {i for i, s in got.items() if s < 0.5}
    odd = X.score(table(ODD, "id", "kind", "fold"), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in X.score(table([(1, ""), (2, None), (3, " .,")]), model).collect()} == {0.0}
    assert X.score(table([]), model).collect() == []


def test_without_labels_every_score_is_zero(spark, table):
    for rows in ([], [(1, 0)], [(1, None), (None, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        model = X.fit(table(ODD), labels)
        assert {r.score for r in X.score(table(ODD), model).collect()} == {0.0}
    X.fit(table([]), spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"))


def test_the_cache_never_mixes_grams_up():
    class Model:
        def differences(self, grams):
            return grams.astype(float)

    cache, draw = X._Cache(Model()), np.random.default_rng(4)
    X._CACHE_BITS, bits = 4, X._CACHE_BITS
    try:
        cache = X._Cache(Model())
        for _ in range(20):
            grams = draw.integers(1, 200, 300).astype(np.uint64)
            assert (cache(grams) == grams).all()
    finally:
        X._CACHE_BITS = bits


def test_grams_seen_once_are_used_however_many(spark, table):
    draw = np.random.default_rng(6)
    signs = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
    junk = [" ".join(w.tobytes().decode() for w in signs[draw.integers(0, 36, (1250, 40))]) for _ in range(100)]
    rows = [(k, t) for k, t in enumerate(junk)] + [(200 + k, "plain words of a text") for k in range(20)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int")
    model = X.fit(table(rows), labels)
    grams, _, _ = X.word_grams(*column_bytes(pa.array(junk)), X.ORDER)
    found, n = X._counted(grams)
    assert (n == 1).sum() > 4_000_000
    assert len(model.classes[1][-1].grams) == (X._length(found) == X.ORDER).sum()


def test_all_labels_are_learnt(spark, table):
    """Before, rows beyond 6,000 labelled ids of a class were left out of the counts and the curve."""
    rows = [(k, f"plain words w{k}q of a text {'blarg' * (k % 3)}") for k in range(6300)] + [(9000 + k, f"blarg snorfle {k}") for k in range(40)]
    labels = spark.createDataFrame([(i, int(i >= 9000)) for i, _ in rows], "doc_id long, toxic int")
    model = X.fit(table(rows).repartition(3), labels)
    grams, _, _ = X.word_grams(*column_bytes(pa.array([t for i, t in rows if i < 9000])), X.ORDER)
    assert len(model.classes[0][-1].grams) == (X._length(X._counted(grams)[0]) == X.ORDER).sum()


def test_a_curve_of_sums_is_the_curve(spark):
    draw = np.random.default_rng(8)
    facts, kind = draw.normal(size=(500, 6)), draw.integers(0, 2, 500)
    share = np.array([0.5, 2.0])
    rows = spark.createDataFrame([(int(k), *f) for k, f in zip(kind, facts.tolist(), strict=True)],
                                 "kind int, " + ", ".join(f"{n} double" for n in X.FACTS)).repartition(5)
    curve = X.Curve.of_sums(lambda part: X._total(rows, part, share))
    want = X.Curve(facts, kind.astype(float), share[kind])
    assert np.allclose(curve.weights, want.weights, atol=1e-6) and np.allclose(curve(facts), want(facts), atol=1e-6)


def test_labelled_rows_pass_the_filter(spark, table):
    rows = table([(k, "") for k in range(2000)]).withColumnRenamed("doc_id", "id")
    train = spark.range(0, 2000, 10).repartition(3)
    passed = {r.id for r in X._may_be_labelled(rows, train).collect()}
    assert passed >= set(range(0, 2000, 10)) and len(passed) < 500
