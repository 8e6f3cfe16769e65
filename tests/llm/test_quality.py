"""Document statistics, the isotonic fit, and held-out accuracy."""

import random

import numpy as np
import pyarrow as pa

from rankweave.llm import quality as Q
from rankweave.llm.words import column_bytes
from tests.llm.conftest import ODD


def stats(*texts):
    rows = Q.statistics(*column_bytes(pa.array(texts, pa.string())))
    return [dict(zip(Q.STATISTICS, r, strict=True)) for r in rows]


def test_statistics():
    a, b, c = stats("The the cat. 12 A|B\nx\nx\n", None, "a b a b a b")
    assert a["log_words"] == np.log1p(7) and np.isclose(a["upper"], 3 / 24) and np.isclose(a["digit"], 2 / 24)
    assert np.isclose(a["distinct"], 5 / 7) and np.isclose(a["echo"], 2 / 7) and np.isclose(a["line_repeats"], 1 / 3)
    assert set(b.values()) <= {0.0, 1.0} and np.isclose(c["distinct"], 2 / 6) and c["echo"] == 0
    assert np.isclose(c["pair_repeats"], 1 - 3 / 6)
    alone = [stats(t)[0] for t in ("one two", "", "three\nfour", "é")]
    assert stats("one two", "", "three\nfour", "é") == alone


def test_isotonic_is_the_nearest_rising_sequence():
    draw = np.random.default_rng(5)
    for _ in range(20):
        y, w = draw.random(12), draw.integers(1, 9, 12).astype(float)
        got = Q.isotonic(y, w)
        assert (np.diff(got) >= -1e-12).all()
        for k in range(12):                              # the known min-max form
            want = max(min(np.average(y[i:j + 1], weights=w[i:j + 1]) for j in range(k, 12)) for i in range(k + 1))
            assert abs(got[k] - want) < 1e-9
    assert Q.isotonic(np.zeros(0), np.zeros(0)).tolist() == []


def sample(n, seed):
    rng, out = random.Random(seed), []
    for k in range(n):
        words = ["".join(rng.choices("aeilnorst", k=rng.randrange(2, 9))) for _ in range(rng.randrange(10, 90))]
        good = k % 3 != 0
        if not good:
            words = [w + "$$$" for w in words] if k % 2 else [w.upper() + "!!" for w in words]
        out.append((k, " ".join(words) + ".", int(good)))
    return out


def test_held_out_rows(spark, table):
    rows = sample(700, 6)
    docs = table([r[:2] for r in rows])
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 450], "doc_id long, quality int")
    facts = Q.measured(docs)
    model = Q.fit(facts, labels)
    got = {r.id: r.score for r in Q.scored(facts, model).collect()}
    assert np.mean([(got[i] >= 0.7) == bool(q) for i, _, q in rows if i >= 450]) >= 0.97
    odd = Q.scored(Q.measured(table(ODD, "id", "facts", "score")), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)


def test_partition_sums_are_the_normal_equations(spark, table):
    facts = Q.measured(table([r[:2] for r in sample(60, 7)]))
    model = Q.QualityModel(np.zeros(len(Q.STATISTICS)), np.ones(len(Q.STATISTICS)))
    rows = facts.selectExpr("facts", "cast(id % 2 as int) good", "cast(id % 4 as int) fold").collect()
    x, y = model.features(np.array([r.facts for r in rows])), np.array([r.good for r in rows], float)
    batch = pa.RecordBatch.from_arrays([pa.array([r.facts for r in rows]), pa.array([r.good for r in rows]),
                                        pa.array([r.fold for r in rows])], names=["facts", "good", "fold"])
    out = next(Q._normal_sums(iter([batch]), model))
    total = np.array(out.column(2).to_pylist()).reshape(Q.FOLDS, Q.FEATURES, -1).sum(axis=0)
    assert np.allclose(total[:, :-1], x.T @ x) and np.allclose(total[:, -1], x.T @ y)


def test_without_labels(spark, table):
    labels = spark.createDataFrame([(1, None), (99, 1)], "doc_id long, quality int")
    facts = Q.measured(table(ODD))
    assert {r.score for r in Q.scored(facts, Q.fit(facts, labels)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (4, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in Q.scored(facts, Q.fit(facts, one)).collect())
    assert Q.scored(Q.measured(table([])), Q.fit(facts, one)).collect() == []
