"""Packed postings against plain ones, and top-k search against exhaustive search."""

import os
import random

import numpy as np
import pytest

from rankweave.operators import keyword as K
from rankweave.operators import packed as P
from tests.conftest import rows_of
from tests.test_keyword import CONDITIONS, FIELDS, NESTED


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_numbers():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 - 1, 2**35, 2**62])
    data, at = P.encode(values)
    assert P.decode(data.tobytes()).tolist() == values.tolist()
    assert np.diff(at).tolist() == [1, 1, 1, 2, 2, 3, 4, 4, 6, 9]
    assert P.decode(b"").tolist() == []


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    vocabulary = ["chest", "pain", "breath", "short", "shortness", "of", "the", "head", "heart", "at", "cough", "on"]
    rows = [(i * 3 - 50, " ".join(rng.choices(vocabulary, k=rng.randint(0, 4))), ", ".join(rng.choices(vocabulary, k=rng.randint(0, 30))))
            for i in range(400)]
    rows += [(5000, None, None), (5001, "of the", ""), (2**40, "chest pain", "x")]
    return spark.createDataFrame(rows, "case_id long, title string, body string").repartition(5)


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return P.build_packed(corpus, str(tmp_path_factory.mktemp("packed")), FIELDS, buckets=4, page_cases=16)


def test_unpacks_to_postings(corpus, index):
    plain = K.build_postings(corpus, FIELDS, buckets=4).select("term_bucket", "term", "case_id", "field", "tf", "positions")
    order = ("term", "case_id", "field")
    assert rows_of(P.unpacked(index), *order) == rows_of(plain, *order)
    assert index.n == 403 and index.len == sum(len(r.positions) for r in plain.collect())
    assert index.blocks.groupBy("term", "page").count().where("count > 1").isEmpty()


def test_impacts_bound_every_count(index):
    for row in index.blocks.join(index.pages.select("page", "lens"), "page").collect():
        case, tf = P._cases(row["cases"])
        dl = P.decode(row["lens"])[case]
        for t, d in zip(tf.tolist(), dl.tolist(), strict=True):
            assert any(t <= T and d >= D for T, D in zip(row["tfs"], row["dls"], strict=True))


@pytest.mark.parametrize("condition", [*CONDITIONS, *(c for c, _ in NESTED)])
def test_top_equals_exhaustive_search(corpus, index, condition, monkeypatch):
    monkeypatch.setattr(P, "ROUNDS", (1, 2))
    want = [tuple(r) for r in K.keyword_scan(corpus, FIELDS, condition, 7).collect()]
    got = [tuple(r) for r in P.search_topk(index, condition, 7).hits.collect()]
    assert [c for c, _ in got] == [c for c, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-8)


def test_pages_that_cannot_reach_the_top_are_skipped(spark, tmp_path):
    """A rare word decides; the common one alone never reaches the bar, so its other pages are not read."""
    rng = random.Random(3)
    rows = [(i, " ".join(["common"] * rng.randint(1, 3) + [f"w{rng.randrange(50)}" for _ in range(20)]
                         + (["rare"] * 3 if i % 400 == 7 else []))) for i in range(6000)]
    corpus = spark.createDataFrame(rows, "case_id long, body string").repartition(4)
    index = P.build_packed(corpus, str(tmp_path / "packed"), ("body",), buckets=4, page_cases=32)
    found = P.search_topk(index, "rare OR common", 10)
    want = [tuple(r) for r in K.keyword_scan(corpus, ("body",), "rare OR common", 10).collect()]
    assert [tuple(r) for r in found.hits.collect()] == want
    assert found.blocks > 180 and found.blocks_read < found.blocks / 5


def test_packed_blocks_take_less_room(spark, tmp_path):
    """Where ids are wide and words are shared by many cases. With few cases to a word both forms take about the same."""
    rng = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    rows = [(rng.getrandbits(60), " ".join(rng.choices(words, k=40))) for _ in range(8000)]
    docs = spark.createDataFrame(rows, "case_id long, body string")
    K.write_postings(K.build_postings(docs, ("body",), buckets=2), str(tmp_path / "plain"))
    P.build_packed(docs, str(tmp_path / "packed"), ("body",), buckets=2)
    assert size(tmp_path / "packed") <= size(tmp_path / "plain") * 0.65


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "case_id long, body string")
    index = P.build_packed(none, str(tmp_path / "packed"), ("body",), buckets=4)
    assert P.search_topk(index, "chest").hits.collect() == [] and P.unpacked(index).collect() == []


def test_blocks_are_unpacked_together(corpus, index, monkeypatch):
    """Case ids are decoded once for each page, not once for each block."""
    rows = index.blocks.join(index.pages.select("page", "ids"), "page").select(
        "term_bucket", "term", "page", "n", "cases", "places", "ids").toArrow().combine_chunks().to_batches()
    calls = []
    monkeypatch.setattr(P, "decode", lambda data, decode=P.decode: calls.append(1) or decode(data))
    found = [r for b in rows for r in P._postings(b, FIELDS).to_pylist()]
    assert len(calls) == sum(2 + len(set(b["page"].to_pylist())) for b in rows) < sum(b.num_rows for b in rows)
    plain = K.build_postings(corpus, FIELDS, buckets=4).select("term_bucket", "term", "case_id", "field", "tf", "positions")
    assert sorted(map(str, (tuple(r.values()) for r in found))) == sorted(map(str, rows_of(plain)))


def test_a_question_without_an_id_keeps_its_hits(spark, corpus):
    asked = spark.createDataFrame([(None, "chest"), (1, "cough")], "query_id long, keyword_search string")
    ids = {r["query_id"] for r in K.keyword_topk(K.scan_index(corpus, FIELDS), asked, 3).collect()}
    assert ids == {None, 1}
