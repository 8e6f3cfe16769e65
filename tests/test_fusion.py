import pytest
from pyspark.sql import functions as F

from rankweave.functions.scoring import rrf_score
from rankweave.operators import fusion
from rankweave.operators.embed import HashEmbedder, embed
from rankweave.operators.keyword import scan_index
from rankweave.operators.vectors import build_ivf
from rankweave.schemas import RESULT_COLS, SEARCHED_FIELDS
from tests.conftest import rows_of
from tests.test_vectors import HAND, SCHEMA


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(HAND, SCHEMA)


def score(spark, rows, missing=9999, wv=0.6, wk=0.4, k=60):
    df = spark.createDataFrame(rows, "v int, k int")
    expr = rrf_score(F.col("v"), F.col("k"), F.lit(wv), F.lit(wk), F.lit(k), missing)
    return [r[0] for r in df.select(expr).collect()]


def test_rrf_by_hand(spark):
    got = score(spark, [(1, 1), (1, None), (None, 1), (2, 50)])
    assert got == pytest.approx([0.0163934426, 0.0098758310, 0.0066170251, 0.0133137830], abs=1e-10)


def test_rrf_without_missing_rank(spark):
    assert score(spark, [(1, None)], missing=None) == pytest.approx([0.6 / 61])
    assert score(spark, [(1, 1)], wv=None) == pytest.approx([0.4 / 61])


def test_rrf_falls_with_each_rank(spark):
    ranks = list(range(1, 51)) + [None]
    by_vector = score(spark, [(r, 3) for r in ranks])
    by_keyword = score(spark, [(3, r) for r in ranks])
    assert by_vector == sorted(by_vector, reverse=True) and by_keyword == sorted(by_keyword, reverse=True)


CONDITION = '"chest pain" OR "shortness of breath"'


def test_hybrid_by_hand(vectors, cases):
    # Vector ranks without the orphan 99: 12, 31, 45, 26, 32. Keyword ranks: 31 (both phrases), 12.
    hits = fusion.hybrid_search(vectors, cases, [1, 0, 0, 0], CONDITION, 5)
    want = {12: 0.6 / 61 + 0.4 / 62, 31: 0.6 / 62 + 0.4 / 61, 45: 0.6 / 63 + 0.4 / 10059,
            26: 0.6 / 64 + 0.4 / 10059, 32: 0.6 / 65 + 0.4 / 10059}
    got = [(r.case_id, r.hybrid_score) for r in hits.collect()]
    assert [c for c, _ in got] == sorted(want, key=lambda c: (-want[c], c))
    for c, s in got:
        assert s == pytest.approx(want[c])
    assert hits.columns == fusion.HYBRID_COLS


def test_fused_ids_are_the_union(vectors, cases):
    ranks = fusion.hybrid_ranks(vectors, cases, [0, 0, 1, 0], "headache OR rest", "SymptomsOnly")
    assert sorted(r.case_id for r in ranks.collect()) == [12, 26, 31, 45]


def test_empty_vector_side(vectors, cases):
    hits = fusion.hybrid_search(vectors, cases, [1, 0, 0, 0], "headache", 5, "DiagnosisOnly").collect()
    assert [(r.case_id, r.vector_distance) for r in hits] == [(26, None)]


def test_stop_words_only(vectors, cases):
    hits = fusion.hybrid_search(vectors, cases, [1, 0, 0, 0], "of the", 2).collect()
    assert [r.case_id for r in hits] == [12, 31] and all(r.keyword_score is None for r in hits)


@pytest.mark.parametrize("bad", [{"condition": " "}, {"n": 0}, {"n": 101}, {"rrf_k": 0}, {"query_text": " "}])
def test_guards(vectors, cases, bad):
    args = {"condition": "chest", "n": 5, **bad}
    with pytest.raises(ValueError):
        fusion.hybrid_search(vectors, cases, [1, 0, 0, 0], **args)


def test_candidates_are_bounded(vectors, cases):
    for bad in (0, 10_001):
        with pytest.raises(ValueError):
            fusion.hybrid_ranks(vectors, cases, [1, 0, 0, 0], "chest", candidates=bad)


def test_batch_equals_single(spark, vectors, cases):
    requests = spark.createDataFrame(
        [(7, CONDITION, 3, "FullCase", 0.6, 0.4, 60, [1.0, 0.0, 0.0, 0.0]),
         (8, "headache OR oxygen", 5, "FullCase", 0.2, 0.8, 10, [0.0, 1.0, 0.0, 0.0]),
         (9, "rest", 2, "SymptomsOnly", 0.5, 0.5, 60, [0.0, 0.0, 1.0, 0.0])],
        "query_id long, keyword_search string, top_n int, embedding_type string, vector_weight double, "
        "keyword_weight double, rrf_k int, embedding array<float>")
    batch = fusion.hybrid_search_batch(scan_index(cases, SEARCHED_FIELDS), vectors, cases, requests).hits
    got = rows_of(batch.select("query_id", "rank", "case_id", F.round("hybrid_score", 12)), "query_id", "rank")
    want = []
    for r in requests.collect():
        single = fusion.hybrid_search(vectors, cases, r.embedding, r.keyword_search, r.top_n, r.embedding_type,
                                      r.vector_weight, r.keyword_weight, r.rrf_k).collect()
        want += [(r.query_id, i + 1, h.case_id, round(h.hybrid_score, 12)) for i, h in enumerate(single)]
    assert got == want


def test_batch_rejects_bad_requests(spark, vectors, cases):
    good = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, "chest", 3, good), (2, "chest", None, good), (3, "chest", 100_000, good), (4, "chest", 3, None),
            (5, "chest", 3, [0.0] * 4)]
    requests = spark.createDataFrame(rows, "query_id long, keyword_search string, top_n int, embedding array<float>").selectExpr(
        "*", "'FullCase' AS embedding_type", "0.6D AS vector_weight", "0.4D AS keyword_weight", "60 AS rrf_k")
    found = fusion.hybrid_search_batch(scan_index(cases, SEARCHED_FIELDS), vectors, cases, requests)
    assert {r.query_id for r in found.hits.collect()} == {1}
    assert {r.query_id: r.reasons for r in found.rejected.collect()} == {2: ["top_n"], 3: ["top_n"], 4: ["embedding"], 5: ["embedding"]}


def test_batch_on_an_ivf_index(spark, vectors, cases, tmp_path):
    requests = spark.createDataFrame([(7, CONDITION, 3, "FullCase", 0.6, 0.4, 60, [1.0, 0.0, 0.0, 0.0])],
        "query_id long, keyword_search string, top_n int, embedding_type string, vector_weight double, "
        "keyword_weight double, rrf_k int, embedding array<float>")
    words = scan_index(cases, SEARCHED_FIELDS)
    exact = fusion.hybrid_search_batch(words, vectors, cases, requests).hits
    index = build_ivf(vectors, str(tmp_path), 2)
    found = fusion.hybrid_search_batch(words, index, cases, requests, nprobe=2).hits
    assert rows_of(found, "rank") == rows_of(exact, "rank") and exact.count() == 3


def test_search_by_text(spark, cases):
    texts = cases.select("case_id", F.lit("FullCase").alias("embedding_type"), "symptoms")
    stored = embed(texts, "symptoms", HashEmbedder(16))
    near = fusion.find_similar_text(stored, cases, "vomiting", HashEmbedder(16), 1).first()
    assert near.case_id == 26 and near.similarity == pytest.approx(1.0)
    top = fusion.hybrid_search_text(stored, cases, "vomiting at night", "headache", HashEmbedder(16), 1).first()
    assert top.case_id == 26
    for bad in (" ", None):
        with pytest.raises(ValueError):
            fusion.find_similar_text(stored, cases, bad, HashEmbedder(16))


def test_weight_sweep_and_comparison(spark):
    ranks = spark.createDataFrame(
        [(1, 0.1, 1, None, None), (2, 0.2, 2, 5.0, 1), (3, None, None, 4.0, 2)],
        "case_id long, vector_distance double, vector_rank int, keyword_score double, keyword_rank int")
    top = {r.preset: r.case_id for r in fusion.weight_sweep(ranks, n=1).collect()}
    assert set(top) == {"Vector 80/20", "Hybrid 60/40", "Hybrid 50/50", "Keyword 80/20"} and set(top.values()) == {2}
    a = ranks.where("vector_rank IS NOT NULL").select("case_id", F.col("vector_rank").alias("rank"))
    b = ranks.where("keyword_rank IS NOT NULL").select("case_id", F.col("keyword_rank").alias("rank"))
    compared = fusion.compare_rankings(a, b, 2)
    assert rows_of(compared, "case_id") == [(1, 1, None, None), (2, 2, 1, 1), (3, None, 2, None)]
    assert fusion.overlap_at_k(compared, 2).first()[0] == 0.5


def test_to_result(spark):
    df = spark.createDataFrame([(None, 0.5)], "case_id long, similarity float")
    out = fusion.to_result(df)
    assert out.columns == [c for c, _ in RESULT_COLS]
    row = out.first()
    assert row.case_id == 0 and row.similarity == 0.5 and row.hybrid_score is None
