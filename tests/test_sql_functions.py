"""Searches called from SQL text give what the library calls give."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from rankweave.operators import fusion, keyword, sql_functions, vectors
from rankweave.schemas import SEARCHED_FIELDS
from tests.conftest import plan_of, rows_of

VECTORS = [(12, [1.0, 0.0, 0.2]), (26, [0.5, 0.5, 0.0]), (31, [0.0, 1.0, 0.0]), (32, [-1.0, 0.1, 0.0]), (45, [0.9, 0.1, 0.1]),
           (99, [1.0, 0.0, 0.0]), (12, [0.0, 0.0, 0.0])]
QUESTION = [1.0, 0.0, 0.1]


@pytest.fixture(scope="module")
def stored(spark, cases, tmp_path_factory):
    rows = spark.createDataFrame([(i, "FullCase", v) for i, v in VECTORS], "case_id long, embedding_type string, embedding array<float>")
    index = keyword.build_index(cases, str(tmp_path_factory.mktemp("index")), SEARCHED_FIELDS)
    sql_functions.register(spark, cases, rows, index)
    return rows, index


def test_find_similar(spark, cases, stored):
    got = spark.sql("SELECT * FROM find_similar(:q, 3)", args={"q": QUESTION})
    want = vectors.find_similar(stored[0].where("case_id <> 12 OR embedding[0] > 0"), cases, QUESTION, 3)
    assert got.columns == want.columns
    assert [(r.case_id, round(r.similarity, 9)) for r in got.orderBy("similarity").collect()] == [
        (r.case_id, round(r.similarity, 9)) for r in want.orderBy("similarity").collect()]
    assert spark.sql("SELECT * FROM find_similar(array(1D, 0D))").collect() == []
    assert spark.sql("SELECT * FROM find_similar(array(0D, 0D, 0D))").collect() == []
    assert spark.sql("SELECT * FROM find_similar(:q, 3, 'Other')", args={"q": QUESTION}).collect() == []


def test_a_bound_on_the_rank_is_a_top_k(spark, stored):
    assert "TakeOrderedAndProject(limit=3" in plan_of(spark.sql("SELECT * FROM find_similar(:q, 3)", args={"q": QUESTION}))


@pytest.mark.parametrize("condition", [
    "chest", "chest pain", '"chest pain"', "pain AND chest", "chest AND NOT cough", '"pain of the chest" OR vomiting', "dyspnee",
    "NOT chest", "the of", "chest OR chest AND oxygen", '"shortness of breath" AND pain', "nothing", '"pain pain"', "it\'s chest"])
def test_keyword_hits(spark, stored, condition):
    got = rows_of(spark.sql("SELECT * FROM keyword_hits(:c)", args={"c": condition}), "case_id")
    assert got == rows_of(keyword.keyword_search(stored[1], condition, 50), "case_id")


def test_hybrid(spark, cases, stored):
    rows = stored[0].where("case_id <> 12 OR embedding[0] > 0")
    for weights in ((0.6, 0.4), (0.0, 1.0)):
        got = spark.sql("SELECT * FROM hybrid_search(:q, 'chest pain', 4, 'FullCase', :v, :k)",
                        args={"q": QUESTION, "v": weights[0], "k": weights[1]})
        want = fusion.hybrid_search(rows, cases, QUESTION, "chest pain", 4, vector_weight=weights[0], keyword_weight=weights[1])
        shown = [(r.case_id, r.keyword_score, round(r.hybrid_score, 12)) for r in got.select(*want.columns).collect()]
        assert sorted(shown) == sorted((r.case_id, r.keyword_score, round(r.hybrid_score, 12)) for r in want.collect())


@pytest.mark.parametrize("call", ["find_similar(array(1D, 0D, 0D), 0)", "find_similar(array(1D, 0D, 0D), 101)", "keyword_hits(' ')",
                                  "keyword_hits('(a OR b) AND c')", "keyword_hits('NEAR(a, b)')", "keyword_hits('ches*')"])
def test_calls_that_are_refused(spark, stored, call):
    with pytest.raises((PySparkException, Py4JJavaError), match="must be between|cannot be blank|not for SQL functions"):
        spark.sql(f"SELECT * FROM {call}").collect()


def test_empty_tables(spark, cases, stored):
    sql_functions.register(spark, cases.limit(0), stored[0].limit(0), stored[1])
    try:
        assert spark.sql("SELECT * FROM find_similar(array(1D, 0D, 0D))").collect() == []
        assert spark.sql("SELECT * FROM hybrid_search(array(1D, 0D, 0D), 'chest')").collect() == []
    finally:
        sql_functions.register(spark, cases, *stored)
    with pytest.raises(ValueError):
        sql_functions.register(spark, cases, stored[0], keyword.scan_index(cases))
