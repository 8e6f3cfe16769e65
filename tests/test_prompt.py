import json

import pytest
from pyspark.sql import functions as F

from rankweave.operators import prompt
from rankweave.operators.keyword import scan_index
from rankweave.plans.retrieval import local_client
from rankweave.schemas import QUERY_LOG, SEARCHED_FIELDS
from tests.conftest import rows_of
from tests.test_vectors import HAND, SCHEMA

HITS = "query_id long, rank int, patient_age int, gender string, chief_complaint string, diagnosis string, " \
       "severity string, treatment_plan string, hybrid_score double"


@pytest.fixture(scope="module")
def hits(spark):
    return spark.createDataFrame([
        (1, 2, 36, None, None, None, None, None, 0.0004),
        (1, 1, 47, "M", "Dull chest pain", "Muscle strain", "High", "Heat pack", 0.0163934),
    ], HITS)


@pytest.mark.parametrize("score, want", [(0.0163934, "0.0164"), (0.0004, "0.0004"), (0.01, "0.01"), (1.0, "1"), (0.0, "0"), (10.5, "10.5")])
def test_plain_score(spark, score, want):
    df = spark.createDataFrame([(score,)], "x double")
    assert df.select(prompt.plain_score(F.col("x"))).first()[0] == want


def test_context_in_rank_order(hits):
    assert prompt.cases_context(hits).first().context == (
        "Case 1:\r  Age: 47\r  Gender: M\r  Chief Complaint: Dull chest pain\r  Diagnosis: Muscle strain\r"
        "  Severity: High\r  Treatment Plan: Heat pack\r  Hybrid Score: 0.0164\r\r"
        "Case 2:\r  Age: 36\r  Gender: Unknown\r  Chief Complaint: N/A\r  Diagnosis: N/A\r"
        "  Severity: N/A\r  Treatment Plan: N/A\r  Hybrid Score: 0.0004\r\r")


def test_prompt_without_hits_has_empty_context(spark, hits):
    requests = spark.createDataFrame([(1, "first"), (2, "second")], "query_id long, query_text string")
    built = {r.query_id: r.user_prompt for r in prompt.build_prompt(requests, hits, "Demo").collect()}
    assert built[2] == ("New Patient Description: second\r\rSimilar Cases Retrieved from Demo Database: \r" + prompt.INSTRUCTION)
    assert "Case 2:" in built[1]


def test_payload(spark):
    df = spark.createDataFrame([('say "hi"\r', "u")], "s string, u string")
    text = df.select(prompt.chat_payload(F.col("s"), F.col("u"))).first()[0]
    assert json.loads(text) == {
        "messages": [{"role": "system", "content": 'say "hi"\r'}, {"role": "user", "content": "u"}],
        "max_tokens": 1000, "temperature": 0.3}
    assert text.index("messages") < text.index("max_tokens") < text.index("temperature")


def test_generate_keeps_errors_per_row(spark):
    def make():
        def client(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("refused")
            return [t.upper() for t in texts]
        return client

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "query_id long, payload string").coalesce(1)
    assert rows_of(prompt.generate(df, make).drop("latency_ms"), "query_id") == [(1, "A", None), (2, None, "refused"), (3, "C", None)]


def test_a_null_age_keeps_the_case(spark, hits):
    rows = hits.withColumn("patient_age", F.lit(None).cast("int"))
    assert prompt.cases_context(rows).first().context.count("Age: Unknown") == 2


def test_extract_answer(spark):
    long = "x" * 10000
    rows = [(json.dumps({"result": {"choices": [{"message": {"content": long}}]}}),), ('{"result": {}}',), (None,)]
    got = spark.createDataFrame(rows, "r string").select(prompt.extract_answer(F.col("r"))).collect()
    assert [r[0] for r in got] == [long, None, None]


def test_conversation_requests(spark):
    turns = [(1, 0, "system", "be kind to everyone"), (1, 1, "user", "  chest pain  at night "), (1, 2, "assistant", "I see what you mean"),
             (1, 3, "user", "too short"), (1, 4, "user", " 123456789 ")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = prompt.conversation_requests(df).collect()
    assert [(r.turn, r.query_text, r.keyword_search, r.rrf_k) for r in got] == [(1, "chest pain  at night", "chest pain at", 60)]


def test_rag_search(spark, cases):
    vectors = spark.createDataFrame(HAND, SCHEMA)
    answer = prompt.rag_search(vectors, cases, "47 year old with pain", [1, 0, 0, 0], '"chest pain"', local_client, 3)
    assert [r.case_id for r in answer.cases.collect()] == [12, 31, 45]
    assert all(r.hybrid_score == round(r.hybrid_score, 4) for r in answer.cases.collect())
    row = answer.summary.first()
    assert row.error is None and row.clinical_summary.startswith("2 messages")


def test_rag_search_batch(spark, cases):
    vectors = spark.createDataFrame(HAND, SCHEMA)
    requests = spark.createDataFrame(
        [(1, "47 year old with pain", '"chest pain"', 3, "FullCase", 0.6, 0.4, 60, [1.0, 0.0, 0.0, 0.0]),
         (2, "nothing like it here", "missing", 3, "DiagnosisOnly", 0.6, 0.4, 60, [1.0, 0.0, 0.0, 0.0])],
        "query_id long, query_text string, keyword_search string, top_n int, embedding_type string, "
        "vector_weight double, keyword_weight double, rrf_k int, embedding array<float>")
    answer = prompt.rag_search_batch(scan_index(cases, SEARCHED_FIELDS), vectors, cases, requests, local_client)
    assert {r.query_id for r in answer.cases.collect()} == {1}
    assert {r.query_id for r in answer.summary.collect()} == {1, 2}


def test_log_rows(spark):
    requests = spark.createDataFrame(
        [(1, 7, "first question", "first", 3), (2, 8, "second question", "second", 500), (3, 9, "third question", "third", 4)],
        "query_id long, user_id long, query_text string, keyword_search string, top_n int")
    outcome = spark.createDataFrame([(1, None, 250), (3, "refused", 40)], "query_id long, error string, latency_ms long")
    rejected = requests.where("query_id = 2").withColumn("reasons", F.array(F.lit("top_n")))
    got = prompt.log_rows(requests, outcome, "rag", F.lit("2024-05-01").cast("timestamp"), rejected)
    assert got.columns == QUERY_LOG.names
    assert rows_of(got.select("id", "user_id", "top_n", "latency_ms", "status", "error_message"), "id") == [
        (1, 7, 3, 250, "success", None), (2, 8, 500, None, "error", "invalid: top_n"), (3, 9, 4, None, "error", "refused")]
    with pytest.raises(ValueError):
        prompt.log_rows(requests, outcome, "chat", F.current_timestamp())


def test_rag_by_text(spark, cases):
    from rankweave.operators.embed import HashEmbedder, embed
    texts = cases.select("case_id", F.lit("FullCase").alias("embedding_type"), "symptoms")
    vectors = embed(texts, "symptoms", HashEmbedder(16))
    answer = prompt.rag_search_text(vectors, cases, "wheezing and short breath", "wheezing", local_client, HashEmbedder(16), 2)
    assert answer.cases.first().case_id == 32 and answer.summary.first().error is None
    with pytest.raises(ValueError):
        prompt.rag_search_text(vectors, cases, "  ", "wheezing", local_client, HashEmbedder(16))
