"""Grounded prompts, batch model calls, answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankweave.functions.text import derive_keywords, squeeze_ends
from rankweave.operators.embed import embed_text
from rankweave.operators.fusion import hybrid_search, hybrid_search_batch
from rankweave.operators.keyword import KeywordIndex
from rankweave.operators.quality import validate_params
from rankweave.schemas import MISSING_RANK, QUERY_LOG, QUERY_TYPES, STATUSES

# The wording of the prompts and the model settings.
SYSTEM_PROMPT = (
    "You are a clinical decision support assistant for the {system} system. "
    "Based on the similar cases retrieved from the database, provide a concise "
    "clinical summary and suggest possible diagnostic pathways for the new patient. "
    "Do not make a definitive diagnosis. Always recommend physician review."
)
USER_HEAD = "New Patient Description: "
CASES_HEAD = "Similar Cases Retrieved from {system} Database: "
INSTRUCTION = (
    "Based on these similar cases, provide a clinical summary and "
    "suggested next steps for the clinician to consider."
)
BLOCK_LINES = (
    ("  Age: ", "patient_age", "Unknown"),
    ("  Gender: ", "gender", "Unknown"),
    ("  Chief Complaint: ", "chief_complaint", "N/A"),
    ("  Diagnosis: ", "diagnosis", "N/A"),
    ("  Severity: ", "severity", "N/A"),
    ("  Treatment Plan: ", "treatment_plan", "N/A"),
)
MAX_TOKENS = 1000
TEMPERATURE = 0.3
ANSWER_PATH = "$.result.choices[0].message.content"
SYSTEM_NAME = "case retrieval"


def plain_score(score: Column) -> Column:
    """A score at four places without trailing zeros or exponent."""
    fixed = F.round(score, 4).cast("decimal(10,4)").cast("string")
    return F.regexp_replace(fixed, r"\.?0+$", "")


def case_block(rank: Column) -> Column:
    """The lines of one numbered case."""
    parts = [F.lit("Case "), rank.cast("string"), F.lit(":\r")]
    for label, name, default in BLOCK_LINES:
        parts += [F.lit(label), F.coalesce(F.col(name).cast("string"), F.lit(default)), F.lit("\r")]
    return F.concat(*parts, F.lit("  Hybrid Score: "), plain_score(F.col("hybrid_score")), F.lit("\r\r"))


def cases_context(hits: DataFrame) -> DataFrame:
    """(query_id, context): case blocks in rank order. A query holds at most 100 hits."""
    blocks = hits.select("query_id", F.struct("rank", case_block(F.col("rank")).alias("text")).alias("b"))
    ordered = F.transform(F.sort_array(F.collect_list("b")), lambda b: b["text"])
    return blocks.groupBy("query_id").agg(F.array_join(ordered, "").alias("context"))


def build_prompt(requests: DataFrame, hits: DataFrame, system: str = SYSTEM_NAME) -> DataFrame:
    """(query_id, system_prompt, user_prompt); a request without hits keeps an empty context."""
    user = F.concat(
        F.lit(USER_HEAD), F.col("query_text"), F.lit("\r\r" + CASES_HEAD.format(system=system) + "\r"),
        F.coalesce("context", F.lit("")), F.lit(INSTRUCTION),
    )
    return (
        requests.select("query_id", "query_text").join(cases_context(hits), "query_id", "left")
        .select("query_id", F.lit(SYSTEM_PROMPT.format(system=system)).alias("system_prompt"), user.alias("user_prompt"))
    )


def chat_payload(system_prompt: Column, user_prompt: Column) -> Column:
    """The JSON body of a chat call."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.to_json(F.struct(
        F.array(message("system", system_prompt), message("user", user_prompt)).alias("messages"),
        F.lit(MAX_TOKENS).alias("max_tokens"), F.lit(TEMPERATURE).alias("temperature"),
    ))


def generate(payloads: DataFrame, make_client: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """(query_id, response, error, latency_ms): call a model for each payload.

    The latency is that of the call the row was part of. `make_client()` runs once per task and returns list[payload] -> list[response]. When a
    batch fails its rows are tried one by one, so a bad row carries its own error. A retried
    task calls the model again; write the result before using it twice.
    """
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            texts = batch["payload"].tolist()
            began = time.perf_counter()
            try:
                responses = list(client(texts))
                if len(responses) != len(texts):
                    raise ValueError(f"{len(texts)} payloads gave {len(responses)} responses")
                errors = [None] * len(texts)
                spent = [time.perf_counter() - began] * len(texts)
            except Exception:
                responses, errors, spent = [], [], []
                for text in texts:
                    began = time.perf_counter()
                    try:
                        responses.append(client([text])[0])
                        errors.append(None)
                    except Exception as e:
                        responses.append(None)
                        errors.append(str(e))
                    spent.append(time.perf_counter() - began)
            yield pd.DataFrame({"query_id": batch["query_id"], "response": responses, "error": errors,
                                "latency_ms": [round(1000 * s) for s in spent]})

    return payloads.select("query_id", "payload").mapInPandas(
        call, "query_id long, response string, error string, latency_ms long")


def extract_answer(response: Column) -> Column:
    return F.get_json_object(response, ANSWER_PATH)


def conversation_requests(conversations: DataFrame, top_n: int = 5, embedding_type: str = "FullCase",
                          vector_weight: float = 0.6, keyword_weight: float = 0.4) -> DataFrame:
    """Each user turn of ten characters or more as a request with derived keywords."""
    text = squeeze_ends(F.col("text"))
    return (
        conversations.where(F.col("role") == "user").select("conv_id", "turn", text.alias("query_text"))
        .where(F.length("query_text") >= 10)
        .select(
            "conv_id", "turn", "query_text", derive_keywords(F.col("query_text")).alias("keyword_search"),
            F.lit(top_n).alias("top_n"), F.lit(embedding_type).alias("embedding_type"),
            F.lit(float(vector_weight)).alias("vector_weight"), F.lit(float(keyword_weight)).alias("keyword_weight"),
            F.lit(60).alias("rrf_k"),
        )
    )


@dataclass(frozen=True)
class RagAnswer:
    """Retrieved cases and the model's answer, as two result sets; of a batch also the rejected requests."""

    cases: DataFrame
    summary: DataFrame
    rejected: DataFrame | None = None


def answers(prompts: DataFrame, make_client) -> DataFrame:
    """(query_id, clinical_summary, error, latency_ms) of built prompts."""
    payloads = prompts.select("query_id", chat_payload(F.col("system_prompt"), F.col("user_prompt")).alias("payload"))
    return generate(payloads, make_client).select(
        "query_id", extract_answer(F.col("response")).alias("clinical_summary"), "error", "latency_ms")


def log_rows(requests: DataFrame, outcome: DataFrame, query_type: str, created_at: Column,
             rejected: DataFrame | None = None) -> DataFrame:
    """One query-log row per request: its settings, then how the call went.

    `outcome` has query_id, error and latency_ms. A failed call has its error and no latency; a
    rejected request is logged as an error with its reasons. `requests` may bring a user_id.
    """
    ended = outcome.select("query_id", "error", "latency_ms")
    if rejected is not None:
        ended = ended.join(rejected.select("query_id"), "query_id", "left_anti").unionByName(rejected.select(
            "query_id", F.concat(F.lit("invalid: "), F.array_join("reasons", ", ")).alias("error"),
            F.lit(None).cast("long").alias("latency_ms")))
    rows = requests.join(ended, "query_id")
    good = F.col("error").isNull()
    made = {
        "id": F.col("query_id"), "user_id": F.col("user_id") if "user_id" in requests.columns else F.lit(0),
        "query_type": F.lit(query_type), "patient_description": F.col("query_text"),
        "latency_ms": F.when(good, F.col("latency_ms")), "status": F.when(good, STATUSES[0]).otherwise(STATUSES[1]),
        "error_message": F.col("error"), "created_at": created_at,
    }
    if query_type not in QUERY_TYPES:
        raise ValueError(f"unknown query type: {query_type}")
    return rows.select(*[made.get(f.name, F.col(f.name) if f.name in requests.columns else F.lit(None))
                         .cast(f.dataType).alias(f.name) for f in QUERY_LOG.fields])


def rag_search(embeddings: DataFrame, cases: DataFrame, text: str, query, condition: str, make_client, n: int = 5,
               system: str = SYSTEM_NAME, **search) -> RagAnswer:
    """One question: hybrid search, grounded prompt, model answer."""
    hits = hybrid_search(embeddings, cases, query, condition, n=n, query_text=text, **search)
    spark = cases.sparkSession
    request = spark.createDataFrame([(0, text)], "query_id long, query_text string")
    # At most 100 rows are numbered.
    order = W.orderBy(F.desc("hybrid_score"), "case_id")
    numbered = hits.withColumn("rank", F.row_number().over(order)).withColumn("query_id", F.lit(0).cast("long"))
    shown = hits.withColumn("hybrid_score", F.round("hybrid_score", 4))
    return RagAnswer(shown, answers(build_prompt(request, numbered, system), make_client).drop("query_id"))


def rag_search_text(embeddings: DataFrame, cases: DataFrame, text: str, condition: str, make_client, embedder, n: int = 5,
                    system: str = SYSTEM_NAME, **search) -> RagAnswer:
    """`rag_search` for a text, which the embedder turns into the question vector."""
    validate_params(text=text, keyword=condition, n=n)
    vector = embed_text(cases.sparkSession, text, embedder)
    return rag_search(embeddings, cases, text, vector, condition, make_client, n, system, **search)


def rag_search_batch(index: KeywordIndex, embeddings: DataFrame, cases: DataFrame, requests: DataFrame, make_client,
                     system: str = SYSTEM_NAME, missing_rank: int | None = MISSING_RANK, **search) -> RagAnswer:
    """`rag_search` for every valid request row."""
    found = hybrid_search_batch(index, embeddings, cases, requests, missing_rank=missing_rank, **search)
    shown = found.hits.withColumn("hybrid_score", F.round("hybrid_score", 4))
    valid = requests.join(found.rejected.select("query_id"), "query_id", "left_anti")
    return RagAnswer(shown, answers(build_prompt(valid, found.hits, system), make_client), found.rejected)
