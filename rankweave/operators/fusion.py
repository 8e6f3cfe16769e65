"""Hybrid search: weighted reciprocal rank fusion of vector and keyword rankings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankweave.functions.scoring import rrf_score
from rankweave.operators.keyword import KeywordIndex, keyword_scan, keyword_search, keyword_topk
from rankweave.operators.embed import embed_text
from rankweave.operators.quality import split_valid, validate_params
from rankweave.operators.topk import topk_per_group
from rankweave.operators.vectors import (
    IvfIndex, check_type, existing, find_similar, ivf_search, knn_join, look_up, vector_topk,
)
from rankweave.schemas import CANDIDATES, CASE_COLS, EMBEDDING_TYPES, MISSING_RANK, RESULT_COLS, SEARCHED_FIELDS
from rankweave.session import written

# The offered weight presets, as (label, vector weight, keyword weight).
WEIGHT_PRESETS = (
    ("Vector 80/20", 0.8, 0.2),
    ("Hybrid 60/40", 0.6, 0.4),
    ("Hybrid 50/50", 0.5, 0.5),
    ("Keyword 80/20", 0.2, 0.8),
)
MAX_CANDIDATES = 10_000
HYBRID_COLS = [c for c in CASE_COLS] + ["vector_distance", "keyword_score", "hybrid_score"]


def vector_rank(candidates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number candidates by distance. Callers cap them to the candidate count first."""
    order = W.partitionBy(*keys).orderBy("vector_distance", "case_id")
    return candidates.withColumn("vector_rank", F.row_number().over(order))


def keyword_rank(candidates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("keyword_score"), "case_id")
    return candidates.withColumn("keyword_rank", F.row_number().over(order))


def fuse(vector: DataFrame, keyword: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Full outer join of two rankings on ids only; case columns are joined after the top-n."""
    on = [*keys, "case_id"]
    return (
        vector.select(*on, "vector_distance", "vector_rank")
        .join(keyword.select(*on, "keyword_score", "keyword_rank"), on, "full")
    )


def with_cases(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Attach case columns to the hits of a batch.

    The hits are written first, so Spark knows their size: few are broadcast, many meet the
    cases in a shuffle that a runtime filter on their ids thins out.
    """
    return cases.select(*CASE_COLS).join(written(hits, "hits"), "case_id")


def check_candidates(candidates: int) -> None:
    """A ranking is numbered in one task, so it stays short."""
    if not 1 <= candidates <= MAX_CANDIDATES:
        raise ValueError(f"candidates must be between 1 and {MAX_CANDIDATES}")


def hybrid_ranks(embeddings: DataFrame, cases: DataFrame, query: Sequence[float], condition: str,
                 embedding_type: str = "FullCase", fields: Sequence[str] = SEARCHED_FIELDS,
                 index: KeywordIndex | None = None, candidates: int = CANDIDATES,
                 fk_enforced: bool = False, known_types: Sequence[str] | None = EMBEDDING_TYPES) -> DataFrame:
    """Both rankings of one question, at most 2 x `candidates` rows."""
    check_candidates(candidates)
    check_type(embedding_type, known_types)
    of_type = embeddings.where(F.col("embedding_type") == embedding_type)
    near = vector_topk(of_type, query, candidates)
    if not fk_enforced:
        near = look_up(cases.select("case_id"), near, candidates).groupBy("case_id").agg(
            F.min("vector_distance").alias("vector_distance"))
    if index is None:
        words = keyword_scan(cases, fields, condition, candidates)
    else:
        words = keyword_search(index, condition, candidates, fields)
    return fuse(vector_rank(near), keyword_rank(words))


def hybrid_search(embeddings: DataFrame, cases: DataFrame, query: Sequence[float], condition: str,
                  n: int = 10, embedding_type: str = "FullCase", vector_weight: float = 0.6,
                  keyword_weight: float = 0.4, rrf_k: int = 60, missing_rank: int | None = MISSING_RANK,
                  query_text: str | None = None, **ranking) -> DataFrame:
    """The `n` best cases by fused rank. `ranking` goes to `hybrid_ranks`.

    Without an index the keyword side reads the case text; with one, only its terms.
    """
    validate_params(text=query_text if query_text is not None else condition, keyword=condition, n=n, rrf_k=rrf_k)
    ranks = hybrid_ranks(embeddings, cases, query, condition, embedding_type, **ranking)
    score = rrf_score(F.col("vector_rank"), F.col("keyword_rank"), F.lit(float(vector_weight)),
                      F.lit(float(keyword_weight)), F.lit(rrf_k), missing_rank)
    top = ranks.withColumn("hybrid_score", score).orderBy(F.desc("hybrid_score"), "case_id").limit(n)
    return look_up(cases.select(*CASE_COLS), top, n).select(*HYBRID_COLS).orderBy(F.desc("hybrid_score"), "case_id")


def find_similar_text(embeddings: DataFrame, cases: DataFrame, text: str, embedder, k: int = 5,
                      embedding_type: str = "FullCase", **search) -> DataFrame:
    """`find_similar` for a text, which the embedder turns into the question vector."""
    validate_params(text=text)
    return find_similar(embeddings, cases, embed_text(cases.sparkSession, text, embedder), k, embedding_type, **search)


def hybrid_search_text(embeddings: DataFrame, cases: DataFrame, text: str, condition: str, embedder, n: int = 10,
                       **search) -> DataFrame:
    """`hybrid_search` for a text, which the embedder turns into the question vector."""
    validate_params(text=text, keyword=condition, n=n)
    vector = embed_text(cases.sparkSession, text, embedder)
    return hybrid_search(embeddings, cases, vector, condition, n=n, query_text=text, **search)


@dataclass(frozen=True)
class BatchResult:
    """Hits of the valid requests, and the rejected requests with their `reasons`."""

    hits: DataFrame
    rejected: DataFrame


def hybrid_ranks_batch(index: KeywordIndex, embeddings: DataFrame | IvfIndex, cases: DataFrame, requests: DataFrame,
                       fields: Sequence[str] | None = None, candidates: int = CANDIDATES,
                       fk_enforced: bool = False, nprobe: int = 8) -> DataFrame:
    """Both rankings of every request (query_id, keyword_search, embedding_type, embedding).

    The vector side reads all vectors of the request's type, or of an IVF index the `nprobe`
    nearest cells.
    """
    check_candidates(candidates)
    keys = ["query_id"]
    if isinstance(embeddings, IvfIndex):
        near = ivf_search(embeddings, requests, candidates, nprobe, by_type=True)
    else:
        near = knn_join(requests, embeddings, candidates, by_type=True)
    if not fk_enforced:
        near = vector_rank(existing(written(near.drop("vector_rank"), "near"), cases), keys)
    return fuse(near, keyword_topk(index, requests, candidates, fields), keys)


def hybrid_search_batch(index: KeywordIndex, embeddings: DataFrame | IvfIndex, cases: DataFrame, requests: DataFrame,
                        fields: Sequence[str] | None = None, candidates: int = CANDIDATES, fk_enforced: bool = False,
                        missing_rank: int | None = MISSING_RANK, nprobe: int = 8) -> BatchResult:
    """`hybrid_search` for every valid request row, with its own weights and top_n; adds query_id and rank.

    `requests` is read several times: write or cache a costly one.
    """
    requests, rejected = split_valid(requests)
    ranks = hybrid_ranks_batch(index, embeddings, cases, requests, fields, candidates, fk_enforced, nprobe)
    settings = requests.select("query_id", "top_n", "vector_weight", "keyword_weight", "rrf_k")
    scored = ranks.join(settings, "query_id").withColumn(
        "hybrid_score",
        rrf_score(F.col("vector_rank"), F.col("keyword_rank"), F.col("vector_weight"),
                  F.col("keyword_weight"), F.col("rrf_k"), missing_rank),
    )
    top = topk_per_group(scored, ["query_id"], [F.desc("hybrid_score"), F.asc("case_id")], "top_n")
    hits = top.select("query_id", "rank", "case_id", "vector_distance", "keyword_score", "hybrid_score")
    return BatchResult(with_cases(hits, cases).select("query_id", "rank", *HYBRID_COLS), rejected)


def weight_sweep(ranks: DataFrame, presets: Sequence[tuple[str, float, float]] = WEIGHT_PRESETS, n: int = 10,
                 rrf_k: int = 60, keys: Sequence[str] = (), missing_rank: int | None = MISSING_RANK) -> DataFrame:
    """The top `n` of each weight preset from one fused ranking.

    The presets are an array literal exploded in place, so the rankings are computed once.
    """
    options = F.array(*[
        F.struct(F.lit(label).alias("preset"), F.lit(float(v)).alias("vw"), F.lit(float(k)).alias("kw"))
        for label, v, k in presets
    ])
    scored = ranks.select("*", F.inline(options)).withColumn(
        "hybrid_score",
        rrf_score(F.col("vector_rank"), F.col("keyword_rank"), F.col("vw"), F.col("kw"), F.lit(rrf_k), missing_rank),
    )
    return topk_per_group(
        scored, [*keys, "preset"], [F.desc("hybrid_score"), F.asc("case_id")], n
    ).select(*keys, "preset", "rank", "case_id", "hybrid_score")


def compare_rankings(left: DataFrame, right: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Side by side of two rankings (case_id, rank): both ranks and the shift between them."""
    on = [*keys, "case_id"]
    a = left.where(F.col("rank") <= k).select(*on, F.col("rank").alias("left_rank"))
    b = right.where(F.col("rank") <= k).select(*on, F.col("rank").alias("right_rank"))
    return a.join(b, on, "full").withColumn("shift", F.col("left_rank") - F.col("right_rank"))


def overlap_at_k(compared: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Share of the top `k` that both rankings hold."""
    both = F.count_if(F.col("left_rank").isNotNull() & F.col("right_rank").isNotNull())
    return compared.groupBy(*keys).agg((both / F.lit(float(k))).alias("overlap"))


def to_result(df: DataFrame) -> DataFrame:
    """Any search result as the full result row; absent columns are null, a null id is 0."""
    columns = []
    for name, kind in RESULT_COLS:
        value = F.col(name) if name in df.columns else F.lit(None)
        if name == "case_id":
            value = F.coalesce(value, F.lit(0))
        columns.append(value.cast(kind).alias(name))
    return df.select(*columns)
