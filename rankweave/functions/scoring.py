"""Scoring expressions: cosine distance, BM25, reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.schemas import MISSING_RANK

# The usual BM25 parameters.
BM25_K1 = 1.2
BM25_B = 0.75


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b) in doubles; null when either vector has no length."""
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance


def bm25(tf: Column, dl: Column, df: Column, n_cases: Column, avg_dl: Column,
         k1: float = BM25_K1, b: float = BM25_B) -> Column:
    idf = F.ln(F.lit(1.0) + (n_cases - df + F.lit(0.5)) / (df + F.lit(0.5)))
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avg_dl)
    return idf * tf * F.lit(k1 + 1.0) / (tf + norm)


def rrf_score(vector_rank: Column, keyword_rank: Column, vector_weight: Column,
              keyword_weight: Column, rrf_k: Column,
              missing_rank: int | None = MISSING_RANK) -> Column:
    """Weighted reciprocal rank fusion.

    A missing rank counts as `missing_rank`; pass None to let it contribute nothing.
    """
    def part(weight: Column, rank: Column) -> Column:
        if missing_rank is not None:
            rank = F.coalesce(rank, F.lit(missing_rank))
        return F.coalesce(weight * (F.lit(1.0) / (rrf_k + rank)), F.lit(0.0))

    return part(vector_weight, vector_rank) + part(keyword_weight, keyword_rank)
