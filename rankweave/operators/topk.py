"""Top-k and pagination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def topk_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | str,
                   rank_col: str = "rank") -> DataFrame:
    """The first `k` rows of each group, numbered from 1.

    `k` may name a column, for a limit per group. Spark cuts each group to `k` rows
    before the shuffle when `k` is a number, so a hot group never reaches one task whole.
    """
    ranked = df.withColumn(rank_col, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank_col) <= (F.col(k) if isinstance(k, str) else F.lit(k)))


def page(df: DataFrame, number: int = 1, size: int = 20, order: Sequence[Column] | None = None) -> DataFrame:
    """One page, newest first."""
    check_page(number, size)
    order = order or [F.desc("created_at"), F.desc("id")]
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, last_ts, last_id: int, size: int = 20) -> DataFrame:
    """The page after the row (last_ts, last_id): a filter instead of a growing offset."""
    check_page(1, size)
    ts, row_id = F.col("created_at"), F.col("id")
    older = (ts < F.lit(last_ts)) | ((ts == F.lit(last_ts)) & (row_id < F.lit(last_id)))
    return df.where(older).orderBy(F.desc("created_at"), F.desc("id")).limit(size)


def check_page(number: int, size: int) -> None:
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page must be >= 1 and page size within 1..100")


def page_totals(df: DataFrame, size: int) -> DataFrame:
    """(total, total_pages); an empty list still has one page."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(size))).cast("long").alias("total_pages")
    )
