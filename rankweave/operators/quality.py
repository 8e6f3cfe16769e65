"""Validation: keys, references, enums, requests, row counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.schemas import EMBEDDING_TYPES
from rankweave.session import written

# Request limits.
MIN_TEXT, MIN_KEYWORD, MIN_TOP, MAX_TOP = 10, 3, 1, 100


def validate_params(text: str | None, keyword: str | None = "-", n: int | None = 5, rrf_k: int = 60) -> None:
    """Guards of the single-question searches."""
    if text is None or not text.strip(" "):
        raise ValueError("query text must not be null or empty")
    if keyword is None or not keyword.strip(" "):
        raise ValueError("keyword search must not be null or empty")
    if n is None or not MIN_TOP <= n <= MAX_TOP:
        raise ValueError(f"top-n must be between {MIN_TOP} and {MAX_TOP}")
    if rrf_k < 1:
        raise ValueError("rrf_k must be at least 1")


def request_errors(columns: Sequence[str]) -> Column:
    """Reasons why a request row is invalid; empty when it is fine. Only `columns` are checked."""
    def outside(col: str, low, high=None) -> Column:
        bad = F.col(col).isNull() | (F.col(col) < low)
        return bad if high is None else bad | (F.col(col) > high)

    def short(col: str, least: int) -> Column:
        return F.col(col).isNull() | (F.length(col) < least) | (F.trim(col) == "")

    checks = [
        (short("query_text", MIN_TEXT), "query_text"),
        (short("keyword_search", MIN_KEYWORD), "keyword_search"),
        (outside("top_n", MIN_TOP, MAX_TOP), "top_n"),
        (outside("vector_weight", 0.0, 1.0), "vector_weight"),
        (outside("keyword_weight", 0.0, 1.0), "keyword_weight"),
        (outside("rrf_k", 1), "rrf_k"),
    ]
    checks = [(bad, reason) for bad, reason in checks if reason in columns]
    if "embedding" in columns:
        checks.append((~F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)), "embedding"))
    return F.array_compact(F.array(*[F.when(bad, F.lit(reason)) for bad, reason in checks]))


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid requests, rejected requests with `reasons`)."""
    checked = requests.withColumn("reasons", request_errors(requests.columns))
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def find_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def find_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent; a null key is no reference at all."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def orphan_counts(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """(key, n): orphaned keys with their row counts.

    Counting before the join sends one row per key and task, however hot a key is.
    """
    counted = child.where(F.col(child_key).isNotNull()).groupBy(child_key).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def cascade_delete(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows left after deleting the given parents."""
    return child.join(deleted.select(key), key, "left_anti")


def cascade_rewrite(spark: SparkSession, path: str, deleted: DataFrame, key: str, partition: str) -> list:
    """Take the rows of deleted parents out of a stored table; the values of the rewritten partitions.

    Only partitions that hold such a row are read whole and written again, by dynamic partition
    overwrite; a partition left without rows is removed. Files of all others stay as they are.
    Readers of a rewritten partition should start after the rewrite; one writer at a time.
    """
    table = spark.read.parquet(path)
    gone = deleted.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    folder = F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("folder")
    hit = table.select(key, partition, folder).join(gone, key, "left_semi").select(partition, "folder").distinct()
    folders = {r[0]: r[1] for r in hit.collect()}                                              # a row per partition
    touched = sorted(folders, key=lambda v: (v is None, str(v)))
    if not touched:
        return []
    named = [v for v in touched if v is not None]
    inside = F.col(partition).isin(*named) if named else F.lit(False)
    if None in touched:
        inside = inside | F.col(partition).isNull()
    # written elsewhere first: a table cannot be overwritten while it is read
    left = written(table.where(inside).join(gone, key, "left_anti"), "rewritten")
    full = {r[0] for r in left.select(partition).distinct().collect()}
    left.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        partition).parquet(path)
    for value in set(touched) - full:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(folders[value]))
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return touched


def enum_violations(df: DataFrame, col: str, allowed: Sequence[str] = EMBEDDING_TYPES) -> DataFrame:
    """(value, n) of values outside the enum."""
    return df.where(~F.col(col).isin(*allowed) | F.col(col).isNull()).groupBy(F.col(col).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the number of nulls of each column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def wrong_dimension(embeddings: DataFrame, dim: int) -> DataFrame:
    v = F.col("embedding")
    return embeddings.where(v.isNull() | (F.size(v) != dim))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count), one row per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def health_report(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(object_name, status): OK where the table can be opened, else MISSING."""
    def status(path: str) -> str:
        try:
            spark.read.parquet(path)
            return "OK"
        except AnalysisException:
            return "MISSING"

    return spark.createDataFrame([(n, status(p)) for n, p in paths.items()], "object_name string, status string")


def embedding_summary(embeddings: DataFrame, approximate: bool = False) -> DataFrame:
    """Vectors and distinct cases of each embedding type."""
    distinct = F.approx_count_distinct("case_id") if approximate else F.countDistinct("case_id")
    return embeddings.groupBy("embedding_type").agg(
        F.count(F.lit(1)).alias("total_embeddings"), distinct.alias("unique_cases"))


def count_by_type(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("embedding_type").agg(F.count(F.lit(1)).alias("n"))
