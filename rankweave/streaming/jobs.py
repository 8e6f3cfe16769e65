"""Structured Streaming jobs over the query log and the case table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankweave.functions.text import STOP_WORDS, compose_text
from rankweave.operators.analytics import rate_violations
from rankweave.operators.embed import embed
from rankweave.operators.keyword import (
    POSTINGS, TERM_BUCKETS, KeywordIndex, build_postings, case_lengths, write_postings, write_vocabulary,
)
from rankweave.schemas import INDEXED_FIELDS
from rankweave.session import written
from rankweave.sources.tables import one_per_key, read_or_empty


def stream_usage(logs: DataFrame, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window_start, query_type, n) per tumbling window; a window appears once it is closed."""
    return (
        logs.withWatermark("created_at", watermark)
        .groupBy(F.window("created_at", window).alias("w"), "query_type").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "query_type", "n")
    )


def stream_rate_violations(logs: DataFrame, limit: int = 10, window: str = "1 minute",
                           watermark: str = "10 minutes") -> DataFrame:
    """`rate_violations` on a stream; a window appears once it is closed, the last ones stay open."""
    return rate_violations(logs.withWatermark("created_at", watermark), limit, window)


SLIDING_STATE = "times array<long>, ids array<long>, told array<boolean>"


def stream_sliding_violations(logs: DataFrame, limit: int = 10, window_seconds: int = 60, watermark: str = "10 minutes"
                              ) -> DataFrame:
    """(id, user_id, created_at): `sliding_violations` on a stream, each call told once, as soon as it is one too many.

    The state of a user holds the calls that a call within the watermark can still meet, by
    event time; a timer drops them. A late call is counted for the calls after it, which may
    make those one too many: they are told then. Nothing waits for the watermark, so the last
    calls of a stream are judged as well. Calls behind the watermark are left out.
    """
    span = window_seconds * 1_000_000

    def micros(column) -> np.ndarray:
        return column.astype("datetime64[us]").astype("int64").to_numpy()

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ids, told = (np.array(x, kind) for x, kind in zip(
            state.get if state.exists else ([], [], []), (np.int64, np.int64, bool), strict=True))
        if not state.hasTimedOut:
            for batch in batches:
                times, ids = np.r_[times, micros(batch["created_at"])], np.r_[ids, batch["id"].to_numpy(np.int64)]
                told = np.r_[told, np.zeros(len(batch), bool)]
            order = np.lexsort((ids, times))
            times, ids, told = times[order], ids[order], told[order]
            breach = np.zeros(len(times), bool)
            breach[limit:] = times[limit:] - times[:len(times) - limit] <= span
            new = breach & ~told
            told |= breach
            if new.any():
                yield pd.DataFrame({"id": ids[new], "user_id": key[0], "created_at": times[new].astype("datetime64[us]")})
        behind = state.getCurrentWatermarkMs() * 1000
        kept = times >= behind - span
        if kept.any():
            state.update((times[kept].tolist(), ids[kept].tolist(), told[kept].tolist()))
            state.setTimeoutTimestamp(max(int(times[kept].min() + span) // 1000, behind // 1000) + 1)
        elif state.exists:
            state.remove()

    user = logs.schema["user_id"].dataType.simpleString()
    rows = logs.withWatermark("created_at", watermark).select("user_id", "id", "created_at")
    return rows.groupBy("user_id").applyInPandasWithState(
        judge, f"id long, user_id {user}, created_at timestamp_ntz", SLIDING_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def to_parquet(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> DataStreamWriter:
    """An append sink that takes what is there and stops; drop the trigger to keep running."""
    writer = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )
    return writer.partitionBy(*partition_by) if partition_by else writer


def stream_append_log(logs: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append log rows once per id, by day, however late they come.

    A micro-batch writes its own folder batch_id=N and leaves out ids that earlier batches
    have stored for the same days; a row that comes again carries the same time. Of repeats in
    one batch the latest stays. A replayed batch overwrites its own folder.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        rows = one_per_key(batch, ["id"], "created_at").withColumn("event_date", F.to_date("created_at"))
        schema = rows.select("id", "event_date").schema.add("batch_id", T.IntegerType())
        rows = written(rows, "log-batch")
        days = [r[0] for r in rows.select("event_date").distinct().collect()]                  # a row per day
        stored = read_or_empty(batch.sparkSession, path, schema).where(F.col("batch_id") < batch_id)
        earlier = stored.where(F.col("event_date").isin(*days)).select("id")
        rows.join(earlier, "id", "left_anti").write.mode("overwrite").partitionBy("event_date").parquet(
            f"{path}/batch_id={batch_id}")

    return logs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)


# ---- incremental text index ----
#
# Each micro-batch writes its own folder batch_id=N of postings, vocabulary and case versions
# and touches no earlier one, so a batch costs what it brings, and a replayed batch overwrites
# its own folder. Readers take, per case, the greatest version, whichever batch brought it.


def write_index_batch(cases: DataFrame, batch_id: int, path: str, fields: Sequence[str], order_col: str,
                      stop_words: Sequence[str] = STOP_WORDS, buckets: int = TERM_BUCKETS,
                      deleted_col: str | None = None) -> None:
    """Index the cases of one micro-batch; of several versions of a case the one greatest by `order_col` counts.

    A row whose `deleted_col` is true takes its case out of the index.
    """
    gone = F.coalesce(F.col(deleted_col), F.lit(False)) if deleted_col else F.lit(False)
    version = F.struct(F.col(order_col).alias("version"), gone.alias("deleted"), *fields)
    newest = cases.groupBy("case_id").agg(F.max(version).alias("c")).select("case_id", "c.*")
    newest = written(newest, "newest")
    live = newest.where("NOT deleted").select("case_id", *fields)
    folder = f"{path}/postings/batch_id={batch_id}"
    write_postings(build_postings(live, fields, stop_words, buckets, lengths=True), folder)
    spark = cases.sparkSession
    terms = read_or_empty(spark, folder, STORED_TERMS).where("term_bucket >= 0")
    terms.distinct().write.mode("overwrite").parquet(f"{path}/vocabulary/batch_id={batch_id}")
    # The versions come last: they make the finished postings visible.
    lens = case_lengths(spark.read.schema(POSTINGS + ", term_bucket int").parquet(folder))
    newest.select("case_id", "version", "deleted").join(lens, "case_id", "left").write.mode("overwrite").parquet(
        f"{path}/versions/batch_id={batch_id}")


STORED_TERMS = T.StructType([T.StructField("term_bucket", T.IntegerType()), T.StructField("term", T.StringType())])
STREAMED_POSTINGS = POSTINGS + ", term_bucket int, batch_id long"


def stream_index(cases: DataFrame, path: str, checkpoint: str, fields: Sequence[str] = INDEXED_FIELDS,
                 order_col: str = "updated_date", stop_words: Sequence[str] = STOP_WORDS,
                 buckets: int = TERM_BUCKETS, deleted_col: str | None = None) -> DataStreamWriter:
    """Keep the text index up to date with a stream of new, changed and deleted cases."""
    def each(batch: DataFrame, batch_id: int) -> None:
        write_index_batch(batch, batch_id, path, fields, order_col, stop_words, buckets, deleted_col)

    return cases.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _current(versions: DataFrame) -> DataFrame:
    """(case_id, batch_id, lens) of the cases that are there now."""
    newest = versions.groupBy("case_id").agg(F.max(F.struct("version", "batch_id", "deleted", "lens")).alias("v"))
    return newest.where("NOT v.deleted").select("case_id", "v.batch_id", "v.lens")


def read_stream_index(spark: SparkSession, path: str, fields: Sequence[str] = INDEXED_FIELDS,
                      stop_words: Sequence[str] = STOP_WORDS, buckets: int = TERM_BUCKETS) -> KeywordIndex:
    """The index as of now. A search looks only at the versions of the cases it has matched."""
    versions = spark.read.parquet(f"{path}/versions")
    postings = spark.read.schema(STREAMED_POSTINGS).parquet(f"{path}/postings").where("term_bucket >= 0")
    vocabulary = read_or_empty(spark, f"{path}/vocabulary", STORED_TERMS).distinct()
    return KeywordIndex(tuple(fields), tuple(stop_words), postings=postings,
                        lengths=_current(versions).select("case_id", "lens"), vocabulary=vocabulary, buckets=buckets,
                        versions=versions)


def compact_index(spark: SparkSession, path: str, target: str, buckets: int = TERM_BUCKETS) -> None:
    """Rewrite a streamed index without superseded postings and deleted cases, as `read_index` reads it."""
    current = _current(spark.read.parquet(f"{path}/versions"))
    postings = spark.read.schema(STREAMED_POSTINGS).parquet(f"{path}/postings")
    kept = postings.join(current.select("case_id", "batch_id"), ["case_id", "batch_id"], "left_semi")
    write_postings(kept.drop("batch_id"), f"{target}/postings")
    write_vocabulary(spark.read.schema(POSTINGS + ", term_bucket int").parquet(f"{target}/postings"), target)
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{target}/settings")


# ---- incremental embedding ----

KEY_BUCKETS = 64


def stream_embeddings(cases: DataFrame, path: str, checkpoint: str, embedding_type: str, embedder,
                      now: Column) -> DataStreamWriter:
    """Embed cases that have no vector of this type yet; one folder per micro-batch.

    The keys of stored vectors are kept beside them by a hash of the case id; a batch reads the
    buckets of its own ids only, named as literals. Of rows that repeat a case id the greatest is embedded.
    """
    def bucket(case_id: str) -> Column:
        return F.pmod(F.xxhash64(case_id), F.lit(KEY_BUCKETS)).cast("int")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keys = spark.createDataFrame([], "case_id long, embedding_type string, batch_id int, bucket int").schema
        rows = one_per_key(batch, ["case_id"]).withColumn("bucket", bucket("case_id"))
        stored = read_or_empty(spark, f"{path}/_keys", keys)
        rows = written(rows, "case-batch")
        own = [r[0] for r in rows.select("bucket").distinct().collect()]                       # at most KEY_BUCKETS
        have = stored.where((F.col("batch_id") < batch_id) & (F.col("embedding_type") == embedding_type)
                            & F.col("bucket").isin(*own))
        todo = rows.join(have.select("bucket", "case_id"), ["bucket", "case_id"], "left_anti")
        texts = todo.select("case_id", compose_text(embedding_type).alias("text")).where("text IS NOT NULL")
        folder = f"{path}/batch_id={batch_id}"
        embed(texts, "text", embedder).select(
            "case_id", F.lit(embedding_type).alias("embedding_type"), "embedding",
            F.lit(embedder.model_name).alias("model_used"), now.alias("created_date"),
        ).write.mode("overwrite").parquet(folder)
        spark.read.parquet(folder).select("case_id", "embedding_type", bucket("case_id").alias("bucket")).write.mode(
            "overwrite").partitionBy("bucket").parquet(f"{path}/_keys/batch_id={batch_id}")

    return cases.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)
