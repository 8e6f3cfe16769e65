"""Registered query-log reports and streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.text import display_text, display_user, latency_label
from rankweave.operators import analytics, keyword
from rankweave.operators.embed import HashEmbedder
from rankweave.operators.topk import page, page_after, page_totals
from rankweave.plans import sql
from rankweave.plans.registry import query
from rankweave.plans.corpus import _long, _vector_sql
from rankweave.plans.retrieval import CONDITION, _kw_sql
from rankweave.plans.tables import DIM, NOW, TEXT_FIELDS, cases, logs, now, users
from rankweave.session import run_dir
from rankweave.sources import tables
from rankweave.streaming import jobs

RECENT = f"{sql.LOGS}, recent AS (SELECT * FROM logs WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY)"


def nearest(p: float, source: str, col: str = "latency_ms") -> str:
    """Smallest value at index min(floor(n * p), n - 1) of the sorted values."""
    return (f"(SELECT v::DOUBLE FROM (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) - 1 AS i, count(*) OVER () AS n "
            f"FROM {source} WHERE {col} IS NOT NULL) WHERE i = least(floor(n * {p}::DOUBLE), n - 1))")


@query("overview", f"""
WITH {sql.LOGS}
SELECT count(*) FILTER (created_at >= date_trunc('day', TIMESTAMP '{NOW}')) AS queries_today, count(*) AS total_queries,
       round(coalesce(avg(latency_ms), 0), 1) AS avg_latency_ms,
       round(coalesce(count(*) FILTER (status = 'success') * 100.0::DOUBLE / nullif(count(*), 0), 100), 1) AS success_rate,
       (SELECT count(*) FROM documents) AS case_count FROM logs""")
def overview(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.overview(logs(spark, folder), cases(spark, folder), now())


@query("usage_daily", f"""
WITH {RECENT} SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS count FROM recent GROUP BY 1""")
def usage_daily(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.usage_daily(logs(spark, folder), 20, now())


@query("usage_by_type", f"""
WITH {RECENT} SELECT '' AS date, count(*) AS count, query_type FROM recent GROUP BY query_type""")
def usage_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.usage_by_type(logs(spark, folder), 20, now())


@query("usage_report", f"""
WITH {RECENT}
SELECT coalesce(strftime(d, '%Y-%m-%d'), '') AS date, count(*) AS count, query_type
FROM (SELECT created_at::DATE AS d, query_type FROM recent) GROUP BY GROUPING SETS ((d), (query_type))""")
def usage_report(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.usage_report(logs(spark, folder), 20, now())


@query("performance", f"""
WITH {RECENT}
SELECT round(coalesce(avg(latency_ms), 0), 1) AS avg_latency_ms, {nearest(0.5, 'recent')} AS p50_latency_ms,
       {nearest(0.95, 'recent')} AS p95_latency_ms, count(*) FILTER (status = 'error') AS error_count,
       count(*) FILTER (status = 'success') AS success_count FROM recent""")
def performance(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.performance(logs(spark, folder), 20, now())


@query("latency_percentiles", f"WITH {sql.LOGS} " + " UNION ALL ".join(
    f"SELECT {p}::DOUBLE AS p, {nearest(p, 'logs')} AS value" for p in (0.0, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0)))
def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.percentile_nearest(logs(spark, folder), "latency_ms", (0.0, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0))


@query("price_percentiles", " UNION ALL ".join(
    f"SELECT {p}::DOUBLE AS p, {nearest(p, 'lineitem', 'l_extendedprice')} AS value" for p in (0.01, 0.5, 0.95)))
def price_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return analytics.percentile_nearest(lines, "l_extendedprice", (0.01, 0.5, 0.95))


@query("approximate_percentiles", "SELECT p::DOUBLE AS p, true AS within_bound FROM (VALUES (0.5), (0.95)) AS t(p)")
def approximate_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the rank of each approximate percentile is within its bound of the asked rank."""
    values = logs(spark, folder).select("latency_ms").where("latency_ms IS NOT NULL")
    found = analytics.percentile_approximate(values, "latency_ms", (0.5, 0.95), 1000)
    ranks = values.join(F.broadcast(found)).groupBy("p").agg(
        F.avg((F.col("latency_ms") < F.col("value")).cast("double")).alias("below"),
        F.avg((F.col("latency_ms") <= F.col("value")).cast("double")).alias("upto"))
    bound = F.lit(1 / 1000 + 1e-9)
    return ranks.select("p", ((F.col("below") <= F.col("p") + bound) & (F.col("upto") >= F.col("p") - bound)).alias("within_bound"))


@query("status_counts", f"""
WITH {sql.LOGS}
SELECT count(*) FILTER (status = 'error') AS error_count, count(*) FILTER (status = 'success') AS success_count FROM logs""")
def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.status_counts(logs(spark, folder))


PAGED = "id, user_id, c_name AS user_email, query_type, patient_description, latency_ms, status, created_at"
LOG_COLS = ["id", "user_id", "user_email", "query_type", "patient_description", "latency_ms", "status", "created_at"]


@query("logs_page", f"""
WITH {sql.LOGS} SELECT {PAGED} FROM logs LEFT JOIN customer ON c_custkey = user_id
ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20""")
def logs_page(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.logs_page(logs(spark, folder), users(spark, folder), 2, 20).select(*LOG_COLS)


@query("logs_filtered_page", f"""
WITH {sql.LOGS} SELECT {PAGED} FROM logs LEFT JOIN customer ON c_custkey = user_id
WHERE status = 'success' AND query_type = 'purchase' ORDER BY created_at DESC, id DESC LIMIT 50""")
def logs_filtered_page(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.logs_page(logs(spark, folder), users(spark, folder), 1, 50, "success", "purchase").select(*LOG_COLS)


@query("logs_page_after", f"""
WITH {sql.LOGS} SELECT id, created_at, status FROM logs WHERE created_at < TIMESTAMP '{NOW}' ORDER BY created_at DESC, id DESC LIMIT 20""")
def logs_page_after(spark: SparkSession, folder: str) -> DataFrame:
    rows = logs(spark, folder)
    return page_after(rows, now(), 0, 20).select("id", "created_at", "status")


@query("recent_logs", f"""
WITH {sql.LOGS} SELECT id, query_type, status FROM logs ORDER BY created_at DESC, id DESC LIMIT 6""")
def recent_logs(spark: SparkSession, folder: str) -> DataFrame:
    return page(logs(spark, folder), 1, 6).select("id", "query_type", "status")


@query("page_totals", f"""
WITH {sql.LOGS} SELECT count(*) AS total, greatest(1, ceil(count(*) / 30.0))::BIGINT AS total_pages FROM logs WHERE status = 'error'""")
def page_total(spark: SparkSession, folder: str) -> DataFrame:
    return page_totals(analytics.filter_logs(logs(spark, folder), status="error"), 30)


@query("log_display", f"""
WITH {sql.LOGS}
SELECT id, coalesce(c_name, 'user #' || user_id) AS shown_user,
       CASE WHEN length(patient_description) > 7 THEN rtrim(patient_description[1:7], ' ') || '…' ELSE patient_description END AS shown_text,
       CASE WHEN latency_ms < 1000 THEN latency_ms || ' ms' ELSE (latency_ms + 5) // 1000 || '.' || lpad(((latency_ms + 5) // 10 % 100)::VARCHAR, 2, '0') || ' s' END AS shown_latency
FROM logs LEFT JOIN customer ON c_custkey = user_id""")
def log_display(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.with_user(logs(spark, folder), users(spark, folder)).select(
        "id", display_user().alias("shown_user"), display_text(7).alias("shown_text"),
        latency_label(F.col("latency_ms")).alias("shown_latency"))


@query("rate_violations", """
SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 4""")
def rate_violations(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.rate_violations(logs(spark, folder), 4, "1 day")


@query("rate_violations_minute", """
SELECT user_id, date_trunc('minute', ts) AS window_start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1""")
def rate_violations_minute(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.rate_violations(logs(spark, folder), 1)


SLIDING_SQL = """
SELECT event_id AS id, user_id, ts AS created_at FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts
  RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 3"""


@query("rate_sliding", SLIDING_SQL)
def rate_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.sliding_violations(logs(spark, folder), 3, "2 days")


@query("latency_sketch_report", f"""
WITH {sql.LOGS} SELECT p::DOUBLE AS p, count(*) AS n, count(*) FILTER (status = 'error') AS error_count,
  round(avg(latency_ms), 1) AS avg_latency_ms, true AS within_bound
FROM logs, (VALUES (0.5), (0.95), (0.99)) AS t(p) WHERE created_at::DATE >= DATE '2024-01-10' GROUP BY p""")
def latency_sketch_report(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of the last days from stored sketches; whether their rank in the log is within the bound."""
    rows, path = logs(spark, folder), run_dir(spark, "sketches")
    analytics.write_sketches(rows, path)
    since = F.lit("2024-01-10").cast("date")
    report = analytics.sketch_report(spark.read.parquet(path), (0.5, 0.95, 0.99), since=since)
    asked = {r["p"]: r["value"] for r in report.collect()}                                     # three rows
    recent = rows.where((F.to_date("created_at") >= since) & F.col("latency_ms").isNotNull())
    ranks = recent.agg(F.array(*[F.struct(
        F.lit(p).alias("p"), F.avg((F.col("latency_ms") < v).cast("double")).alias("below"),
        F.avg((F.col("latency_ms") <= v).cast("double")).alias("upto")) for p, v in asked.items()]).alias("r"))
    bound = F.lit(analytics.SKETCH_ERROR)
    checked = ranks.select(F.inline("r")).select("p", (
        (F.col("below") <= F.col("p") + bound) & (F.col("upto") >= F.col("p") - bound)).alias("within_bound"))
    return report.drop("value").join(checked, "p")


# ---- streams: the given files arrive as a stream, the job runs until it has read them ----


def _log_stream(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read_table_stream(spark, folder, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("query_type"),
        F.round(F.col("value") * 100).cast("long").alias("latency_ms"), F.col("ts").cast("timestamp").alias("created_at"))


def _run_to_parquet(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    path = run_dir(spark, label)
    jobs.to_parquet(stream, f"{path}/out", f"{path}/checkpoint").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _closed(watermark: str, window: str) -> str:
    """Windows that end by the newest event minus the watermark."""
    return (f"time_bucket(INTERVAL {window}, ts) + INTERVAL {window} <= "
            f"(SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL {watermark}")


@query("stream_usage", f"""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type AS query_type, count(*) AS n FROM events
WHERE {_closed('1 HOUR', '1 DAY')} GROUP BY ALL""")
def stream_usage(spark: SparkSession, folder: str) -> DataFrame:
    counted = _run_to_parquet(spark, jobs.stream_usage(_log_stream(spark, folder)), "usage")
    return counted.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_rate_violations", f"""
SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events
WHERE {_closed('10 MINUTE', '1 HOUR')} GROUP BY ALL HAVING count(*) > 1""")
def stream_rate(spark: SparkSession, folder: str) -> DataFrame:
    stream = jobs.stream_rate_violations(_log_stream(spark, folder), 1, "1 hour")
    found = _run_to_parquet(spark, stream, "rate")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_rate_sliding", SLIDING_SQL)
def stream_rate_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Told at the breach: equal to the batch, the last calls included."""
    stream = jobs.stream_sliding_violations(_log_stream(spark, folder), 3, 2 * 86400)
    return _run_to_parquet(spark, stream, "sliding")


@query("stream_append_log", """
SELECT event_id AS id, user_id, event_type AS query_type, round(value * 100)::BIGINT AS latency_ms, ts::DATE AS event_date FROM events""")
def stream_append(spark: SparkSession, folder: str) -> DataFrame:
    path = run_dir(spark, "append")
    jobs.stream_append_log(_log_stream(spark, folder), f"{path}/log", f"{path}/checkpoint").start().awaitTermination()
    return spark.read.parquet(f"{path}/log").select("id", "user_id", "query_type", "latency_ms", "event_date")


def _streamed(spark: SparkSession, folder: str) -> str:
    """The path of an index that a stream of all documents has filled."""
    documents = tables.read_table_stream(spark, folder, "documents")
    arriving = documents.select(F.col("doc_id").alias("case_id"), F.col("text").alias("treatment_plan"),
                                F.col("n_chars").alias("updated_date"))
    path = run_dir(spark, "stream-index")
    jobs.stream_index(arriving, path, f"{path}/checkpoint", TEXT_FIELDS, buckets=16).start().awaitTermination()
    return path


@query("stream_index_search", _kw_sql(CONDITION))
def stream_index_search(spark: SparkSession, folder: str) -> DataFrame:
    index = jobs.read_stream_index(spark, _streamed(spark, folder), TEXT_FIELDS, buckets=16)
    return keyword.keyword_search(index, CONDITION)


@query("compact_index", _kw_sql(CONDITION))
def compact_index(spark: SparkSession, folder: str) -> DataFrame:
    target = run_dir(spark, "compact-index")
    jobs.compact_index(spark, _streamed(spark, folder), target, buckets=16)
    return keyword.keyword_search(keyword.read_index(spark, target, TEXT_FIELDS), CONDITION)


@query("stream_index_deletes", _kw_sql(CONDITION).replace("FROM documents)", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"))
def stream_index_deletes(spark: SparkSession, folder: str) -> DataFrame:
    """All documents arrive, then the labelled ones are deleted and an old version of each comes late."""
    path = _streamed(spark, folder)
    gone = spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias("case_id"))
    rows = spark.read.parquet(f"{folder}/documents.parquet").select(
        F.col("doc_id").alias("case_id"), F.col("text").alias("treatment_plan"), F.col("n_chars").alias("updated_date"))
    deletes = rows.join(gone, "case_id", "left_semi").select(
        "case_id", "treatment_plan", (F.col("updated_date") + 1).alias("updated_date"), F.lit(True).alias("is_deleted"))
    late = rows.select("case_id", F.lit("thtion onen").alias("treatment_plan"), (F.col("updated_date") - 1).alias("updated_date"),
                       F.lit(False).alias("is_deleted"))
    jobs.write_index_batch(deletes, 100, path, TEXT_FIELDS, "updated_date", buckets=16, deleted_col="is_deleted")
    jobs.write_index_batch(late, 101, path, TEXT_FIELDS, "updated_date", buckets=16, deleted_col="is_deleted")
    return keyword.keyword_search(jobs.read_stream_index(spark, path, TEXT_FIELDS, buckets=16), CONDITION)


@query("stream_embeddings", _vector_sql(sql.hashed("v", "cases", "case_id", "'Diagnosis: ' || diagnosis")))
def stream_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    documents = tables.read_table_stream(spark, folder, "documents")
    arriving = documents.select(F.col("doc_id").alias("case_id"), F.col("source").alias("diagnosis"))
    path = run_dir(spark, "stream-vectors")
    job = jobs.stream_embeddings(arriving, f"{path}/out", f"{path}/checkpoint", "DiagnosisOnly", HashEmbedder(DIM), now())
    job.start().awaitTermination()
    return _long(spark.read.parquet(f"{path}/out"))
