"""Query-log analytics: KPIs, usage, exact nearest-rank percentiles, log lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankweave.operators.topk import check_page, page
from rankweave.session import written


def check_days(days: int) -> None:
    if not 1 <= days <= 365:
        raise ValueError("days must be between 1 and 365")


def last_days(logs: DataFrame, days: int, now: Column) -> DataFrame:
    """Rows of the last `days` x 24 hours before `now`."""
    check_days(days)
    since = now - F.make_dt_interval(F.lit(days))
    logs = logs.where(F.col("created_at") >= since)
    if "event_date" in logs.columns:
        logs = logs.where(F.col("event_date") >= F.to_date(since))
    return logs


def since_midnight(now: Column) -> Column:
    return F.col("created_at") >= F.date_trunc("day", now)


def filter_logs(logs: DataFrame, status: str | None = None, query_type: str | None = None) -> DataFrame:
    if status:
        logs = logs.where(F.col("status") == status)
    if query_type:
        logs = logs.where(F.col("query_type") == query_type)
    return logs


def overview(logs: DataFrame, cases: DataFrame, now: Column) -> DataFrame:
    """Dashboard row over the whole log, in one scan of it."""
    total = F.count(F.lit(1))
    rate = F.try_divide(F.count_if(F.col("status") == "success") * F.lit(100.0), total)
    kpis = logs.agg(
        F.count_if(since_midnight(now)).alias("queries_today"),
        total.alias("total_queries"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 1).alias("avg_latency_ms"),
        F.round(F.coalesce(rate, F.lit(100.0)), 1).alias("success_rate"),
    )
    n_cases = cases.agg(F.count(F.lit(1)).alias("n")).scalar()
    return kpis.withColumn("case_count", n_cases)


def _day() -> Column:
    return F.date_format("created_at", "yyyy-MM-dd")


def usage_daily(logs: DataFrame, days: int, now: Column) -> DataFrame:
    """(date, count); days without rows are absent."""
    return last_days(logs, days, now).groupBy(_day().alias("date")).agg(F.count(F.lit(1)).alias("count"))


def usage_by_type(logs: DataFrame, days: int, now: Column) -> DataFrame:
    counted = last_days(logs, days, now).groupBy("query_type").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.lit("").alias("date"), "count", "query_type")


def usage_report(logs: DataFrame, days: int, now: Column) -> DataFrame:
    """Daily and by-type series together: one scan, counted per (day, type) first, so the
    grouping sets only expand those few rows."""
    fine = last_days(logs, days, now).groupBy(_day().alias("day"), "query_type").agg(F.count(F.lit(1)).alias("n"))
    sets = fine.groupingSets([[F.col("day")], [F.col("query_type")]], F.col("day"), F.col("query_type"))
    return sets.agg(F.sum("n").alias("count")).select(
        F.coalesce("day", F.lit("")).alias("date"), "count", "query_type")


def status_counts(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count_if(F.col("status") == "error").alias("error_count"),
        F.count_if(F.col("status") == "success").alias("success_count"),
    )


def _histogram(df: DataFrame, col: str, *also: str) -> DataFrame:
    """(v, n, *also): how often each value occurs, counted where the rows lie first."""
    return df.groupBy(F.col(col).alias("v"), *also).agg(F.count(F.lit(1)).alias("n"))


def _percentiles(hist: DataFrame, ps: Sequence[float]) -> DataFrame:
    """(p, value) from a histogram; null values are left out.

    The element at index min(int(N * p), N - 1) of the sorted values is the smallest value
    whose running count passes that index. Spark deals the distinct values into ranges by
    sampled splitters; running counts go over the ranges, and only the ranges that hold an
    asked index are numbered value by value, each on its own. No task sees more than a range.
    NaN sorts above infinity.
    """
    known = hist.where("v IS NOT NULL").groupBy("v").agg(F.sum("n").alias("n"))
    ranged = written(known.repartitionByRange("v").withColumn("range", F.spark_partition_id()), "ranges")
    per_range = ranged.groupBy("range").agg(F.sum("n").alias("rn"))
    running = W.orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    everything = W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    asked = F.array(*[F.struct(F.lit(float(p)).alias("p")) for p in ps])
    total = F.col("total")
    wanted = (
        per_range.withColumn("upto", F.sum("rn").over(running)).withColumn("total", F.sum("rn").over(everything))
        .select("range", "rn", "upto", "total", F.inline(asked))
        .withColumn("target", F.least(F.floor(total * F.col("p")), total - 1))
        .where((F.col("target") < F.col("upto")) & (F.col("target") >= F.col("upto") - F.col("rn")))
        .select("range", "p", "target", (F.col("upto") - F.col("rn")).alias("before"))
    )
    # One row per asked percentile, hence broadcast.
    inside = ranged.join(F.broadcast(wanted), "range")
    order = W.partitionBy("p").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    at = F.col("before") + F.sum("n").over(order)
    return (
        inside.withColumn("at", at).where(F.col("at") > F.col("target"))
        .groupBy("p").agg(F.min("v").cast("double").alias("value"))
    )


def percentile_nearest(df: DataFrame, col: str, ps: Sequence[float]) -> DataFrame:
    """(p, value): exact nearest-rank percentiles of the non-null values; 0.0 when there are none."""
    found = _percentiles(_histogram(df, col), ps)
    asked = df.sparkSession.createDataFrame([(float(p),) for p in ps], "p double")
    return asked.join(F.broadcast(found), "p", "left").select("p", F.coalesce("value", F.lit(0.0)).alias("value"))


def percentile_approximate(df: DataFrame, col: str, ps: Sequence[float], accuracy: int = 10000) -> DataFrame:
    """(p, value) within a relative rank error of 1 / accuracy, in one aggregation."""
    sketch = df.agg(F.percentile_approx(col, [float(p) for p in ps], accuracy).alias("vs"))
    pairs = F.arrays_zip(F.lit([float(p) for p in ps]).alias("p"), F.col("vs").alias("value"))
    return sketch.select(F.inline(pairs)).toDF("p", "value").select("p", F.col("value").cast("double").alias("value"))


def performance(logs: DataFrame, days: int, now: Column) -> DataFrame:
    """Average, p50, p95 of latency and the status counts of the last days.

    The log is scanned once into a histogram over (latency, status); every figure comes
    from that. Averages and percentiles skip null latencies, the counts do not.
    """
    hist = written(_histogram(last_days(logs, days, now), "latency_ms", "status"), "latencies")
    known, n = F.col("v").isNotNull(), F.col("n")
    sums = hist.agg(
        F.sum(F.when(known, F.col("v") * n)).alias("ms"), F.sum(F.when(known, n)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("status") == "error", n)), F.lit(0)).alias("error_count"),
        F.coalesce(F.sum(F.when(F.col("status") == "success", n)), F.lit(0)).alias("success_count"),
    )
    points = _percentiles(hist, (0.5, 0.95)).agg(
        F.struct(F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("p50"),
                 F.max(F.when(F.col("p") == 0.95, F.col("value"))).alias("p95")).alias("s")).scalar()
    zero = F.lit(0.0)
    return sums.withColumn("s", points).select(
        F.round(F.coalesce(F.try_divide(F.col("ms"), F.col("rows")), zero), 1).alias("avg_latency_ms"),
        F.coalesce("s.p50", zero).alias("p50_latency_ms"), F.coalesce("s.p95", zero).alias("p95_latency_ms"),
        "error_count", "success_count",
    )


def with_user(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Log rows with `user_email`, null where the user is gone."""
    emails = users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email"))
    return rows.join(emails, "user_id", "left")


def logs_page(logs: DataFrame, users: DataFrame, number: int = 1, size: int = 20, status: str | None = None,
              query_type: str | None = None) -> DataFrame:
    """One page of the log, newest first, with user emails.

    The page is cut first: its rows, at most 100, pick the users, so neither table shuffles.
    """
    check_page(number, size)
    rows = page(filter_logs(logs, status, query_type), number, size)
    ids = rows.select("user_id").distinct()
    emails = users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email")).join(
        F.broadcast(ids), "user_id")
    return rows.join(F.broadcast(emails), "user_id", "left").orderBy(F.desc("created_at"), F.desc("id"))


def rate_violations(logs: DataFrame, limit: int = 10, window: str = "1 minute") -> DataFrame:
    """(user_id, window_start, n): users above `limit` calls in a tumbling window.

    Works on a batch and on a stream; counting is partial before the shuffle, so one user
    with most of the calls is no hot spot.
    """
    return (
        logs.groupBy("user_id", F.window("created_at", window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > limit)
        .select("user_id", F.col("w.start").alias("window_start"), "n")
    )


def sliding_violations(logs: DataFrame, limit: int = 10, window: str = "1 minute") -> DataFrame:
    """(id, user_id, created_at) of the calls that have more than `limit` calls of their user within the window that ends with them.

    Calls are ordered by (created_at, id). A call is one too many when the call `limit` places
    before it is no older than the window, so no frame is summed.
    """
    order = W.partitionBy("user_id").orderBy("created_at", "id")
    rows = logs.withColumn("before", F.lag("created_at", limit).over(order))
    return rows.where(F.col("before") >= F.col("created_at") - F.expr(f"INTERVAL {window}")).select("id", "user_id", "created_at")


# ---- stored sketches of latencies ----

#: size of a latency sketch; merged ones answer a rank within this share of all rows
SKETCH_K, SKETCH_ERROR = 1600, 0.01


def latency_sketches(logs: DataFrame) -> DataFrame:
    """A row per day and query type: counts, latency sum and a mergeable KLL sketch of the latencies.

    Sketches are built where the rows lie and merged after the shuffle, however hot a day is.
    """
    known = F.col("latency_ms").isNotNull()
    return logs.groupBy(F.to_date("created_at").alias("event_date"), "query_type").agg(
        F.kll_sketch_agg_bigint(F.col("latency_ms").cast("long"), SKETCH_K).alias("sketch"),
        F.count(F.lit(1)).alias("n"), F.count_if(known).alias("n_latency"), F.sum("latency_ms").alias("ms"),
        F.count_if(F.col("status") == "error").alias("error_count"))


def write_sketches(logs: DataFrame, path: str) -> None:
    """Store the sketches of whole days; a day that is written again replaces itself and no other."""
    rows = written(latency_sketches(logs), "sketches")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)


def sketch_report(sketches: DataFrame, ps: Sequence[float], since: Column | None = None, until: Column | None = None,
                  by: Sequence[str] = ()) -> DataFrame:
    """(*by, p, value, n, error_count, avg_latency_ms) from stored sketches only, the log is not read.

    A value's rank lies within SKETCH_ERROR of the asked one. Days are taken from `since` to
    `until`, both included. Groups without a latency have no row.
    """
    if since is not None:
        sketches = sketches.where(F.col("event_date") >= since)
    if until is not None:
        sketches = sketches.where(F.col("event_date") <= until)
    merged = sketches.where("n_latency > 0").groupBy(*by).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))
    counts = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("error_count").alias("error_count"),
                                       F.round(F.try_divide(F.sum("ms"), F.sum("n_latency")), 1).alias("avg_latency_ms"))
    asked = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(p))).alias("value"))
                      for p in ps])
    points = merged.where(F.kll_sketch_get_n_bigint("sketch") > 0).select(*by, F.inline(asked))
    if by:
        return points.join(counts, list(by)).select(*by, "p", "value", "n", "error_count", "avg_latency_ms")
    total = counts.select(F.struct("*").alias("t")).scalar()
    return points.withColumn("t", total).select("p", "value", "t.n", "t.error_count", "t.avg_latency_ms")
