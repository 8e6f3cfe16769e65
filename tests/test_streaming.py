import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rankweave.operators.analytics import rate_violations, sliding_violations
from rankweave.operators.embed import HashEmbedder
from rankweave.operators.keyword import keyword_scan, keyword_search, read_index
from rankweave.sources.tables import read_or_empty as jobs_read
from rankweave.sources.tables import read_table_stream
from rankweave.streaming import jobs
from tests.conftest import plan_of, rows_of

LOG = "id long, user_id long, query_type string, latency_ms long, created_at timestamp"
DAY = dt.datetime(2024, 5, 1)


def feed(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture()
def log_dir(spark, tmp_path):
    rows = [(i, i % 3, ["rag", "vector"][i % 2], 10 * i, DAY + dt.timedelta(hours=5 * i)) for i in range(20)]
    feed(spark, rows, LOG, tmp_path / "in")
    return tmp_path


def stream(spark, folder, schema=LOG):
    return spark.readStream.schema(schema).parquet(str(folder / "in"))


def run(writer):
    writer.start().awaitTermination()


def test_usage_equals_batch_after_the_window_closes(spark, log_dir):
    out, ck = str(log_dir / "out"), str(log_dir / "ck")
    job = lambda: run(jobs.to_parquet(jobs.stream_usage(stream(spark, log_dir)), out, ck))
    job()
    batch = spark.read.parquet(str(log_dir / "in")).groupBy(
        F.date_trunc("day", "created_at").alias("window_start"), "query_type").agg(F.count("*").alias("n"))
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] < 20
    # A later event closes every earlier window.
    feed(spark, [(99, 0, "rag", 1, DAY + dt.timedelta(days=30))], LOG, log_dir / "in")
    job()
    assert rows_of(spark.read.parquet(out), "window_start", "query_type") == rows_of(
        batch.where("window_start < DATE '2024-05-20'"), "window_start", "query_type")


def test_rate_violations_equal_batch(spark, tmp_path):
    rows = [(i, 7, "rag", 1, DAY + dt.timedelta(seconds=i)) for i in range(15)]
    rows += [(100, 1, "rag", 1, DAY + dt.timedelta(hours=2))]
    feed(spark, rows, LOG, tmp_path / "in")
    out = str(tmp_path / "out")
    run(jobs.to_parquet(jobs.stream_rate_violations(stream(spark, tmp_path)), out, str(tmp_path / "ck")))
    assert rows_of(spark.read.parquet(out)) == rows_of(rate_violations(spark.read.parquet(str(tmp_path / "in")))) == [(7, DAY, 15)]


def test_log_is_appended_once_per_id(spark, log_dir):
    out, ck = str(log_dir / "log"), str(log_dir / "ck2")
    run(jobs.stream_append_log(stream(spark, log_dir), out, ck))
    # The same rows arrive again, with one new row.
    feed(spark, [(19, 1, "vector", 190, DAY + dt.timedelta(hours=95)), (20, 1, "rag", 5, DAY + dt.timedelta(hours=96))],
         LOG, log_dir / "in")
    run(jobs.stream_append_log(stream(spark, log_dir), out, ck))
    ids = [r.id for r in spark.read.parquet(out).collect()]
    assert sorted(ids) == list(range(21))


def test_late_log_rows_arrive(spark, tmp_path):
    out, ck = str(tmp_path / "log"), str(tmp_path / "ck")
    for rows in ([(2, 1, "rag", 5, DAY + dt.timedelta(days=9))], [(1, 1, "rag", 5, DAY), (2, 1, "rag", 5, DAY + dt.timedelta(days=9))], []):
        if rows:
            feed(spark, rows, LOG, tmp_path / "in")
        run(jobs.stream_append_log(stream(spark, tmp_path), out, ck))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]


CASE = "case_id long, body string, updated_date long"


def test_an_old_version_that_comes_late_changes_nothing(spark, tmp_path):
    for number, row in enumerate([(1, "new text", 9), (1, "stale text", 2)]):
        jobs.write_index_batch(spark.createDataFrame([row], CASE), number, str(tmp_path), ["body"], "updated_date", buckets=4)
    index = jobs.read_stream_index(spark, str(tmp_path), ["body"], buckets=4)
    assert keyword_search(index, "new").count() == 1 and keyword_search(index, "stale").count() == 0


def test_deleted_cases_leave_the_index(spark, tmp_path):
    schema = CASE + ", gone boolean"
    batches = [[(1, "chest pain", 1, False), (2, "pain", 1, None)], [(1, "chest pain", 2, True), (3, "pain pain", 2, False)]]
    for number, rows in enumerate(batches):
        jobs.write_index_batch(spark.createDataFrame(rows, schema), number, str(tmp_path / "ix"), ["body"], "updated_date",
                               buckets=4, deleted_col="gone")
    index = jobs.read_stream_index(spark, str(tmp_path / "ix"), ["body"], buckets=4)
    state = spark.createDataFrame([(2, "pain"), (3, "pain pain")], "case_id long, body string")
    want = rows_of(keyword_scan(state, ["body"], "pain OR chest"), "case_id")
    assert rows_of(keyword_search(index, "pain OR chest"), "case_id") == want
    jobs.compact_index(spark, str(tmp_path / "ix"), str(tmp_path / "flat"), buckets=4)
    assert rows_of(keyword_search(read_index(spark, str(tmp_path / "flat"), ["body"]), "pain OR chest"), "case_id") == want
    only = spark.createDataFrame([(2, "pain", 3, True), (3, "pain", 3, True)], schema)
    jobs.write_index_batch(only, 2, str(tmp_path / "ix"), ["body"], "updated_date", buckets=4, deleted_col="gone")
    assert keyword_search(jobs.read_stream_index(spark, str(tmp_path / "ix"), ["body"], buckets=4), "pain").count() == 0


def index_now(spark, folder):
    run(jobs.stream_index(stream(spark, folder, CASE), str(folder / "ix"), str(folder / "ck"), ["body"], buckets=4))
    return jobs.read_stream_index(spark, str(folder / "ix"), ["body"], buckets=4)


def test_index_follows_changes(spark, tmp_path):
    feed(spark, [(1, "chest pain", 1), (2, "head pain", 1), (3, "old text", 1), (3, "cough", 2)], CASE, tmp_path / "in")
    first = index_now(spark, tmp_path)
    assert sorted(r.case_id for r in keyword_search(first, "pain").collect()) == [1, 2]
    assert keyword_search(first, "old").count() == 0
    feed(spark, [(1, "cured", 5), (4, "pain pain", 5)], CASE, tmp_path / "in")
    second = index_now(spark, tmp_path)
    state = spark.createDataFrame([(1, "cured"), (2, "head pain"), (3, "cough"), (4, "pain pain")], "case_id long, body string")
    for question in ("pain", "cured OR cough", '"head pain"', "chest", "pa*"):
        assert rows_of(keyword_search(second, question), "case_id") == rows_of(keyword_scan(state, ["body"], question), "case_id")
    jobs.compact_index(spark, str(tmp_path / "ix"), str(tmp_path / "flat"), buckets=4)
    flat = read_index(spark, str(tmp_path / "flat"), ["body"])
    assert rows_of(keyword_search(flat, "pain"), "case_id") == rows_of(keyword_search(second, "pain"), "case_id")
    assert flat.postings.where("term = 'chest'").count() == 0


def test_replayed_batch_changes_nothing(spark, tmp_path):
    batch = spark.createDataFrame([(1, "chest pain", 1), (2, "pain", 1)], CASE)
    for _ in range(2):
        jobs.write_index_batch(batch, 0, str(tmp_path), ["body"], "updated_date", buckets=4)
    assert spark.read.parquet(str(tmp_path / "postings")).where("term_bucket >= 0").count() == 3
    index = jobs.read_stream_index(spark, str(tmp_path), ["body"], buckets=4)
    assert keyword_search(index, "pain").count() == 2


def test_embeddings_only_for_new_cases(spark, tmp_path):
    schema = "case_id long, chief_complaint string, symptoms string"
    out, ck = str(tmp_path / "emb"), str(tmp_path / "ck")
    for rows in ([(1, "a", "b"), (2, "c", "d")], [(2, "changed", "d"), (3, "e", "f")]):
        feed(spark, rows, schema, tmp_path / "in")
        run(jobs.stream_embeddings(stream(spark, tmp_path, schema), out, ck, "SymptomsOnly", HashEmbedder(8), F.lit(DAY)))
    assert sorted(r.case_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_sliding_violations_equal_batch(spark, tmp_path):
    """Several micro-batches, rows out of order and late within the watermark, equal times, the last rows included."""
    rng = random.Random(6)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    start, every = DAY, []
    for batch in range(4):
        rows = [(100 * batch + i, rng.randrange(3), "rag", 1, start + dt.timedelta(seconds=300 * batch + rng.randrange(-240, 240)))
                for i in range(60)]
        every += rows
        feed(spark, rows, LOG, tmp_path / "in")
        run(jobs.to_parquet(jobs.stream_sliding_violations(stream(spark, tmp_path), 4, 60, "10 minutes"), out, ck))
    got = spark.read.parquet(out)
    want = sliding_violations(spark.createDataFrame(every, LOG), 4, "1 minute")
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect()) and want.count() > 10
    by_user = {}
    for ident, user, _, _, at in sorted(every, key=lambda r: (r[4], r[0])):
        by_user.setdefault(user, []).append((at, ident))
    plain = {ident for calls in by_user.values() for i, (at, ident) in enumerate(calls)
             if sum(at - dt.timedelta(minutes=1) <= t for t, _ in calls[:i + 1]) > 4}
    assert {r["id"] for r in want.collect()} == plain


def test_sliding_state_is_dropped(spark, tmp_path):
    """Calls behind the watermark are forgotten and never told again; a call far later starts anew."""
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    burst = [(i, 1, "rag", 1, DAY + dt.timedelta(seconds=i)) for i in range(6)]
    for rows in (burst, [(50, 2, "rag", 1, DAY + dt.timedelta(days=1))], [(60, 1, "rag", 1, DAY + dt.timedelta(days=1, minutes=1))],
                 [(70, 1, "rag", 1, DAY + dt.timedelta(seconds=7))]):
        feed(spark, rows, LOG, tmp_path / "in")
        run(jobs.to_parquet(jobs.stream_sliding_violations(stream(spark, tmp_path), 4, 60, "10 minutes"), out, ck))
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [4, 5]


def test_micro_batches_read_their_own_days_and_buckets(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(jobs, "read_or_empty", lambda s, path, schema: seen.append(df := jobs_read(s, path, schema)) or df)
    out, ck = str(tmp_path / "log"), str(tmp_path / "ck")
    for day in range(3):
        feed(spark, [(day, 1, "rag", 1, DAY + dt.timedelta(days=day)), (0, 1, "rag", 1, DAY)], LOG, tmp_path / "in")
        run(jobs.stream_append_log(stream(spark, tmp_path), out, ck))
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2] and seen
    plan = plan_of(seen[-1].where(F.col("event_date").isin(DAY.date())).select("id"))
    assert "event_date" in plan.split("PartitionFilters")[1].split("]")[0]


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_tables_that_are_a_file_or_a_folder(spark, tmp_path, files):
    table = tmp_path / "documents.parquet"
    spark.range(30).repartition(files).write.parquet(str(tmp_path / "parts" if files == 1 else table))
    if files == 1:
        next((tmp_path / "parts").glob("part-*.parquet")).rename(table)
    run(jobs.to_parquet(read_table_stream(spark, str(tmp_path), "documents"), str(tmp_path / "out"), str(tmp_path / "ck")))
    assert sorted(r["id"] for r in spark.read.schema("id long").parquet(str(tmp_path / "out")).collect()) == list(range(30))
