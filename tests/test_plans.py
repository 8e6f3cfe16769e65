"""What Spark is asked to read and move."""

import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rankweave.operators import analytics, keyword, quality, vectors
from rankweave.session import clear_runs, run_dir, shared_dir
from rankweave.sources.tables import upsert_latest
from tests.conftest import plan_of, rows_of
from tests.test_vectors import HAND, SCHEMA


@pytest.fixture(scope="module")
def stored(spark, cases, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    cases.write.parquet(str(base / "cases"))
    spark.createDataFrame(HAND, SCHEMA).write.parquet(str(base / "vectors"))
    return spark.read.parquet(str(base / "cases")), spark.read.parquet(str(base / "vectors"))


def scans(plan):
    return [line for line in plan.splitlines() if "FileScan" in line]


def test_hit_ids_reach_the_case_scan(stored):
    cases, rows = stored
    hits = vectors.vector_topk(rows.where("embedding_type = 'FullCase'"), [1, 0, 0, 0], 3)
    plan = plan_of(vectors.look_up(cases, hits, 3, literal_ids=True))
    assert any("EqualTo(case_id,12)" in line for line in scans(plan))
    lazy = vectors.look_up(cases, hits, 3)
    assert "BroadcastHashJoin" in plan_of(lazy) and rows_of(lazy, "case_id") == rows_of(
        vectors.look_up(cases, hits, 3, literal_ids=True), "case_id")


def test_type_filter_reaches_the_vector_scan(stored):
    _, rows = stored
    hits = vectors.vector_topk(rows.where("embedding_type = 'FullCase'"), [1, 0, 0, 0], 3)
    assert "EqualTo(embedding_type,FullCase)" in plan_of(hits)


def test_keyword_scan_reads_only_the_searched_fields(stored):
    cases, _ = stored
    for line in scans(plan_of(keyword.keyword_scan(cases, ["symptoms"], "chest"))):
        assert re.search(r"ReadSchema: struct<case_id:bigint,symptoms:string>", line)


def test_filters_move_nothing(stored):
    cases, _ = stored
    assert "Exchange" not in plan_of(keyword.contains_filter(cases, ["symptoms"], '"chest pain" OR breath'))
    assert "Exchange" not in plan_of(keyword.freetext_filter(cases, ["symptoms"], "chest pain"))


def test_batch_search_prunes_term_buckets_at_run_time(spark, cases, tmp_path):
    index = keyword.build_index(cases, str(tmp_path), ("symptoms",), buckets=8)
    requests = spark.createDataFrame([(1, "chest"), (2, "wheezing")], "query_id long, keyword_search string")
    assert "dynamicpruning" in plan_of(keyword.leaf_hits(index, requests, ("symptoms",)))


def test_batch_search_cuts_before_its_only_shuffle(spark, cases):
    requests = spark.createDataFrame([(1, "chest pain"), (2, "wheezing")], "query_id long, keyword_search string")
    plan = plan_of(keyword.keyword_topk(keyword.scan_index(cases, ("symptoms",)), requests, 3))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "query_id" in exchanges[0] and "case_id" not in exchanges[0].split("), ")[0]
    assert "WindowGroupLimit" in plan


def test_counts_are_partial_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS user_id", "timestamp_seconds(id) AS created_at", "id AS value")
    assert "partial_count" in plan_of(analytics.rate_violations(df))
    assert "partial_max" in plan_of(upsert_latest(df, df, ["user_id"], "created_at"))
    assert "partial_count" in plan_of(quality.find_duplicates(df, ["user_id"]))


def test_overview_scans_the_log_once(spark, tmp_path, cases):
    spark.range(50).selectExpr(
        "id", "timestamp_seconds(id) AS created_at", "id AS latency_ms", "'success' AS status", "'rag' AS query_type"
    ).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = plan_of(analytics.overview(log, cases, F.lit("2024-01-01").cast("timestamp")))
    assert len(scans(plan)) == 1


class FakeSession:
    """Just what `shared_dir` asks for."""

    def __init__(self, named, master):
        self.conf = type("Conf", (), {"get": lambda _, key, default=None: named})()
        self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": lambda _: None})()


def test_shared_dir():
    assert shared_dir(FakeSession("/shared/here", "yarn")) == "/shared/here"
    assert shared_dir(FakeSession(None, "local[2]"))
    with pytest.raises(RuntimeError):
        shared_dir(FakeSession(None, "yarn"))


def test_run_folders_can_be_cleared(spark):
    path = run_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    clear_runs(spark)
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)
