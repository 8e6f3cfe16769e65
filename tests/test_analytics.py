import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankweave.operators import analytics as A
from rankweave.operators.topk import page, page_after, page_totals
from tests.conftest import NOW, plan_of, rows_of

COLS = "id long, user_id long, query_type string, patient_description string, keyword_search string, latency_ms long, status string, created_at timestamp"
BASE = NOW - dt.timedelta(days=2)
SEED = [
    (1, 1, "rag", "chest pain", "MI", 500, "success", BASE),
    (2, 1, "vector", "headache", None, 120, "success", BASE + dt.timedelta(hours=1)),
    (3, 2, "hybrid", "fever cough", "pneumonia", 900, "error", BASE + dt.timedelta(hours=2)),
]


@pytest.fixture(scope="module")
def now():
    return None


def lit_now():
    return F.lit(NOW)


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(SEED, COLS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLS)


def test_overview(logs, none, cases):
    assert tuple(A.overview(logs, cases, lit_now()).first()) == (0, 3, 506.7, 66.7, 5)
    assert tuple(A.overview(none, cases, lit_now()).first()) == (0, 0, 0.0, 100.0, 5)


def test_today_starts_at_midnight_utc(spark, cases):
    rows = [(i, 1, "rag", None, None, None, "success", t) for i, t in enumerate(
        [dt.datetime(2024, 5, 9, 23, 59, 59, 999000), dt.datetime(2024, 5, 10), dt.datetime(2024, 5, 10, 11)])]
    got = A.overview(spark.createDataFrame(rows, COLS), cases, lit_now()).first()
    assert got.queries_today == 2 and got.avg_latency_ms == 0.0


def test_usage(logs):
    assert rows_of(A.usage_daily(logs, 30, lit_now())) == [("2024-05-08", 3)]
    assert rows_of(A.usage_by_type(logs, 30, lit_now()), "query_type") == [("", 1, "hybrid"), ("", 1, "rag"), ("", 1, "vector")]
    both = rows_of(A.usage_report(logs, 30, lit_now()), "date", "count")
    assert len(both) == 4 and ("2024-05-08", 3, None) in both
    assert A.usage_daily(logs, 1, lit_now()).count() == 0


@pytest.mark.parametrize("days", [0, 366])
def test_days_are_checked(logs, days):
    with pytest.raises(ValueError):
        A.last_days(logs, days, lit_now())


def test_performance(logs, none):
    assert tuple(A.performance(logs, 30, lit_now()).first()) == (506.7, 500.0, 900.0, 1, 2)
    assert tuple(A.performance(none, 30, lit_now()).first()) == (0.0, 0.0, 0.0, 0, 0)


def test_performance_counts_rows_without_latency(spark):
    rows = [(1, 1, "rag", None, None, None, "error", BASE), (2, 1, "rag", None, None, 70, "success", BASE)]
    assert tuple(A.performance(spark.createDataFrame(rows, COLS), 30, lit_now()).first()) == (70.0, 70.0, 70.0, 1, 1)


def nearest(values, p):
    values = sorted(values)
    return float(values[min(int(len(values) * p), len(values) - 1)]) if values else 0.0


PS = (0.0, 0.25, 0.5, 0.95, 1.0)


def percentiles(spark, values, kind="double"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return dict(rows_of(A.percentile_nearest(df, "x", PS)))


@pytest.mark.parametrize("values", [
    [], [5.0], [120.0, 500.0], [None, 3.0, None], [-7.5, 0.0, 7.5, -0.25, 1e-9, 1e12], [4.0] * 50 + [9.0],
    [float(random.Random(1).randint(0, 300)) for _ in range(500)],
])
def test_percentiles(spark, values):
    real = [v for v in values if v is not None]
    assert percentiles(spark, values) == {p: nearest(real, p) for p in PS}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.integers(-10**6, 10**6), st.sampled_from([0, 1, 2, 1023, 1024, 2**40])), max_size=60))
def test_percentiles_of_any_integers(spark, values):
    assert percentiles(spark, values, "long") == {p: nearest(values, p) for p in PS}


def test_percentiles_scan_once(spark, tmp_path):
    spark.range(1000).selectExpr("id % 97 AS x").write.parquet(str(tmp_path / "t"))
    df = A.percentile_nearest(spark.read.parquet(str(tmp_path / "t")), "x", (0.5,))
    df.collect()
    assert str(tmp_path) not in plan_of(df)               # the values were counted once, the plan reads the ranges


def test_approximate_percentile(spark):
    df = spark.range(1000).selectExpr("id AS x")
    got = dict(rows_of(A.percentile_approximate(df, "x", (0.5, 0.95))))
    assert got[0.5] == pytest.approx(500, abs=2) and got[0.95] == pytest.approx(950, abs=2)


def test_status_counts_and_filters(logs):
    assert tuple(A.status_counts(logs).first()) == (1, 2)
    assert A.filter_logs(logs, status="success", query_type="rag").count() == 1
    assert A.filter_logs(logs).count() == 3


def test_pages(spark, logs):
    users = spark.createDataFrame([(1, "a@x"), (5, "b@x")], "id long, email string")
    got = A.logs_page(logs, users, 1, 2).collect()
    assert [(r.id, r.user_email) for r in got] == [(3, None), (2, "a@x")]
    assert [r.id for r in A.logs_page(logs, users, 2, 2).collect()] == [1]
    assert tuple(page_totals(logs, 2).first()) == (3, 2)
    assert tuple(page_totals(logs.limit(0), 20).first()) == (0, 1)
    with pytest.raises(ValueError):
        page(logs, 0)
    with pytest.raises(ValueError):
        page(logs, 1, 101)


def test_keyset_pages_meet_offset_pages(spark):
    rows = [(i, 1, "rag", None, None, 1, "success", BASE + dt.timedelta(minutes=i // 4)) for i in range(30)]
    df = spark.createDataFrame(rows, COLS)
    first = page(df, 1, 10).collect()
    follow = page_after(df, first[-1].created_at, first[-1].id, 10)
    assert [r.id for r in follow.collect()] == [r.id for r in page(df, 2, 10).collect()]


def test_page_is_no_full_sort(logs):
    assert "TakeOrderedAndProject" in plan_of(page(logs, 1, 20))


def test_rate_violations(spark):
    rows = [(i, 7, "rag", None, None, 1, "success", BASE + dt.timedelta(seconds=i)) for i in range(11)]
    rows += [(50 + i, 8, "rag", None, None, 1, "success", BASE + dt.timedelta(seconds=i)) for i in range(10)]
    got = rows_of(A.rate_violations(spark.createDataFrame(rows, COLS)))
    assert got == [(7, BASE, 11)]


def nearest_of(values, p):
    ordered = sorted(values, key=lambda v: (v != v, v))
    return ordered[min(int(len(ordered) * p), len(ordered) - 1)]


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 3.0, float("nan")], [float("inf"), 1.0, float("-inf")], [float("nan")], [0.0, -0.0, -1.5],
    [1714521600000.0 + i for i in range(20_000)]])
def test_percentiles_of_odd_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(4)
    got = {r.p: r.value for r in A.percentile_nearest(df, "x", (0.0, 0.5, 0.99)).collect()}
    for p, value in got.items():
        want = nearest_of(values, p)
        assert value == want or (value != value and want != want)


def test_no_task_orders_all_distinct_values(spark):
    df = spark.range(20_000).selectExpr("id + 1714521600000D AS x")
    found = A._percentiles(A._histogram(df, "x"), (0.5,))
    plan = plan_of(found)
    assert "Window" in plan and "BroadcastHashJoin" in plan     # ranges are picked before values are numbered


def test_sketch_report_reads_merged_days(spark, tmp_path):
    """Ranks within the bound over merged days; a day written again replaces itself only."""
    rng = random.Random(12)
    rows = [(i, i % 5, rng.choice(["rag", "vector"]), None if i % 50 == 0 else int(rng.lognormvariate(5, 1)),
             "error" if i % 9 == 0 else "success", dt.datetime(2024, 5, 1 + i % 6, i % 24)) for i in range(6000)]
    logs = spark.createDataFrame(rows, "id long, user_id long, query_type string, latency_ms long, status string, created_at timestamp")
    path = str(tmp_path / "sketches")
    A.write_sketches(logs, path)
    A.write_sketches(logs.where("to_date(created_at) = DATE '2024-05-03'"), path)
    since, until = F.lit("2024-05-02").cast("date"), F.lit("2024-05-05").cast("date")
    inside = [r for r in rows if 2 <= r[5].day <= 5]
    for by in ((), ("query_type",)):
        got = A.sketch_report(spark.read.parquet(path), (0.0, 0.5, 0.95, 1.0), since, until, by).collect()
        assert len(got) == 4 * (2 if by else 1)
        for row in got:
            mine = [r for r in inside if not by or r[2] == row["query_type"]]
            values = sorted(r[3] for r in mine if r[3] is not None)
            assert row["n"] == len(mine) and row["error_count"] == sum(r[4] == "error" for r in mine)
            assert row["avg_latency_ms"] == pytest.approx(sum(values) / len(values), abs=0.051)
            below, upto = (sum(v < row["value"] for v in values), sum(v <= row["value"] for v in values))
            assert below / len(values) <= row["p"] + A.SKETCH_ERROR and upto / len(values) >= row["p"] - A.SKETCH_ERROR
    assert A.sketch_report(spark.read.parquet(path).limit(0), (0.5,)).collect() == []
