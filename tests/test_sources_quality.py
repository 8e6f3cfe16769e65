import datetime as dt

import pytest
from pyspark.sql import functions as F

from rankweave.operators import embed as E
from rankweave.operators import quality as Q
from rankweave.schemas import CASES, CONFIG, DEFAULT_CONFIG, EMBEDDINGS, QUERY_LOG
from rankweave.sources import tables as S
from tests.conftest import rows_of
from tests.test_vectors import HAND, SCHEMA

T0 = dt.datetime(2024, 1, 1)


def test_cases_survive_csv(spark, cases, tmp_path):
    S.write_csv(cases, str(tmp_path / "c"))
    back = S.load_cases_csv(spark, str(tmp_path / "c"))
    assert all(r["_corrupt"] is None for r in back.collect())
    assert rows_of(back.drop("_corrupt"), "case_id") == rows_of(cases, "case_id")


def test_csv_without_header_and_with_bad_rows(spark, tmp_path):
    good = '1,50,M,"pain, sharp","said ""ow""",,MI,rest,,High,3,12.50,2024-01-01 00:00:00,'
    (tmp_path / "a.csv").write_text(good + "\nnot-a-number,x\n")
    rows = S.load_cases_csv(spark, str(tmp_path / "a.csv")).orderBy(F.col("case_id").asc_nulls_last()).collect()
    assert len(rows) == 2 and rows[0]["_corrupt"] is None and rows[1]["_corrupt"] is not None
    assert rows[0].chief_complaint == "pain, sharp" and rows[0].symptoms == 'said "ow"' and rows[0].medical_history is None


def test_embeddings_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text('1,FullCase,"[0.5, -1.0]"\n2,FullCase,"[0.5, x]"\n3,FullCase,nothing\n')
    assert rows_of(S.load_embeddings_csv(spark, str(tmp_path / "e.csv")), "case_id") == [
        (1, "FullCase", [0.5, -1.0], None), (2, "FullCase", None, "[0.5, x]"), (3, "FullCase", None, "nothing")]


def test_ensure_table_keeps_what_is_there(spark, tmp_path):
    path = str(tmp_path / "cfg")
    S.ensure_table(spark, path, CONFIG)
    assert spark.read.schema(CONFIG).parquet(path).count() == 0
    rows = spark.createDataFrame([(k, v, None, T0) for k, v in DEFAULT_CONFIG.items()], CONFIG)
    for _ in range(2):
        S.seed_defaults(spark, path, CONFIG, rows, "key")
    assert spark.read.parquet(path).count() == 5


def test_query_log(spark, tmp_path):
    path = str(tmp_path / "log")
    row = (1, 2, "rag", "text", "kw", 5, "FullCase", 0.6, 0.4, 100, "success", None, T0)
    df = spark.createDataFrame([row], QUERY_LOG)
    S.append_query_log(df, path)
    S.append_query_log(df.withColumn("created_at", F.col("created_at") + F.expr("interval 3 days")), path)
    assert spark.read.parquet(path).count() == 2
    recent = S.read_query_log(spark, path, F.lit(T0 + dt.timedelta(days=1)))
    assert recent.count() == 1
    assert "PartitionFilters: [isnotnull(event_date" in recent._jdf.queryExecution().executedPlan().toString()


def test_settings_change(spark):
    base = spark.createDataFrame([(k, v, None, T0) for k, v in DEFAULT_CONFIG.items()], CONFIG)
    change = S.config_updates({"top_n": 12, "vector_weight": 0.55, "keyword_weight": 0.45, "rrf_k": None}, 1,
                              F.lit(T0 + dt.timedelta(days=1)), spark)
    got = {r.key: r.value for r in S.upsert_latest(base, change, ["key"], "updated_at", "value").collect()}
    assert got == {"top_n": "12", "embedding_type": "FullCase", "vector_weight": "0.55", "keyword_weight": "0.45", "rrf_k": "60"}


def test_versions(spark, tmp_path):
    path = str(tmp_path / "cfg")
    assert S.latest_version(spark, path) == -1
    S.write_version(spark.createDataFrame([(k, v, None, T0) for k, v in DEFAULT_CONFIG.items()], CONFIG), path)
    before = S.read_version(spark, path)
    change = S.config_updates({"top_n": 11}, 1, F.lit(T0 + dt.timedelta(days=1)), spark)
    after = S.update_table(path, change, ["key"], "updated_at", "value")
    assert S.latest_version(spark, path) == 1
    assert after.where("key = 'top_n'").first().value == "11" and after.count() == 5
    assert before.where("key = 'top_n'").first().value == "5"


def test_effective_config(spark):
    defaults = spark.createDataFrame(list(DEFAULT_CONFIG.items()), "key string, value string")
    stored = spark.createDataFrame([("top_n", "9"), ("other", "1")], "key string, value string")
    got = dict(rows_of(S.effective_config(defaults, stored)))
    assert got["top_n"] == "9" and got["rrf_k"] == "60" and "other" not in got


def test_settings_reach_the_requests(spark):
    requests = spark.createDataFrame([(1, 3, None), (2, None, 0.9)], "query_id long, top_n int, vector_weight double")
    config = spark.createDataFrame(list(DEFAULT_CONFIG.items()), "key string, value string")
    got = S.apply_settings(requests, config)
    assert rows_of(got, "query_id") == [(1, 3, 0.6, "FullCase", 0.4, 60), (2, 5, 0.9, "FullCase", 0.4, 60)]


def test_a_repeated_key_keeps_its_greatest_row(spark):
    rows = [(1, "a", 5), (1, "b", 2), (1, "c", 5), (2, "z", None)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "key long, value string, at int").repartition(parts)
        none = spark.createDataFrame([], df.schema)
        assert rows_of(S.missing_rows(df, none, ["key"], "at"), "key") == [(1, "c", 5), (2, "z", None)]


def test_hot_key_upsert(spark):
    base = spark.createDataFrame([(0, "old", T0)], "key long, value string, at timestamp")
    updates = spark.range(3000).select(
        F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("key"), F.col("id").cast("string").alias("value"),
        (F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("at"))
    got = S.upsert_latest(base, updates, ["key"], "at")
    assert got.count() == 2001 and got.where("key = 0").first().value == "999"


def test_hash_embedder(spark):
    df = spark.createDataFrame([("chest pain chest",), ("the",), (None,), ("",)], "t string").coalesce(1)
    got = [r[0] for r in E.embed(df, "t", E.HashEmbedder(16)).select("embedding").collect()]
    assert all(len(v) == 16 for v in got)
    assert sum(x * x for x in got[0]) == pytest.approx(1.0, abs=1e-6)
    assert got[1] == got[2] == got[3] == [0.0] * 16
    import hashlib
    want = [0.0] * 16
    for w in ("chest", "pain", "chest"):
        h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        want[h % 16] += 1.0 if h // 16 % 2 == 0 else -1.0
    norm = sum(x * x for x in want) ** 0.5
    assert got[0] == pytest.approx([x / norm for x in want], abs=1e-6)


def test_callable_embedder_makes_one_model_per_worker(spark):
    def make():
        seen = []
        def run(texts):
            seen.append(1)
            return [[float(len(t)), float(len(seen) > 0)] for t in texts]
        return run

    df = spark.createDataFrame([("abc",), ("de",)], "t string").coalesce(1)
    got = [r[0] for r in E.embed(df, "t", E.CallableEmbedder(make, 2, "len")).select("embedding").collect()]
    assert got == [[3.0, 1.0], [2.0, 1.0]]


def test_append_embeddings_twice_adds_nothing(spark, cases, tmp_path):
    path = str(tmp_path / "emb")
    for _ in range(2):
        E.append_embeddings(cases, path, "FullCase", E.HashEmbedder(8), F.lit(T0))
        E.append_embeddings(cases, path, "OutcomeOnly", E.HashEmbedder(8), F.lit(T0))
    rows = spark.read.parquet(path)
    assert rows.count() == 5 + 2
    assert Q.find_duplicates(rows, ["case_id", "embedding_type"]).count() == 0
    assert {r.model_used for r in rows.collect()} == {"feature-hash-8"}


def test_only_missing_cases_reach_the_model(spark, cases):
    have = spark.createDataFrame([(12, "FullCase"), (26, "SymptomsOnly")], "case_id long, embedding_type string")
    assert sorted(r.case_id for r in E.missing_pairs(cases, have, "FullCase").collect()) == [26, 31, 32, 45]


@pytest.fixture(scope="module")
def hand(spark):
    return spark.createDataFrame(HAND + [(12, "Wrong", [1.0])], SCHEMA)


def test_validation(hand, cases):
    assert rows_of(Q.enum_violations(hand, "embedding_type")) == [("Wrong", 1)]
    assert rows_of(Q.find_orphans(hand, cases, "case_id", "case_id").select("case_id")) == [(99,)]
    assert rows_of(Q.orphan_counts(hand, cases, "case_id", "case_id")) == [(99, 1)]
    assert Q.wrong_dimension(hand, 4).count() == 3
    assert tuple(Q.null_counts(hand, ["embedding", "case_id"]).first()) == (1, 0)
    assert Q.find_duplicates(hand.union(hand), ["case_id", "embedding_type"]).count() == len(HAND) + 1
    gone = cases.where("case_id = 12")
    assert Q.cascade_delete(hand, gone, "case_id").where("case_id = 12").count() == 0


def test_summaries(hand, cases, spark, tmp_path):
    got = {r.embedding_type: (r.total_embeddings, r.unique_cases) for r in Q.embedding_summary(hand.union(hand)).collect()}
    assert got["FullCase"] == (12, 6)
    approx = {r.embedding_type: r.unique_cases for r in Q.embedding_summary(hand, approximate=True).collect()}
    assert approx["FullCase"] == 6
    assert dict(rows_of(Q.count_by_type(hand)))["OutcomeOnly"] == 4
    assert dict(rows_of(Q.table_counts({"a": hand, "b": cases}))) == {"a": 12, "b": 5}
    hand.write.parquet(str(tmp_path / "t"))
    report = Q.health_report(spark, {"there": str(tmp_path / "t"), "gone": str(tmp_path / "u")})
    assert dict(rows_of(report)) == {"there": "OK", "gone": "MISSING"}


def test_split_valid(spark):
    fine = (1, "47 year old male", "pain", 5, "FullCase", 0.6, 0.4, 60)
    bad = [(2, " " * 12, "pain", 5, "FullCase", 0.6, 0.4, 60), (3, "123456789", "pain", 5, "FullCase", 0.6, 0.4, 60),
           (4, "47 year old male", "ab", 0, "FullCase", 0.6, 0.4, 60), (5, "47 year old male", "pain", 101, "FullCase", 1.1, -0.1, 0),
           (6, None, None, None, "FullCase", None, None, None)]
    columns = ("query_id long, query_text string, keyword_search string, top_n int, embedding_type string, "
               "vector_weight double, keyword_weight double, rrf_k int")
    valid, rejected = Q.split_valid(spark.createDataFrame([fine, *bad], columns))
    assert [r.query_id for r in valid.collect()] == [1]
    reasons = {r.query_id: r.reasons for r in rejected.collect()}
    assert reasons[2] == ["query_text"] and reasons[3] == ["query_text"] and reasons[4] == ["keyword_search", "top_n"]
    assert reasons[5] == ["top_n", "vector_weight", "keyword_weight", "rrf_k"] and len(reasons[6]) == 6


def test_schemas_are_explicit():
    assert len(CASES) == 14 and len(QUERY_LOG) == 13 and len(EMBEDDINGS) == 6


def test_cascade_rewrite_touches_affected_partitions_only(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(i, f"t{i % 4}" if i % 9 else None) for i in range(80)] + [(None, "t1"), (500, "a b/c")]
    spark.createDataFrame(rows, "case_id long, kind string").write.partitionBy("kind").parquet(path)

    def files():
        return {str(f.relative_to(path)) for f in (tmp_path / "store").rglob("*.parquet")}

    def stored():
        return sorted((tuple(r) for r in spark.read.schema("case_id long, kind string").parquet(path).collect()), key=repr)

    before = files()
    assert Q.cascade_rewrite(spark, path, spark.createDataFrame([(9999,), (None,)], "case_id long"), "case_id", "kind") == []
    assert files() == before
    ids = [i for i, kind in rows if kind == "t2"] + [5, 9, 500]
    gone = spark.createDataFrame([(i,) for i in ids] * 2, "case_id long")
    assert Q.cascade_rewrite(spark, path, gone, "case_id", "kind") == ["a b/c", "t1", "t2", None]
    assert stored() == sorted((r for r in rows if r[0] not in ids), key=repr)
    kept = {f for f in before if f.startswith(("kind=t0", "kind=t3"))}
    assert kept and kept <= files() and not any(f.startswith(("kind=t2", "kind=a")) for f in files())
    assert not any(f in files() for f in before - kept)
