import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankweave.functions.scoring import cosine_distance
from rankweave.operators import vectors as V
from tests.conftest import plan_of, rows_of

R = 2 ** -0.5
HAND = [
    (12, "FullCase", [1.0, 0.0, 0.0, 0.0]), (26, "FullCase", [0.0, 1.0, 0.0, 0.0]),
    (31, "FullCase", [R, R, 0.0, 0.0]), (32, "FullCase", [-1.0, 0.0, 0.0, 0.0]),
    (45, "FullCase", [5.0, 5.0, 0.0, 0.0]), (99, "FullCase", [0.9, 0.1, 0.0, 0.0]),
    (12, "SymptomsOnly", [0.0, 0.0, 1.0, 0.0]),
    (26, "OutcomeOnly", [0.0, 0.0, 0.0, 0.0]), (31, "OutcomeOnly", [1.0, 0.0]), (32, "OutcomeOnly", None),
    (45, "OutcomeOnly", [1.0, None, 0.0, 0.0]),
]
SCHEMA = "case_id long, embedding_type string, embedding array<float>"


@pytest.fixture(scope="module")
def hand(spark):
    return spark.createDataFrame(HAND, SCHEMA)


@pytest.fixture(scope="module")
def many(spark):
    """300 random vectors, a third of them copies of one, two types."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[100:200] = v[0]
    rows = [(i, ["FullCase", "SymptomsOnly"][i % 2], [float(x) for x in row]) for i, row in enumerate(v)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), v


def brute(v, q, k, keep=lambda i: True):
    v, q = v.astype(float), np.asarray(q, float)
    d = np.round(1 - (v @ q) / (np.linalg.norm(v, axis=1) * np.linalg.norm(q)), 12)
    return sorted((round(x, 9), i) for i, x in enumerate(d) if keep(i))[:k]


def test_distance_column(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [3.0, 3.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == pytest.approx([1.0, 0.0, 2.0]) and got[3] is None


def test_find_similar_joins_before_it_cuts(hand, cases):
    got = rows_of(V.find_similar(hand, cases, [1, 0, 0, 0], 3).select("case_id", F.round("similarity", 6)))
    assert got == [(12, 1.0), (31, round(R, 6)), (45, round(R, 6))]


def test_find_similar_with_foreign_key_cuts_first(hand, cases):
    got = rows_of(V.find_similar(hand, cases, [1, 0, 0, 0], 3, fk_enforced=True).select("case_id"))
    assert [c for (c,) in got] == [12, 31]


def test_type_filter(hand, cases):
    assert [r.case_id for r in V.find_similar(hand, cases, [0, 0, 1, 0], 5, "SymptomsOnly").collect()] == [12]
    assert V.find_similar(hand, cases, [0, 0, 1, 0], 5, "DiagnosisOnly").count() == 0
    with pytest.raises(ValueError):
        V.find_similar(hand, cases, [0, 0, 1, 0], 5, "Other")


def test_unusable_vectors_are_skipped(hand):
    rows = hand.where("embedding_type = 'OutcomeOnly'")
    assert V.vector_topk(rows, [1, 0, 0, 0], 5).count() == 0


@pytest.mark.parametrize("k", [0, 101, None])
def test_k_is_checked(hand, cases, k):
    with pytest.raises(ValueError):
        V.find_similar(hand, cases, [1, 0, 0, 0], k)


def test_query_without_length(hand):
    with pytest.raises(ValueError):
        V.vector_topk(hand, [0, 0, 0, 0], 1)


@pytest.mark.parametrize("k", [1, 10, 100])
def test_topk_equals_brute_force_with_copies(many, k):
    df, v = many
    got = [(round(d, 9), c) for c, d in rows_of(V.vector_topk(df, v[0].tolist(), k))]
    assert got == brute(v, v[0], k)


def knn_truth(v, k, same_type):
    out = {}
    for q in range(len(v)):
        out[q] = [i for _, i in brute(v, v[q], k, (lambda i: i % 2 == q % 2) if same_type else (lambda i: True))]
    return out


@pytest.mark.parametrize("size", [256 << 10, 2000])
@pytest.mark.parametrize("by_type", [False, True])
def test_knn_join(many, size, by_type, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_BYTES", size)
    df, v = many
    hits = V.knn_join(df.withColumnRenamed("case_id", "query_id"), df, 4, by_type)
    got = {}
    for q, c, _, r in rows_of(hits.select("query_id", "case_id", "vector_distance", "vector_rank"), "query_id", "vector_rank"):
        got.setdefault(q, []).append(c)
    assert got == knn_truth(v, 4, by_type)


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_blocks_meet_with_and_without_a_broadcast(spark, many, threshold):
    df, v = many
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        hits = V.knn_join(df.withColumnRenamed("case_id", "query_id"), df, 3)
        assert ("BroadcastHashJoin" in plan_of(hits)) == (threshold != "-1")
        got = {}
        for q, c, r in rows_of(hits.select("query_id", "case_id", "vector_rank"), "query_id", "vector_rank"):
            got.setdefault(q, []).append(c)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == knn_truth(v, 3, False)


def test_questions_of_another_size_have_no_hits(spark, hand):
    asked = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0] * 6), (3, None), (4, [0.0] * 4), (5, [1.0, 0.0, 0.0, 0.0]), (6, [1.0, None, 0.0, 0.0])],
        "query_id long, embedding array<float>")
    hits = V.knn_join(asked, hand.where("embedding_type = 'FullCase'"), 2)
    assert rows_of(hits.select("query_id", "case_id", "vector_rank"), "query_id", "vector_rank") == [(5, 12, 1), (5, 99, 2)]
    faults = rows_of(V.vector_faults(asked, 4, "query_id"), "query_id")
    assert faults == [(1, "wrong_dimension"), (2, "wrong_dimension"), (3, "null"), (4, "zero"), (6, "null_element")]


def test_ivf_over_all_cells_is_exact(spark, many, tmp_path):
    df, v = many
    index = V.build_ivf(df, str(tmp_path), 6)
    queries = df.withColumnRenamed("case_id", "query_id")
    for by_type in (False, True):
        truth = V.knn_join(queries, df, 5, by_type)
        exact = V.ivf_search(index, queries, 5, 6, by_type)
        assert rows_of(exact.select("query_id", "vector_rank", "case_id"), "query_id", "vector_rank") == rows_of(
            truth.select("query_id", "vector_rank", "case_id"), "query_id", "vector_rank")
    truth = V.knn_join(queries, df, 5)
    assert V.recall(V.ivf_search(index, queries, 5, 3), truth).first()[0] > 0.7
    assert index.vectors.count() == 300 and index.faults.count() == 0


def test_ivf_grows_and_shrinks(spark, many, tmp_path):
    df, _ = many
    V.build_ivf(df.where("case_id < 150"), str(tmp_path), 4)
    index = V.append_ivf(df.where("case_id >= 150"), str(tmp_path))
    queries = df.withColumnRenamed("case_id", "query_id")
    assert rows_of(V.ivf_search(index, queries, 3, 4), "query_id", "vector_rank") == rows_of(
        V.knn_join(queries, df, 3), "query_id", "vector_rank")
    left = V.delete_ivf(index, df.where("case_id < 100"))
    assert V.ivf_search(left, queries, 3, 4).where("case_id < 100").count() == 0


def test_ivf_survives_bad_vectors(spark, many, tmp_path):
    df, _ = many
    bad = spark.createDataFrame([(900, "FullCase", None), (901, "FullCase", [1.0, 2.0]), (902, "FullCase", [0.0] * 8),
                                 (903, "FullCase", [None] + [1.0] * 7)], SCHEMA)
    index = V.build_ivf(df.unionByName(bad), str(tmp_path), 4)
    assert index.vectors.count() == 300
    assert rows_of(index.faults, "case_id") == [
        (900, "null"), (901, "wrong_dimension"), (902, "zero"), (903, "null_element")]


def test_ivf_reads_only_probed_cells(spark, many, tmp_path):
    df, v = many
    index = V.build_ivf(df, str(tmp_path), 6)
    one = df.where("case_id = 0").withColumnRenamed("case_id", "query_id")
    plan = plan_of(V.ivf_search(index, one, 5, 1))
    assert "dynamicpruning" in plan


def test_lsh_finds_the_copies(many, tmp_path):
    df, v = many
    index = V.build_lsh(df, str(tmp_path), tables=4, bits=6)
    got = V.lsh_search(index, v[0].tolist(), 20)
    assert len(got.collect()) == 20 and all(r.vector_distance < 1e-6 for r in got.collect())
    assert "bucket" in plan_of(got).split("PushedFilters")[1]


def test_many_orphans_before_the_cases(spark):
    """The nearest vectors have no case: the search widens until enough do."""
    rows = [(i, "FullCase", [1.0, i / 1000.0]) for i in range(200)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    cases = spark.range(150, 200).withColumnRenamed("id", "case_id")
    got = V.nearest_existing(vectors, cases, [1.0, 0.0], 3)
    assert [r.case_id for r in got.collect()] == [150, 151, 152]
    assert V.nearest_existing(vectors, cases.limit(0), [1.0, 0.0], 3).count() == 0


def test_find_similar_moves_no_distances(hand, cases):
    plan = plan_of(V.find_similar(hand, cases, [1, 0, 0, 0], 3))
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_single_search_sorts_k_rows_per_task(many):
    df, v = many
    assert "TakeOrderedAndProject" in plan_of(V.vector_topk(df, v[0].tolist(), 5))


def test_batch_limits_before_the_shuffle(many):
    df, _ = many
    assert "WindowGroupLimit" in plan_of(V.knn_join(df.withColumnRenamed("case_id", "query_id"), df, 4))


def test_a_task_gives_k_hits_however_many_blocks_of_questions_it_meets():
    rng = np.random.default_rng(5)
    blocks = [(b, rng.normal(size=(3, 4)).astype(np.float32)) for b in range(100)]
    tiles = [(np.arange(20 * i, 20 * i + 20), rng.normal(size=(20, 4)).astype(np.float32)) for i in range(5)]
    rows = [(4, b, ids.tobytes(), v.tobytes(), (np.arange(3) + 3 * b).tobytes(), q.tobytes()) for ids, v in tiles for b, q in blocks]
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                       names=["dim", "block", "ids", "vectors", "q_ids", "q_vectors"])
    found = pa.Table.from_batches(V._nearest_pairs(2)(iter([batch])))
    assert found.num_rows == 300 * 2
    got = {}
    for q, c in zip(found["query_id"].to_pylist(), found["case_id"].to_pylist(), strict=True):
        got.setdefault(q, []).append(c)
    every = np.concatenate([v for _, v in tiles])
    for b, asked in blocks:
        for i, one in enumerate(asked):
            assert got[3 * b + i] == [c for _, c in brute(every, one, 2)]


def test_questions_go_to_every_share(spark):
    rows = V.for_shares(spark.range(3).withColumnRenamed("id", "block"))
    assert rows_of(rows, "block", "share") == [(b, s) for b in range(3) for s in range(V.SHARES)]


def test_products_in_floats_lose_no_neighbour():
    """Distances differ by less than a float can tell, the nearest come last, and hits wait before they are sorted in."""
    rng = np.random.default_rng(8)
    asked = V._unit_rows(rng.normal(size=(5, 16)))[0]
    every = np.concatenate([V._unit_rows(asked[[i % 5]] + rng.normal(size=(200, 16)) * 10.0 ** -(i // 5 + 3))[0] for i in range(20)])
    running = V._Running(np.arange(5), asked, 7)
    for lo in range(0, len(every), 100):
        running.add(np.arange(lo, lo + 100), every[lo:lo + 100])
    got = {}
    for q, c, d in zip(*(running.rows().column(i).to_pylist() for i in range(3)), strict=True):
        got.setdefault(q, []).append((d, c))
    for q, one in enumerate(asked):
        exact = np.round(1.0 - np.einsum("ij,ij->i", every, np.broadcast_to(one, every.shape)), V.DISTANCE_DECIMALS)
        assert sorted(got[q]) == sorted(zip(exact.tolist(), range(len(every)), strict=True))[:7]
