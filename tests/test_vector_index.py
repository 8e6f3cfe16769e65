"""Exact search that skips cells, and product quantisation."""

import numpy as np
import pyarrow as pa
import pytest

from rankweave.operators import vector_index as I
from rankweave.operators import vectors as V
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, "FullCase", (centres[i % 12] + 0.25 * rng.normal(size=16)).tolist()) for i in range(900)]
    rows += [(900 + i, "FullCase", rows[i][2]) for i in range(40)]                             # equal vectors tie
    rows += [(2000, "FullCase", None), (2001, "FullCase", [0.0] * 16), (2002, "FullCase", [1.0])]
    return spark.createDataFrame(rows, "case_id long, embedding_type string, embedding array<float>").repartition(3)


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    return V.build_ivf(table, str(tmp_path_factory.mktemp("ivf")), 12)


def hits(df):
    return [(q, c, round(d, 9), r) for q, c, d, r in rows_of(df, "query_id", "vector_rank")]


@pytest.mark.parametrize("k", [1, 10, 120])
def test_pruned_equals_exact(table, index, k):
    queries = table.where("case_id <> 2002").withColumnRenamed("case_id", "query_id")
    assert hits(I.knn_pruned(index, queries, k)) == hits(V.knn_join(queries, table, k))


def test_far_cells_are_skipped(table, index):
    queries = table.where("case_id < 300").withColumnRenamed("case_id", "query_id")
    cells = I.measure_cells(index)
    first = I._search_cells(index, I.first_cells(queries.select("query_id", "embedding"), cells, 5), 5, "vector_rank")
    met = I.first_cells(queries, cells, 5).count() + I.other_cells(I.reaches(queries, first, 5), cells, 5).count()
    assert cells.count.sum() == 940 and met < 300 * len(cells.centres) / 3


def test_fewer_vectors_than_asked(spark, table, index):
    queries = table.where("case_id = 7").withColumnRenamed("case_id", "query_id")
    assert I.knn_pruned(index, queries, 2000).count() == 940
    assert I.knn_pruned(index, queries.limit(0), 5).count() == 0


def test_codes(table, tmp_path):
    pq = I.build_pq(table, str(tmp_path / "pq"), parts=8, sample=500)
    assert pq.codes.count() == 940 and {len(r["code"]) for r in pq.codes.collect()} == {8}
    queries = table.withColumnRenamed("case_id", "query_id")
    assert I.pq_search(pq, queries.where("query_id >= 2000"), 10).count() == 0
    queries = queries.where("query_id < 2000")
    truth = V.knn_join(queries, table, 10)
    assert V.recall(I.pq_search(pq, queries, 10, rerank=100), truth).first()["recall"] >= 0.9
    assert hits(I.pq_search(pq, queries, 10, rerank=940)) == hits(truth)
    with pytest.raises(ValueError):
        I.build_pq(table, str(tmp_path / "other"), parts=5)


def test_all_candidates_are_no_table_of_pairs(spark, table, tmp_path, monkeypatch):
    pq = I.build_pq(table, str(tmp_path / "pq"), parts=8, sample=500)
    queries = table.where("case_id < 900").withColumnRenamed("case_id", "query_id")
    kept = {}
    monkeypatch.setattr(I, "written", lambda df, label: kept.setdefault(label, df))
    found = hits(I.pq_search(pq, queries, 5, rerank=pq.codes.count()))
    assert found == hits(V.knn_join(queries, table, 5))
    assert kept["candidates"].count() == 900 * 5                # before: 900 * 940, each pair measured by itself


def test_codes_rule_out_most_of_the_vectors(table, tmp_path):
    pq = I.build_pq(table, str(tmp_path / "pq"), parts=8, sample=900)
    rows = pq.coded.toArrow().combine_chunks()
    unit = V._unit_rows(rows["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, 16))[0]
    measured = []

    class Counting(V._Running):
        def take(self, query, case, near):
            measured.append(len(query))
            super().take(query, case, near)

    ids = np.frombuffer(rows["case_id"].to_numpy().tobytes(), np.int64)
    running = Counting(ids[:100], unit[:100], 5)
    blocks = [pa.scalar(b) for b in (ids.tobytes(), b"".join(rows["code"].to_pylist()), unit.tobytes())]
    I._meet_coded(running, 16, *blocks, pq.books)
    assert sum(measured) < 100 * len(ids) / 4
    for q in range(100):
        exact = sorted((round(float(d), 12), int(c)) for d, c in zip(1 - unit @ unit[q], ids, strict=True))[:5]
        assert [c for p, c in zip(running.best[0], running.best[2], strict=True) if p == q] == [c for _, c in exact]
