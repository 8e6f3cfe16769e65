"""Batch searches ask with every row of their table, in the code and in their SQL."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from rankweave.plans import retrieval, tables
from tests.conftest import rows_of

# of the vector and conversation ids 20 divides none, one, several
VECTORS, TURNS = [3, 7, 20, *range(41, 60)], [(c, t) for c in (1, 2, 9, 20, 33, 40) for t in (0, 1, 3)]
BY_VECTOR = ("knn_batch", "knn_batch_by_type", "ivf_search_all_cells", "ivf_append_all_cells", "ivf_search", "knn_pruned", "pq_search_all")
BY_TURN = ("keyword_batch", "hybrid_batch", "hybrid_ivf_all_cells", "hybrid_batch_orphans", "prompt_batch", "rag_batch")
IDS = [c * 1000000 + t for c, t in TURNS]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base, rng = tmp_path_factory.mktemp("asked"), random.Random(3)
    texts = [" ".join(rng.choices(("chest", "pain", "cough", "fever", "rest", "heart"), k=12)) for _ in range(30)]

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(base / f"{name}.parquet"))

    write("documents", [(i, f"{t}\n{t[:20]}\nend", "en", "web", len(t)) for i, t in enumerate(texts)],
          "doc_id long, text string, lang string, source string, n_chars long")
    write("embeddings", [(v, [rng.gauss(0, 1) for _ in range(tables.DIM)], v % 2) for v in VECTORS],
          "vec_id long, embedding array<float>, label int")
    write("conversations", [(c, t, "user", f"{rng.choice(texts)} {c} {t}") for c, t in TURNS] + [(5, 0, "assistant", texts[0])],
          "conv_id long, turn int, role string, text string")
    return str(base)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    yield con
    con.close()


def test_every_vector_asks(spark, folder):
    assert sorted(r.query_id for r in tables.vector_requests(spark, folder).collect()) == VECTORS


def test_every_user_turn_asks(spark, folder):
    assert sorted(r.query_id for r in retrieval.turn_requests(spark, folder).collect()) == IDS


@pytest.mark.parametrize("name", [*BY_VECTOR, *BY_TURN])
def test_sql_asks_with_every_row(duck, name):
    got = duck.sql(f"SELECT DISTINCT query_id FROM ({entry.oracle_sql()[name]}) ORDER BY ALL").fetchall()
    assert [q for q, in got] == (VECTORS if name in BY_VECTOR else IDS)


def test_sql_of_the_log_and_of_rejected_turns(duck):
    got = duck.sql(f"SELECT id FROM ({entry.oracle_sql()['rag_logged']}) ORDER BY ALL").fetchall()
    assert [q for q, in got] == IDS
    got = duck.sql(f"SELECT query_id FROM ({entry.oracle_sql()['rejected_from_batch']}) ORDER BY ALL").fetchall()
    assert [q for q, in got] == [q for q in IDS if q % 1000000 in (0, 3)]


@pytest.mark.parametrize("name", ["knn_batch", "keyword_batch", "rejected_from_batch"])
def test_query_asks_with_every_row(spark, duck, folder, name):
    df = entry.queries()[name](spark, folder)
    want = duck.sql(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]}) ORDER BY ALL").fetchall()
    assert rows_of(df, *df.columns) == want
    every = VECTORS if name in BY_VECTOR else IDS if name in BY_TURN else [q for q in IDS if q % 1000000 in (0, 3)]
    assert sorted({row[0] for row in want}) == every
