"""The stages on a small table, against what each must do to its own input."""

import corpus_pipeline
from rankweave.llm import queries
from tests.llm.test_decontaminate import plain
from tests.llm.test_simhash import plain_print
from tests.llm.test_toxicity import texts


def tables(spark, tmp_path):
    rows = texts(240, 9)
    docs = [(i, t, "en", f"src{i % 5}", len(t)) for i, t, _ in rows]
    docs += [(1000 + k, docs[k][1].upper() if k % 2 else docs[k][1], "en", "src0", None) for k in range(30)]
    leak = "every word of this benchmark question is known to nobody but the people who wrote it down"
    docs += [(2000 + k, f"{docs[k][1]} {leak} tail", None, None, 1) for k in (1, 2, 3)]
    docs += [(3000, None, None, None, None), (3001, "", "en", "src1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return leak, {i for i, _, t in rows if t}


def test_stages(spark, tmp_path):
    leak, toxic = tables(spark, tmp_path)
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "source_mix"]
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        path = f"{folder}/out{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.collect())
    first = {r.doc_id for r in seen[0]}
    assert len(toxic & first) <= 0.05 * len(toxic) and len(first - toxic) >= 0.95 * (275 - len(toxic) - 8)
    lines = {}
    for r in seen[0]:
        lines.setdefault((r.text or "").lower(), []).append(r.doc_id)
    assert sorted(r.doc_id for r in seen[1]) == sorted(max(ids) for ids in lines.values())
    prints = [plain_print(r.text) for r in seen[2]]
    assert all((p ^ q).bit_count() > 2 for k, p in enumerate(prints) for q in prints[:k])
    assert {r.doc_id for r in seen[3]} == {r.doc_id for r in seen[2] if not plain(r.text, [(7, leak)])[1]}
    assert all(r.copies in (1, 2) and r.taken == r.copies * r.size for r in seen[4])
    assert {r.doc_id for r in seen[4]} <= {r.doc_id for r in seen[3]}


def test_run_is_the_stages(spark, tmp_path):
    tables(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert sorted(q.split("_")[0] for q in queries.QUERIES) == sorted(f"op{n}" for n in range(1, 14))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    for name, fn in queries.QUERIES.items():
        assert fn(spark, str(tmp_path)).collect() == [], name
