"""Documents to a training mix: five stages, each applying one operator to what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankweave.llm import decontaminate, exact, mixing, simhash, toxicity
from rankweave.llm.queries import fold
from rankweave.session import run_dir, ship_package
from rankweave.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects."""
    ship_package(spark)
    labels = read_table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return exact.deduplicated(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    ship_package(spark)
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    ship_package(spark)
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with how often (copies) and what their source was given."""
    ship_package(spark)
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies),
          ("decontamination", drop_leaks), ("source_mix", mix)]

# Models, fingerprints and seeded choices have no SQL form; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is written and read again by the next stage."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = run_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
