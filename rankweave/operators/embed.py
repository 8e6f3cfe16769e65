"""Text to vectors: embedders and incremental embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.text import compose_text, tokens
from rankweave.sources.tables import EMBEDDING_STORE, one_per_key, read_or_empty


class HashEmbedder:
    """Signed feature hashing of the words of a text, scaled to unit length.

    A word's hash is the first 8 hex digits of its md5; bucket = hash % dim, the sign is
    plus where hash // dim is even. Words are split by Spark; a batch hashes each
    distinct word once. A text without words gets a zero vector.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.model_name = f"feature-hash-{dim}"

    def column(self, text: Column) -> Column:
        dim = self.dim

        @F.arrow_udf("array<float>")
        def hashed(words: pa.Array) -> pa.Array:
            lengths = np.diff(words.offsets.to_numpy())
            coded = words.flatten().dictionary_encode()
            h = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in coded.dictionary.to_pylist()],
                         dtype=np.int64)
            codes = coded.indices.to_numpy()
            row = np.repeat(np.arange(len(words)), lengths)
            sums = np.zeros(len(words) * dim)
            if len(codes):
                sign = np.where((h // dim) % 2 == 0, 1.0, -1.0)
                sums = np.bincount(row * dim + (h % dim)[codes], weights=sign[codes], minlength=len(sums))
            sums = sums.reshape(len(words), dim)
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            unit = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0).astype(np.float32)
            offsets = np.arange(0, (len(words) + 1) * dim, dim, dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()))

        return hashed(tokens(text))


class CallableEmbedder:
    """Wraps a model: `make()` runs once per Python worker and returns list[str] -> vectors."""

    def __init__(self, make: Callable[[], Callable[[list[str]], list]], dim: int, model_name: str):
        self.make, self.dim, self.model_name = make, dim, model_name

    def column(self, text: Column) -> Column:
        make = self.make

        @F.pandas_udf("array<float>")
        def model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            run = make()
            for texts in batches:
                yield pd.Series([np.asarray(v, dtype=np.float32) for v in run(texts.tolist())])

        return model(text)


def embed(df: DataFrame, text_col: str, embedder, out: str = "embedding") -> DataFrame:
    """`df` with a vector column; row-wise, so nothing shuffles."""
    return df.withColumn(out, embedder.column(F.col(text_col)))


def embed_text(spark: SparkSession, text: str, embedder) -> list[float]:
    """The vector of one text."""
    one = embed(spark.createDataFrame([(text,)], "text string"), "text", embedder)
    return [float(x) for x in one.first()["embedding"]]


def missing_pairs(cases: DataFrame, embeddings: DataFrame, embedding_type: str) -> DataFrame:
    """Cases that have no vector of this type yet."""
    have = embeddings.where(F.col("embedding_type") == embedding_type).select("case_id")
    return cases.join(have, "case_id", "left_anti")


def embed_missing(cases: DataFrame, embeddings: DataFrame, embedding_type: str, embedder, now: Column) -> DataFrame:
    """New embedding rows for cases lacking this type; only those are sent to the model, each once."""
    todo = missing_pairs(cases, embeddings, embedding_type).select(
        "case_id", compose_text(embedding_type).alias("text")
    ).where("text IS NOT NULL")
    todo = one_per_key(todo, ["case_id"])
    return embed(todo, "text", embedder).select(
        "case_id", F.lit(embedding_type).alias("embedding_type"), "embedding",
        F.lit(embedder.model_name).alias("model_used"), now.alias("created_date"),
    )


def append_embeddings(cases: DataFrame, path: str, embedding_type: str, embedder, now: Column) -> None:
    """Run `embed_missing` against the stored vectors and append the result."""
    stored = read_or_empty(cases.sparkSession, path, EMBEDDING_STORE)
    fresh = embed_missing(cases, stored, embedding_type, embedder, now)
    fresh.select(*EMBEDDING_STORE.names).write.mode("append").partitionBy("embedding_type").parquet(path)
