"""Nearest neighbours from an index: exact search that skips cells, and product quantisation.

`knn_pruned` is exact. On unit vectors the cosine distance is half the squared Euclidean one, so
the triangle inequality holds: a vector of a cell is no nearer to a question than the distance
to the cell's centre less the cell's radius. A question first meets its nearest cells until they
hold k vectors, which bounds its k-th distance, and then only cells that may hold a nearer one.

`pq_search` reads byte codes. A vector is cut into parts, each part is stored as the number of
the nearest of 256 centres of that part. The centres that the codes of a block name are looked up
once, and their products with a block of questions give all distances by code of the two. The
best `rerank` candidates of each question are measured again by the stored vectors. Where every
vector is a candidate, a table of all pairs would follow. Then the vectors lie beside the codes: a
vector is as far from its centres as its code is wrong, so a distance by code bounds the true one
from both sides. A task measures what may be among the k nearest of those it has met, and keeps k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.functions.scoring import cosine_distance
from rankweave.operators.topk import topk_per_group
from rankweave.operators.vectors import (
    BLOCK_BYTES, DISTANCE_DECIMALS, SCORED, IvfIndex, _meet, _numbered, _ranked, _Running, _running_hits, _unit_rows, _unpack,
    _usable, blocks_of, dimension, for_shares, share_of,
)
from rankweave.session import written

#: added to bounds, for rounding
SLACK = 1e-9
#: added to distances that bound others: roots of numbers near zero lose half their digits
BOUND_SLACK = 1e-6
#: pairs measured at once
PAIRS = 1 << 16


@dataclass(frozen=True)
class Cells:
    """Centre, radius and number of vectors of each cell of an index."""

    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray


def measure_cells(index: IvfIndex) -> Cells:
    """Radii by one scan of the vectors; a row per cell reaches the driver."""
    centres = _unit_rows(index.centroids)[0]
    keep = _usable(centres.shape[1])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius, count = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for batch in keep(batches):
            unit = _unit_rows(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))[0]
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            np.maximum.at(radius, cell, np.sqrt(((unit - centres[cell]) ** 2).sum(axis=1)))
            count += np.bincount(cell, minlength=len(centres))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(radius), pa.array(count)],
                                         names=["cell", "radius", "n"])

    parts = index.vectors.select("cell", "embedding").mapInArrow(scan, "cell int, radius double, n long")
    rows = {r["cell"]: r for r in parts.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()}
    every = range(len(centres))
    return Cells(centres, np.array([rows[c]["radius"] if c in rows else 0.0 for c in every]),
                 np.array([rows[c]["n"] if c in rows else 0 for c in every]))


def _asking(queries: DataFrame, cells: Cells, choose: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The questions, once for each cell that `choose` picks from their distances to the centres."""
    schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType())])
    keep = _usable(cells.centres.shape[1])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in keep(batches):
            at = batch.schema.get_field_index("embedding")
            unit = _unit_rows(batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))[0]
            far = np.sqrt(np.maximum(2.0 - 2.0 * unit @ cells.centres.T, 0.0))
            row, cell = np.nonzero(choose(far, batch))
            yield batch.take(pa.array(row)).append_column("cell", pa.array(cell.astype(np.int32)))

    return queries.mapInArrow(scan, schema)


def first_cells(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """Each question with its nearest cells, as many as hold k vectors."""
    def choose(far: np.ndarray, _: pa.RecordBatch) -> np.ndarray:
        order = np.argsort(far, axis=1, kind="stable")
        before = np.cumsum(cells.count[order], axis=1) - cells.count[order]
        picked = np.zeros(far.shape, bool)
        np.put_along_axis(picked, order, before < k, axis=1)
        return picked & (cells.count > 0)

    return _asking(queries, cells, choose)


def other_cells(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """Questions (query_id, embedding, reach) with the further cells that may hold a vector nearer than `reach`."""
    def choose(far: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        reach = np.sqrt(2.0 * batch.column(batch.schema.get_field_index("reach")).to_numpy(zero_copy_only=False) + SLACK)
        order = np.argsort(far, axis=1, kind="stable")
        before = np.cumsum(cells.count[order], axis=1) - cells.count[order]
        met = np.zeros(far.shape, bool)
        np.put_along_axis(met, order, before < k, axis=1)
        return ~met & (cells.count > 0) & (far - cells.radius[None, :] <= reach[:, None] + SLACK)

    return _asking(queries, cells, choose)


def _search_cells(index: IvfIndex, asking: DataFrame, k: int, rank_col: str) -> DataFrame:
    label = F.col("cell").cast("string")
    asked = _numbered(blocks_of(asking, "query_id", label))
    wanted = asked.select(F.col("label").cast("int").alias("cell")).distinct().where("cell >= 0")      # a row per cell at most
    vectors = index.vectors.join(F.broadcast(wanted), "cell", "left_semi")
    return _meet(blocks_of(vectors, "case_id", label), asked, k, rank_col)


def reaches(queries: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The questions with `reach`, the k-th distance so far; 2, the greatest there is, where fewer were found."""
    kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("vector_distance")).alias("kth"))
    return queries.select("query_id", "embedding").join(kth, "query_id", "left").select(
        "query_id", "embedding", F.coalesce("kth", F.lit(2.0)).alias("reach"))


def knn_pruned(index: IvfIndex, queries: DataFrame, k: int, rank_col: str = "vector_rank", cells: Cells | None = None) -> DataFrame:
    """(query_id, case_id, vector_distance, rank): as `knn_join`, from an index. Query ids must be distinct."""
    cells = cells or measure_cells(index)
    first = written(_search_cells(index, first_cells(queries.select("query_id", "embedding"), cells, k), k, rank_col), "near")
    rest = _search_cells(index, other_cells(reaches(queries, first, k), cells, k), k, rank_col)
    return _ranked(first.drop(rank_col).unionByName(rest.drop(rank_col)), k, rank_col)


# ---- product quantisation ----


CODED = "case_id long, embedding array<float>, code binary"


@dataclass(frozen=True)
class PqIndex:
    """`coded` (case_id, embedding, code), the stored vectors beside their codes, and codebooks [part, centre, component]."""

    coded: DataFrame
    books: np.ndarray

    @property
    def codes(self) -> DataFrame:
        """(case_id, code); the vectors are not read."""
        return self.coded.select("case_id", "code")

    @property
    def vectors(self) -> DataFrame:
        return self.coded.select("case_id", "embedding")


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = points[rng.permutation(len(points))[:k]]
    for _ in range(rounds):
        own = ((points * points).sum(1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(1)[None, :]).argmin(1)
        count = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, points[:, d], len(centres)) for d in range(points.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _nearest(unit: np.ndarray, books: np.ndarray) -> np.ndarray:
    parts = unit.reshape(len(unit), len(books), -1)
    return np.stack([(-2 * parts[:, p] @ books[p].T + (books[p] ** 2).sum(1)[None, :]).argmin(1) for p in range(len(books))], axis=1)


def build_pq(embeddings: DataFrame, path: str, parts: int = 32, sample: int = 20_000, seed: int = 7) -> PqIndex:
    """Train codebooks on `sample` vectors, picked by a hash of their id, and code every usable vector.

    With float vectors of dimension d a code takes parts / (4 d) of their bytes.
    """
    spark, dim = embeddings.sparkSession, dimension(embeddings)
    if dim % parts:
        raise ValueError(f"{parts} parts do not divide {dim} components")
    rows = embeddings.select(F.col("case_id").cast("long").alias("case_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    vectors = written(rows.mapInArrow(_usable(dim), rows.schema), "vectors")
    picked = vectors.orderBy(F.xxhash64("case_id", F.lit(seed)), "case_id").limit(sample).select("embedding").toArrow()
    flat = picked.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    unit, rng = _unit_rows(flat.reshape(-1, dim))[0], np.random.default_rng(seed)
    width = dim // parts
    books = np.stack([_kmeans(unit[:, p * width:(p + 1) * width], min(256, len(unit)), rng) for p in range(parts)])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _unit_rows(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim))[0]
                codes = _nearest(own, books).astype(np.uint8)
                cuts = np.arange(0, codes.size + 1, parts, dtype=np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(cuts), pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([*batch.columns, packed], names=["case_id", "embedding", "code"])

    vectors.mapInArrow(code, CODED).write.mode("overwrite").parquet(f"{path}/coded")
    spark.createDataFrame([(p, books[p].ravel().tolist()) for p in range(parts)], "part int, centres array<double>").coalesce(
        1).write.mode("overwrite").parquet(f"{path}/books")
    return read_pq(spark, path)


def read_pq(spark: SparkSession, path: str) -> PqIndex:
    coded = spark.read.schema(CODED).parquet(f"{path}/coded")
    rows = spark.read.parquet(f"{path}/books").orderBy("part").collect()                       # a row per part
    dim = dimension(coded)
    books = np.array([r["centres"] for r in rows]).reshape(len(rows), -1, dim // len(rows))
    return PqIndex(coded, books)


def _code_blocks(coded: DataFrame, dim: int) -> DataFrame:
    """(ids, codes) of the rows (case_id, code), (ids, codes, vectors) of the rows (case_id, code, embedding), by blocks."""
    step, columns = max(1, BLOCK_BYTES // (4 * dim)), len(coded.columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            for lo in range(0, batch.num_rows, step):
                piece = batch.slice(lo, step)
                block = [piece.column(0).to_numpy().tobytes(), b"".join(piece.column(1).to_pylist()),
                         *(c.flatten().to_numpy().tobytes() for c in piece.columns[2:])]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in block], names=["ids", "codes", "vectors"][:columns])

    return coded.mapInArrow(pack, ", ".join(f"{name} binary" for name in ["ids", "codes", "vectors"][:columns]))


def _decoded(ids: pa.Scalar, codes: pa.Scalar, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(case ids, the vectors that their codes stand for)."""
    cases = np.frombuffer(ids.as_buffer(), np.int64)
    code = np.frombuffer(codes.as_buffer(), np.uint8).reshape(len(cases), -1)
    return cases, books[np.arange(len(books)), code].reshape(len(cases), -1)


def _looked_up(books: np.ndarray, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The n nearest by code of each question of a block, over all blocks of codes a task reads.

    The distance is half the squared one. One more component holds what it takes from the vector's own length.
    """
    def start(ids: np.ndarray, unit: np.ndarray) -> _Running:
        return _Running(ids, np.column_stack([unit, np.ones(len(unit))]), n)

    def meet(running: _Running, _: int, ids: pa.Scalar, codes: pa.Scalar) -> None:
        cases, near = _decoded(ids, codes, books)
        running.add(cases, np.column_stack([near, -(near * near).sum(axis=1) / 2]))

    return _running_hits(n, start, meet)


def _meet_coded(running: _Running, dim: int, ids: pa.Scalar, codes: pa.Scalar, vectors: pa.Scalar, books: np.ndarray) -> None:
    """Add the vectors of a block that the codes do not rule out, by their true distances."""
    cases, near = _decoded(ids, codes, books)
    unit = _unpack(ids, vectors, dim)[1]
    wrong = np.sqrt(((unit - near) ** 2).sum(axis=1))
    far = np.sqrt(np.maximum(1.0 + (near * near).sum(axis=1) - 2.0 * running.unit @ near.T, 0.0))
    reach = np.sqrt(2.0 * np.maximum(running.limit, 0.0))
    if len(cases) > running.k:
        reach = np.minimum(reach, np.partition(far + wrong, running.k - 1, axis=1)[:, running.k - 1])
    query, row = np.nonzero(far - wrong <= reach[:, None] + BOUND_SLACK)
    for lo in range(0, len(query), PAIRS):
        q, r = query[lo:lo + PAIRS], row[lo:lo + PAIRS]
        running.take(q, cases[r], np.einsum("ij,ij->i", running.unit[q], unit[r]))


def _measured(books: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k nearest by true distance of each question of a block, measured where the codes do not rule them out."""
    return _running_hits(k, lambda ids, unit: _Running(ids, unit, k),
                         lambda running, dim, *block: _meet_coded(running, dim, *block, books))


def pq_search(index: PqIndex, queries: DataFrame, k: int, rerank: int = 100, rank_col: str = "vector_rank") -> DataFrame:
    """(query_id, case_id, vector_distance, rank): the k nearest of the `rerank` nearest by code, true distances.

    Questions of another dimension than the index have no hits. With as many candidates as vectors the
    search is exact, and tasks keep k hits for each question and share; else they keep `rerank`.
    """
    dim = index.books.shape[0] * index.books.shape[2]
    every = rerank >= index.codes.count()
    asked = _numbered(blocks_of(queries, "query_id", F.lit(""))).where(F.col("dim") == dim)
    asked = for_shares(asked.select("dim", "block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))
    tiles = _code_blocks(index.coded.select("case_id", "code", "embedding") if every else index.codes, dim)
    pairs = asked.join(tiles.select("*", share_of("ids")), "share").select(
        "dim", "block", *tiles.columns, "q_ids", "q_vectors")
    n = k if every else rerank
    found = pairs.mapInArrow(_measured(index.books, k) if every else _looked_up(index.books, rerank), SCORED)
    kept = written(topk_per_group(found, ["query_id"], [F.asc("vector_distance"), F.asc("case_id")], n, rank_col).select(
        "query_id", "case_id"), "candidates")
    asking = queries.select("query_id", F.col("embedding").alias("asked"))
    true = F.round(cosine_distance(F.col("embedding"), F.col("asked")), DISTANCE_DECIMALS)
    rows = kept.join(index.vectors, "case_id").join(asking, "query_id").select("query_id", "case_id", true.alias("vector_distance"))
    return _ranked(rows, k, rank_col)
