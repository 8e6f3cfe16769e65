"""Cosine nearest neighbours: exact scans, partitioned (IVF) search, LSH.

Batches of questions meet the corpus in blocks. Both sides are packed into rows of at most
`BLOCK_BYTES` of vectors that share a label and a dimension. The blocks of the corpus are dealt
into `SHARES`, every block of questions meets every share of its label: Spark broadcasts the
questions while their table is small and shuffles both sides otherwise, and one label alone
keeps many tasks busy. A task multiplies one block by the other and keeps k running hits for
each question, so what is ranked in the end is k rows per question and share.

A vector that is null, holds a null, has no length or is of another size than its partner
never matches. `vector_faults` lists such rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.functions.scoring import similarity
from rankweave.operators.topk import topk_per_group
from rankweave.schemas import CASE_COLS, EMBEDDING_TYPES
from rankweave.session import written

# Distances are defined to this many decimals, so equal vectors tie exactly and the
# case id decides, whichever block of a matrix product they were computed in.
DISTANCE_DECIMALS = 12
#: more than rounding moves a sum of a component's products in floats, as a part of the lengths multiplied
FLOAT_SLACK = 1.2e-7
#: pairs measured in doubles at once
MEASURED_PAIRS = 1 << 16
BLOCK_BYTES = 256 << 10
#: shares of the corpus that a block of questions meets one by one; running hits that a task holds
SHARES, HELD_HITS = 32, 1 << 22
SCORED = "query_id long, case_id long, vector_distance double"
PACKED = "label string, dim int, ids binary, vectors binary"


def _unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    matrix = matrix.astype(np.float64)
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return matrix / norms[:, None], norms > 0


def vector_faults(rows: DataFrame, dim: int, id_col: str = "case_id") -> DataFrame:
    """(id, reason) of rows whose vector cannot be searched: null, wrong_dimension, null_element, zero."""
    v = F.col("embedding")
    reason = (
        F.when(v.isNull(), "null").when(F.size(v) != dim, "wrong_dimension")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x)), "null_element")
        .when(F.forall(v, lambda x: x == 0), "zero")
    )
    return rows.select(id_col, reason.alias("reason")).where("reason IS NOT NULL")


def dimension(embeddings: DataFrame) -> int:
    """The commonest size of the vectors, the smaller of two; 0 without any."""
    sizes = embeddings.groupBy(F.size("embedding").alias("dim")).count().where("dim > 0")
    first = sizes.orderBy(F.desc("count"), "dim").first()
    return first["dim"] if first else 0


def _usable(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows whose vector has `dim` elements and a length.

    Checked here and not by a where(): on vectors that a model has just computed, Spark
    would push the condition down and compute them twice.
    """
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("embedding")
            fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(at)), dim), False)
            batch = batch.filter(fits)
            if batch.num_rows:
                flat = batch.column(at).flatten().to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(_unit_rows(flat.reshape(-1, dim))[1]))
            if batch.num_rows:
                yield batch

    return keep


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, embedding, label) as blocks of equal label and dimension."""
    for batch in batches:
        column, label = batch.column(1), batch.column(2).dictionary_encode()
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
        flat = column.flatten().to_numpy(zero_copy_only=False)
        start = np.cumsum(size) - size
        code = pc.fill_null(label.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = pc.fill_null(batch.column(0), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        good = (size > 0) & (code >= 0) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        out: list[tuple[str, int, bytes, bytes]] = []
        for kind, dim in {(int(c), int(d)) for c, d in zip(code[good], size[good], strict=True)}:
            rows = np.flatnonzero(good & (code == kind) & (size == dim))
            step = max(1, BLOCK_BYTES // (dim * flat.itemsize))
            for lo in range(0, len(rows), step):
                part = rows[lo:lo + step]
                matrix = flat[start[part][:, None] + np.arange(dim)]
                usable = _unit_rows(matrix)[1]
                if usable.any():
                    out.append((label.dictionary[kind].as_py(), dim, ids[part][usable].tobytes(),
                                matrix[usable].tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         names=["label", "dim", "ids", "vectors"])


def _unpack(ids: pa.Scalar, vectors: pa.Scalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids.as_buffer(), np.int64)
    data = vectors.as_buffer()
    kind = np.float32 if data.size == 4 * dim * len(numbers) else np.float64
    return numbers, _unit_rows(np.frombuffer(data, kind).reshape(len(numbers), dim))[0]


def blocks_of(rows: DataFrame, id_col: str, label: Column) -> DataFrame:
    """`rows` packed into blocks by label and dimension; nothing shuffles."""
    return rows.select(F.col(id_col).cast("long").alias("id"), "embedding", label.cast("string").alias("label")).mapInArrow(
        _pack, PACKED)


def _best(query: np.ndarray, dist: np.ndarray, case: np.ndarray, k: int):
    """The k nearest (distance, case) of each query."""
    order = np.lexsort((case, dist, query))
    query, dist, case = query[order], dist[order], case[order]
    starts = np.r_[0, np.flatnonzero(np.diff(query)) + 1] if len(query) else np.array([], int)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    keep = place < k
    return query[keep], dist[keep], case[keep]


def _longest(rows: np.ndarray) -> float:
    """The greatest length of some vectors."""
    return float(np.sqrt((rows * rows).sum(axis=1).max(initial=0.0)))


class _Running:
    """The k best hits so far of the questions of one block.

    Products in floats tell which pairs may be among them; only those are measured in doubles. Hits
    wait until there are half as many as the best ones and are then sorted in.
    """

    def __init__(self, ids: np.ndarray, unit: np.ndarray, k: int):
        self.ids, self.unit, self.k = ids, unit, k
        self.rough = unit.astype(np.float32)
        self.reach = FLOAT_SLACK * (unit.shape[1] + 8) * _longest(unit)
        self.ranked = (np.array([], np.int64), np.array([]), np.array([], np.int64))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.limit = np.full(len(ids), np.inf)

    @property
    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the question, distance, case) of the best hits."""
        if self.waiting:
            self.ranked = _best(*(np.concatenate(x) for x in zip(self.ranked, *self.waiting, strict=True)), self.k)
            self.waiting = []
            query, dist, _ = self.ranked
            last = np.flatnonzero(np.diff(query, append=-1))
            full = np.bincount(query, minlength=len(self.limit)) >= self.k
            worst = np.full(len(self.limit), np.inf)
            worst[query[last]] = dist[last]
            self.limit = np.where(full, worst, np.inf)
        return self.ranked

    def add(self, cases: np.ndarray, unit: np.ndarray) -> None:
        near = self.rough @ unit.astype(np.float32).T
        slack = self.reach * _longest(unit)
        cut = self.limit
        if len(cases) > self.k and np.isinf(cut).any():
            cut = np.minimum(cut, 1.0 + slack - np.partition(near, len(cases) - self.k, axis=1)[:, len(cases) - self.k])
        found = np.flatnonzero(near >= (1.0 - slack - cut).astype(np.float32)[:, None])
        for lo in range(0, len(found), MEASURED_PAIRS):
            query, row = np.divmod(found[lo:lo + MEASURED_PAIRS], len(cases))
            self.take(query, cases[row], np.einsum("ij,ij->i", self.unit[query], unit[row]))

    def take(self, query: np.ndarray, case: np.ndarray, near: np.ndarray) -> None:
        """Add pairs of the number of a question and a case, with their products."""
        dist = np.round(1.0 - near, DISTANCE_DECIMALS)
        kept = dist <= self.limit[query]
        if not kept.any():
            return
        self.waiting.append((query[kept], dist[kept], case[kept]))
        if 2 * sum(len(w[0]) for w in self.waiting) > len(self.ranked[0]) or np.isinf(self.limit).any():
            self.best  # noqa: B018  sorts them in

    def rows(self) -> pa.RecordBatch:
        query, dist, case = self.best
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[query], pa.int64()), pa.array(case, pa.int64()), pa.array(dist, pa.float64())],
            names=["query_id", "case_id", "vector_distance"])


def _running_hits(k: int, start: Callable[[np.ndarray, np.ndarray], _Running], meet: Callable[..., None]
                  ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's scan over pairs of blocks, with at most `HELD_HITS` running hits, or those of one block.

    Rows are dim and block, a block of the corpus, q_ids and q_vectors. `start` makes running hits of
    the ids and unit vectors of a block of questions, `meet` adds to them what a block of the corpus holds.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running: dict[int, _Running] = {}
        room = HELD_HITS // k
        for batch in batches:
            dims, blocks, *corpus, q_ids, q_vectors = batch.columns
            for i in range(batch.num_rows):
                block, dim = blocks[i].as_py(), dims[i].as_py()
                if block not in running:
                    one = start(*_unpack(q_ids[i], q_vectors[i], dim))
                    while running and sum(len(r.ids) for r in running.values()) + len(one.ids) > room:
                        yield running.pop(next(iter(running))).rows()
                    running[block] = one
                meet(running[block], dim, *(column[i] for column in corpus))
        for one in running.values():
            yield one.rows()

    return scan


def _nearest_pairs(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k nearest of each question of a block, by the vectors."""
    return _running_hits(k, lambda ids, unit: _Running(ids, unit, k),
                         lambda running, dim, ids, vectors: running.add(*_unpack(ids, vectors, dim)))


def for_shares(asked: DataFrame) -> DataFrame:
    """`asked` once for each share.

    Spark takes an exploded table for no larger than before, and a product for as large as both
    sizes multiplied: 4 rows of 12 bytes and 8 elements come to about `SHARES` times the size.
    """
    some = asked.sparkSession.range(SHARES // 8).select(F.col("id").cast("int").alias("some"))
    eight = F.explode(F.sequence(F.col("some") * 8, F.col("some") * 8 + 7)).alias("share")
    return asked.crossJoin(F.broadcast(some)).select(*asked.columns, eight)


def share_of(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SHARES)).cast("int").alias("share")


def _meet(tiles: DataFrame, blocks: DataFrame, k: int, rank_col: str) -> DataFrame:
    """The k nearest of each question among the tiles of its labels."""
    asked = for_shares(blocks.select("label", "dim", "block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))
    # where both sides are shuffled, a block of questions meets all tiles of a share one after the other
    pairs = asked.join(tiles.select("*", share_of("ids")), ["label", "dim", "share"]).select(
        "dim", "block", "ids", "vectors", "q_ids", "q_vectors")
    return _ranked(pairs.mapInArrow(_nearest_pairs(k), SCORED), k, rank_col)


def _numbered(blocks: DataFrame) -> DataFrame:
    """Question blocks with a number, written so that Spark knows their size."""
    return written(blocks.withColumn("block", F.monotonically_increasing_id()), "questions")


def _one_block(query: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The scan of a single question, given as a unit vector."""
    keep = _usable(len(query))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = _Running(np.zeros(1, np.int64), query[None, :], k)
        for batch in keep(batches):
            matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            step = max(1, BLOCK_BYTES // (8 * len(query)))
            cases = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(matrix), step):
                running.add(cases[lo:lo + step], _unit_rows(matrix[lo:lo + step])[0])
        yield running.rows()

    return scan


def check_type(embedding_type: str, known: Sequence[str] | None = EMBEDDING_TYPES) -> None:
    if known is not None and embedding_type not in known:
        raise ValueError(f"unknown embedding type: {embedding_type}")


def check_k(k: int) -> None:
    if k is None or not 1 <= k <= 100:
        raise ValueError("top-k must be between 1 and 100")


def _unit_query(query: Sequence[float]) -> np.ndarray:
    v = np.asarray(query, dtype=np.float64)
    norm = np.sqrt((v * v).sum())
    if not norm > 0:
        raise ValueError("the query vector has no length")
    return v / norm


def vector_topk(embeddings: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """(case_id, vector_distance): the k nearest vectors, nearest first.

    Each task keeps k rows, so what reaches the final sort is k rows per task.
    """
    rows = embeddings.select("case_id", "embedding")
    return (
        rows.mapInArrow(_one_block(_unit_query(query), k), SCORED).drop("query_id")
        .orderBy("vector_distance", "case_id").limit(k)
    )


def nearest_existing(embeddings: DataFrame, cases: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """(case_id, vector_distance): the k nearest vectors that have a case.

    The 4k nearest of all are found and their few ids looked up. Where fewer than k of them exist,
    vectors without a case are many: they are left out once by a semi-join on ids, and the k
    nearest of the rest are the answer. No distance shuffles.
    """
    m = 4 * k
    near = written(vector_topk(embeddings, query, m), "near")
    there = written(look_up(cases.select("case_id"), near, m).groupBy("case_id").agg(
        F.min("vector_distance").alias("vector_distance")), "near")
    if there.count() < k and near.count() == m:
        real = embeddings.join(cases.select("case_id").distinct(), "case_id", "left_semi")
        # a case may have several vectors, of which the nearest counts
        there = vector_topk(real, query, m).groupBy("case_id").agg(F.min("vector_distance").alias("vector_distance"))
    return there.orderBy("vector_distance", "case_id").limit(k)


def find_similar(embeddings: DataFrame, cases: DataFrame, query: Sequence[float], k: int = 5,
                 embedding_type: str = "FullCase", fk_enforced: bool = False,
                 known_types: Sequence[str] | None = EMBEDDING_TYPES) -> DataFrame:
    """The k most similar cases with `similarity`.

    Vectors without a case do not count. Where a foreign key rules those out
    (`fk_enforced`) the k nearest vectors are the answer and the plan is one lazy plan.
    """
    check_k(k)
    check_type(embedding_type, known_types)
    of_type = embeddings.where(F.col("embedding_type") == embedding_type)
    hits = vector_topk(of_type, query, k) if fk_enforced else nearest_existing(of_type, cases, query, k)
    return (
        look_up(cases.select(*CASE_COLS), hits, k)
        .select(*CASE_COLS, similarity(F.col("vector_distance")).alias("similarity"))
        .orderBy(F.desc("similarity"), "case_id")
    )


def knn_join(queries: DataFrame, embeddings: DataFrame, k: int, by_type: bool = False,
             rank_col: str = "vector_rank") -> DataFrame:
    """(query_id, case_id, vector_distance, rank): the k nearest vectors of each query.

    `by_type` limits a query to its own embedding type. Queries listed by
    `vector_faults(queries, dim, "query_id")` have no hits.
    """
    label = F.col("embedding_type") if by_type else F.lit("")
    asked = _numbered(blocks_of(queries, "query_id", label))
    return _meet(blocks_of(embeddings, "case_id", label), asked, k, rank_col)


def _ranked(hits: DataFrame, k: int, rank_col: str) -> DataFrame:
    return topk_per_group(hits, ["query_id"], [F.asc("vector_distance"), F.asc("case_id")], k, rank_col)


def look_up(cases: DataFrame, hits: DataFrame, n: int, literal_ids: bool = False) -> DataFrame:
    """Join the at most `n` hits of one question to the case table, whose rows stay in place.

    `literal_ids` runs the search at once and hands the found ids to the scan as literal
    equalities, so that row groups without any of them are not read.
    """
    hits = hits.limit(n)
    if literal_ids:
        rows = hits.toArrow()
        ids = rows.column("case_id").to_pylist()
        hits = cases.sparkSession.createDataFrame(rows, hits.schema)
        cases = cases.where(reduce(lambda a, b: a | b, [F.col("case_id") == i for i in ids], F.lit(False)))
    return cases.join(F.broadcast(hits), "case_id")


def existing(candidates: DataFrame, cases: DataFrame) -> DataFrame:
    """Candidates whose case exists."""
    return candidates.join(cases.select("case_id"), "case_id", "left_semi")


# ---- partitioned index ----


@dataclass(frozen=True)
class IvfIndex:
    """Vectors by embedding type and nearest centre, and the rows that could not be indexed."""

    vectors: DataFrame
    centroids: np.ndarray
    faults: DataFrame


def train_centroids(embeddings: DataFrame, nlist: int, seed: int = 7) -> np.ndarray:
    """Cosine k-means centres of all usable vectors."""
    usable = embeddings.select("embedding").mapInArrow(_usable(dimension(embeddings)), embeddings.select("embedding").schema)
    points = usable.select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=nlist, seed=seed, distanceMeasure="cosine", maxIter=10).fit(points)
    return np.array(model.clusterCenters(), dtype=np.float64)


def _assign(unit_centroids: np.ndarray, nprobe: int = 1):
    """The nearest cell of each usable vector, or a row for each of its `nprobe` nearest."""
    keep = _usable(unit_centroids.shape[1])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in keep(batches):
            at = batch.schema.get_field_index("embedding")
            flat = batch.column(at).flatten().to_numpy(zero_copy_only=False)
            near = _unit_rows(flat.reshape(batch.num_rows, -1))[0] @ unit_centroids.T
            cells = np.argsort(-near, axis=1, kind="stable")[:, :nprobe]
            wide = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1])))
            yield wide.append_column("cell", pa.array(cells.ravel().astype(np.int32)))

    return scan


def _with_cells(rows: DataFrame, centroids: np.ndarray, nprobe: int = 1) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])
    return rows.mapInArrow(_assign(_unit_rows(centroids)[0], nprobe), schema)


def _write_cells(embeddings: DataFrame, path: str, centroids: np.ndarray, mode: str) -> None:
    """Partitioned by type and cell; Spark splits a dense cell over several tasks by its size."""
    rows = embeddings.select("case_id", "embedding_type", F.col("embedding").cast("array<float>").alias("embedding"))
    _with_cells(rows, centroids).hint("rebalance", "embedding_type", "cell").write.mode(mode).partitionBy(
        "embedding_type", "cell").parquet(f"{path}/vectors")
    vector_faults(rows, centroids.shape[1]).write.mode(mode).parquet(f"{path}/faults")


def build_ivf(embeddings: DataFrame, path: str, nlist: int, seed: int = 7) -> IvfIndex:
    """Train on all usable vectors and write them by embedding type and nearest centre.

    The vectors are written first: a model may have to compute them, and they are read often.
    """
    spark = embeddings.sparkSession
    embeddings = written(embeddings.select("case_id", "embedding_type", "embedding"), "vectors")
    centroids = train_centroids(embeddings, nlist, seed)
    _write_cells(embeddings, path, centroids, "overwrite")
    spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(centroids)], "cell int, centroid array<double>"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return read_ivf(spark, path)


def append_ivf(embeddings: DataFrame, path: str) -> IvfIndex:
    """Add new vectors to a stored index; its centres stay."""
    spark = embeddings.sparkSession
    embeddings = written(embeddings.select("case_id", "embedding_type", "embedding"), "vectors")
    _write_cells(embeddings, path, read_ivf(spark, path).centroids, "append")
    return read_ivf(spark, path)


def delete_ivf(index: IvfIndex, deleted: DataFrame) -> IvfIndex:
    """The index without the vectors of deleted cases (case_id)."""
    return IvfIndex(index.vectors.join(deleted.select("case_id"), "case_id", "left_anti"), index.centroids, index.faults)


def read_ivf(spark: SparkSession, path: str) -> IvfIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()     # nlist rows
    schema = "case_id long, embedding array<float>, embedding_type string, cell int"
    return IvfIndex(spark.read.schema(schema).parquet(f"{path}/vectors"), np.array([r["centroid"] for r in rows]),
                    spark.read.schema("case_id long, reason string").parquet(f"{path}/faults"))


def ivf_search(index: IvfIndex, queries: DataFrame, k: int, nprobe: int, by_type: bool = False,
               rank_col: str = "vector_rank") -> DataFrame:
    """Approximate k nearest: each query looks into its `nprobe` nearest cells only.

    Probing every cell gives the exact result. `by_type` limits a query to its own embedding
    type. Cells no query asks for are not read.
    """
    probing = _with_cells(queries, index.centroids, min(nprobe, len(index.centroids)))
    label = F.col("cell").cast("string")
    if by_type:
        label = F.concat(label, F.lit(":"), "embedding_type")
    asked = _numbered(blocks_of(probing, "query_id", label))
    # At most one row per cell. The comparison marks them as selective, which lets Spark
    # skip the folders of the other cells.
    cells = asked.select(F.substring_index("label", ":", 1).cast("int").alias("cell")).distinct().where("cell >= 0")
    vectors = index.vectors.join(F.broadcast(cells), "cell", "left_semi")
    return _meet(blocks_of(vectors, "case_id", label), asked, k, rank_col)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(recall): the share of true neighbours that were found."""
    keys = ["query_id", "case_id"]
    both = truth.select(*keys, F.lit(1).alias("t")).join(found.select(*keys, F.lit(1).alias("f")), keys, "left")
    return both.agg(F.try_divide(F.count("f"), F.count("t")).alias("recall"))


# ---- hashed index ----


def _planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables * bits, dim))


def _keys(tables: int, bits: int, seed: int):
    """(table, bucket, case_id) of each vector: the sides of `bits` random planes it lies on."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows = flat.reshape(batch.num_rows, -1)
            side = (rows @ _planes(rows.shape[1], tables, bits, seed).T > 0).reshape(batch.num_rows, tables, bits)
            bucket = (side * (1 << np.arange(bits))).sum(axis=2).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)), pa.array(bucket.ravel()),
                 pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), tables))],
                names=["hash_table", "bucket", "case_id"])

    return scan


@dataclass(frozen=True)
class LshIndex:
    vectors: DataFrame
    hashes: DataFrame
    dim: int
    tables: int
    bits: int
    seed: int


def build_lsh(embeddings: DataFrame, path: str, tables: int = 8, bits: int = 8, seed: int = 7) -> LshIndex:
    """Hash every usable vector once per table and store the hashes by bucket, next to the vectors."""
    dim = dimension(embeddings)
    rows = embeddings.select(F.col("case_id").cast("long").alias("case_id"), "embedding")
    rows.mapInArrow(_usable(dim), rows.schema).write.mode("overwrite").parquet(f"{path}/vectors")
    vectors = embeddings.sparkSession.read.parquet(f"{path}/vectors")
    hashes = vectors.mapInArrow(_keys(tables, bits, seed), "hash_table int, bucket long, case_id long")
    hashes.hint("rebalance", "hash_table", "bucket").sortWithinPartitions("hash_table", "bucket", "case_id").write.mode(
        "overwrite").parquet(f"{path}/hashes")
    return LshIndex(vectors, embeddings.sparkSession.read.parquet(f"{path}/hashes"), dim, tables, bits, seed)


def lsh_search(index: LshIndex, query: Sequence[float], k: int) -> DataFrame:
    """(case_id, vector_distance): the k nearest of the vectors that share a stored bucket with the question."""
    unit = _unit_query(query)
    side = (_planes(index.dim, index.tables, index.bits, index.seed) @ unit > 0).reshape(index.tables, index.bits)
    own = (side * (1 << np.arange(index.bits))).sum(axis=1).tolist()
    mine = reduce(lambda a, b: a | b, [(F.col("hash_table") == t) & (F.col("bucket") == b) for t, b in enumerate(own)])
    near = index.hashes.where(mine).select("case_id").distinct()
    return vector_topk(index.vectors.join(near, "case_id", "left_semi"), query, k)
