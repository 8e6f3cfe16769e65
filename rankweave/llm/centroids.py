"""Centroid clustering in exact integer arithmetic, sped up by ns-bounds.

Every vector keeps, beside its cluster, an upper bound of the distance to its own centroid and
a lower bound of the distance to every other one, each with the round in which it was taken.
Nothing is loosened round by round: the history of all centroids is kept, and a bound taken in
round T holds now after it is moved by the norm of what its centroid moved in total since T,
which is never more than the sum of the single moves. A vector whose upper bound lies strictly
below all its lower bounds stays. Otherwise its own distance is taken anew, and only the
centroids whose bounds still fail are measured exactly.

Vectors and centroids are integers, so distances and sums are exact and ties go to the smaller
number, whatever the partitioning. A round is one scan that writes the new state and one
aggregation of (count, component sums) per cluster, summed up in each task first: what reaches
the driver is one row per cluster. The history in each task is rounds x clusters x components.
The state of the round before is deleted once the next one is written.

Left out are vectors that are null, of another length, or hold a null, a non-finite component
or one whose integer passes +-2^20 (beyond it squared distances would not be exact in a
double; unit vectors stay below 2^7). Rows that repeat an id are vectors of their own, as are
rows without an id. Fewer vectors than clusters: as many clusters as vectors. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.session import run_dir

#: largest integer component
REACH = 1 << 20
#: how much a bound is widened for the rounding of square roots and single precision
SLACK = 1e-5


def integer_vectors(rows: DataFrame, dim: int = 64, scale: int = 64, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """(id, x): floor(scale * component) of the vectors that can be used."""
    v = F.col(vector_col).cast("array<double>")
    # the bound also fails for NaN and infinity; NaN counts as greater than any number here
    good = (F.size(v) == dim) & F.forall(v, lambda c: F.coalesce(F.abs(c) * scale < REACH, F.lit(False)))
    return rows.where(F.coalesce(good, F.lit(False))).select(
        F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c * scale).cast("int")).alias("x"))


def seeds(points: DataFrame, clusters: int, seed: int = 1) -> np.ndarray:
    """The vectors of the smallest sha256 of `seed:id`, in that order; equal hashes go by vector."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = points.select(order.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    return np.array([r["x"] for r in first], np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All squared distances, exact: every partial sum is an integer far below 2^53."""
    return (points * points).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2.0 * (points @ centroids.T)


def moves(history: np.ndarray) -> np.ndarray:
    """[T, j]: the norm of what centroid j moved in total between round T and now."""
    return np.sqrt(((history - history[-1]) ** 2).sum(axis=2))


class State:
    """Clusters and bounds of a run of vectors. `rescans` counts distances taken exactly."""

    def __init__(self, points: np.ndarray, centroids: np.ndarray):
        self.points, self.rescans = points, points.shape[0] * centroids.shape[0]
        found = squared(points, centroids)
        self.cluster = found.argmin(axis=1)              # the first of equals
        self.lower = np.sqrt(found)
        self.lower_at = np.zeros(found.shape, np.int16)
        self.upper = self.lower[np.arange(len(points)), self.cluster]
        self.upper_at = np.zeros(len(points), np.int16)

    @classmethod
    def of(cls, points, cluster, upper, upper_at, lower, lower_at) -> State:
        self = cls.__new__(cls)
        self.points, self.rescans, self.cluster = points, 0, cluster
        self.upper, self.upper_at, self.lower, self.lower_at = upper, upper_at, lower, lower_at
        return self

    def advance(self, history: np.ndarray) -> None:
        """Assign to the last centroids of the history."""
        now, moved, n = len(history) - 1, moves(history), np.arange(len(self.points))
        k = history.shape[1]
        bound = (self.lower - moved[self.lower_at, np.arange(k)]) * (1 - SLACK) - SLACK
        upper = (self.upper + moved[self.upper_at, self.cluster]) * (1 + SLACK) + SLACK
        bound[n, self.cluster] = np.inf
        fails = np.flatnonzero(upper >= bound.min(axis=1))
        if not len(fails):
            return
        # first its own distance, exactly; then every centroid that may still be as near
        points, own = self.points[fails], self.cluster[fails]
        exact = ((points - history[-1][own]) ** 2).sum(axis=1)
        self.rescans += len(fails)
        self.upper[fails], self.upper_at[fails] = np.sqrt(exact), now
        self.lower[fails, own], self.lower_at[fails, own] = np.sqrt(exact), now
        row, other = np.nonzero(np.sqrt(exact)[:, None] * (1 + SLACK) + SLACK >= bound[fails])
        if not len(row):
            return
        found = ((points[row] - history[-1][other]) ** 2).sum(axis=1)
        self.rescans += len(row)
        self.lower[fails[row], other], self.lower_at[fails[row], other] = np.sqrt(found), now
        table = np.full((len(fails), k), np.inf)
        table[np.arange(len(fails)), own] = exact
        table[row, other] = found
        best = table.argmin(axis=1)
        changed = best != own
        self.cluster[fails] = best
        self.upper[fails[changed]] = np.sqrt(table[changed, best[changed]])


STATE = "x array<int>, cluster int, upper double, upper_at short, lower array<float>, lower_at array<short>, rescans long"
STEP = 4096


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def _assign(history: np.ndarray):
    """The state of each vector under the last centroids, from the state of the round before or from none."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "x", "cluster", "upper", "upper_at", "lower", "lower_at", "rescans"]
        for whole in batches:
            for lo in range(0, whole.num_rows, STEP):
                batch = whole.slice(lo, STEP)
                points, k = _matrix(batch.column(1)), history.shape[1]
                if len(history) == 1:
                    state = State(points, history[0])
                else:
                    cluster, upper, upper_at = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in (2, 3, 4))
                    lower, lower_at = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, k).copy() for c in (5, 6))
                    state = State.of(points, cluster.astype(np.int64), upper, upper_at, lower.astype(np.float64), lower_at)
                    state.advance(history)
                rescans = np.zeros(len(points), np.int64)
                rescans[:1] = state.rescans
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array(state.cluster, pa.int32()), pa.array(state.upper, pa.float64()),
                    pa.array(state.upper_at, pa.int16()), _lists(state.lower.astype(np.float32), pa.float32()),
                    _lists(state.lower_at, pa.int16()), pa.array(rescans, pa.int64())], names=names)

    return scan


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, n, sums) of each task, sums of integers."""
    total: dict[int, list] = {}
    for batch in batches:
        points = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)
        cluster = batch.column(1).to_numpy(zero_copy_only=False)
        for c in np.unique(cluster).tolist():
            mine = points[cluster == c]
            held = total.setdefault(c, [0, np.zeros(points.shape[1], np.int64)])
            held[0] += len(mine)
            held[1] += mine.sum(axis=0)
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()),
             pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])


def means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """floor(sum / count) per component of each cluster; an empty one keeps its centroid."""
    parts = state.select("x", "cluster").mapInArrow(_sums, "cluster int, n long, sums array<long>")
    at = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(before.shape[1])]
    after = before.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *at).collect():      # a row per cluster
        after[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(before.shape[1])]
    return after


def _delete(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def fit(points: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """The state (id, x, cluster, ..., rescans) after `rounds` updates and a last assignment, and all centroids.

    `points` is (id, x). The returned history is [round, cluster, component]; its last entry
    is what the clusters refer to. `rescans` adds up to the distances taken in the last pass.
    """
    spark = points.sparkSession
    history, old = np.asarray(centroids, np.float64)[None], None
    schema = f"id {points.schema['id'].dataType.simpleString()}, {STATE}"
    state = points
    for step in range(rounds + 1):
        path = run_dir(spark, "clusters")
        state.mapInArrow(_assign(history), schema).write.parquet(path)
        state = spark.read.schema(schema).parquet(path)
        if old:
            _delete(spark, old)
        old = path
        if step < rounds:
            history = np.concatenate([history, means(state, history[-1].astype(np.int64))[None].astype(np.float64)])
    return state, history.astype(np.int64)


def clustered(points: DataFrame, clusters: int = 16, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector, and the final centroids; `distance` is squared."""
    centroids = seeds(points, clusters, seed)
    schema = T.StructType([points.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not len(centroids):
        return points.sparkSession.createDataFrame([], schema), centroids
    state, history = fit(points, centroids, rounds)
    last = history[-1].astype(np.float64)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column(2).to_numpy(zero_copy_only=False)
            found = ((_matrix(batch.column(1)) - last[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.astype(np.int64))],
                                             names=["id", "cluster", "distance"])

    return state.select("id", "x", "cluster").mapInArrow(measure, schema), history[-1]


def with_inertia(found: DataFrame) -> DataFrame:
    """`found` with the distances summed over the cluster and over all, as far as a long holds them."""
    def total(column: str) -> Column:
        return F.sum(F.col(column).cast("decimal(38,0)"))

    per_cluster = found.groupBy("cluster").agg(total("distance").alias("s"))
    # one row, which holds a sum for each cluster
    sums = per_cluster.agg(F.struct(
        F.collect_list(F.struct("cluster", F.col("s").try_cast("long").alias("s"))).alias("each"),
        total("s").try_cast("long").alias("all")).alias("t")).scalar()
    rows = found.withColumn("t", sums)
    own = F.filter("t.each", lambda one: one["cluster"] == F.col("cluster"))[0]["s"]
    return rows.select(*found.columns, own.alias("cluster_inertia"), F.col("t.all").alias("inertia"))
