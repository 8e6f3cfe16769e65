"""Centroid clustering against plain integer arithmetic."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from rankweave.llm import centroids


def plain(vectors, clusters, rounds, seed=1):
    """(id, cluster, distance) and the final centroids, vector by vector."""
    points = [(i, tuple(math.floor(64 * float(c)) for c in v)) for i, v in vectors]
    order = sorted(points, key=lambda p: (hashlib.sha256(f"{seed}:{'' if p[0] is None else p[0]}".encode()).hexdigest(), p[1]))
    centres = [p[1] for p in order[:clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in points]
        for k in range(len(centres)):
            mine = [x for (_, x), c in zip(points, own, strict=True) if c == k]
            if mine:
                centres[k] = tuple(sum(column) // len(mine) for column in zip(*mine, strict=True))
    return sorted(((i, *nearest(x)[::-1]) for i, x in points), key=repr), centres


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def as_float(v):
    return [float(np.float32(c)) for c in v]


@pytest.mark.parametrize("rounds", [0, 1, 3, 8])
@pytest.mark.parametrize("spread", [0.05, 0.4])
def test_against_plain(spark, rounds, spread):
    rng = np.random.default_rng(rounds)
    centre = rng.normal(size=(7, 6))
    rows = [(i, as_float(centre[i % 7] + spread * rng.normal(size=6))) for i in range(400)]
    rows += rows[:5] + [(None, as_float(rng.normal(size=6))), (None, as_float(rng.normal(size=6)))]
    points = centroids.integer_vectors(table(spark, rows), dim=6)
    found, last = centroids.clustered(points, 9, rounds)
    want, centres = plain(rows, 9, rounds)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert [tuple(c) for c in last.tolist()] == centres


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(20)]         # two places, so most clusters are empty
    points = centroids.integer_vectors(table(spark, rows), dim=2)
    found, last = centroids.clustered(points, 5, 3)
    want, centres = plain(rows, 5, 3)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert [tuple(c) for c in last.tolist()] == centres


def test_negative_components_are_floored(spark):
    rows = [(1, [-0.001, 0.001]), (2, [-1.0, 1.0]), (3, [-0.5, 0.49])]
    got = {r["id"]: r["x"] for r in centroids.integer_vectors(table(spark, rows), dim=2).collect()}
    assert got == {1: [-1, 0], 2: [-64, 64], 3: [-32, 31]}
    found, last = centroids.clustered(centroids.integer_vectors(table(spark, rows), dim=2), 1, 1)
    assert last.tolist() == [[-33, 31]]                          # floor(-97 / 3), floor(95 / 3)


def test_vectors_that_cannot_be_used(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]),
            (8, [0.0, float("-inf")]), (9, [1e30, 0.0]), (10, [1.0, 2.0, 3.0]), (11, [-16383.0, 0.0])]
    df = table(spark, rows).selectExpr("*", "1 AS X", "'a' AS ID", "2 AS cluster")
    assert sorted(r["id"] for r in centroids.integer_vectors(df, dim=2).collect()) == [1, 11]


def test_empty(spark):
    points = centroids.integer_vectors(table(spark, []), dim=2)
    found, last = centroids.clustered(points, 4, 2)
    assert found.collect() == [] and len(last) == 0
    assert centroids.with_inertia(found).columns == ["id", "cluster", "distance", "cluster_inertia", "inertia"]
    assert centroids.with_inertia(found).collect() == []


def test_bounds_use_total_displacement():
    """A centroid that went away and came back moved nothing; single drifts would add up."""
    history = np.array([[[0.0, 0.0]], [[30.0, 40.0]], [[0.0, 0.0]]])
    assert centroids.moves(history).tolist() == [[0.0], [50.0], [0.0]]


def test_bounds_hold_and_save_distances():
    rng = np.random.default_rng(2)
    centre = rng.integers(-60, 60, size=(8, 16))
    points = (centre[rng.integers(0, 8, 3000)] + rng.integers(-6, 7, size=(3000, 16))).astype(np.float64)
    history = [points[rng.choice(3000, 8, replace=False)]]
    state = centroids.State(points, history[0])
    for _ in range(6):
        after = history[-1].copy()
        for k in range(8):
            if (state.cluster == k).any():
                after[k] = np.floor(points[state.cluster == k].mean(axis=0))
        history.append(after)
        state.rescans = 0
        state.advance(np.array(history))
        exact = centroids.squared(points, after)
        assert (state.cluster == exact.argmin(axis=1)).all()
        moved = centroids.moves(np.array(history))
        lower = state.lower - moved[state.lower_at, np.arange(8)]
        assert (lower <= np.sqrt(exact) + 1e-6).all()
        upper = state.upper + moved[state.upper_at, state.cluster]
        assert (upper >= np.sqrt(exact[np.arange(3000), state.cluster]) - 1e-6).all()
    assert state.rescans < 0.1 * exact.size                      # most vectors are settled by their bounds


def test_inertia(spark):
    found = spark.createDataFrame([(1, 0, 5), (2, 0, 7), (3, 1, 1 << 62), (4, 1, 1 << 62)], "id long, cluster int, distance long")
    got = {r["id"]: (r["cluster_inertia"], r["inertia"]) for r in centroids.with_inertia(found).collect()}
    assert got == {1: (12, None), 2: (12, None), 3: (None, None), 4: (None, None)}
