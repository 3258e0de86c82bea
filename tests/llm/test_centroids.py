import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from epilode.llm import centroids as C
from oracle import compare, connect

BOUND = (1 << 63) - 1


def brute(rows, k=8, rounds=10, scale=1024, dims=64):
    kept = [(i, tuple(v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    points = [[math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in v] for _, v in kept]
    centres = points[:k]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for p in points:
            groups.setdefault(nearest(p)[1], []).append(p)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *nearest(p)) for (i, _), p in zip(kept, points)]
    inertia = {}
    for _, d, n in found:
        inertia[n] = inertia.get(n, 0) + d
    cut = lambda x: min(x, BOUND)
    return sorted(((i, n, cut(d), cut(inertia[n]), cut(sum(inertia.values())), ",".join(map(str, centres[n]))) for i, d, n in found), key=repr)


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS distance", "'x' AS vector")
    return sorted((tuple(r) for r in C.k_means(df.repartition(3), **options).collect()), key=repr)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(9, 5))
    rows = [(i, (middles[i % 9] + rng.normal(scale=0.2, size=5)).tolist()) for i in range(400)]
    rows += [(500 + i, rows[0][1]) for i in range(200)]  # a third of the rows are one vector
    assert got(spark, rows, dims=5) == brute(rows, dims=5)


def test_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i) % 40, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(120)]
    assert got(spark, rows, dims=3, scale=1) == brute(rows, dims=3, scale=1)


ODD = [
    (1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (None, [0.5, 0.5]), (7, [1.0, 2.0]),
    (7, [1.0, 2.0]), (8, []), (9, [-1.0, -2.5]), (10, [0.0, 0.0]), (11, [-0.001, 0.001]), (12, [3e4, 1.0]),
]


def test_odd_rows(spark):
    assert got(spark, ODD, dims=2) == brute(ODD, dims=2)
    assert got(spark, [], dims=2) == []
    assert got(spark, [(1, None)], dims=2) == []
    assert got(spark, [(1, [1.0, 2.0])], dims=2) == brute([(1, [1.0, 2.0])], dims=2)
    assert got(spark, ODD, dims=2, k=1) == brute(ODD, dims=2, k=1)
    assert got(spark, [(1, []), (2, [])], dims=0) == brute([(1, []), (2, [])], dims=0)


def test_numbers_of_any_size(spark):
    rows = ODD + [(13, [1e12, 5.0]), (14, [1e12, 7.0]), (15, [1e307, -1e307]), (16, [-1.7e308, 1e150]), (17, [1e12 + 1, 5.0])] * 2
    assert got(spark, rows, dims=2, k=4) == brute(rows, dims=2, k=4)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 4), st.floats(0, 5), st.floats(0, 3))
def test_no_vector_of_a_sphere_comes_nearer_than_the_loosening(seed, dims, spread, radius):
    rng = np.random.default_rng(seed)
    old = rng.normal(scale=spread + 0.01, size=(3, dims))
    new = old + rng.normal(scale=1.0, size=(3, dims)) * rng.integers(0, 2, (3, 1))
    loosen = C.loosening(old, new, np.full(3, radius))
    far = np.sqrt(((new - old) ** 2).sum(axis=1))
    for i in range(3):
        points = rng.normal(size=(200, dims))
        points *= (radius * rng.random((200, 1)) ** 0.2) / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
        points += old[i]
        others = [j for j in range(3) if j != i]
        nearer = max((np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1)).max() for j in others)
        assert nearer <= loosen[i] + 1e-6
        assert loosen[i] <= max(far[others]) + 1e-12


def test_bounds_spare_scans_and_loosen_less_than_the_full_move():
    rng = np.random.default_rng(0)
    middles = rng.normal(scale=300, size=(8, 16))
    vectors = np.floor(np.repeat(middles, 100, axis=0) + rng.normal(scale=10, size=(800, 16)))
    still = np.zeros(8)
    first = C.Round(np.floor(middles), still, still)
    moved = np.floor(middles + rng.normal(scale=3, size=middles.shape))
    cluster, upper, scanned = C.assign(vectors, [first])
    assert scanned == 800
    radius = np.array([upper[cluster == c].max() for c in range(8)])
    drift = np.sqrt(((moved - first.centroids) ** 2).sum(axis=1))
    loosen = C.loosening(first.centroids, moved, radius)
    assert (loosen < 0.9 * drift.max()).all()
    again, _, both = C.assign(vectors, [first, C.Round(moved, drift, loosen)])
    assert both == 800  # no vector is scanned a second time
    assert (again == C._squares(vectors, moved).argmin(axis=1)).all()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_equals_sql(spark, folder):
    assert compare(entry.queries()["op12_centroids"](spark, folder), connect(folder), entry.oracle_sql()["op12_centroids"]) is None
