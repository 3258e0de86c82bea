import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from epilode.llm import negatives as N
from oracle import compare, connect

BOUND = (1 << 63) - 1


def brute(rows, ask, positives=5, negatives=3):
    kept = [(n, i, label, [math.floor(256 * x) for x in v]) for n, (i, label, v) in enumerate(rows)
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, label, q in kept:
        if not ask(i):
            continue
        scored = sorted((-max(-BOUND, min(BOUND, sum(a * b for a, b in zip(q, v)))), c, m, other) for m, c, other, v in kept if m != n and len(v) == len(q))
        for p, pid, _, _ in [s for s in scored if s[3] == label][:positives]:
            found = [s for s in scored if s[3] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(i, pid, r + 1, s[1], -p, -s[0]) for r, s in enumerate(found)]
    return sorted(out)


def got(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS score", "'y' AS tile", "3 AS row", "4 AS block")
    return sorted(tuple(r) for r in N.mine(df.repartition(3), F.col("vec_id") % 5 == 0, **sizes).collect())


@pytest.mark.parametrize("sizes", [{}, {"tile": 60, "block": 30}])
def test_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(7)
    middles = np.abs(rng.normal(size=(6, 8)))
    rows = [(i, int(rng.integers(0, 4)), (middles[i % 6] + rng.normal(scale=0.4, size=8)).tolist()) for i in range(300)]
    rows += [(400 + i, i % 2, rows[3][2]) for i in range(150)]  # one vector many times
    rows += [(i, 1, rows[i][2]) for i in range(0, 40, 5)]  # ids of anchors again
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 500
    assert got(spark, rows, **sizes) == want


ODD = [
    (0, 1, [1.0, 2.0]), (5, 1, [0.5, 0.25]), (1, None, [1.0, 1.0]), (2, 1, None), (3, 2, [1.0, None]), (4, 2, [float("nan"), 1.0]), (None, 2, [1.0, 1.0]),
    (6, 2, [0.5, 1.0]), (7, 2, [0.5, 1.0]), (7, 2, [0.5, 1.0]), (8, 2, [0.75, 1.25]), (10, 2, [0.0, 0.0]), (11, 1, [0.0, 0.0]), (12, 3, []), (15, 3, []),
    (20, 4, [9.0]), (21, 5, [8.0]), (22, 4, [9.5]), (25, 6, [-1.0, -1.0]), (26, 6, [1.0, 1.0]), (30, 7, [1.0, 2.0, 3.0]), (9, 3, [float("inf"), 0.0]),
]


def test_odd_rows(spark):
    assert got(spark, ODD) == brute(ODD, lambda i: i % 5 == 0)
    assert got(spark, []) == []
    assert got(spark, [(1, 1, [1.0]), (2, 2, [2.0])]) == []
    assert got(spark, [(5, 1, [1.0])]) == []


def test_numbers_of_any_size(spark):
    rows = ODD + [(35, 1, [1e15, 1.0]), (36, 1, [1e15, 2.0]), (37, 2, [9e14, 3.0]), (38, 2, [1e300, 3.0]), (40, 1, [3e6, -1.0]), (41, 1, [3e6, 0.0]), (42, 3, [2e6, 0.5])]
    want = brute(rows, lambda i: i % 5 == 0)
    assert got(spark, rows) == want


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300), st.integers(1, 5), st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 300]), st.integers(1, 40))
def test_search_loses_nothing(n, dims, seed, spread, leaf):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-spread, spread + 1, (n, dims)).astype(float)
    query = rng.integers(-spread, spread + 1, dims).astype(float)
    ids, allowed = rng.integers(0, 50, n), rng.random(n) < 0.7
    tree = N.PackedTree(vectors, leaf, 3)
    scores = vectors @ query
    low, high = tree.intervals(query[None])
    for box, children in enumerate(tree.children):
        if children is None:
            own = (tree.vectors[box * leaf : (box + 1) * leaf] @ query)
            assert low[0, box] <= own.min() and own.max() <= high[0, box]
    lo, hi = sorted(int(x) for x in rng.integers(-10 * spread, 10 * spread, 2))
    windows = [N._Wanted(3, lo, hi, -BOUND), N._Wanted(2, -BOUND, BOUND, -BOUND)]
    N.search(tree, query, low[0], high[0], allowed[tree.order], ids[tree.order], windows)
    for w, (a, b, k) in zip(windows, ((lo, hi, 3), (-math.inf, math.inf, 2))):
        want = sorted((-int(s), int(i)) for s, i, ok in zip(scores, ids, allowed) if ok and a <= s <= b)[:k]
        assert sorted((-s, -i) for s, i, _ in w.heap) == want


def test_boxes_are_pruned():
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * (np.repeat(rng.normal(size=(40, 3)), 100, axis=0) + rng.normal(scale=0.05, size=(4000, 3))))
    tree = N.PackedTree(vectors, 64, 8)
    query = vectors[17]
    low, high = tree.intervals(query[None])
    window = N._Wanted(5, -BOUND, BOUND, -BOUND)
    read = N.search(tree, query, low[0], high[0], np.ones(4000, bool), np.arange(4000), [window])
    assert read <= 8  # of 63 leaves
    best = int((vectors @ query).max())
    narrow = N._Wanted(3, best // 2, best // 2 + best // 50, -BOUND)
    assert N.search(tree, query, low[0], high[0], np.ones(4000, bool), np.arange(4000), [narrow]) < 40


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_equals_sql(spark, folder):
    assert compare(entry.queries()["op11_negatives"](spark, folder), connect(folder), entry.oracle_sql()["op11_negatives"]) is None
