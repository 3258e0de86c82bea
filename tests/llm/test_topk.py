import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from epilode.llm import topk
from oracle import compare, connect


def brute(rows, ask, k=5):
    known = [(key, tuple(math.floor(256 * x) for x in v)) for key, v in rows
             if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, qv) in enumerate(known):
        if ask(q):
            scores = sorted((-sum(a * b for a, b in zip(qv, v)), c) for m, (c, v) in enumerate(known) if m != n and len(v) == len(qv))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def search(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS shard", "3 AS key")
    return sorted(tuple(r) for r in topk.top_k(df.repartition(3), F.col("vec_id") % 5 == 0, **sizes).collect())


@pytest.mark.parametrize("shard,block", [(8192, 8192), (300, 70)])
def test_equals_brute_force(spark, shard, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(scale=0.3 + i % 3, size=12)).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(400)]  # one vector many times
    rows += [(2000 + i, [0.0] * 12) for i in range(50)]
    assert search(spark, rows, shard=shard, block=block) == brute(rows, lambda q: q % 5 == 0)


ODD = [
    (0, [1.0, 2.0]), (5, [0.5, -0.25]), (1, None), (2, [1.0, None]), (3, [float("nan"), 0.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]),
    (7, [1.0, 2.0, 3.0]), (10, [0.0, 0.0]), (11, [1.0, 2.0]), (11, [1.0, 2.0]), (12, []), (15, []), (20, [9.0]), (5, [0.25, 0.25]), (13, [1e30, -1e30]),
]


def test_odd_rows(spark):
    got, want = search(spark, ODD), brute(ODD, lambda q: q % 5 == 0)
    bound = (1 << 63) - 1
    assert got == sorted((q, r, c, max(-bound, min(bound, s))) for q, r, c, s in want)
    assert search(spark, []) == []
    assert search(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert search(spark, [(5, [1.0])]) == []


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.integers(1, 6), st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 300]))
def test_stopping_loses_nothing(n, dims, seed, spread):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-spread, spread + 1, (n, dims)).astype(float)
    query, ids = rng.integers(-spread, spread + 1, dims).astype(float), rng.permutation(n)
    index = topk.ImpactIndex(ids, vectors)
    for turn in range(3):  # later searches begin where earlier ones ended
        rows, scores = index.best(0, query * (turn + 1), 2)
        want = sorted((-(turn + 1) * int(v @ query), int(i)) for n, (i, v) in enumerate(zip(ids, vectors)) if n != 0)[:2]
        assert [(-s, i) for i, s in zip(index.ids[rows].tolist(), scores.tolist())] == want


def test_it_stops_early():
    rng = np.random.default_rng(1)
    vectors = np.floor(256 * rng.normal(scale=0.1, size=(4000, 16)))
    query = vectors[7] * 3
    index = topk.ImpactIndex(np.arange(4000), vectors)
    possible = index._possible(query, 5, np.arange(4000) != 7)
    assert len(possible) <= 4000 // 64
    assert topk._STOPS[index.first] > 0  # proved before the last level


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(entry.queries()["op8_topk"](spark, folder), connect(folder), entry.oracle_sql()["op8_topk"]) is None
