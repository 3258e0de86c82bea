"""Exact k-means over integer vectors, with bounds loosened by the geometry of the moves.

Each round is one map over the vectors with the centroids in its closure and one small
aggregate: sums and counts per cluster and component, and the cluster's radius.  A vector
has an upper bound on the distance to its centroid and a lower bound on that to all others.
When centroids move, the upper bound grows by its centroid's move.  The lower one shrinks
by less than the farthest move: all vectors of a cluster lie in its sphere, and in the
plane of the sphere's centre and a move from p to q, no point that is seen from the middle
of the move at an angle phi to its direction comes nearer by more than |pq| cos(phi); the
sphere's least such angle follows from its radius.  Only vectors whose bounds then overlap
are scanned against all centroids, in exact integers.

Bounds are not written between rounds: a round starts from the vectors and replays the
earlier ones, whose centroids, moves and loosenings are a few numbers.  That is less work
than writing each vector's state, and a lost task needs nothing but its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from epilode.llm.common import map_batches
from epilode.llm.topk import usable
from epilode.llm.vectors import integers, stack, whole
from epilode.session import cut_lineage

#: Up to here, squared distances of up to 128 components are exact in floating point.
_LIMIT = 2.0**22
_LONG = (1 << 63) - 1
_LIMB = 32  # sums travel in digits of so many bits
_SLACK = 1e-9  # relative rounding of bounds, by far

_PARTS = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("limb", pa.int32()), ("total", pa.int64()), ("radius", pa.float64())])


@dataclass(frozen=True)
class Round:
    """Centroids, and how they came there: each one's move, and what it takes off its members' lower bounds."""

    centroids: np.ndarray
    drift: np.ndarray
    loosen: np.ndarray


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, by how much any vector of its sphere can have come nearer to another centroid."""
    move = new - old
    far = np.sqrt((move**2).sum(axis=1))
    away = old[:, None, :] - ((old + new) / 2)[None, :, :]  # from the middle of j's move to centre i
    apart = np.sqrt((away**2).sum(axis=2))
    with np.errstate(invalid="ignore", divide="ignore"):
        cos_centre = np.clip((away * move[None]).sum(axis=2) / (apart * far[None]), -1, 1)
        sin_half = np.minimum(radius[:, None] / apart, 1.0)
        cos_half = np.sqrt(1 - sin_half**2)
        edge = cos_centre * cos_half + np.sqrt(1 - cos_centre**2) * sin_half
    share = np.where((radius[:, None] >= apart) | (cos_centre >= cos_half), 1.0, np.maximum(edge, 0.0))
    nearer = np.where(far[None] > 0, far[None] * np.minimum(np.nan_to_num(share, nan=1.0) + _SLACK, 1.0), 0.0)
    np.fill_diagonal(nearer, 0.0)
    return nearer.max(axis=1, initial=0.0)


def _squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, exact."""
    own, other = (vectors * vectors).sum(axis=1), (centroids * centroids).sum(axis=1)
    return own[:, None] - 2 * (vectors @ centroids.T) + other[None, :]


def assign(vectors: np.ndarray, rounds: list[Round]) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, upper bound of the distance to its centroid, vectors scanned) after the last round."""
    n, scanned = len(vectors), 0
    cluster, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
    for step in rounds:
        plain = vectors.dtype != object and step.centroids.dtype != object
        v, c = (vectors, step.centroids) if plain else (whole(vectors), whole(step.centroids))
        upper, lower = upper + step.drift[cluster], lower - step.loosen[cluster]
        left = np.flatnonzero(~(upper * (1 + _SLACK) < lower))
        if plain:
            known = left[np.isfinite(upper[left])]
            upper[known] = np.sqrt(((v[known] - c[cluster[known]]) ** 2).sum(axis=1))
            left = left[~(upper[left] * (1 + _SLACK) < lower[left])]
        scanned += len(left)
        squares = _squares(v[left], c)
        cluster[left] = squares.argmin(axis=1) if len(left) else 0  # the first of equals
        if plain and len(left):
            upper[left] = np.sqrt(squares[np.arange(len(left)), cluster[left]])
            squares[np.arange(len(left)), cluster[left]] = np.inf
            lower[left] = np.sqrt(squares.min(axis=1))  # infinite for a single centroid
        else:
            upper[left], lower[left] = np.inf, 0.0  # numbers beyond floating point: always scanned
    return cluster, upper, scanned


def own_squares(vectors: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> list[int]:
    """The exact squared distance of each vector to its centroid."""
    if vectors.dtype == object or centroids.dtype == object:
        vectors, centroids = whole(vectors), whole(centroids)
    return [int(s) for s in ((vectors - centroids[cluster]) ** 2).sum(axis=1).tolist()]


def _digits(total: int) -> list[tuple[int, int]]:
    """(place, digit) of an integer of any size; digits carry its sign."""
    sign, rest, out, place = (-1 if total < 0 else 1), abs(total), [], 0
    while rest:
        out.append((place, sign * (rest & ((1 << _LIMB) - 1))))
        rest, place = rest >> _LIMB, place + 1
    return out


def _gather(vectors: DataFrame, rounds: list[Round], scale: int) -> tuple[list[list[int]], list[int], np.ndarray]:
    """Sums, counts and radii of the clusters."""
    k, dims = rounds[-1].centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, radius = [[0] * dims for _ in range(k)], [0] * k, [0.0] * k
        for batch in batches:
            v = integers(stack(batch.column(0), dims), scale, _LIMIT)
            cluster, upper, _ = assign(v, rounds)
            for c in np.unique(cluster).tolist():
                own = cluster == c
                sums[c] = [s + int(t) for s, t in zip(sums[c], v[own].sum(axis=0).tolist())]
                counts[c] += int(own.sum())
                radius[c] = max(radius[c], float(upper[own].max()))
        out = [(c, dim, limb, digit, radius[c]) for c in range(k) for dim, total in enumerate([*sums[c], counts[c]]) for limb, digit in _digits(total)]
        columns = list(zip(*out)) if out else [()] * len(_PARTS)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _PARTS)], schema=_PARTS)

    parts = map_batches(vectors.select("vector"), run, from_arrow_schema(_PARTS)).groupBy("cluster", "dim", "limb").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("radius").alias("radius")
    )
    sums, radius = [[0] * (dims + 1) for _ in range(k)], np.zeros(k)
    # One row per cluster, component and digit, however many vectors there are.
    for r in parts.collect():
        sums[r.cluster][r.dim] += int(r.total) << (_LIMB * r.limb)
        radius[r.cluster] = max(radius[r.cluster], r.radius)
    return [s[:-1] for s in sums], [s[-1] for s in sums], radius


def _matrix(rows: list[list[int]], dims: int) -> np.ndarray:
    big = any(abs(x) > _LIMIT for row in rows for x in row)
    return np.array(rows, object if big else float).reshape(len(rows), dims)


def _next(step: Round, sums: list[list[int]], counts: list[int], radius: np.ndarray) -> Round:
    """The round after `step`."""
    old = [[int(x) for x in row] for row in step.centroids.tolist()]
    moved = _matrix([[s // n for s in own] if n else kept for own, n, kept in zip(sums, counts, old)], step.centroids.shape[1])
    if moved.dtype == object or step.centroids.dtype == object:
        nothing = np.full(len(moved), np.inf)
        return Round(moved, nothing, nothing)
    drift = np.sqrt(((moved - step.centroids) ** 2).sum(axis=1))
    return Round(moved, drift * (1 + _SLACK), loosening(step.centroids, moved, radius * (1 + _SLACK)))


def _long(total: Column) -> Column:
    return F.least(total, F.lit(_LONG).cast("decimal(38,0)")).cast("long")


def k_means(
    vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: str = "3",
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """`vec_id, cluster, distance, cluster_inertia, inertia, centroid`: one row per vector that takes part.

    Vectors of `dims` components, none null or not finite, count; a component x is the
    integer floor(scale * x).  Centroids start as the `k` vectors with the smallest
    sha256 of `seed:id`; among equal ids the lesser vector comes first, rows without id
    come last, and with fewer vectors there are fewer centroids.  A round assigns each
    vector to the nearest centroid (ties: the smaller number) and replaces every centroid
    that has vectors by their mean, rounded down by component.  Distances are squared;
    those and sums beyond 64 bits are cut off there.  `centroid` holds the components as
    decimal integers joined by commas.  Repeated rows count one by one; other columns are
    left out; an empty table gives an empty one.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    vector = F.col(vector_col)
    kept = vectors.where(usable(vector) & (F.size(vector) == dims)).select(F.col(id_col).cast("long").alias("vec_id"), vector.cast(kind).alias("vector"))
    kept = cut_lineage(kept, "vectors")
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.orderBy(first.asc_nulls_last(), "vec_id", "vector").limit(k).collect()
    begin = [[int(x) for x in row] for row in integers(np.array([s.vector for s in starts], float).reshape(len(starts), dims), scale, _LIMIT).tolist()]
    still = np.zeros(len(starts))
    steps = [Round(_matrix(begin, dims), still, still)]
    for _ in range(rounds if starts else 0):
        after = _next(steps[-1], *_gather(kept, steps, scale))
        if after.centroids.tolist() == steps[-1].centroids.tolist():
            break  # nothing moves any more, in later rounds neither
        steps.append(after)
    last = steps[-1].centroids
    out = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.decimal128(38))])
    most = 10**38 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = integers(stack(batch.column(1), dims), scale, _LIMIT)
            cluster, _, _ = assign(v, steps)
            apart = pa.array([min(s, most) for s in own_squares(v, last, cluster)], pa.decimal128(38))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), apart], schema=out)

    found = cut_lineage(map_batches(kept, run, from_arrow_schema(out)), "clusters")
    inertia = {r.cluster: r.total for r in found.groupBy("cluster").agg(_long(F.sum("distance")).alias("total")).collect()}
    # One row per cluster: at most k.
    texts = [",".join(str(int(x)) for x in row) for row in last.tolist()]
    table = [(c, inertia[c], min(sum(inertia.values()), _LONG), text) for c, text in enumerate(texts) if c in inertia]
    facts = vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid string")
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", _long(F.col("distance")).alias("distance"), "cluster_inertia", "inertia", "centroid"
    )
