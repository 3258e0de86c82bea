"""Exact top-k search by inner product over an impact-ordered index.

Vectors are dealt into shards.  In a shard, each dimension is a posting list sorted by
value.  For a query, a posting's impact is its contribution to the score, counted from
the least contribution that the dimension has in the shard, and quantised to `LEVELS`
steps of the largest.  Postings are processed score at a time: all segments of the
higher levels, over all dimensions, before any of the lower ones.

After the segments of some levels, a vector's score is at most what it has gathered and
one level's impact for each dimension not yet met.  The search stops where it is proved
that few vectors can still reach the k-th best exact score found so far; those are scored
exactly.  Without such a proof it goes on to the last level.  A query first seeks a proof
after as many levels as the one before it in the block needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from epilode.session import cut_lineage

#: Vectors of a shard and queries of a block.
SHARD = 4096
BLOCK = 8192
LEVELS = 256
_STOPS = (160, 112, 80, 60, 46, 36, 28, 22, 17, 13, 9, 6, 3, 0)  # levels after which proof is sought
_LONG = (1 << 63) - 1

HITS = pa.schema([
    ("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()),
])


class ImpactIndex:
    """The posting lists of a shard of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, numbers: np.ndarray | None = None):
        numbers = np.arange(len(ids)) if numbers is None else numbers
        order = np.lexsort((numbers, ids))
        # Ties fall to the smaller id; rows are told apart by their numbers.
        self.ids, self.numbers, self.vectors = ids[order], numbers[order], vectors[order]
        self.rows = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.vectors.T, self.rows, axis=1)
        self.first = 0  # place in `_STOPS` at which the last proof was found
        self.met, self.impacts = np.empty(self.rows.size, np.int64), np.empty(self.rows.size)

    def exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Integer scores of some rows."""
        part = self.vectors[rows]
        size = max(1.0, np.abs(part).max(initial=0)) * max(1.0, np.abs(query).max(initial=0)) * max(1, len(query))
        if size < 2.0**62:
            return part.astype(np.int64) @ query.astype(np.int64)
        whole = [int(x) for x in query.tolist()]
        scores = [sum(int(a) * b for a, b in zip(row, whole)) for row in part.tolist()]
        return np.array([max(-_LONG, min(_LONG, s)) for s in scores], np.int64)

    def best(self, number: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k highest scores, ties to smaller ids; the row of this number is no candidate."""
        n, dims = self.vectors.shape
        allowed = self.numbers != number
        rows = np.flatnonzero(allowed)
        if dims and len(rows) > 4 * k:
            rows = self._possible(query, k, allowed)
        scores = self.exact(rows, query)
        chosen = np.lexsort((rows, -scores))[:k]
        return rows[chosen], scores[chosen]

    def _gathered(self, query: np.ndarray, least: np.ndarray, floor: float) -> np.ndarray:
        """For each row, how far the impacts of all segments down to `floor` are above it, summed."""
        n, filled = len(self.ids), 0
        for d in np.flatnonzero(query).tolist():
            # Values whose impact is at least the floor are one end of the list.
            edge = (least[d] + floor) / query[d]
            if query[d] > 0:
                part = slice(int(np.searchsorted(self.values[d], edge, "left")), n)
            else:
                part = slice(0, int(np.searchsorted(self.values[d], edge, "right")))
            end = filled + part.stop - part.start
            self.met[filled:end] = self.rows[d, part]
            np.multiply(self.values[d, part], query[d], out=self.impacts[filled:end])
            self.impacts[filled:end] -= least[d] + floor
            filled = end
        return np.bincount(self.met[:filled], self.impacts[:filled], n)

    def _possible(self, query: np.ndarray, k: int, allowed: np.ndarray) -> np.ndarray:
        """Rows that may be among the k best: a proved superset."""
        n, dims = self.vectors.shape
        low, high = self.values[:, 0] * query, self.values[:, -1] * query
        least = np.minimum(low, high)
        unit = float((np.maximum(low, high) - least).max()) / LEVELS
        if unit == 0.0:
            return np.flatnonzero(allowed)
        slack = 1 + 1e-9 * float(np.abs(low).sum() + np.abs(high).sum())  # rounding of very large numbers
        for place in range(self.first, len(_STOPS)):
            stop = _STOPS[place]
            # A dimension that is not met adds the floor at most.
            above = self._gathered(query, least, stop * unit)
            most = above + dims * stop * unit
            # The k-th best of some exact scores is reached by all that matter.
            lead = np.argpartition(np.where(allowed, above, -1.0), n - k)[n - k :]
            lead = lead[allowed[lead]]
            if len(lead) < k:
                continue
            reached = float(self.exact(lead, query).min()) - float(least.sum())
            possible = np.flatnonzero(allowed & (most >= reached - slack))
            if len(possible) <= max(8 * k, n // 64) or stop == 0:
                # The next query begins here, or a step earlier if this proof was easy.
                self.first = max(0, place - (len(possible) <= max(8 * k, n // 256)))
                return possible
        self.first = len(_STOPS) - 1
        return np.flatnonzero(allowed)


def usable(vector: Column) -> Column:
    """Not null, and all components finite numbers."""
    double = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _stack(table: pa.Table) -> np.ndarray:
    flat = table.column("vector").combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
    shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k highest inner products of each query with all other rows.

    A component x counts as floor(scale * x).  `is_query` is a condition on the columns of
    `vectors`.  Ties go to the smaller id.  A vector takes no part if it or its id is null
    or a component is null or not finite.  Every other row of any id is a candidate, equal
    ones too, and each row of a query id is a query of its own.  Vectors meet only vectors
    of their own length.  Scores beyond 64 bits are cut off there.  An empty table, or one
    without queries, gives an empty one.  Every query meets every shard: the work grows
    with the number of queries times that of vectors, in blocks.
    """
    cleaned = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vector_col, lambda x: x.cast("double")).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )
    # Written with a number, which then stays the row's own.
    cleaned = cut_lineage(cleaned.withColumn("row", F.monotonically_increasing_id()).withColumn("dims", F.size("vector")), "vectors")
    sizes = cleaned.agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q")).first()
    shards, blocks = max(1, -(-sizes.n // shard)), max(1, -(-(sizes.q or 0) // block))
    # Queries meet every shard, vectors every block of queries.
    mixed = F.xxhash64("row")
    rows = cleaned.withColumn("shard", F.pmod(mixed, F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    queries = cleaned.where("is_query").withColumn("block", F.pmod(mixed, F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )

    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, ...]] = []
        if own.num_rows and asked.num_rows:
            index = ImpactIndex(own.column("vec_id").to_numpy(), np.floor(scale * _stack(own)), own.column("row").to_numpy())
            wanted = np.floor(scale * _stack(asked))
            for number, query_id, query in zip(asked.column("row").to_pylist(), asked.column("vec_id").to_pylist(), wanted):
                rows, scores = index.best(number, query, k)
                found = zip(index.numbers[rows].tolist(), index.ids[rows].tolist(), scores.tolist())
                out += [(number, query_id, *hit) for hit in found]
        columns = list(zip(*out)) if out else [()] * len(HITS)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, HITS)], schema=HITS)

    keys = ["dims", "shard", "block"]
    names = [*keys, "row", "vec_id", "vector"]
    found = rows.select(names).groupBy(*keys).cogroup(queries.select(names).groupBy(*keys)).applyInArrow(
        search, from_arrow_schema(HITS)
    )
    by = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
