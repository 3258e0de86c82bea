"""Hard negatives by inner product, searched in an R-tree packed by sort and tile.

Vectors are dealt into the tree's top tiles: slabs by the quantiles of one coordinate, cut
into tiles by those of another; a tile of many (or equal) vectors is split further by
hash.  A task packs a tile the same way over the coordinates that vary most: leaves of
near vectors, and boxes over boxes up to a root.  A box's least and largest component give
an interval of inner products with an anchor, summed coordinate by coordinate.

An anchor searches for what its windows ask: the best k rows of its own label or of other
labels, with scores between two numbers.  A queue opens the box with the largest possible
score first.  A box is left out for a window if its interval lies outside of it or strictly
below the k-th best score found, and the search ends when that holds for all windows.

Positives come first, then each positive's window of negatives.  Either search runs in the
anchor's own tile first; the k-th scores found there go with the anchor to the other tiles.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from epilode.llm.topk import usable
from epilode.llm.vectors import integers, rough, stack, whole
from epilode.session import cut_lineage

#: Vectors of a tile, anchors of a block, vectors of a leaf, boxes of a box.
TILE = 8192
BLOCK = 4096
LEAF = 256
FAN = 8
_LONG = (1 << 63) - 1

_WINDOWS = "array<struct<positive:long, positive_id:long, positive_score:long, lo:long, hi:long, floor:long>>"
_FOUND = pa.schema([
    ("anchor", pa.int64()), ("anchor_id", pa.int64()), ("positive", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()),
    ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()),
])


class PackedTree:
    """Vectors in leaves of a sort-tile-recursive R-tree, with the boxes of all levels."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        n, dims = vectors.shape
        size = float(np.abs(rough(vectors)).max(initial=0))
        self.order = _tiled(vectors, leaf)
        self.vectors, self.starts = vectors[self.order], list(range(0, n, leaf))
        self.biggest, self.dims, self.leaf = size, dims, leaf
        low = np.array([self.vectors[s : s + leaf].min(axis=0) for s in self.starts])
        high = np.array([self.vectors[s : s + leaf].max(axis=0) for s in self.starts])
        # Boxes of all levels, the root last; children of a box are a range of the level below.
        self.children: list[range | None] = [None] * len(low)
        lows, highs, begin = [low], [high], 0
        while len(low) > 1:
            cuts = range(0, len(low), fan)
            self.children += [range(begin + s, begin + min(s + fan, len(low))) for s in cuts]
            begin += len(low)
            low, high = (np.array([f(x[s : s + fan], axis=0) for s in cuts]) for f, x in ((np.min, low), (np.max, high)))
            lows.append(low)
            highs.append(high)
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)

    def intervals(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible score of every query in every box."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def exact(self, queries: np.ndarray) -> tuple[PackedTree, np.ndarray]:
        """The tree and the queries in numbers whose products are exact."""
        if queries.dtype != object and self.vectors.dtype != object:
            if self.biggest * float(np.abs(queries).max(initial=0)) * max(1, self.dims) < 2.0**52:
                return self, queries
        if self.vectors.dtype != object:
            self.vectors, self.low, self.high = whole(self.vectors), whole(self.low), whole(self.high)
        return self, whole(queries)


def _tiled(vectors: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows in which runs of `leaf` rows are tiles."""
    n = len(vectors)
    leaves = max(1, -(-n // leaf))
    cuts = min(vectors.shape[1], max(1, int(math.log2(leaves)))) if leaves > 1 else 0
    # Coordinates that vary most are cut; floats serve, since any order of rows is right.
    spread = rough(vectors).var(axis=0) if n and cuts else np.zeros(0)
    order, parts = np.arange(n), [np.arange(n)]
    for level, axis in enumerate(np.argsort(-spread, kind="stable")[:cuts].tolist()):
        slabs = max(2, round(leaves ** (1 / cuts)))
        cut = []
        for rows in parts:
            rows = rows[np.argsort(vectors[rows, axis], kind="stable")]
            # Slabs of whole leaves.
            size = max(leaf, -(-len(rows) // (slabs * leaf)) * leaf)
            cut += [rows[s : s + size] for s in range(0, len(rows), size)]
        parts = cut
    return np.concatenate(parts) if parts else order


class _Wanted:
    """A window's best rows so far."""

    def __init__(self, k: int, lo, hi, floor):
        # The ends of 64 bits stand for no bound.
        self.k, self.hi = k, hi if hi < _LONG else math.inf
        self.lo, self.floor = (x if x > -_LONG else -math.inf for x in (lo, floor))
        self.heap: list[tuple] = []  # (score, -id, row), least first

    def least(self):
        """Scores strictly below this one cannot matter."""
        return max(self.lo, self.floor, self.heap[0][0] if len(self.heap) == self.k else self.lo)

    def offer(self, score, vec_id: int, row: int) -> None:
        entry = (score, -vec_id, row)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry[:2] > self.heap[0][:2]:
            heapq.heapreplace(self.heap, entry)


def search(tree: PackedTree, query: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray, ids: np.ndarray, windows: list[_Wanted]) -> int:
    """Fill the windows with the best allowed rows, places in the tree's order; returns the number of leaves read."""
    root, read = len(high) - 1, 0
    queue = [(-high[root], root)]
    while queue:
        bound, box = heapq.heappop(queue)
        open_ = [w for w in windows if -bound >= w.least() and low[box] <= w.hi]
        if not open_:
            if all(-bound < w.least() for w in windows):
                break  # the rest of the queue is no better
            continue
        if tree.children[box] is not None:
            for child in tree.children[box]:
                heapq.heappush(queue, (-high[child], child))
            continue
        read += 1
        start = box * tree.leaf
        part = slice(start, start + tree.leaf)
        scores = tree.vectors[part] @ query
        for w in open_:
            met = np.flatnonzero(allowed[part] & (scores >= w.least()) & (scores <= w.hi))
            if len(met) > 4 * w.k and scores.dtype != object:
                met = met[np.lexsort((ids[part][met], -scores[met]))[: w.k]]
            for i in met.tolist():
                w.offer(int(scores[i]), int(ids[start + i]), start + i)
    return read


def _cut(score: int) -> int:
    return max(-_LONG, min(_LONG, score))


def _searcher(scale: int, same: bool, k: int):
    """The cogroup function: a tile's rows and a block of anchors to the best rows of each window."""

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and asked.num_rows:
            dims = own.column("dims")[0].as_py()
            tree = PackedTree(integers(stack(own.column("vector"), dims), scale, 2.0**52))
            tree, queries = tree.exact(integers(stack(asked.column("vector"), dims), scale, 2.0**52))
            rows, ids, labels = (own.column(c).to_numpy()[tree.order] for c in ("row", "vec_id", "label"))
            lows, highs = tree.intervals(queries)
            columns = [asked.column(c).to_pylist() for c in ("row", "vec_id", "label", "windows")]
            for i, (anchor, anchor_id, label, asks) in enumerate(zip(*columns)):
                allowed = (labels == label) & (rows != anchor) if same else labels != label
                windows = [_Wanted(k, a["lo"], a["hi"], a["floor"]) for a in asks]
                search(tree, queries[i], lows[i], highs[i], allowed, ids, windows)
                for ask, window in zip(asks, windows):
                    head = (anchor, anchor_id, ask["positive"], ask["positive_id"], ask["positive_score"])
                    out += [(*head, int(rows[row]), -vec_id, _cut(score)) for score, vec_id, row in window.heap]
        columns = list(zip(*out)) if out else [()] * len(_FOUND)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _dealt(kept: DataFrame, tile: int) -> DataFrame:
    """`kept` with `tile`: slabs of a coordinate, tiles of another, and parts of crowded tiles by hash."""
    total = kept.groupBy("dims").agg(F.count("*").alias("n")).collect()  # one row per length of vectors
    tiled = None
    for dims, n in ((r.dims, r.n) for r in total):
        own, tiles = kept.where(F.col("dims") == dims), -(-n // tile)
        place = F.lit(0)
        if tiles > 1 and dims > 1:
            spread = own.select(*[F.var_pop(F.element_at("vector", i + 1).cast("double")).alias(f"v{i}") for i in range(min(dims, 256))]).first()
            first, second = sorted(range(min(dims, 256)), key=lambda i: -spread[i] if math.isfinite(spread[i]) else 0.0)[:2]
            slabs = math.isqrt(tiles - 1) + 1
            slab = _between(own, "slab", "vector", first, slabs, [])
            per = -(-tiles // slabs)
            own = _between(slab, "part", "vector", second, per, ["slab"])
            place = F.col("slab") * per + F.col("part")
        own = own.withColumn("place", place.cast("int")).drop("slab", "part")
        tiled = own if tiled is None else tiled.unionByName(own)
    if tiled is None:
        tiled = kept.withColumn("place", F.lit(0))
    tiled = cut_lineage(tiled, "tiles")
    crowded = tiled.groupBy(F.col("dims").alias("d_"), F.col("place").alias("p_")).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiled = tiled.join(F.broadcast(cut_lineage(crowded.where("parts > 1"), "crowded")), (F.col("dims") == F.col("d_")) & (F.col("place") == F.col("p_")), "left")
    part = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int")
    return tiled.withColumn("tile", F.struct("place", part.alias("part"))).drop("place", "parts", "d_", "p_")


def _between(df: DataFrame, into: str, vector: str, axis: int, parts: int, within: list[str]) -> DataFrame:
    """`df` with the number of the quantile range of a coordinate."""
    x = F.element_at(vector, axis + 1).cast("double")
    if parts < 2:
        return df.withColumn(into, F.lit(0))
    bounds = F.percentile_approx(x, [i / parts for i in range(1, parts)], 1000).alias("bounds")
    if not within:
        known = F.array(*[F.lit(b) for b in df.agg(bounds).first().bounds])
        return df.withColumn(into, F.size(F.filter(known, lambda b: b < x)))
    # A row per slab; with its number of bounds that is the number of tiles at most.
    joined = df.join(F.broadcast(df.groupBy(*within).agg(bounds)), within)
    return joined.withColumn(into, F.size(F.filter("bounds", lambda b: b < x))).drop("bounds")


def mine(
    vectors: DataFrame, is_anchor: Column, label: str | Column = "label", positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
    tile: int = TILE, block: int = BLOCK,
) -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score`.

    A component x counts as floor(scale * x); a row's score is its inner product with the
    anchor; higher scores come first, ties by the smaller id.  An anchor's positives are
    the first `positives` other rows of its label; for each of them, negatives are the
    first `negatives` rows of another label whose score lies between `low` and `high` per
    cent of the positive's: low * positive <= 100 * negative <= high * positive.

    Rows take no part if the id, label or vector is null or a component is null or not
    finite.  Every row counts: those that repeat an anchor's id are others to it, and each
    is an anchor of its own.  Vectors meet only vectors of their own length.  Scores beyond
    64 bits are cut off there.  An empty table, or one without anchors, gives an empty one.
    """
    own_label = F.col(label) if isinstance(label, str) else label
    kind = "array<float>" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    kept = vectors.where(F.col(id_col).isNotNull() & own_label.isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), own_label.cast("long").alias("label"), F.col(vector_col).cast(kind).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.size(vector_col).alias("dims"),
    )
    # Written with a number, which then stays the row's own.
    kept = _dealt(cut_lineage(kept.withColumn("row", F.monotonically_increasing_id()), "vectors"), tile)
    anchors = kept.where("is_anchor")
    counted = anchors.count()
    blocks = max(1, -(-counted // block))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumnRenamed("tile", "home")
    rows = kept.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    every = kept.groupBy("dims").agg(F.collect_set("tile").alias("tiles"))
    keys = ["dims", "tile", "block"]

    def searched(asked: DataFrame, same: bool, k: int) -> DataFrame:
        """The best of each window: first in the anchor's tile, then elsewhere above what was found."""

        def over(some: DataFrame) -> DataFrame:
            some = some.select(*keys, "row", "vec_id", "label", "vector", "windows")
            tiles = rows.select(*keys, "row", "vec_id", "label", "vector")
            return tiles.groupBy(*keys).cogroup(some.groupBy(*keys)).applyInArrow(_searcher(scale, same, k), from_arrow_schema(_FOUND))

        asked = cut_lineage(asked, "asked")
        home = cut_lineage(over(asked.withColumn("tile", F.col("home"))), "home")
        floors = home.groupBy("anchor", "positive").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
        floors = floors.groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("positive", "kth"))).alias("floors"))
        raised = asked.join(floors, "row", "left").withColumn("windows", F.transform("windows", lambda w: w.withField(
            "floor", F.coalesce(F.col("floors")[w["positive"]], w["floor"])
        )))
        others = raised.join(every, "dims").withColumn("tile", F.explode("tiles")).where(F.col("tile") != F.col("home"))
        return cut_lineage(_best(home.unionByName(over(others)), k), "best")

    everything = F.array(F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(
        ("positive", "positive_id", "positive_score", "lo", "hi", "floor"), (-1, -1, -1, -_LONG, _LONG, -_LONG))])).cast(_WINDOWS)
    chosen = searched(anchors.withColumn("windows", everything), True, positives)

    # low * p <= 100 * n <= high * p, for whole n; decimals hold the products.
    score = F.col("score").cast("decimal(25,0)")
    edges = (F.ceil(score * low / 100), F.floor(score * high / 100))
    lo, hi = (F.greatest(F.least(e, F.lit(_LONG)), F.lit(-_LONG)).cast("long") for e in edges)
    window = F.struct(
        F.col("row").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        lo.alias("lo"), hi.alias("hi"), F.lit(-_LONG).alias("floor"),
    )
    # Windows without any number between their ends (scores below zero) are not searched.
    windows = chosen.where(lo <= hi).groupBy(F.col("anchor").alias("row")).agg(F.collect_list(window).cast(_WINDOWS).alias("windows"))
    found = searched(anchors.join(windows, "row"), False, negatives)
    return found.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
