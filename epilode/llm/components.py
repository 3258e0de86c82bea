"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilode.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """`node, root` for every node of the edges (a, b); the root is a component's least node.

    Alternates two steps until nothing changes: every node hands its least neighbour to
    its larger neighbours, then to its smaller ones.  The number of rounds grows with
    the logarithm of a component's size.  Least neighbours come from partial
    aggregates that are joined back, so a hub's rows are not gathered in a task.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = cut_lineage(
        edges.where(F.col("a") != F.col("b")).select(high.alias("a"), low.alias("b")).distinct(), "edges"
    )
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a != b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        edges = cut_lineage(
            small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges"
        )
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
