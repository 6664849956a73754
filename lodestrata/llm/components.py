"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, saved, spread


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the least node reachable.

    Each round hangs larger neighbours under a node's least neighbour (large
    star), then a node's smaller neighbours under the least of them (small
    star). Both keep connectivity and no round makes more rows than it read.
    A node that is its own minimum keeps its edges as they are, so the centre
    of a large star is never a join key. Rounds end when the edges stay the
    same; the table between two rounds lies in the shared folder.

    Self-loops and nulls are dropped; an empty input gives an empty result.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = saved(e, "edges")
    before = _state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).where("m < a")
        # e holds (larger a, smaller b): edges below a centre go over as they are unless the centre moves.
        moved = e.select(F.col("b").alias("c"), F.col("a").alias("v")).join(spread(least.withColumnRenamed("a", "c")), "c", "left")
        large = moved.select(F.col("v").alias("a"), F.coalesce("m", "c").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread(large).join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        done, e = e, saved(small, "edges")
        after = _state(e)
        discard(done)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
