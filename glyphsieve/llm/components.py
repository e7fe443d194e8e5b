"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half round.  edges: a > b, distinct.  The minimum is pre-aggregated, so a hub's rows are joined
    (and split by the skew join), never gathered in a task."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if large:  # each larger neighbour moves to the least of the neighbourhood
        up = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        out = up.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # each smaller neighbour moves, and the node itself stays linked
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs, any order, repeats and loops allowed -> (node, root): the least node reachable,
    for every node with a link to another.  Each round is written to the shared folder; the rounds stop when
    the edge set, held against the one before by count and hash sums, no longer changes."""
    now = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or state == last:
            break
        last = state
        step = scratch.write(_star(_star(now, True), False), "edges")
        scratch.drop(now)
        now = step
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
