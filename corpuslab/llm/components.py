"""Connected components of a graph given by its edges, by alternating large and small stars.

Every step is a map-side combined minimum and a join; nothing is collected. Each round is written to the shared folder, so a lost executor repeats one round
at most, and the number of rounds grows with the logarithm of a component's diameter.

Cases: an edge from a node to itself, or one given twice, changes nothing; null ends are ignored; no edges give no rows. The least node of a component is its root, so there are no ties.
A hub with a third of all edges is a group of a combined minimum and one side of a join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_A_FILE, Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(near: DataFrame, keep) -> DataFrame:
    """For each a the least of itself and its neighbours, linked to those that ``keep`` names."""
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    return keep(joined).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 40, scratch: Scratch | None = None) -> DataFrame:
    """edges: a, b of one sortable type. ``scratch`` holds the last round. Returns node, root: each node of an edge and the least node of its component."""
    scratch = scratch or Scratch(edges.sparkSession)
    now = scratch.hold(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())  # F.greatest skips nulls, so a null end makes a pair of equals
    mark = _mark(now)
    files = 1 + mark[0] // ROWS_A_FILE  # rounds have no more edges than the first
    now = scratch.materialise(now.coalesce(files), "edges")
    for _ in range(rounds):
        large = _star(_both_ways(now), lambda j: j.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = large.select("a", "b")  # a > b
        small = _star(down, lambda j: j.select(F.col("b").alias("a"), F.col("m").alias("b")).union(j.select("a", F.col("m").alias("b"))))
        now = scratch.materialise(small.coalesce(files), "stars")
        # a forest of stars: no node is both a leaf and a root
        new = _mark(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
