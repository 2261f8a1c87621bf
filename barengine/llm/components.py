"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def star_step(edges: DataFrame) -> DataFrame:
    """One large and one small star: edges (a long, b long) -> edges with a > b and the same components.

    Nodes come nearer to the smallest node they reach. Stars are made with a minimum
    per node and a join back, so no node's neighbours are gathered in one place; both
    halves are written to the shared folder, which cuts the lineage.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # large star: larger neighbours of a node hang on the smallest one
    large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .where("a <> b").distinct())
    large = materialize(large, "cc")
    # small star: a node and its smaller neighbours hang on the smallest one
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a")
    return materialize(small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                       .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "cc")


def nearest(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest neighbour of every node that has a smaller one, in edges with a > b."""
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, comp): comp is the smallest node reachable.

    Ends when a step changes no edge.
    """
    e, seen = edges, None
    while True:
        e = star_step(e)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()
