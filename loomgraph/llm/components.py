"""Connected components by alternating stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges (a, b): component is the smallest id that can be reached.

    Each round joins every node's neighbours to the smallest of them, first those above the node, then those
    below; the number of rounds grows with the logarithm of the longest path. A node's minimum is aggregated
    before it is joined back, so that a hub is never gathered in one task. It ends when every node has one smaller
    neighbour, which has none. No edges: no rows. Loops and repeated edges change nothing. Each round is read back from
    Parquet, whose small files are read together, so that few edges make few tasks and shuffle files in every round.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not _stars(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = up.groupBy("a").agg(F.min("b").alias("m"))
        joined = up.join(least, "a")
        down = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        now = written(down.where("a <> b").distinct(), "edges")
    nodes = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.union(nodes.select("component", "component").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether the edges (a, b) with a > b are stars around their smallest nodes."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("b", F.lit(0), F.lit(1)))
    degrees = ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return not degrees.where("below > 1 OR below = 1 AND above = 1").take(1)
