"""Betweenness of nodes: shortest paths from many sources at once, counted forwards and summed up backwards.

A batch of sources is one DataFrame of (source, node); each step is a join with the arcs and an aggregation by source and node, whose
partial sums meet a hub's arcs where they lie.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import written


def sources_needed(nodes: int, error: float, failure: float = 0.1) -> int:
    """Sources, drawn with equal chances, after which every node's betweenness (0..1) is off by at most `error`, but with a chance of `failure`.

    By Hoeffding's inequality for each node and the union over all: a source adds at most n / (n - 1) to a mean of n sources.
    """
    if nodes < 3:
        return nodes
    return min(nodes, math.ceil((nodes / (nodes - 1)) ** 2 * math.log(2 * nodes / failure) / (2 * error**2)))


def _arcs(edges: DataFrame, weighted: bool) -> DataFrame:
    """(src, dst, len) both ways, of edges that repeat the shortest; lengths are whole or as they are given."""
    pairs = written(edges.where("u <> v").groupBy(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).agg(F.min("w" if weighted else F.lit(1)).alias("len")))
    if weighted and pairs.where("len <= 0 OR len IS NULL").take(1):
        raise ValueError("lengths of edges must be above 0")
    return pairs.union(pairs.select("dst", "src", "len"))


def _by_steps(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, part): what the sources add to each node, the sum over targets of the share of shortest paths that pass it.

    Breadth first: neighbours of a level lie in it or in those beside it, so a step reads two levels and not all that was seen.
    """
    levels = [sources.select("source", F.col("source").alias("node"), F.lit(1.0).alias("paths"))]
    while True:
        step = levels[-1].withColumnRenamed("node", "src").join(arcs, "src").groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        for seen in levels[-2:]:
            step = step.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        step = written(step)
        if not step.take(1):
            break
        levels.append(step)
    parts = []
    later = levels[-1].select("source", "node", "paths", F.lit(0.0).alias("part"))
    for level in reversed(levels[:-1]):
        parts.append(later.where("node <> source").select("node", "part"))
        share = later.select("source", F.col("node").alias("dst"), ((1 + F.col("part")) / F.col("paths")).alias("share"))
        back = share.join(arcs, "dst").select("source", F.col("src").alias("node"), "share").groupBy("source", "node").agg(F.sum("share").alias("more"))
        later = written(level.join(back, ["source", "node"], "left").select("source", "node", "paths", (F.col("paths") * F.coalesce("more", F.lit(0.0))).alias("part")))
    total = parts[0] if parts else later.where("false").select("node", "part")
    for part in parts[1:]:
        total = total.union(part)
    return total.groupBy("node").agg(F.sum("part").alias("part"))


def _distances(arcs: DataFrame, sources: DataFrame, digits: int) -> DataFrame:
    """(source, node, dist) of all nodes that a source reaches: each round hands on what became shorter in the last."""
    best = written(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(True).alias("new")))
    while True:
        step = best.where("new").select("source", F.col("node").alias("src"), "dist").join(arcs, "src")
        step = step.groupBy("source", F.col("dst").alias("node")).agg(F.min(F.round(F.col("dist") + F.col("len"), digits)).alias("near"))
        both = best.drop("new").join(step, ["source", "node"], "full")
        shorter = F.coalesce(F.col("near") < F.col("dist"), F.col("dist").isNull())
        best = written(both.select("source", "node", F.when(shorter, F.col("near")).otherwise(F.col("dist")).alias("dist"), shorter.alias("new")))
        if not best.where("new").take(1):
            return best.drop("new")


def _by_lengths(arcs: DataFrame, sources: DataFrame, digits: int) -> DataFrame:
    """The same for arcs with lengths. A node's layer is one more than the largest of those before it on a shortest path, so that a
    layer needs only earlier ones; layers take the place of levels."""
    dist = _distances(arcs, sources, digits)
    at = lambda name, far: dist.select("source", F.col("node").alias(name), F.col("dist").alias(far))
    on = at("src", "near").join(arcs, "src").join(at("dst", "far"), ["source", "dst"]).where(F.round(F.col("near") + F.col("len"), digits) == F.col("far"))
    on = written(on.select("source", "src", "dst"))  # arcs of shortest paths
    layers = dist.select("source", "node", F.lit(0).alias("layer"), (F.col("node") == F.col("source")).alias("new"))
    while layers.where("new").take(1):
        step = layers.where("new").select("source", F.col("node").alias("src"), "layer").join(on, ["source", "src"]).groupBy("source", F.col("dst").alias("node")).agg((F.max("layer") + 1).alias("next"))
        later = F.coalesce(F.col("next") > F.col("layer"), F.lit(False))
        layers = written(layers.drop("new").join(step, ["source", "node"], "left").select("source", "node", F.when(later, F.col("next")).otherwise(F.col("layer")).alias("layer"), later.alias("new")))
    last = layers.agg(F.max("layer")).first()[0] or 0
    on = written(on.join(layers.select("source", F.col("node").alias("dst"), "layer"), ["source", "dst"]))
    paths = layers.where("layer = 0").select("source", "node", F.lit(1.0).alias("paths"), F.lit(0).alias("layer"))
    for k in range(1, last + 1):
        came = on.where(F.col("layer") == k).join(paths.select("source", F.col("node").alias("src"), "paths"), ["source", "src"])
        paths = written(paths.union(came.groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"), F.lit(k).alias("layer"))))
    found = paths.withColumn("part", F.lit(0.0))
    for k in range(last, 0, -1):
        far = found.where(F.col("layer") == k).select("source", F.col("node").alias("dst"), ((1 + F.col("part")) / F.col("paths")).alias("share"))
        back = on.where(F.col("layer") == k).join(far, ["source", "dst"]).groupBy("source", F.col("src").alias("node")).agg(F.sum("share").alias("more"))
        found = written(found.join(back, ["source", "node"], "left").select("source", "node", "paths", "layer", (F.col("part") + F.col("paths") * F.coalesce("more", F.lit(0.0))).alias("part")))
    return found.where("node <> source").groupBy("node").agg(F.sum("part").alias("part"))


def betweenness(edges: DataFrame, sources: DataFrame | None = None, weighted: bool = False, batch: int = 256, digits: int = 9) -> DataFrame:
    """(entity_id, betweenness) of the nodes of undirected edges (u, v, w), scaled to 0..1 by the pairs that a node can lie between.

    With `weighted`, w is an edge's length and must be above 0; lengths of paths are compared to `digits` places. sources
    (entity_id) estimate it from shortest paths that begin at them (see sources_needed); without, every node is one and the
    result is exact. `batch` sources are followed at a time, so that what is kept grows with nodes times batch.
    Edges are written first, as arcs and nodes are both made of them.
    """
    edges = written(edges.select("u", "v", *(["w"] if weighted else [])))
    arcs = written(_arcs(edges, weighted))
    nodes = written(edges.select(F.explode(F.array("u", "v")).alias("entity_id")).distinct())
    n = nodes.count()
    start = (nodes if sources is None else sources.select("entity_id").distinct().join(nodes, "entity_id", "left_semi")).withColumnRenamed("entity_id", "source")
    k = start.count()
    if not k or n < 3:
        return nodes.withColumn("betweenness", F.lit(0.0))
    parts = max(1, math.ceil(k / batch))
    start = written(start.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(parts))))
    total = None
    for at in range(parts):
        some = start.where(F.col("part") == at)
        own = _by_lengths(arcs, some, digits) if weighted else _by_steps(arcs, some)
        total = written(own if total is None else total.union(own).groupBy("node").agg(F.sum("part").alias("part")))
    scaled = F.coalesce(F.col("part") * n / k / ((n - 1) * (n - 2)), F.lit(0.0))
    return nodes.join(total.withColumnRenamed("node", "entity_id"), "entity_id", "left").select("entity_id", scaled.alias("betweenness"))


def drawn_sources(nodes: DataFrame, error: float, failure: float = 0.1, seed: int = 1) -> DataFrame:
    """The sources (entity_id) of nodes with the smallest hashes, as many as sources_needed() says."""
    nodes = written(nodes.select("entity_id").distinct())
    return nodes.orderBy(F.xxhash64(F.lit(seed), "entity_id"), "entity_id").limit(sources_needed(nodes.count(), error, failure))
