"""Communities of a weighted graph by modularity: local moves on DataFrames, and contraction between levels.

All nodes of a round decide at once, on what communities looked like before it. So that their moves add up, a community either
sends or receives in a round, by chance and by how many want to enter and to leave it; and a node moves if its gain pays for all
that would leave or enter with it, or if it is the best one both of its community and of its target. Modularity
can't fall, whatever the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import written


@dataclass(frozen=True)
class Moves:
    """passes: over all levels, each from the communities of the last; rounds: of one level at most. A level ends once no more than
    `few` of its nodes moved in two rounds."""

    passes: int = 3
    rounds: int = 40
    few: float = 0.01


def _arcs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst, w) between nodes both ways, and (id, k): each node's weight, that of a loop twice. Edges without weight are left out."""
    pairs = edges.where("w > 0").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("w").alias("w"))
    pairs = written(pairs)
    ends = pairs.select(F.explode(F.array("u", "v")).alias("id"), "w")
    k = ends.groupBy("id").agg(F.sum("w").alias("k"))
    cross = pairs.where("u <> v")
    return cross.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w").union(cross.select("v", "u", "w")), k


def _links(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, comm, w): each node's weight to each community beside it. A hub's arcs are summed where they lie, before any join by the hub."""
    return arcs.join(nodes.select(F.col("id").alias("dst"), "comm"), "dst").groupBy("src", "comm").agg(F.sum("w").alias("w"))


def _wishes(arcs: DataFrame, nodes: DataFrame, m2: float) -> DataFrame:
    """(id, comm, k, best, delta): the community where a node gains most by a move, null where it would gain nowhere.

    The gain of being in c is 2 w / m2 - 2 k tot / m2**2, tot without the node itself; m2 is twice the weight of all edges.
    """
    totals = nodes.groupBy("comm").agg(F.sum("k").alias("tot"))
    own = nodes.join(totals, "comm").select(F.col("id").alias("src"), F.col("comm").alias("own"), "k", (F.col("tot") - F.col("k")).alias("left"))
    rows = own.join(_links(arcs, nodes).join(totals, "comm"), "src", "left")
    there = F.when(F.col("comm") != F.col("own"), 2 * F.col("w") / m2 - 2 * F.col("k") * F.col("tot") / m2**2)
    inside = F.coalesce(F.sum(F.when(F.col("comm") == F.col("own"), F.col("w"))), F.lit(0.0))
    rows = rows.groupBy("src", "own", "k", "left").agg(F.max(there).alias("gain"), F.min_by("comm", F.when(there.isNotNull(), F.struct(-there, "comm"))).alias("best"), inside.alias("inside"))
    delta = F.col("gain") - (2 * F.col("inside") / m2 - 2 * F.col("k") * F.col("left") / m2**2)
    wants = F.coalesce(delta > 1e-12, F.lit(False))
    return rows.select(F.col("src").alias("id"), F.col("own").alias("comm"), "k", F.when(wants, F.col("best")).alias("best"), F.when(wants, delta).alias("delta"))


def _round(arcs: DataFrame, nodes: DataFrame, m2: float, n: int) -> tuple[DataFrame, int, int]:
    """The nodes after round n, how many moved, and how many would gain by a move."""
    wishes = written(_wishes(arcs, nodes, m2))
    wants = wishes.where("best IS NOT NULL")
    each = wants.select(F.col("comm").alias("c"), F.lit(0).alias("in")).union(wants.select("best", F.lit(1)))
    chance = F.pmod(F.xxhash64(F.lit(n), "c"), F.lit(1 << 20)) / (1 << 20)
    role = each.groupBy("c").agg(F.sum("in").alias("in"), F.count("*").alias("all")).select("c", (chance < (F.col("in") + 0.5) / (F.col("all") + 1)).alias("receives"))
    moving = wants.join(role.where("NOT receives").select(F.col("c").alias("comm")), "comm", "left_semi").join(role.where("receives").select(F.col("c").alias("best")), "best", "left_semi")
    first = F.max(F.struct("delta", "id"))["id"]
    into = moving.groupBy("best").agg(F.sum("k").alias("in_k"), first.alias("in_first"))
    out = moving.groupBy("comm").agg(F.sum("k").alias("out_k"), first.alias("out_first"))
    pays = F.col("delta") > 2 * F.col("k") * (F.col("in_k") + F.col("out_k") - 2 * F.col("k")) / m2**2
    only = (F.col("id") == F.col("in_first")) & (F.col("id") == F.col("out_first"))
    moved = moving.join(into, "best").join(out, "comm").where(pays | only).select("id", F.col("best").alias("to"))
    after = written(wishes.join(moved, "id", "left").select("id", F.coalesce("to", "comm").alias("comm"), "k", F.col("best").isNotNull().alias("wants"), F.col("to").isNotNull().alias("moved")))
    seen = after.agg(F.count_if("moved").alias("moved"), F.count_if("wants").alias("wants")).first()
    return after.select("id", "comm", "k"), seen.moved, seen.wants


def _settled(arcs: DataFrame, nodes: DataFrame, m2: float, salt: int, p: Moves) -> tuple[DataFrame, bool]:
    """The nodes once hardly any moves, and whether any did."""
    n, moves = nodes.count(), []
    for k in range(p.rounds):
        nodes, moved, wants = _round(arcs, nodes, m2, salt + k)
        moves.append(moved)
        if not wants or len(moves) > 1 and sum(moves[-2:]) <= p.few * n:
            break
    return nodes, any(moves)


def _contracted(arcs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """arcs and nodes of the graph whose nodes are the communities; what lies inside one is in its k alone."""
    side = lambda e: nodes.select(F.col("id").alias(e), F.col("comm").alias(f"c_{e}"))
    cross = arcs.join(side("src"), "src").join(side("dst"), "dst").where("c_src <> c_dst")
    arcs = cross.groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("w").alias("w"))
    return written(arcs), written(nodes.groupBy("comm").agg(F.sum("k").alias("k")).select(F.col("comm").alias("id"), "comm", "k"))


def modularity(edges: DataFrame, members: DataFrame) -> float:
    """Of edges (u, v, w) by members (entity_id, community)."""
    arcs, k = _arcs(edges)
    side = lambda e: members.select(F.col("entity_id").alias(e), F.col("community").alias(f"c_{e}"))
    total = k.agg(F.sum("k")).first()[0]
    if not total:
        return 0.0
    inside = edges.where("w > 0").join(side("u"), "u").join(side("v"), "v").where("c_u = c_v").agg(F.coalesce(2 * F.sum("w"), F.lit(0.0))).first()[0]
    shares = k.join(members.withColumnRenamed("entity_id", "id"), "id").groupBy("community").agg(F.pow(F.sum("k") / total, F.lit(2)).alias("x"))
    return inside / total - shares.agg(F.sum("x")).first()[0]


def communities(edges: DataFrame, p: Moves = Moves()) -> DataFrame:  # noqa: B008
    """(entity_id, community) of the nodes of undirected edges (u, v, w); a community is named by its smallest node.

    Edges that repeat count together; those without positive weight, and nodes that have no other, are left out.
    """
    arcs, k = _arcs(edges.select("u", "v", F.col("w").cast("double").alias("w")))
    arcs, nodes = written(arcs), written(k.select("id", F.col("id").alias("comm"), "k"))
    m2 = nodes.agg(F.sum("k")).first()[0]
    salt, merged = 0, m2 is not None
    for _ in range(p.passes if merged else 0):
        nodes, merged = _settled(arcs, nodes, m2, salt, p)
        level_arcs, level = arcs, nodes
        while merged:
            salt += p.rounds
            level_arcs, level = _contracted(level_arcs, level)
            level, merged = _settled(level_arcs, level, m2, salt, p)
            if merged:
                to = level.select(F.col("id").alias("comm"), F.col("comm").alias("to"))
                nodes = written(nodes.join(to, "comm").select("id", F.col("to").alias("comm"), "k"))
        salt += p.rounds
        if level_arcs is arcs:
            break
    smallest = nodes.groupBy("comm").agg(F.min("id").alias("community"))
    return nodes.join(smallest, "comm").select(F.col("id").alias("entity_id"), "community")
