"""Graph algorithms on edges (u, v, w): personalised PageRank, components, seeded sub-graphs, bridge candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scoring import bridge, min_max, type_pair_prior, with_source_weights
from loomgraph.operators import first_per
from loomgraph.operators.edges import induced, merged_edges, node_stats, undirected, weighted_counts
from loomgraph.operators.entities import quality
from loomgraph.operators.quantiles import at_least_quantile, exact_quantiles
from loomgraph.params import SUBGRAPH_SOURCES, Mining, Seeded
from loomgraph.session import checkpointed, written


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of undirected edges."""
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w").union(edges.select("v", "u", "w"))


def pagerank(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, p: Mining = Mining(), iterations: int | None = None) -> DataFrame:  # noqa: B008
    """(entity_id, ppr) of every node by power iteration from 1/N, restarting at the seeds among the nodes.

    Rank of nodes without outgoing weight goes to the seeds. It ends when the ranks move by less than N * tolerance in
    all, or after `iterations`, and fails if max_iterations don't suffice. Without seeds every rank is 0. Out-weights
    are normalised once; each step is one join and one aggregation by destination, whose partial sums meet a hub's
    edges where they lie. Nodes and arcs are written first, as each is read several times.
    """
    nodes = written(nodes.select("entity_id").distinct())
    start = seeds.select("entity_id").distinct().join(nodes, "entity_id", "left_semi")
    n, k = nodes.count(), start.count()
    if not k:
        return nodes.withColumn("ppr", F.lit(0.0))
    ends = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))))
    arcs = written(edges.where("w > 0").select(ends.alias("a"), "w").groupBy("a.src", "a.dst").agg(F.sum("w").alias("w")))
    out = arcs.groupBy("src").agg(F.sum("w").alias("total"))
    arcs = checkpointed(arcs.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")).repartition("src"))
    restart = start.withColumn("restart", F.lit(1.0 / k))
    base = nodes.join(restart, "entity_id", "left").join(out.select(F.col("src").alias("entity_id"), F.lit(True).alias("flows")), "entity_id", "left")
    base = checkpointed(base.select("entity_id", F.coalesce("restart", F.lit(0.0)).alias("restart"), F.col("flows").isNull().alias("sink")))
    now = base.withColumn("ppr", F.lit(1.0 / n))
    for _ in range(iterations or p.max_iterations):
        lost = now.agg(F.sum(F.when(F.col("sink"), F.col("ppr")).otherwise(0.0)).alias("lost"))
        moved = arcs.join(now.select(F.col("entity_id").alias("src"), "ppr"), "src").groupBy(F.col("dst").alias("entity_id")).agg(F.sum(F.col("ppr") * F.col("share")).alias("flow"))
        new = now.join(moved, "entity_id", "left").crossJoin(F.broadcast(lost))  # one row
        rank = p.damping * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") * F.col("restart")) + (1 - p.damping) * F.col("restart")
        new = new.select("entity_id", "restart", "sink", rank.alias("ppr"), F.col("ppr").alias("before"))
        new = checkpointed(new)  # each step reads the ranks three times
        now = new.drop("before")
        if not iterations and new.agg(F.sum(F.abs(F.col("ppr") - F.col("before")))).first()[0] < n * p.tolerance:
            break
    else:
        if not iterations:
            raise RuntimeError(f"ranks still move after {p.max_iterations} steps")
    return now.select("entity_id", "ppr")


def _roots(pairs: DataFrame) -> DataFrame:
    """(id, root): each end's smallest neighbour or itself, that one's in turn, and so on to ends that have no smaller neighbour."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("far")), F.struct(F.col("b").alias("id"), F.col("a").alias("far"))))
    now = written(pairs.select(ends.alias("e")).groupBy("e.id").agg(F.min("e.far").alias("near")).select("id", F.least("id", "near").alias("root")))
    while True:
        far = now.select(F.col("id").alias("root"), F.col("root").alias("far"))
        new = written(now.join(far, "root").select("id", F.col("far").alias("root"), (F.col("far") < F.col("root")).alias("changed")))
        now = new.drop("changed")
        if not new.where("changed").take(1):
            return now


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(entity_id, component): the smallest id that can be reached. Nodes without edges are their own.

    Each round replaces the ends of edges by their roots, and only the different edges between different roots go on to the
    next. A root that stays has taken in a neighbour or is no root in the round after, so that two rounds halve the ends.
    """
    pairs = edges.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    rounds = []
    pairs = written(pairs)
    while not rounds or pairs.take(1):
        rounds.append(_roots(pairs))
        for end in ("a", "b"):
            pairs = pairs.join(rounds[-1].select(F.col("id").alias(end), "root"), end).drop(end).withColumnRenamed("root", end)
            pairs = pairs.where("a <> b").distinct()  # most fall together before they are dealt out again
        pairs = written(pairs)
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("id").alias("root"), F.col("root").alias("last"))
        found = rounds.pop().join(later, "root", "left").select("id", F.coalesce("last", "root").alias("root"))
    found = found.select(F.col("id").alias("entity_id"), F.col("root").alias("component"))
    if nodes is None:
        return found
    ids = nodes.select("entity_id").union(found.select("entity_id")).distinct()
    return ids.join(found, "entity_id", "left").select("entity_id", F.coalesce("component", "entity_id").alias("component"))


def giant_component(edges: DataFrame) -> DataFrame:
    """Edges of the component with most nodes, of equal ones the smallest."""
    parts = connected_components(edges)
    top = parts.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return induced(edges, parts.join(F.broadcast(top), "component", "left_semi"))  # one row


def local_weight(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(entity_id, local): each node's weight to seeds one step away."""
    near = both_ways(edges).join(seeds.select(F.col("entity_id").alias("dst")).distinct(), "dst", "left_semi")
    return near.groupBy(F.col("src").alias("entity_id")).agg(F.sum("w").alias("local"))


def top_seed_neighbours(edges: DataFrame, seeds: DataFrame, k: int = 6) -> DataFrame:
    """(entity_id, explain): `seed:weight` of a node's k heaviest seeds, joined by semicolons."""
    near = both_ways(edges).join(seeds.select(F.col("entity_id").alias("dst")).distinct(), "dst", "left_semi")
    best = first_per(near, ["src"], [F.desc("w"), "dst"], k)
    parts = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "dst"))), lambda x: F.format_string("%s:%.3f", x["dst"], -x["w"]))
    return best.groupBy(F.col("src").alias("entity_id")).agg(F.array_join(parts, ";").alias("explain"))


def _seed_rows(relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows with (seed, neighbour): the seed end and the other; between seeds from source to target."""
    ids = seeds.select("entity_id").distinct()
    for end in ("source", "target"):
        relations = relations.join(ids.select(F.col("entity_id").alias(f"{end}_entity_id"), F.lit(True).alias(f"{end}_seed")), f"{end}_entity_id", "left")
    rows = relations.where("(source_seed OR target_seed) AND source_entity_id <> target_entity_id AND source_entity_id <> '' AND target_entity_id <> ''")
    forward = F.col("source_seed").isNotNull()
    return rows.withColumns({"seed": F.when(forward, F.col("source_entity_id")).otherwise(F.col("target_entity_id")), "neighbour": F.when(forward, F.col("target_entity_id")).otherwise(F.col("source_entity_id"))})


def seed_neighbours(relations: DataFrame, seeds: DataFrame, p: Seeded = Seeded()) -> DataFrame:  # noqa: B008
    """(seed, neighbour, count, weight_sum, weight_mean, weight_max): each seed's strongest neighbours."""
    counts = _seed_rows(relations, seeds).groupBy("seed", "neighbour", "source").agg(F.count("*").alias("n"))
    rows = with_source_weights(counts, SUBGRAPH_SOURCES).groupBy("seed", "neighbour")
    out = rows.agg(F.sum("n").alias("count"), F.sum(F.col("n") * F.col("w")).alias("weight_sum"), F.max("w").alias("weight_max")).withColumn("weight_mean", F.col("weight_sum") / F.col("count"))
    out = out.select("seed", "neighbour", "count", "weight_sum", "weight_mean", "weight_max")
    return first_per(out, ["seed"], [F.desc(F.round("weight_sum", 9)), F.desc("count"), "neighbour"], p.top_k)


def confidence_edges(relations: DataFrame, nodes: DataFrame, p: Seeded = Seeded()) -> DataFrame:  # noqa: B008
    """Edges among nodes with their confidence, scaled as it is and capped at a quantile."""
    ends = induced(undirected(relations), nodes)
    part = weighted_counts(ends, ["u", "v"], SUBGRAPH_SOURCES)
    part = part.groupBy("u", "v", "label").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("w")).alias("w"), F.max("w").alias("top"))
    out = part.groupBy("u", "v").agg(F.sum("n").alias("count"), F.sum("w").alias("weight_sum"), F.max("top").alias("weight_max"), F.min_by("label", F.struct(-F.col("n"), "label")).alias("reltype_top"))
    out = checkpointed(out.where(F.col("count") >= p.min_count).withColumn("confidence", F.col("weight_sum")))
    cap = exact_quantiles(out, "confidence", p.quantile).get("")
    ends = out.agg(F.lit(cap).cast("double").alias("cap"), F.min("confidence").alias("low"), F.max("confidence").alias("high"))
    out = out.crossJoin(F.broadcast(ends))  # one row
    scaled = lambda x, high: F.when(high > F.col("low"), (x - F.col("low")) / (high - F.col("low"))).otherwise(0.0)
    out = out.withColumns({"conf_norm_mm": scaled(F.col("confidence"), F.col("high")), "conf_norm_q": scaled(F.least("confidence", "cap"), F.col("cap"))})
    return out.select("u", "v", "count", "weight_sum", (F.col("weight_sum") / F.col("count")).alias("weight_mean"), "weight_max", "reltype_top", "confidence", "conf_norm_mm", "conf_norm_q")


def final_edges(edges: DataFrame, types: DataFrame, p: Seeded = Seeded()) -> DataFrame:  # noqa: B008
    """(u, v, w_final, reltype_top): confidence times the prior of the ends' types (entity_id, entity_type), the weakest dropped."""
    out = edges.where(F.col("reltype_top").isin([*p.relations, ""]))
    for end in ("u", "v"):
        out = out.join(types.select(F.col("entity_id").alias(end), F.col("entity_type").alias(f"type_{end}")), end, "left")
    kind = lambda e: F.coalesce(f"type_{e}", F.lit("Other"))
    out = out.withColumn("w_final", F.col("conf_norm_q") * type_pair_prior(kind("u"), kind("v")))
    out = at_least_quantile(out, "w_final", p.min_quantile)
    if p.top_edges:
        out = out.orderBy(F.desc("w_final"), "u", "v").limit(p.top_edges)
    return merged_edges(out)


def seeded_subgraph(relations: DataFrame, seeds: DataFrame, types: DataFrame, pool: DataFrame | None = None, p: Seeded = Seeded()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(nodes, edges): the seeds with their strongest neighbours, and the edges among them.

    pool (entity_id) limits the neighbours, types (entity_id, entity_type) give the priors. The number of neighbours is
    a parameter of the sub-graph, as is top_k.
    """
    near = seed_neighbours(relations, seeds, p)
    best = near.groupBy("neighbour").agg(F.sum("weight_sum").alias("w")).orderBy(F.desc(F.round("w", 9)), "neighbour").limit(p.max_neighbours)
    best = best.select(F.col("neighbour").alias("entity_id"))
    if pool is not None:
        best = best.join(pool.select("entity_id").distinct(), "entity_id", "left_semi")
    seeds = seeds.select("entity_id").distinct()
    nodes = checkpointed(seeds.withColumn("role", F.lit("seed")).union(best.join(seeds, "entity_id", "left_anti").withColumn("role", F.lit("neighbor"))))
    edges = checkpointed(confidence_edges(relations, nodes, p))
    degrees = node_stats(edges, "confidence").select("entity_id", F.col("degree").alias("degree_sub"), F.col("strength").alias("strength_sub"))
    return nodes.join(degrees, "entity_id", "left").na.fill(0, ["degree_sub", "strength_sub"]), final_edges(edges, types, p)


def _axis(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, name: str, p: Mining) -> DataFrame:
    both = pagerank(edges, nodes, seeds, p).join(local_weight(edges, seeds), "entity_id", "left").na.fill(0.0, ["local"])
    both = min_max(written(both), {"ppr": "ppr_n", "local": "local_n"})
    return both.select("entity_id", (p.ppr * F.col("ppr_n") + p.local * F.col("local_n")).alias(name))


def bridge_candidates(edges: DataFrame, nodes: DataFrame, weights: DataFrame, aging: DataFrame, longevity: DataFrame, p: Mining = Mining()) -> DataFrame:  # noqa: B008
    """Nodes (entity_id, degree_sub, strength_sub) with their scores on both axes and as bridges between them.

    edges are (u, v, w), weights as of type_weights(), aging and longevity the seeds (entity_id) of the axes. Edges, and what
    is scaled, are read several times and so written first.
    """
    edges = written(edges.select("u", "v", "w"))
    ends = edges.select(F.explode(F.array("u", "v")).alias("entity_id")).distinct()
    axes = _axis(edges, ends, aging, "A", p).join(_axis(edges, ends, longevity, "L", p), "entity_id")
    axes = min_max(written(axes), {"A": "A_score", "L": "L_score"}).withColumn("bridge_score", bridge(F.col("A_score"), F.col("L_score")))
    out = nodes.select("entity_id", "degree_sub", "strength_sub").join(quality(weights), "entity_id", "left").join(axes.drop("A", "L"), "entity_id", "left")
    out = out.na.fill(0.0, ["quality_norm", "A_score", "L_score", "bridge_score"])
    out = min_max(written(out), {"degree_sub": "deg_n", "strength_sub": "str_n"})

    def total(score: str, s: float, q: float, strength: float, degree: float) -> Column:
        return s * F.col(score) + q * F.col("quality_norm") + strength * F.col("str_n") + degree * F.col("deg_n")

    seeds = aging.select("entity_id").union(longevity.select("entity_id")).distinct().withColumn("is_seed", F.lit(True))
    out = out.join(seeds, "entity_id", "left").na.fill(False, ["is_seed"])
    return out.withColumns({"A_total": total("A_score", 0.55, 0.20, 0.15, 0.10), "L_total": total("L_score", 0.55, 0.20, 0.15, 0.10), "B_total": total("bridge_score", 0.60, 0.10, 0.15, 0.15)})


def candidates(scored: DataFrame, axis: str, k: int = 200) -> DataFrame:
    """The k best nodes of an axis that are no seeds."""
    return scored.where("NOT is_seed").orderBy(F.desc(axis), "entity_id").limit(k)


#: Rows of a figure's grid at most.
MAX_GRID = 5_000_000


def seed_grid(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(candidate, seed, w): every pair of two listed node sets, 0 where there is no edge. Both sets are parameters of a figure,
    counted first: a grid of more than MAX_GRID pairs is refused."""
    n, k = nodes.limit(MAX_GRID + 1).count(), seeds.limit(MAX_GRID + 1).count()
    if n * k > MAX_GRID:
        raise ValueError(f"{n} times {k} pairs are too many for one grid")
    pairs = nodes.select(F.col("entity_id").alias("candidate")).crossJoin(F.broadcast(seeds.select(F.col("entity_id").alias("seed"))))
    pairs = pairs.withColumns({"u": F.least("candidate", "seed"), "v": F.greatest("candidate", "seed")})
    return pairs.join(edges.select("u", "v", "w"), ["u", "v"], "left").select("candidate", "seed", F.coalesce("w", F.lit(0.0)).alias("w"))
