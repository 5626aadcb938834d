"""Relations to undirected edges, and what edges say of their nodes.

Relations need source_entity_id, target_entity_id, relation_type and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scoring import min_max, relation_type, with_source_weights
from loomgraph.operators import require_columns
from loomgraph.params import RELATION_SOURCES, SourceWeights
from loomgraph.session import checkpointed

_ENDS = ("source_entity_id", "target_entity_id")


def undirected(relations: DataFrame) -> DataFrame:
    """relations with u < v; rows with a null or empty end, and loops, are dropped."""
    require_columns(relations, *_ENDS)
    s, t = (F.col(c) for c in _ENDS)
    return relations.where((s != "") & (t != "") & (s != t)).withColumns({"u": F.least(s, t), "v": F.greatest(s, t)})


def _top_types(typed: DataFrame) -> DataFrame:
    """The most frequent label of each (u, v); of equally frequent ones the smallest."""
    counts = typed.groupBy("u", "v", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("u", "v").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("reltype_top"))


def weighted_counts(rows: DataFrame, keys: list[str], p: SourceWeights) -> DataFrame:
    """(keys, label, source, n, hits, w): how often each type and source occurs, dealt out by the keys.

    Rows are dealt out by the keys before they are counted, so that counts need no second exchange. A key's rows stream through
    one task, which keeps a count for each of its types and sources only.
    """
    dealt = rows.select(*keys, relation_type(F.col("relation_type")).alias("label"), "source").repartition(*keys)
    return with_source_weights(dealt.groupBy(*keys, "label", "source").agg(F.count("*").alias("n")), p)


def weighted_edges(relations: DataFrame, p: SourceWeights = RELATION_SOURCES, min_count: int = 1) -> DataFrame:
    """Edges with count, weights, hit sources and the most frequent relation type.

    Rows are counted by (u, v, type, source) first, of which there are few for any edge, and the source rules run once
    for each. These counts are dealt out by (u, v), where the rest needs no further exchange.
    """
    part = weighted_counts(undirected(relations), ["u", "v"], p)
    by_label = part.groupBy("u", "v", "label").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("w")).alias("w"), F.max("w").alias("top"), F.sum(F.when(F.size("hits") == 0, F.col("n")).otherwise(0)).alias("defaults"), F.flatten(F.collect_set("hits")).alias("hits")
    )
    edges = by_label.groupBy("u", "v").agg(
        F.sum("n").alias("count"), F.sum("w").alias("weight_sum"), F.max("top").alias("weight_max"), F.sum("defaults").alias("default_hits"),
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("sources_unique"),
        F.min_by("label", F.struct(-F.col("n"), "label")).alias("reltype_top"),
    )
    edges = edges.where(F.col("count") >= min_count)
    return edges.select("u", "v", "count", "weight_sum", (F.col("weight_sum") / F.col("count")).alias("weight_mean"), "weight_max", "default_hits", (F.col("default_hits") > 0).alias("any_default"), "sources_unique", "reltype_top")


def relation_type_histogram(relations: DataFrame, k: int = 6, canonical: bool = True) -> DataFrame:
    """(u, v, rank, label, n): the k most frequent types of each edge."""
    label = relation_type(F.col("relation_type")) if canonical else F.coalesce("relation_type", F.lit(""))
    counts = undirected(relations).groupBy("u", "v", label.alias("label")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(_by_edge())
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def _by_edge():
    from pyspark.sql import Window

    return Window.partitionBy("u", "v").orderBy(F.desc("n"), "label")


def type_json(histogram: DataFrame) -> DataFrame:
    """(u, v, reltype_json) of a histogram, keys by rank."""
    entries = F.transform(F.sort_array(F.collect_list(F.struct("rank", "label", "n"))), lambda x: F.struct(x["label"], x["n"]))
    return histogram.groupBy("u", "v").agg(F.to_json(F.map_from_entries(entries)).alias("reltype_json"))


def count_edges(relations: DataFrame, min_weight: int = 2) -> DataFrame:
    """Edges weighted by the number of their relations, with the most frequent type as it is spelled."""
    typed = undirected(relations).select("u", "v", F.coalesce("relation_type", F.lit("")).alias("label"))
    counts = typed.groupBy("u", "v", "label").agg(F.count("*").alias("n"))
    edges = counts.groupBy("u", "v").agg(F.sum("n").alias("weight"), F.min_by("label", F.struct(-F.col("n"), "label")).alias("reltype_top"))
    return edges.where(F.col("weight") >= min_weight)


def source_coverage(relations: DataFrame, p: SourceWeights = RELATION_SOURCES) -> DataFrame:
    """(source_key, n_rows) of hit keys; `__DEFAULT__` counts the rows without."""
    hits = with_source_weights(undirected(relations).groupBy("source").count(), p).select("hits", "count")
    key = F.explode(F.when(F.size("hits") > 0, F.col("hits")).otherwise(F.array(F.lit("__DEFAULT__"))))
    return hits.select(key.alias("source_key"), "count").groupBy("source_key").agg(F.sum("count").alias("n_rows"))


def type_coverage(relations: DataFrame) -> DataFrame:
    return undirected(relations).groupBy(relation_type(F.col("relation_type")).alias("relation_type")).agg(F.count("*").alias("n_rows"))


def best_names(relations: DataFrame) -> DataFrame:
    """(entity_id, best_name): the most frequent name at either end, of equal ones the smallest."""
    ends = [F.struct(F.col(f"{e}_entity_id").alias("entity_id"), F.col(f"{e}_entity_name").alias("name")) for e in ("source", "target")]
    both = relations.select(F.explode(F.array(*ends)).alias("end")).select("end.*")  # not a union, which would make the relations twice
    counts = both.where("entity_id <> '' AND name <> ''").groupBy("entity_id", "name").agg(F.count("*").alias("n"))
    return counts.groupBy("entity_id").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("best_name"))


def node_stats(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """(entity_id, degree, strength). Hubs are summed on the map side."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("entity_id"), F.col(weight).alias("w"))
    return ends.groupBy("entity_id").agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def node_scores(stats: DataFrame, alpha: float = 0.6) -> DataFrame:
    """stats with degree and strength scaled, and score = alpha * degree + (1 - alpha) * strength."""
    scaled = min_max(stats, {"degree": "degree_norm", "strength": "strength_norm"})
    return scaled.withColumn("score", alpha * F.col("degree_norm") + (1 - alpha) * F.col("strength_norm"))


def importance(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """(entity_id, importance): the weight of a node's edges, scaled to 0..1 over all nodes; 0 where all are alike."""
    return min_max(node_stats(edges, weight), {"strength": "importance"}).select("entity_id", "importance")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes (entity_id)."""
    for end in ("u", "v"):
        edges = edges.join(nodes.select(F.col("entity_id").alias(end)), end, "left_semi")
    return edges.select("u", "v", *[c for c in edges.columns if c not in ("u", "v")])


def top_subgraph(edges: DataFrame, nodes: int = 200, top_edges: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the best nodes by score, their heaviest edges, and the degrees that these edges leave."""
    edges = checkpointed(edges)  # read for the statistics, their scales and the sub-graph
    best = node_scores(node_stats(edges)).orderBy(F.desc("score"), "entity_id").limit(nodes)
    kept = induced(edges, best).orderBy(F.desc("weight"), "u", "v").limit(top_edges)
    left = node_stats(kept).select("entity_id", F.col("degree").alias("degree_sub"), F.col("strength").alias("strength_sub"))
    return best.join(left, "entity_id", "left").na.fill(0, ["degree_sub", "strength_sub"]), kept


def dangling(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations with an end that is no node, and which ends these are."""
    known = nodes.select("entity_id").distinct()
    for end in ("source", "target"):
        known_end = known.select(F.col("entity_id").alias(f"{end}_entity_id"), F.lit(True).alias(f"{end}_known"))
        relations = relations.join(known_end, f"{end}_entity_id", "left")
    missing = {f"{e}_missing": F.col(f"{e}_known").isNull() for e in ("source", "target")}
    return relations.withColumns(missing).drop("source_known", "target_known").where("source_missing OR target_missing")


def without_dangling(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.select("entity_id").distinct()
    for end in _ENDS:
        relations = relations.join(known.withColumnRenamed("entity_id", end), end, "left_semi")
    return relations


def merged_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges folded to one row: the largest w_final and the most frequent type."""
    both = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w_final", F.col("reltype_top").alias("label"))
    top = both.groupBy("u", "v").agg(F.max("w_final").alias("w_final"))
    return top.join(_top_types(both), ["u", "v"])
