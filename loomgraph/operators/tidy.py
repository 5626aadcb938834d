"""Tables put into the shape that later steps expect: scaled columns, clean articles, ids and types by name, standard edges, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import first_per, require_columns
from loomgraph.operators.quantiles import exact_quantiles
from loomgraph.session import checkpointed

#: Ways to scale to 0..1, as (least span that isn't constant, what is added to the span).
SCALES = {"plain": (0.0, 0.0), "guarded": (1e-12, 0.0), "soft": (None, 1e-9), "softer": (None, 1e-12)}


def scaled(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """df with columns (new: (column, way of SCALES)) scaled by the smallest and largest value of all rows.

    A column that is constant for its way gives 0, as do nulls in it. One aggregate, of one row, is joined back.
    """
    ends = df.agg(*(f(c).alias(f"__{n}_{k}") for k, (c, _) in enumerate(columns.values()) for n, f in (("low", F.min), ("high", F.max))))
    out = df.crossJoin(F.broadcast(ends))  # one row
    for k, (new, (c, way)) in enumerate(columns.items()):
        least, more = SCALES[way]
        low, span = F.col(f"__low_{k}"), F.col(f"__high_{k}") - F.col(f"__low_{k}")
        value = (F.col(c) - low) / (span + more)
        out = out.withColumn(new, F.coalesce(F.when(span > least, value) if least is not None else value, F.lit(0.0)))
    return out.drop(*(f"__{n}_{k}" for k in range(len(columns)) for n in ("low", "high")))


def clean_records(articles: DataFrame, needed: list[str], kinds: str = "publication_type", unwanted: str = "Retracted Publication", key: str = "pmid", order: list[Column] | None = None) -> DataFrame:
    """Articles with all needed columns, not of an unwanted kind (null is wanted), one for each key: the first in order, else the smallest row."""
    require_columns(articles, *needed, kinds, key)
    good = articles.dropna(subset=needed).where(F.coalesce(~F.col(kinds).contains(unwanted), F.lit(True)))
    return first_per(good, [key], [*(order or []), *(F.col(c) for c in articles.columns)])


def with_known_ids(rows: DataFrame, known: DataFrame, name: str, new: str) -> DataFrame:
    """rows with the id of a name as it is spelled in known (name, entity_id), null for others: no id is made. Of several ids the largest."""
    by = known.groupBy(F.col("name").alias("__name")).agg(F.max("entity_id").alias(new))
    return rows.join(by, rows[name] == F.col("__name"), "left").drop("__name")


def with_types(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relations (pmid, source, target, ...) with source_type and target_type by (pmid, name) of entities (pmid, name, type, place): of several the one of the last place."""
    last = entities.groupBy("pmid", "name").agg(F.max_by("type", F.struct("place", "type")).alias("type"))
    for end in ("source", "target"):
        own = last.select("pmid", F.col("name").alias(end), F.col("type").alias(f"{end}_type"))
        relations = relations.join(own, ["pmid", end], "left")
    return relations


def entity_dictionary(*texts: DataFrame) -> DataFrame:
    """(entity, main_text, details) of the distinct names of all texts (entity): brackets taken apart, blank names left out."""
    first, *rest = (t.select(F.trim("entity").alias("entity")) for t in texts)
    for more in rest:
        first = first.union(more)
    parts = T.bracket_parts(F.col("entity"))
    return first.where("entity <> ''").distinct().select("entity", parts.alias("p")).select("entity", "p.main_text", "p.details")


def annotated(rows: DataFrame, dictionary: DataFrame, text: str = "main_text") -> DataFrame:
    """rows with `annotation` by text from dictionary (main_text, annotation), `{}` where it has none; of several the smallest."""
    by = dictionary.groupBy(F.col("main_text").alias("__text")).agg(F.min("annotation").alias("annotation"))
    return rows.join(by, rows[text] == F.col("__text"), "left").drop("__text").na.fill("{}", ["annotation"])


def neighbour_types(rows: DataFrame) -> DataFrame:
    """(seed, neighbour, type): the most frequent type of rows (seed, neighbour, type), of equal ones the smallest."""
    counts = rows.groupBy("seed", "neighbour", "type").agg(F.count("*").alias("n"))
    return counts.groupBy("seed", "neighbour").agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("type"))


#: Names that edges come with for their ends, and for their weight: those that are capped already, and those to be scaled, in order.
END_NAMES = (("u", "v"), ("source", "target"), ("src", "tgt"))
CAPPED, SCALED = ("w_final", "conf_norm_q"), ("confidence", "weight", "count")


def standard_edges(edges: DataFrame, clip: float = 0.98, gamma: float = 2.0) -> DataFrame:
    """(u, v, reltype_top, w_norm, w_vis) of edges under any of the known column names, undirected, each pair once.

    w_norm is the first weight there is, held between 0 and 1, or scaled to that; of a pair the largest, with the most frequent
    type. w_vis is w_norm held at its quantile `clip`, by that quantile, to the power gamma. Null weights are 0.
    """
    ends = next((e for e in END_NAMES if set(e) <= set(edges.columns)), None)
    if ends is None:
        raise ValueError(f"none of {END_NAMES} are columns")
    kind = next((c for c in ("reltype_top", "reltype_top_x", "reltype_top_y") if c in edges.columns), None)
    weight = next((c for c in (*CAPPED, *SCALED) if c in edges.columns), None)
    number = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    a, b = (F.col(e).cast("string") for e in ends)
    out = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), (F.col(kind) if kind else F.lit("")).alias("type"), number.alias("w"))
    if weight not in CAPPED:
        out = scaled(out.withColumnRenamed("w", "__w"), {"w": ("__w", "soft")})
    out = out.withColumn("w", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "w")))
    counts = out.groupBy("u", "v", "type").agg(F.count("type").alias("n"), F.max("w").alias("w"))
    pairs = counts.groupBy("u", "v").agg(F.coalesce(F.min_by("type", F.when(F.col("type").isNotNull(), F.struct(-F.col("n"), "type"))), F.lit("")).alias("reltype_top"), F.max("w").alias("w_norm"))
    pairs = checkpointed(pairs)
    cap = exact_quantiles(pairs, "w_norm", clip).get("", 0.0)
    return pairs.withColumn("w_vis", F.pow(F.least("w_norm", F.lit(cap)) / F.lit(cap if cap > 1e-12 else 1.0), F.lit(gamma)))


def relation_statistics(relations: DataFrame, symmetric: list[str]) -> DataFrame:
    """(relation_type, n, directed, entities, mean_confidence) of relations (source, target, relation_type, confidence), with a row `_ALL_`.

    directed tells whether the type isn't among the symmetric ones (in `_ALL_`, how many rows aren't); entities counts distinct ends.
    """
    ends = relations.select("relation_type", "confidence", F.explode(F.array("source", "target")).alias("entity"))
    directed = (~F.col("relation_type").isin(symmetric)).cast("long")
    each = ends.groupBy("relation_type").agg((F.count("*") / 2).cast("long").alias("n"), F.count_distinct("entity").alias("entities"), F.avg("confidence").alias("mean_confidence"))
    each = each.select("relation_type", "n", (directed * F.col("n")).alias("directed"), "entities", "mean_confidence")
    whole = ends.agg(F.lit("_ALL_").alias("relation_type"), (F.count("*") / 2).cast("long").alias("n"), (F.sum(directed) / 2).cast("long").alias("directed"), F.count_distinct("entity").alias("entities"), F.avg("confidence").alias("mean_confidence"))
    return each.union(whole)


def top_ids(ranking: DataFrame, score: str, k: int, id_col: str = "entity_id") -> DataFrame:
    """(ids): one row, a JSON list of the k ids of the highest scores, ties by id: what is exported beside a ranking."""
    best = ranking.select(F.col(id_col).cast("string").alias("id"), F.round(score, 9).alias("s")).orderBy(F.desc("s"), "id").limit(k)
    order = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "id")))  # k rows
    return best.agg(F.to_json(F.transform(order, lambda x: x["id"])).alias("ids"))
