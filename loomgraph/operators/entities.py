"""Entity types by source-weighted evidence, selection of entities, and their literature ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scoring import lookup, min_max, recency, with_source_weights
from loomgraph.functions.text import bad_name, clean_entity_name
from loomgraph.operators import first_per, ranked, require_columns
from loomgraph.operators.quantiles import at_least_quantile
from loomgraph.params import CLASSES, ENTITY_SOURCES, ENTITY_WEIGHTS, QUALITY_WEIGHTS, Aging, Selection, SourceWeights
from loomgraph.session import written


#: Different sources whose weights are broadcast at most; beyond that, the rules run on each row.
BROADCAST_SOURCES = 100_000
#: Decimals of a sum of weights: short decimals stay what they are, so that shares of equal sums are equal.
DIGITS = 12


def _bits(p: SourceWeights) -> list[dict[str, int]]:
    """A bit for each key, 63 a number."""
    keys = p.keys()
    return [{k: 1 << i for i, k in enumerate(keys[start : start + 63])} for start in range(0, len(keys), 63)]


def _with_rules(df: DataFrame, p: SourceWeights) -> DataFrame:
    """df with w, no_hit, and the hit keys as bits hit_0, hit_1, ... by the source rules."""
    mask = lambda of: F.aggregate("hits", F.lit(0).cast("long"), lambda m, h: m.bitwiseOR(F.coalesce(F.try_element_at(lookup(of), h), F.lit(0)).cast("long")))
    return with_source_weights(df, p).withColumns({"no_hit": F.size("hits") == 0, **{f"hit_{i}": mask(of) for i, of in enumerate(_bits(p))}}).drop("hits")


def _ruled(rows: DataFrame, p: SourceWeights) -> DataFrame:
    """_with_rules() of rows, which must be cheap to read twice: the rules run once for each different source."""
    sources = written(rows.select("source").distinct().limit(BROADCAST_SOURCES + 1))
    if sources.count() > BROADCAST_SOURCES:
        return _with_rules(rows, p)
    return rows.join(F.broadcast(_with_rules(sources, p)), "source")


def _weights_by_type(rows: DataFrame, p: SourceWeights) -> DataFrame:
    """(entity_id, entity_type, evidence_count, sources_unique, weight_sum, weight_max, default_hits) of _ruled() rows.

    Rows are counted by their weight, of which there are few: so sums don't depend on the rows' order, and what a task keeps of a
    type has one size, whatever its sources.
    """
    weights, hits = sorted({*p.weights.values(), p.default}), [f"hit_{i}" for i in range(len(_bits(p)))]
    counts = [F.count_if(F.col("w") == w).alias(f"n_{i}") for i, w in enumerate(weights)]
    out = rows.groupBy("entity_id", "entity_type").agg(*counts, F.count_if("no_hit").alias("default_hits"), *(F.bit_or(h).alias(h) for h in hits))
    n = [(F.col(f"n_{i}"), F.lit(w)) for i, w in enumerate(weights)]
    return out.select(
        "entity_id", "entity_type", sum((c for c, _ in n), F.lit(0)).cast("long").alias("evidence_count"), sum((F.bit_count(h) for h in hits), F.lit(0)).cast("long").alias("sources_unique"),
        F.round(sum((c * w for c, w in n), F.lit(0.0)), DIGITS).alias("weight_sum"), F.coalesce(*(F.when(c > 0, w) for c, w in n[::-1])).alias("weight_max"), "default_hits",
    )


def type_weights(types: DataFrame, p: SourceWeights = ENTITY_SOURCES) -> DataFrame:
    """Weights of each (entity_id, entity_type), their share of the entity, and the type's rank in it.

    types are written first, as they are read for their sources and then for their weights.
    """
    require_columns(types, "entity_id", "entity_type", "source")
    rows = types.select("entity_id", "entity_type", F.coalesce("source", F.lit("")).alias("source")).dropna(subset=["entity_id", "entity_type"])
    out = _weights_by_type(_ruled(written(rows), p), p)
    total = F.round(F.sum("weight_sum").over(Window.partitionBy("entity_id")), DIGITS)
    out = out.withColumns({"weight_mean": F.col("weight_sum") / F.col("evidence_count"), "any_default": F.col("default_hits") > 0, "weight_total_entity": total})
    out = out.withColumn("weight_norm", F.when(F.col("weight_total_entity") > 0, F.col("weight_sum") / F.col("weight_total_entity")).otherwise(0.0))
    # sums of doubles depend on their order: equal weights must tie
    return ranked(out, "rank_in_entity", ["entity_id"], [F.desc(F.round("weight_sum", 9)), "entity_type"])


def source_coverage(types: DataFrame, p: SourceWeights = ENTITY_SOURCES) -> DataFrame:
    """(source_key, n_rows, mean_weight, key_weight) of hit keys; rows without a hit have a null key."""
    rows = with_source_weights(types.groupBy("source").count(), p)
    each = rows.select(F.explode_outer("hits").alias("source_key"), "w", "count")
    out = each.groupBy("source_key").agg(F.sum("count").alias("n_rows"), (F.sum(F.col("w") * F.col("count")) / F.sum("count")).alias("mean_weight"))
    weights = F.create_map(*[F.lit(x) for kv in ENTITY_WEIGHTS.items() for x in kv])
    return out.withColumn("key_weight", F.try_element_at(weights, F.coalesce("source_key", F.lit(""))))


def select_entities(weights: DataFrame, types: list[str] = CLASSES, s: Selection = Selection()) -> DataFrame:  # noqa: B008
    """Rows of type_weights() that are of a type and strong enough. Without min_weight_norm the type's own quantile decides."""
    kind = F.lower("entity_type") if s.ignore_case else F.col("entity_type")
    out = weights.where(kind.isin([t.lower() for t in types] if s.ignore_case else types))
    if s.primary_only:
        out = out.where("rank_in_entity = 1")
    if s.min_weight_norm is None:
        out = at_least_quantile(out, "weight_norm", s.quantile, "entity_type")
    else:
        out = out.where(F.col("weight_norm") >= s.min_weight_norm)
    return out.where((F.col("evidence_count") >= s.min_evidence) & (F.col("sources_unique") >= s.min_sources))


def select_sets(weights: DataFrame, sets: dict[str, tuple[list[str], Selection]]) -> DataFrame:
    """Rows of type_weights() of every named set of types, each with its own selection, under the set's name."""
    first, *rest = (select_entities(weights, types, s).withColumn("seed_set", F.lit(name)) for name, (types, s) in sets.items())
    for more in rest:
        first = first.unionByName(more)
    return first


def entity_pool(weights: DataFrame, names: DataFrame, s: Selection = Selection(min_sources=2), banned: list[str] = ()) -> DataFrame:  # noqa: B008
    """Selected entities whose name (entity_id, name) says something and whose id is not banned."""
    good = names.select("entity_id", clean_entity_name(F.col("name")).alias("name")).where(~bad_name(F.col("name")))
    out = select_entities(weights, CLASSES, s).join(good, "entity_id")
    return out.where(~F.col("entity_id").isin(list(banned))) if banned else out


def primary_types(weights: DataFrame) -> DataFrame:
    return first_per(weights, ["entity_id"], [F.desc(F.round("weight_sum", 9)), "entity_type"])


def quality(weights: DataFrame) -> DataFrame:
    """(entity_id, entity_type, quality_norm) of each entity's main type: a weighted sum of logs, scaled to 0..1.

    The sums are written before they are scaled, so that the weights are computed once.
    """
    have = {c: w for c, w in QUALITY_WEIGHTS.items() if c in weights.columns}
    raw = sum((F.lit(w / sum(have.values())) * F.log1p(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c, w in have.items()), F.lit(0.0))
    main = written(primary_types(weights).select("entity_id", "entity_type", raw.alias("quality_raw")))
    return min_max(main, {"quality_raw": "quality_norm"}).select("entity_id", "entity_type", "quality_norm")


def _scored_evidence(articles: DataFrame, evidence: DataFrame, seeds: DataFrame | None, p: Aging) -> DataFrame:
    a = articles.select(
        "pmid", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("aging_prob"))), F.lit(0.0)).alias("prob"), F.log1p(F.coalesce("factor", F.lit(0.0))).alias("log_factor"), "pub_date",
    )
    a = min_max(a, {"log_factor": "journal"})
    weight = F.pow("prob", F.lit(p.alpha))
    if p.use_journal:
        weight = weight * (1 + F.col("journal"))
    if p.use_recency:
        weight = weight * recency(F.col("pub_date"), p.as_of, p.half_life)
    pairs = evidence.select("entity_id", "pmid").where("entity_id <> '' AND pmid <> ''").distinct()
    if seeds is not None:
        pairs = pairs.join(seeds.select("entity_id").distinct(), "entity_id", "left_semi")
    return pairs.join(a.select("pmid", "prob", weight.alias("row_score")), "pmid")


def aging_rank(articles: DataFrame, evidence: DataFrame, p: Aging, seeds: DataFrame | None = None) -> DataFrame:
    """Entities by the articles that mention them: probability, journal and recency, summed and scaled."""
    rows = _scored_evidence(articles, evidence, seeds, p)
    out = rows.groupBy("entity_id").agg(
        F.count("*").alias("n_pmids_total"), F.avg("prob").alias("mean_prob"), F.sum("prob").alias("sum_prob"), F.sum("row_score").alias("score_sum"), F.count_if(F.col("prob") >= p.threshold).alias("n_high"),
    )
    return min_max(out, {"score_sum": "aging_score"})


def top_articles(articles: DataFrame, evidence: DataFrame, p: Aging, seeds: DataFrame | None = None) -> DataFrame:
    """(entity_id, rank, pmid, row_score): each entity's best articles."""
    rows = ranked(_scored_evidence(articles, evidence, seeds, p), "rank", ["entity_id"], [F.desc(F.round("row_score", 9)), "pmid"])
    return rows.where(F.col("rank") <= p.top_articles).select("entity_id", "rank", "pmid", "row_score")


def merge_duplicates(entities: DataFrame) -> DataFrame:
    """One row a name: the largest confidence, the longest description, all synonyms and the number of rows."""
    return entities.groupBy("name").agg(
        F.max("confidence").alias("confidence"), F.max_by("description", F.struct(F.length("description"), "description")).alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("synonyms")))).alias("synonyms"), F.count("*").alias("n_merged"),
    )


def search(entities: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    """Entities whose name, description or a synonym has the text, in any case."""
    has = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(text.lower())
    out = entities.where(has(F.col("name")) | has(F.col("description")) | F.coalesce(F.exists("synonyms", has), F.lit(False)))
    return out.where(F.col("entity_type") == kind) if kind else out


def statistics(entities: DataFrame) -> DataFrame:
    """(entity_type, n, mean_confidence) with a row `_ALL_`."""
    by = entities.groupBy("entity_type").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))
    return by.union(entities.agg(F.lit("_ALL_").alias("entity_type"), F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence")))


def relations_between(relations: DataFrame, a: str, b: str) -> DataFrame:
    """Relations between two entities, in either direction."""
    return relations.where((F.least("source_entity_id", "target_entity_id") == min(a, b)) & (F.greatest("source_entity_id", "target_entity_id") == max(a, b)))


def search_relations(relations: DataFrame, text: str, columns: list[str], kind: str | None = None) -> DataFrame:
    """Relations that have the text in one of the columns, in any case."""
    has = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(text.lower()) for c in columns]
    out = relations.where(F.greatest(*has) if len(has) > 1 else has[0])
    return out.where(F.col("relation_type") == kind) if kind else out
