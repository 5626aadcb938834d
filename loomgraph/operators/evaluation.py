"""Extracted entities against gold ones, and matching of samples to texts.

gold and pred are rows (pmid, ent) with an optional label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scoring import precision_recall
from loomgraph.functions.text import fingerprint


def strict_counts(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(pmid, tp, fp, fn) over the articles that both have; keys say what must agree besides the article."""
    shared = gold.select("pmid").intersect(pred.select("pmid"))
    each = gold.select("pmid", *keys, F.lit(1).alias("g"), F.lit(0).alias("p")).union(pred.select("pmid", *keys, F.lit(0), F.lit(1)))
    each = each.join(shared, "pmid", "left_semi").groupBy("pmid", *keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return each.groupBy("pmid").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))


def misses(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Gold rows that pred lacks; with the sides changed, false positives."""
    shared = gold.select("pmid").intersect(pred.select("pmid"))
    return gold.select("pmid", *keys).distinct().join(shared, "pmid", "left_semi").join(pred.select("pmid", *keys).distinct(), ["pmid", *keys], "left_anti")


def lenient_counts(gold: DataFrame, pred: DataFrame, with_label: bool = False, one_to_one: bool = False) -> DataFrame:
    """(pmid, tp, fp, fn) where a left-over gold entity may also match the first prediction that has it or that it has.

    A lenient match counts for the gold entity and for the prediction, so as two; a prediction may serve several gold
    entities. one_to_one counts each matched prediction once instead.
    """
    keys = ["ent", "label"] if with_label else ["ent"]
    strict = strict_counts(gold, pred, keys)
    g, p = misses(gold, pred, keys), misses(pred, gold, keys)
    g = g.select("pmid", *(F.col(k).alias(f"g_{k}") for k in keys))
    p = p.select("pmid", *(F.col(k).alias(f"p_{k}") for k in keys))
    on = ((F.col("g_ent").contains(F.col("p_ent"))) | (F.col("p_ent").contains(F.col("g_ent")))) & (F.col("g_ent") != "") & (F.col("p_ent") != "")
    if with_label:
        on = on & (F.col("g_label") == F.col("p_label"))
    near = g.join(p, "pmid").where(on)  # within one article
    chosen = near.groupBy("pmid", *(f"g_{k}" for k in keys)).agg(F.min(F.struct(*(f"p_{k}" for k in keys))).alias("p"))
    more = chosen.groupBy("pmid").agg(F.count("*").alias("mg"), F.count_distinct("p").alias("mp"))
    out = strict.join(more, "pmid", "left").na.fill(0, ["mg", "mp"])
    hits = F.col("mp") if one_to_one else F.col("mg") + F.col("mp")
    return out.select("pmid", (F.col("tp") + hits).alias("tp"), (F.col("fp") - F.col("mp")).alias("fp"), (F.col("fn") - F.col("mg")).alias("fn"))


def with_scores(counts: DataFrame) -> DataFrame:
    return counts.withColumns(precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def micro_macro(counts: DataFrame) -> DataFrame:
    """One row: precision, recall and F1 of the summed counts (micro), and the means of the articles' own (macro)."""
    total = with_scores(counts).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), *(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    micro = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return total.select("tp", "fp", "fn", *(c.alias(f"micro_{k}") for k, c in micro.items()), "macro_precision", "macro_recall", "macro_f1")


def by_label(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) over the articles that both have."""
    shared = gold.select("pmid").intersect(pred.select("pmid"))
    each = gold.select("pmid", "ent", "label", F.lit(1).alias("g"), F.lit(0).alias("p")).union(pred.select("pmid", "ent", "label", F.lit(0), F.lit(1)))
    each = each.join(shared, "pmid", "left_semi").groupBy("pmid", "ent", "label").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    sums = each.groupBy("label").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))
    return with_scores(sums)


def fingerprint_matches(samples: DataFrame, texts: DataFrame) -> DataFrame:
    """(sample_id, text_id) where a sample's fingerprint is that of exactly one text. Both are rows (id, text)."""
    one = texts.select(F.col("id").alias("text_id"), fingerprint(F.col("text")).alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.min("text_id").alias("text_id")).where("n = 1")
    return samples.select(F.col("id").alias("sample_id"), fingerprint(F.col("text")).alias("f")).join(one, "f").select("sample_id", "text_id")


def class_matrix(relations: DataFrame, types: DataFrame, classes: list[str]) -> DataFrame:
    """Counts of relations by the ends' types (entity_id, entity_type): a row each source type, a column each target type."""
    for end in ("source", "target"):
        relations = relations.join(types.select(F.col("entity_id").alias(f"{end}_entity_id"), F.col("entity_type").alias(f"{end}_type")), f"{end}_entity_id")
    return relations.groupBy("source_type").pivot("target_type", classes).count().na.fill(0)


def by_task(counts: DataFrame) -> DataFrame:
    """(task, tp, fp, fn, precision, recall, f1) of counts (task, tp, fp, fn), with a row `_ALL_` of the sums."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    each = counts.groupBy("task").agg(*sums)
    return with_scores(each.union(each.agg(F.lit("_ALL_").alias("task"), *sums)))
