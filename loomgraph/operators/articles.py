"""Annotations of articles: model results to entities and relations, evidence, names, tables made of them, and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import first_per
from loomgraph.operators.lookups import literal_of, matched_patterns
from loomgraph.operators.quantiles import at_least_quantile, hashed
from loomgraph.operators.tables import matched_by_key, snippet_places
from loomgraph.params import SYNONYM_TRIGGERS
from loomgraph.session import checkpointed

_CONTENT = (
    "entities array<struct<entity_text:string,entity_type:string,evidence:string>>, "
    "relationships array<struct<source_entity:string,source_entity_id:string,target_entity:string,target_entity_id:string,relation_type:string,confidence:string,evidence:string>>"
)

def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def parsed_results(results: DataFrame, requests: DataFrame, articles: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of results (request_id, content), by requests (request_id, pmid) and articles (pmid, abstract).

    Content is JSON, also in a fenced block; what cannot be parsed has neither. Evidence is valid if the abstract has it.
    """
    rows = results.join(requests, "request_id").join(articles.select("pmid", "abstract"), "pmid", "left")
    rows = rows.select(F.lit(batch).alias("batch_id"), "pmid", "abstract", F.from_json(T.json_payload(F.col("content")), _CONTENT).alias("c"))
    valid = T.evidence_in(F.col("x.evidence"), F.col("abstract")).alias("evidence_valid")
    entities = rows.select("batch_id", "pmid", "abstract", F.explode("c.entities").alias("x"))
    entities = entities.select("batch_id", "pmid", *(_text(f"x.{c}").alias(c) for c in ("entity_text", "entity_type", "evidence")), valid)
    relations = rows.select("batch_id", "pmid", "abstract", F.explode("c.relationships").alias("x"))
    end = lambda e: F.coalesce(f"x.{e}_entity", f"x.{e}_entity_id", F.lit("")).alias(f"{e}_entity")
    return entities, relations.select("batch_id", "pmid", end("source"), end("target"), *(_text(f"x.{c}").alias(c) for c in ("relation_type", "confidence", "evidence")), valid)


def tagged_pair(text: Column) -> dict[str, Column]:
    """The names in `<e1>` and `<e2>` tags, in any case, and the text without tags; null names where a tag is missing."""
    name = lambda k: F.nullif(F.regexp_extract(text, rf"(?is)<e{k}>(.*?)</e{k}>", 1), F.lit(""))
    return {"e1": F.trim(name(1)), "e2": F.trim(name(2)), "sentence": F.trim(F.regexp_replace(text, r"(?i)</?e[12]>", ""))}


def filled_evidence(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """rows (pmid, entity_name, evidence, ...) with blank evidence as the abstract's first sentence that has the name, else empty.

    Of several abstracts of an article the largest counts.
    """
    abstracts = articles.where("abstract IS NOT NULL").groupBy("pmid").agg(F.max("abstract").alias("__abstract"))
    out = rows.join(abstracts, "pmid", "left")
    found = F.coalesce(T.first_sentence(F.col("__abstract"), F.col("entity_name")), F.lit(""))
    return out.withColumn("evidence", F.when(F.trim("evidence") != "", F.trim("evidence")).otherwise(found)).drop("__abstract")


def with_ids(names: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """names with entity_id: of known (name, entity_id) by the name in any case, else made from it; blank names have none."""
    by = known.groupBy(F.lower(F.trim("name")).alias("__key")).agg(F.max("entity_id").alias("__known"))
    out = names.withColumn("__key", F.lower(F.trim(name))).join(by, "__key", "left")
    return out.withColumn("entity_id", F.coalesce("__known", T.entity_id(F.col(name)))).drop("__key", "__known")


def catalog(rows: DataFrame) -> DataFrame:
    """One row for each entity of rows (entity_id, entity_name, pref_label, definitions, synonyms array, ontology).

    The smallest name; labels, definitions and ontologies that aren't blank sorted and joined by `;`, repeats kept;
    all synonyms sorted as a PostgreSQL array.
    """
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.trim(c) != "", F.trim(c)))), ";").alias(c)
    synonyms = F.filter(F.transform(F.flatten(F.collect_list("synonyms")), lambda x: F.trim(x)), lambda x: x != "")
    return rows.groupBy("entity_id").agg(F.min("entity_name").alias("entity_name"), joined("pref_label"), joined("definitions"), T.pg_array(F.array_sort(synonyms)).alias("synonyms"), joined("ontology"))


def graph_nodes(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(entity_id, name, label) of rows (entity_id, entity_name, source_label): the preferred name of names (entity_id, name), else
    the smallest; the labels with Entity, sorted and joined by `|`."""
    labels = F.array_join(F.array_sort(F.array_distinct(F.array_append(F.collect_set("source_label"), F.lit("Entity")))), "|")
    out = rows.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.min("entity_name").alias("own"), labels.alias("label"))
    preferred = names.groupBy("entity_id").agg(F.max("name").alias("name"))
    return out.join(preferred, "entity_id", "left").select("entity_id", F.coalesce("name", "own").alias("name"), "label")


def unified_nodes(rows: DataFrame) -> DataFrame:
    """(entity_name, entity_type, source) of rows of the same columns: distinct types and sources, sorted and joined by `;`."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";").alias(c)
    return rows.groupBy("entity_name").agg(joined("entity_type"), joined("source"))


def spelled_ids(spellings: DataFrame, synonyms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, entity_id) and (entity_id, name) of spellings (name) and synonyms (primary, synonym).

    A synonym has the id of its primary name, of several the largest; any other spelling that of itself in upper case. An
    id is named by a primary name, the smallest, else by its most frequent spelling.
    """
    key = lambda c: T.entity_id(F.col(c), upper=True)
    given = synonyms.where("trim(synonym) <> ''").groupBy(F.trim("synonym").alias("name")).agg(F.max(F.trim("primary")).alias("primary"))
    given = given.select("name", key("primary").alias("entity_id"))
    counted = spellings.select(F.trim("name").alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))
    other = counted.join(given.select("name"), "name", "left_anti").withColumn("entity_id", key("name"))
    primary = synonyms.where("trim(primary) <> ''").select(key("primary").alias("entity_id"), F.trim("primary").alias("name")).groupBy("entity_id").agg(F.min("name").alias("name"))
    frequent = other.groupBy("entity_id").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("name")).join(primary, "entity_id", "left_anti")
    return given.union(other.select("name", "entity_id")), primary.union(frequent)


def seed_ids(seeds: DataFrame, names: DataFrame, weights: DataFrame, banned: list[str] = ()) -> DataFrame:
    """(seed, entity_id, mode, weight) of seeds (seed) among names (entity_id, name).

    A seed that equals a name by its key is `exact`. One that equals none is `regex`: the names that have it as a word, or
    one of its synonyms, in any case. weights (entity_id, weight) that are missing don't drop a row. Banned ids are left out,
    and a seed all of whose exact ids are banned isn't looked up again.
    """
    exact = matched_by_key(names, seeds).withColumn("mode", F.lit("exact"))
    missed = seeds.join(exact.select("seed").distinct(), "seed", "left_anti").distinct()
    plain = r"^[A-Z0-9 _-]+$"
    upper = F.upper(F.trim("seed"))
    own = F.when(upper.rlike(plain), F.concat(F.lit(r"\b"), upper, F.lit(r"\b"))).otherwise(F.concat(F.lit(r"\Q"), upper, F.lit(r"\E")))
    more = [F.when(upper.rlike(t), F.lit("|".join(alternatives))) for t, alternatives in SYNONYM_TRIGGERS.items()]
    needs = [F.when(upper.rlike(t), F.array(*(F.lit(literal_of(x)) for x in alternatives))) for t, alternatives in SYNONYM_TRIGGERS.items()]
    needs = F.flatten(F.array_compact(F.array(F.array(upper), *needs)))
    patterns = missed.where(F.trim("seed") != "").select("seed", F.concat(F.lit("(?i)"), F.concat_ws("|", own, *more)).alias("pattern"), needs.alias("needs"))
    found = matched_patterns(names, checkpointed(patterns)).withColumn("mode", F.lit("regex"))
    out = exact.unionByName(found).where(~F.coalesce(F.col("entity_id").isin(list(banned)), F.lit(False)))
    return out.join(weights.groupBy("entity_id").agg(F.max("weight").alias("weight")), "entity_id", "left").select("seed", "entity_id", "mode", "weight")


def seed_summary(hits: DataFrame, k: int = 12) -> DataFrame:
    """(seed, n_ids, ids): how many ids a seed has, and the first k of the heaviest."""
    order = [F.desc_nulls_last("weight"), F.col("entity_id")]
    first = first_per(hits.withColumn("at", F.row_number().over(Window.partitionBy("seed").orderBy(*order))), ["seed"], order, k)
    ids = first.groupBy("seed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "entity_id"))), lambda x: x["entity_id"]), ";").alias("ids"))
    return hits.groupBy("seed").agg(F.count("*").alias("n_ids")).join(ids, "seed")


def best_texts(samples: DataFrame, texts: DataFrame, min_chars: int = 40, k: int = 8) -> DataFrame:
    """(sample_id, id, score): the text (id, text) that has most of a sample's snippets (sample_id, text), whole words in sequence.

    A sample's k longest distinct snippets of min_chars or more count; score = 1000 * snippets found + length of the longest;
    of equal scores the smallest id.
    """
    bare = samples.select("sample_id", F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")).alias("text")).where(F.length("text") >= min_chars).distinct()
    best = first_per(bare.withColumn("chars", F.length("text")), ["sample_id"], [F.desc("chars"), "text"], k)
    asked = best.withColumn("snippet_id", F.struct("sample_id", F.xxhash64("text").alias("h")))
    found = snippet_places(asked.select("snippet_id", "text"), texts).join(asked.select("snippet_id", "sample_id", "chars"), "snippet_id")
    scored = found.groupBy("sample_id", "id").agg((1000 * F.count("*") + F.max("chars")).alias("score"))
    return scored.groupBy("sample_id").agg(F.max(F.struct("score", -F.col("id"))).alias("b")).select("sample_id", (-F.col("b")["col2"]).alias("id"), "b.score")


def matrix_scaled(cells: DataFrame, row: str, value: str) -> DataFrame:
    """cells with by_row and by_all: each value by the largest of its row, and of all; 0 where that is 0."""
    rows = cells.groupBy(row).agg(F.max(value).alias("__row"))
    every = cells.agg(F.max(value).alias("__all"))
    share = lambda top: F.when(F.col(top) > 0, F.col(value) / F.col(top)).otherwise(0.0)
    return cells.join(rows, row).crossJoin(F.broadcast(every)).withColumns({"by_row": share("__row"), "by_all": share("__all")}).drop("__row", "__all")  # one row


def strongest_columns(cells: DataFrame, column: str, value: str, quantile: float) -> DataFrame:
    """(column, total, mean, top) of the columns whose total reaches a quantile of the totals."""
    sums = cells.groupBy(column).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("top"))
    return at_least_quantile(sums, "total", quantile)


def balance(scored: DataFrame, types: list[str] | None = None, without: list[str] = (), keep: list[str] = (), expression: str | None = None, least: float = 0.0) -> DataFrame:
    """scored (entity_id, entity_type, A_score, L_score) with delta = A - L, its size and strength = the larger of both.

    Rows of types, without others, that the expression and the least strength let pass; ids in keep stay in any case.
    """
    a, b = F.col("A_score"), F.col("L_score")
    out = scored.withColumns({"delta": a - b, "abs_delta": F.abs(a - b), "strength": F.greatest(a, b)})
    good = F.col("strength") >= least
    if types is not None:
        good &= F.col("entity_type").isin(types)
    if without:
        good &= ~F.col("entity_type").isin(list(without))
    if expression:
        good &= F.expr(expression)
    return out.where(F.coalesce(good, F.lit(False)) | F.col("entity_id").isin(list(keep)))


def sampled(df: DataFrame, share: float, seed: int, *keys: str) -> DataFrame:
    """About a share of the rows, the same ones for the same seed, however the rows lie."""
    return df.where(hashed(seed, *keys) < share * 2.0**52)
