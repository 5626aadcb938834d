"""Tables of articles, names and relations: ids, cleaning, unions, batches, merges and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import first_per
from loomgraph.session import checkpointed

#: Words of the windows by which snippets are looked up, and snippets that are broadcast at most.
SNIPPET_WORDS = 5
BROADCAST_SNIPPETS = 100_000


def id_mapping(names: DataFrame, name: str = "name") -> DataFrame:
    """(id, name) of each distinct name; a field holds several, split at `;` or `|`."""
    each = names.select(F.explode(F.split(name, r"[;|]")).alias("name")).select(F.trim("name").alias("name")).where("name <> ''")
    return each.select(T.entity_id(F.col("name"), upper=True).alias("id"), F.upper("name").alias("name")).distinct()


def catalog(names: DataFrame) -> DataFrame:
    """(entity_id, name, n_rows) of names (name): one row for each id, under its smallest spelling."""
    keyed = names.select(T.entity_id(F.col("name")).alias("entity_id"), F.trim("name").alias("name")).where("entity_id IS NOT NULL")
    return keyed.groupBy("entity_id").agg(F.min("name").alias("name"), F.count("*").alias("n_rows"))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with the numbers of its rows from 0 in a unique order.

    Rows are dealt out by ranges and numbered in each; only the ranges' sizes are summed up in one task.
    """
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__size"))  # one row for each range
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("__at", inside).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__start", "__at", "__size")


def batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    """df with the number of its batch of `size` rows in order."""
    return numbered(df, "__row", *order).withColumn("batch", F.floor(F.col("__row") / size)).drop("__row")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; of a key in both, the new one."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def clean_articles(articles: DataFrame, min_chars: int) -> DataFrame:
    """Rows (id, text, ...) of at least min_chars; of equal texts that of the smallest id."""
    long = articles.where(F.length("text") >= min_chars).withColumn("__print", F.sha2("text", 256))
    return first_per(long, ["__print"], ["id"]).drop("__print")


def same_fingerprint(texts: DataFrame) -> DataFrame:
    """(id, first_id) of texts (id, text) whose word characters equal those of a text of a smaller id."""
    prints = texts.select("id", T.fingerprint(F.col("text")).alias("print"))
    first = prints.groupBy("print").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return prints.join(first, "print").where("id <> first_id").select("id", "first_id")


def _words(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " ")
    return F.filter(F.split(bare, " "), lambda w: w != "")


def snippet_places(snippets: DataFrame, texts: DataFrame) -> DataFrame:
    """(snippet_id, id): texts (id, text) that have all words of a snippet (snippet_id, text), in sequence.

    A text is looked up under the hash of each of its windows of SNIPPET_WORDS words, or of as many as a shorter snippet has;
    only (id, hash) is exploded. What is found is compared whole, once for each pair. Snippets without words are in no pair.
    """
    key = lambda w, i, n: F.xxhash64(F.slice(w, i, n))
    asked = snippets.select("snippet_id", _words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(SNIPPET_WORDS)))
    sizes = sorted(r.n for r in asked.select("n").distinct().collect())  # SNIPPET_WORDS at most
    asked = asked.select("snippet_id", key(F.col("w"), F.lit(1), F.col("n")).alias("key"), F.array_join("w", " ").alias("wanted"))
    keys = asked.select("snippet_id", "key")
    if keys.limit(BROADCAST_SNIPPETS + 1).count() <= BROADCAST_SNIPPETS:
        keys = F.broadcast(keys)
    words = texts.select("id", _words(F.col("text")).alias("w"))

    def windows_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
        return F.when(F.size("w") >= n, F.transform(starts, lambda i: key(F.col("w"), i, F.lit(n))))

    windows = [windows_of(n) for n in sizes]
    each = words.select("id", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*windows))))).alias("key")) if sizes else words.select("id", F.lit(0).cast("long").alias("key")).limit(0)
    pairs = each.join(keys, "key").select("id", "snippet_id").distinct()
    found = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("wanted"), F.lit(" ")))
    return pairs.join(asked.select("snippet_id", "wanted"), "snippet_id").join(words, "id").where(found).select("snippet_id", "id").distinct()


def matched_by_key(names: DataFrame, seeds: DataFrame) -> DataFrame:
    """(entity_id, seed) where a name's key equals a seed's."""
    left = names.select("entity_id", T.match_key(F.col("name")).alias("key"))
    return left.join(seeds.select("seed", T.match_key(F.col("seed")).alias("key")), "key").select("entity_id", "seed").distinct()


def matched_by_pattern(names: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """(entity_id, seed) where a name fits one of a seed's patterns, in any case; the patterns are parameters."""
    hit = {s: F.col("name").rlike("(?i)" + "|".join(p)) for s, p in patterns.items()}
    seeds = F.array_compact(F.array(*(F.when(h, F.lit(s)) for s, h in hit.items())))
    return names.select("entity_id", F.explode(seeds).alias("seed")).distinct()


def merged_names(names: DataFrame) -> DataFrame:
    """(name, entity_id, n, types) of names (entity_id, name, type): equal names in any case as one entity."""
    key = F.lower(F.trim("name")).alias("name")
    return names.groupBy(key).agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("type")), ";").alias("types"))
