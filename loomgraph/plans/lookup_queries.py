"""Queries over look-ups, samples, published tables, named files and the structure of graphs, with their DuckDB equivalents where SQL has one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import articles as A
from loomgraph.operators import centrality as Y
from loomgraph.operators import communities as M
from loomgraph.operators import edges as E
from loomgraph.operators import lookups as L
from loomgraph.operators import quantiles as Q
from loomgraph.plans.views import plain, view
from loomgraph.session import checkpoint_folder, written
from loomgraph.sources import batch_files as B
from loomgraph.sources import publish as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/published-{uuid.uuid4().hex}/{name}"


_JOURNALS = "SELECT CASE WHEN c_custkey % 4 > 0 THEN 'ISSN' || CAST(c_custkey AS VARCHAR(20)) END AS issn, 'Journal ' || CAST(c_custkey % 50 AS VARCHAR(20)) AS title, c_acctbal AS factor FROM {customer}"
_ARTICLES = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN 'ISSN' || CAST(o_custkey AS VARCHAR(20)) END AS issn, CASE WHEN o_orderkey % 11 > 0 THEN 'JOURNAL ' || CAST(o_custkey % 70 AS VARCHAR(20)) END AS title FROM {orders}"


@query(f"""WITH j AS ({_JOURNALS.format(customer="customer")}), a AS ({_ARTICLES.format(orders="orders")}),
i AS (SELECT issn, max(factor) AS factor FROM j WHERE issn IS NOT NULL GROUP BY issn), t AS (SELECT lower(title) AS title, max(factor) AS factor FROM j GROUP BY 1)
SELECT a.id, CAST(CASE WHEN i.issn IS NOT NULL THEN 1 WHEN t.title IS NOT NULL THEN 2 END AS INTEGER) AS step, coalesce(i.factor, t.factor) AS value
FROM a LEFT JOIN i ON a.issn = i.issn LEFT JOIN t ON lower(a.title) = t.title""")
def journal_factors(spark, d):
    """Articles with their journal's factor: by ISSN, and by title where that misses; of several journals the largest."""
    journals = spark.sql(_JOURNALS, customer=_table(spark, d, "customer"))
    articles = spark.sql(_ARTICLES, orders=_table(spark, d, "orders"))
    return L.first_hit(articles, journals, "id", [(F.col("issn"), F.col("issn")), (F.lower("title"), F.lower("title"))], F.col("factor"), [-F.col("factor")])


_ASKED = "SELECT DISTINCT CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN upper(p_name) WHEN 1 THEN 'P' || CAST(p_partkey AS VARCHAR(20)) WHEN 2 THEN 'the ' || p_name || ' of 1' ELSE 'none' END AS alias FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"


@query(f"""WITH a AS ({_ASKED.format(lineitem="lineitem", part="part")}), n AS (SELECT lower(p_name) AS name, min('P' || CAST(p_partkey AS VARCHAR)) AS value FROM part GROUP BY 1),
k AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS value FROM part), w AS (SELECT a.alias, min(n.value) AS value FROM (SELECT DISTINCT alias FROM a WHERE alias LIKE 'the %') a JOIN n ON regexp_matches(lower(a.alias), '\\b' || n.name || '\\b') GROUP BY 1)
SELECT a.alias, CAST(CASE WHEN n.value IS NOT NULL THEN 1 WHEN k.value IS NOT NULL THEN 2 WHEN w.value IS NOT NULL THEN 3 END AS INTEGER) AS step, coalesce(n.value, k.value, w.value) AS value
FROM a LEFT JOIN n ON lower(a.alias) = n.name LEFT JOIN k ON a.alias = k.value LEFT JOIN w ON a.alias = w.alias""")
def alias_ids(spark, d):
    """Ids of aliases: by name in any case, then by the id itself, then by a name that the alias has as words."""
    part = _table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("entity_id"), F.lower("p_name").alias("name"))
    asked = spark.sql(_ASKED, lineitem=_table(spark, d, "lineitem"), part=_table(spark, d, "part"))
    named = part.groupBy("name").agg(F.min("entity_id").alias("entity_id"))
    patterns = named.select(F.col("entity_id").alias("seed"), F.concat(F.lit(r"(?i)\b"), "name", F.lit(r"\b")).alias("pattern"), F.array("name").alias("needs"))
    texts = asked.where("alias LIKE 'the %'").select("alias").distinct()
    found = L.matched_patterns(texts.select(F.col("alias").alias("entity_id"), F.col("alias").alias("name")), patterns).groupBy("entity_id").agg(F.min("seed").alias("value"))
    more = asked.join(found, asked["alias"] == found["entity_id"]).select("alias", F.lit(3).alias("step"), "value")
    return L.first_hit(asked, part, "alias", [(F.lower("alias"), F.col("name")), (F.col("alias"), F.col("entity_id"))], F.col("entity_id"), [F.col("entity_id")], more)


_HASH = "CAST('0x' || substr(md5('42:' || pmid), 1, 13) AS BIGINT)"
_POSITIVE = "journal_abbr IN ('1-URGENT', '2-HIGH')"


@query(f"""WITH a AS ({plain("art")}), n AS (SELECT pmid, abstract, row_number() OVER (ORDER BY {_HASH}, pmid) AS k FROM a WHERE NOT {_POSITIVE}),
p AS (SELECT pmid, abstract FROM a WHERE {_POSITIVE}), x AS (SELECT pmid, abstract, 1 AS label FROM p UNION ALL SELECT pmid, abstract, 0 FROM n WHERE k <= (SELECT count(*) // 2 FROM p))
SELECT pmid, CAST(label AS INTEGER) AS label FROM x WHERE trim(abstract) <> ''""")
def training_rows(spark, d):
    """Articles of some journals as positives, and half as many of the others, those of the smallest hashes."""
    art = view(spark, d, "art").select("pmid", "abstract", "journal_abbr")
    return Q.training_set(art.where(_POSITIVE), art.where(f"NOT {_POSITIVE}"), 0.5, ["pmid"]).select("pmid", "label")


@query(f"SELECT pmid FROM ({plain('art')}) v WHERE {_HASH} < 0.1 * pow(2, 52)")
def sampled_articles(spark, d):
    """About a tenth of the articles, the same for the same seed."""
    return A.sampled(view(spark, d, "art"), 0.1, 42, "pmid").select("pmid")


_QUANTILES = (0.05, 0.5, 0.98)


@query("SELECT grp, q, v FROM (SELECT l_returnflag AS grp, unnest([0.05, 0.5, 0.98]::DOUBLE[]) AS q, unnest(quantile_cont(l_extendedprice, [0.05, 0.5, 0.98]::DOUBLE[])) AS v FROM lineitem GROUP BY l_returnflag) x")
def price_quantiles(spark, d):
    """Exact quantiles of each group, by narrowing."""
    rows = _table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    found = [(g, q, v) for q in _QUANTILES for g, v in Q.exact_quantiles(rows, "l_extendedprice", q, "l_returnflag").items()]
    return spark.createDataFrame(found, "grp string, q double, v double").select("grp", "q", F.round("v", 6).alias("v"))


@query(f"SELECT DISTINCT source_entity_id, target_entity_id, relation_type FROM ({plain('rel')}) v")
def appended_relations(spark, d):
    """Relations appended to a published table in two parts, the second of them twice; each row is there once."""
    rel, at = view(spark, d, "rel").select("source_entity_id", "target_entity_id", "relation_type", "pmid"), _path(spark, "relations")
    for part in ("pmid % 3 = 0", "pmid % 3 <> 0", "pmid % 3 <> 0"):
        P.append_distinct(rel.where(part).drop("pmid"), at)
    return P.read_published(spark, at)


@query("SELECT DISTINCT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def published_once(spark, d):
    """A table published, and not again while it is there; the cache of other parameters doesn't touch it."""
    customers, at = _table(spark, d, "customer").select("c_custkey", "c_name"), _path(spark, "customers")
    P.cached(spark, at, {"half": 1}, lambda: customers.where("c_custkey % 2 = 1"))
    return P.cached(spark, at, {"half": 0}, lambda: customers.where("c_custkey % 2 = 0"))


@query("""WITH n AS (SELECT year(o_orderdate) AS y, (row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) - 1) // 200 AS b FROM orders)
SELECT 'BATCH_Y' || y || '_NER_B' || b || '.csv' AS file, count(*) AS n FROM n GROUP BY 1""")
def batch_file_rows(spark, d):
    """Orders in files of 200 rows of a year each, counted by the names of the files that hold them."""
    orders, at = _table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice"), _path(spark, "batches")
    B.batch_files(orders, at, "NER", "year", ["o_orderkey"])
    back = spark.read.option("header", "true").option("pathGlobFilter", "BATCH_*.csv").csv(at)  # the folder is listed once
    return back.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS pmid, 'ARTICLES_Y' || year(o_orderdate) || '.csv' AS file, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders")
def yearly_file_rows(spark, d):
    """Orders in a file for each year, the year read back from the file's name."""
    orders, at = _table(spark, d, "orders").select(F.col("o_orderkey").alias("pmid"), F.year("o_orderdate").alias("year")), _path(spark, "years")
    B.yearly_files(orders, at, "ARTICLES", "year", ["pmid"])
    back = spark.read.option("header", "true").csv(f"{at}/ARTICLES_Y*.csv")
    return back.select("pmid", F.col("_metadata.file_name").alias("file"), F.regexp_extract(F.col("_metadata.file_name"), r"_Y(\d{4})", 1).alias("year"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return E.count_edges(view(spark, d, "rel")).select("u", "v", F.col("weight").cast("double").alias("w"))


@query()
def node_communities(spark, d):
    """Communities of the edges with two relations or more."""
    return M.communities(_edges(spark, d))


@query()
def node_betweenness(spark, d):
    """Exact betweenness over weighted shortest paths."""
    return Y.betweenness(view(spark, d, "nation_edges").select("u", "v", F.col("w").cast("double").alias("w")), weighted=True, digits=6)


@query()
def sampled_betweenness(spark, d):
    """Betweenness from as many sources as an error of 0.3 takes; the bound is that of sources_needed()."""
    edges = written(_edges(spark, d))
    return Y.betweenness(edges, Y.drawn_sources(edges.select(F.explode(F.array("u", "v")).alias("entity_id")), 0.3))
