"""Queries over tables put into shape, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import tidy as D
from loomgraph.plans.views import plain, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("""WITH x AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS a, 3.0::DOUBLE AS c FROM customer), m AS (SELECT min(a) AS lo, max(a) AS hi FROM x)
SELECT c_custkey, round((a - lo) / (hi - lo), 6) AS plain, round((a - lo) / (hi - lo), 6) AS guarded, round((a - lo) / (hi - lo + 1e-9), 6) AS soft, 0.0::DOUBLE AS constant, 0.0::DOUBLE AS softer FROM x, m""")
def scaled_columns(spark, d):
    """A column scaled in each way, and a constant one."""
    rows = _table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("a"), F.lit(3.0).alias("c"))
    out = D.scaled(rows, {"plain": ("a", "plain"), "guarded": ("a", "guarded"), "soft": ("a", "soft"), "constant": ("c", "plain"), "softer": ("c", "softer")})
    return out.select("c_custkey", *(F.round(c, 6).alias(c) for c in ("plain", "guarded", "soft", "constant", "softer")))


_RECORDS = """SELECT CAST(o_custkey AS VARCHAR(20)) AS pmid, o_orderkey AS k, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS title, CASE WHEN o_orderkey % 11 > 0 THEN o_orderstatus END AS abstract,
CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'Journal Article; Retracted Publication' ELSE 'Journal Article' END AS publication_type FROM {orders}"""


@query(f"""SELECT pmid, k FROM (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY k) AS r FROM ({_RECORDS.format(orders="orders")}) x
WHERE title IS NOT NULL AND abstract IS NOT NULL AND (publication_type IS NULL OR NOT contains(publication_type, 'Retracted Publication'))) y WHERE r = 1""")
def clean_article_records(spark, d):
    """Articles with title and abstract that weren't retracted, one for each id."""
    rows = spark.sql(_RECORDS, orders=_table(spark, d, "orders"))
    return D.clean_records(rows, ["pmid", "k", "title", "abstract"], order=[F.col("k")]).select("pmid", "k")


@query("""WITH k AS (SELECT c_name AS name, max('C' || c_custkey) AS entity_id FROM customer WHERE c_custkey % 3 > 0 GROUP BY 1)
SELECT o_orderkey, k.entity_id FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN k ON k.name = CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE lower(c_name) END""")
def known_ids(spark, d):
    """Ids of names as they are spelled; other spellings have none."""
    customer = _table(spark, d, "customer")
    rows = _table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr("o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE lower(c_name) END AS asked")
    known = customer.where("c_custkey % 3 > 0").selectExpr("c_name AS name", "'C' || c_custkey AS entity_id")
    return D.with_known_ids(rows, known, "asked", "entity_id").select("o_orderkey", "entity_id")


_SAID = "SELECT CAST(l_orderkey % 100 AS INT) AS pmid, 'P' || CAST(l_partkey % 50 AS INT) AS name, l_returnflag AS type, l_orderkey * 10 + l_linenumber AS place FROM {lineitem}"
_TOLD = "SELECT DISTINCT CAST(l_orderkey % 100 AS INT) AS pmid, 'P' || CAST(l_suppkey % 60 AS INT) AS source, 'P' || CAST(l_partkey % 50 AS INT) AS target FROM {lineitem}"


@query(f"""WITH l AS (SELECT pmid, name, type FROM (SELECT *, row_number() OVER (PARTITION BY pmid, name ORDER BY place DESC, type DESC) AS r FROM ({_SAID.format(lineitem="lineitem")}) x) y WHERE r = 1)
SELECT t.pmid, t.source, t.target, a.type AS source_type, b.type AS target_type FROM ({_TOLD.format(lineitem="lineitem")}) t LEFT JOIN l a ON a.pmid = t.pmid AND a.name = t.source LEFT JOIN l b ON b.pmid = t.pmid AND b.name = t.target""")
def typed_relations(spark, d):
    """Relations with both ends' types in the same article, the last one said."""
    line = _table(spark, d, "lineitem")
    return D.with_types(spark.sql(_TOLD, lineitem=line), spark.sql(_SAID, lineitem=line)).select("pmid", "source", "target", "source_type", "target_type")


@query("""WITH t AS (SELECT DISTINCT p_name || ' (' || p_brand || ')' AS entity, p_name AS main_text FROM part UNION SELECT DISTINCT p_type, p_type FROM part)
SELECT t.entity, t.main_text, coalesce(a.annotation, '{}') AS annotation FROM t LEFT JOIN (SELECT p_name AS m, min('{"size":' || p_size || '}') AS annotation FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) a ON a.m = t.main_text""")
def dictionary_annotations(spark, d):
    """The distinct names of two tables with their brackets cut off, and what a dictionary says of them."""
    part = _table(spark, d, "part")
    names = D.entity_dictionary(part.select(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("entity")), part.select(F.col("p_type").alias("entity")))
    says = part.where("p_partkey % 2 = 0").selectExpr("p_name AS main_text", "'{\"size\":' || p_size || '}' AS annotation")
    return D.annotated(names, says).select("entity", "main_text", "annotation")


@query(f"""WITH r AS ({plain("rel")}), s AS ({plain("seeds")}), c AS (SELECT source_entity_id AS seed, target_entity_id AS neighbour, relation_type AS type, count(*) AS n FROM r WHERE source_entity_id IN (SELECT entity_id FROM s) GROUP BY 1, 2, 3)
SELECT seed, neighbour, type FROM (SELECT *, row_number() OVER (PARTITION BY seed, neighbour ORDER BY n DESC, type) AS k FROM c) x WHERE k = 1""")
def seed_neighbour_types(spark, d):
    """The most frequent type of the relations between each seed and each neighbour."""
    rel = view(spark, d, "rel").join(view(spark, d, "seeds").withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id", "left_semi")
    return D.neighbour_types(rel.selectExpr("source_entity_id AS seed", "target_entity_id AS neighbour", "relation_type AS type"))


@query("""WITH e AS (SELECT 'C' || o_custkey AS a, 'C' || CAST(o_orderkey % 200 AS INT) AS b, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS t, CAST(o_totalprice AS DOUBLE) AS w FROM orders), m AS (SELECT min(w) AS lo, max(w) AS hi FROM e),
x AS (SELECT least(a, b) AS u, greatest(a, b) AS v, t, greatest(0, least(1, (w - lo) / (hi - lo + 1e-9))) AS w FROM e, m), c AS (SELECT u, v, t, count(*) AS n FROM x WHERE t IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT u, v, t FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY n DESC, t) AS r FROM c) y WHERE r = 1), p AS (SELECT u, v, max(w) AS w FROM x GROUP BY 1, 2), q AS (SELECT quantile_cont(w, 0.98) AS cap FROM p)
SELECT p.u, p.v, coalesce(k.t, '') AS reltype_top, round(p.w, 6) AS w_norm, round(pow(least(p.w, cap) / cap, 2), 6) AS w_vis FROM p CROSS JOIN q LEFT JOIN k ON k.u = p.u AND k.v = p.v""")
def drawn_edges(spark, d):
    """Edges under other names, standardised for a figure."""
    rows = _table(spark, d, "orders").selectExpr("'C' || o_custkey AS source", "'C' || CAST(o_orderkey % 200 AS INT) AS target", "CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS reltype_top", "o_totalprice AS weight")
    return D.standard_edges(rows).select("u", "v", "reltype_top", F.round("w_norm", 6).alias("w_norm"), F.round("w_vis", 6).alias("w_vis"))


@query(f"""WITH r AS (SELECT source_entity_id AS s, target_entity_id AS t, relation_type AS k, CAST(length(pmid) AS DOUBLE) AS c FROM ({plain("rel")}) v), e AS (SELECT k, c, s AS x FROM r UNION ALL SELECT k, c, t FROM r)
SELECT k AS relation_type, CAST(count(*) // 2 AS BIGINT) AS n, CAST(CASE WHEN k IN ('Association', 'associated with') THEN 0 ELSE count(*) // 2 END AS BIGINT) AS directed, count(DISTINCT x) AS entities, round(avg(c), 6) AS mean_confidence FROM e GROUP BY k
UNION ALL SELECT '_ALL_', CAST(count(*) // 2 AS BIGINT), CAST(count(*) FILTER (WHERE k NOT IN ('Association', 'associated with')) // 2 AS BIGINT), count(DISTINCT x), round(avg(c), 6) FROM e""")
def relation_stats(spark, d):
    """Numbers of each type of relation and of all."""
    rel = view(spark, d, "rel").selectExpr("source_entity_id AS source", "target_entity_id AS target", "relation_type", "CAST(length(pmid) AS DOUBLE) AS confidence")
    return D.relation_statistics(rel, ["Association", "associated with"]).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("SELECT '[' || string_agg('\"' || id || '\"', ',' ORDER BY s DESC, id) || ']' AS ids FROM (SELECT 'C' || c_custkey AS id, round(CAST(c_acctbal AS DOUBLE), 9) AS s FROM customer ORDER BY s DESC, id LIMIT 50) x")
def exported_ids(spark, d):
    """The ids of the fifty highest scores as they are exported."""
    return D.top_ids(_table(spark, d, "customer").selectExpr("'C' || c_custkey AS entity_id", "CAST(c_acctbal AS DOUBLE) AS score"), "score", 50)
