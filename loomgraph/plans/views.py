"""Stand-in views over the star schema, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_SOURCE = "CASE CAST({c}l_suppkey % 6 AS INT) WHEN 0 THEN 'ctd__genes' WHEN 1 THEN 'AgingRelated-DeepSeekV3' WHEN 2 THEN 'bert_model_prediction' WHEN 3 THEN 'JCRQ1-IF10-DeepSeekR1-7B;uniprot' WHEN 4 THEN 'unknown_src' ELSE 'source:HALL' END"
_LABEL = "CASE l.l_returnflag WHEN 'A' THEN 'BMC' WHEN 'N' THEN 'EGR' ELSE 'AAI' END"

VIEWS = {
    "rel": "SELECT 'C' || CAST(o.o_custkey AS VARCHAR(20)) AS source_entity_id, 'S' || CAST(l.l_suppkey AS VARCHAR(20)) AS target_entity_id, CASE CAST(l.l_partkey % 7 AS INT) WHEN 0 THEN 'Causal' WHEN 1 THEN 'associated with' WHEN 2 THEN 'REG' WHEN 3 THEN 'Part of' WHEN 4 THEN 'Feedback' WHEN 5 THEN 'novel_type' ELSE 'Association' END AS relation_type, " + _SOURCE.replace("{c}", "l.") + " AS source, 'Customer ' || CAST(o.o_custkey AS VARCHAR(20)) AS source_entity_name, CASE WHEN l.l_linenumber = 1 THEN 'Supplier ' ELSE 'supplier ' END || CAST(l.l_suppkey AS VARCHAR(20)) AS target_entity_name, CAST(l.l_orderkey AS VARCHAR(20)) AS pmid FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey",
    "nation_edges": "SELECT least(a, b) AS u, greatest(a, b) AS v, sum(w) AS w FROM (SELECT 'N' || CAST(c.c_nationkey AS VARCHAR(20)) AS a, 'N' || CAST(s.s_nationkey AS VARCHAR(20)) AS b, l.l_quantity AS w FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey) x WHERE a <> b GROUP BY least(a, b), greatest(a, b)",
    "etype": "SELECT 'P' || CAST(l_partkey AS VARCHAR(20)) AS entity_id, CASE CASE WHEN l_partkey % 5 = 0 THEN 'AF' ELSE l_returnflag || l_linestatus END WHEN 'AF' THEN 'BMC' WHEN 'AO' THEN 'EGR' WHEN 'NF' THEN 'AAI' WHEN 'NO' THEN 'APP' WHEN 'RF' THEN 'CRD' ELSE 'NM' END AS entity_type, " + _SOURCE.replace("{c}", "") + " AS source FROM {lineitem}",
    "ctype": "SELECT 'C' || CAST(c_custkey AS VARCHAR(20)) AS entity_id, CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'BMC' WHEN 1 THEN 'EGR' WHEN 2 THEN 'AAI' ELSE 'NM' END AS entity_type FROM {customer} UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR(20)), CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'BMC' WHEN 1 THEN 'CRD' ELSE 'APP' END FROM {supplier}",
    "art": "SELECT CAST(o_orderkey AS VARCHAR(20)) AS pmid, CAST(o_orderkey % 101 AS DOUBLE) / 100.0 AS aging_prob, o_totalprice / 10000.0 AS factor, CAST(o_orderdate AS DATE) AS pub_date, o_orderpriority AS journal_abbr, CASE WHEN o_orderstatus = 'F' THEN 'Q1' ELSE 'Q2' END AS jcr, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'Order of ' || o_orderpriority END AS abstract FROM {orders}",
    "evid": "SELECT CAST(l_orderkey AS VARCHAR(20)) AS pmid, 'P' || CAST(l_partkey AS VARCHAR(20)) AS entity_id FROM {lineitem}",
    "gold": "SELECT DISTINCT CAST(l.l_orderkey % 200 AS INT) AS pmid, p.p_name AS ent, " + _LABEL + " AS label FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey WHERE l.l_linenumber = 1 AND l.l_orderkey % 3 = 0",
    "pred": "SELECT DISTINCT CAST(l.l_orderkey % 200 AS INT) AS pmid, CASE WHEN p.p_partkey % 4 = 0 THEN substring(p.p_name, 1, 6) ELSE p.p_name END AS ent, " + _LABEL + " AS label FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey WHERE l.l_linenumber = 2 AND l.l_orderkey % 3 = 0",
    "seeds": "SELECT 'C' || CAST(c_custkey AS VARCHAR(20)) AS entity_id FROM {customer} WHERE c_custkey % 150 = 0",
    "seeds_aging": "SELECT 'N' || CAST(n_nationkey AS VARCHAR(20)) AS entity_id FROM {nation} WHERE n_nationkey % 5 = 0",
    "seeds_longevity": "SELECT 'N' || CAST(n_nationkey AS VARCHAR(20)) AS entity_id FROM {nation} WHERE n_nationkey % 7 = 3",
    "names": "SELECT 'P' || CAST(p_partkey AS VARCHAR(20)) AS entity_id, p_name AS name, p_type AS type, p_brand AS brand FROM {part}",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables of sf_dir; columns and filters reach the scans."""
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def plain(name: str) -> str:
    """The same view for an engine where the tables have their own names."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])
