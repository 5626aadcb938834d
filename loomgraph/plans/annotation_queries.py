"""Queries over annotations of articles, with their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import articles as A
from loomgraph.operators import entities as N
from loomgraph.operators import evaluation as V
from loomgraph.operators import graph as G
from loomgraph.params import Selection
from loomgraph.plans.graph_queries import _EV, _NATION, _PRF_COLS, _W, _prf
from loomgraph.plans.views import plain, view
from loomgraph.session import checkpoint_folder
from loomgraph.sources import readers as R

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


def _results(spark, d):
    """Result lines of a language model, written and read as such: plain JSON, fenced JSON, and content that is none."""
    body = """'{"entities": [{"entity_text": "Customer ' || o_custkey || '", "entity_type": "BMC", "evidence": "' || CASE WHEN o_orderkey % 2 = 0 THEN 'order OF' ELSE 'nowhere zq' END || '"}, {"entity_text": "E' || o_orderkey || '"}],
 "relationships": [{"source_entity_id": "c' || o_custkey || '", "target_entity": "' || o_orderstatus || '", "relation_type": "Causal", "confidence": 0.5, "evidence": ""}]}'"""
    content = F.expr(f"CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'no json' WHEN 1 THEN 'Here:\\n```json\\n' || {body} || '\\n```' ELSE {body} END")
    message = F.array(F.struct(F.struct(content.alias("content")).alias("message")))
    lines = _table(spark, d, "orders").select(F.struct(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("request_id")).alias("request"), F.struct(message.alias("choices")).alias("response"))
    at = f"{checkpoint_folder(spark)}/results-{uuid.uuid4().hex}"
    lines.select(F.to_json(F.struct("*"))).write.text(at)
    rows = R.json_rows(spark, at, "request struct<request_id:string>, response struct<choices:array<struct<message:struct<content:string>>>>")
    results = rows.select("request.request_id", F.col("response.choices")[0]["message"]["content"].alias("content"))
    art = view(spark, d, "art")
    return A.parsed_results(results, art.select(F.concat(F.lit("r"), "pmid").alias("request_id"), "pmid"), art, "B1")


_ART = f"art AS ({plain('art')}), o AS (SELECT orders.*, abstract FROM orders JOIN art ON pmid = CAST(o_orderkey AS VARCHAR) WHERE o_orderkey % 7 <> 0)"


@query(f"""WITH {_ART} SELECT 'B1' AS batch_id, CAST(o_orderkey AS VARCHAR) AS pmid, 'Customer ' || o_custkey AS entity_text, 'BMC' AS entity_type, CASE WHEN o_orderkey % 2 = 0 THEN 'order OF' ELSE 'nowhere zq' END AS evidence, o_orderkey % 2 = 0 AND coalesce(abstract, '') LIKE 'Order of%' AS evidence_valid FROM o
UNION ALL SELECT 'B1', CAST(o_orderkey AS VARCHAR), 'E' || o_orderkey, '', '', true FROM o""")
def llm_entities(spark, d):
    return _results(spark, d)[0]


@query(f"WITH {_ART} SELECT 'B1' AS batch_id, CAST(o_orderkey AS VARCHAR) AS pmid, 'c' || o_custkey AS source_entity, o_orderstatus AS target_entity, 'Causal' AS relation_type, '0.5' AS confidence, '' AS evidence, true AS evidence_valid FROM o")
def llm_relations(spark, d):
    return _results(spark, d)[1]


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS e1, p_brand AS e2, CASE WHEN p_partkey % 4 > 0 THEN p_name || ' acts on ' || p_brand || '.' ELSE p_name || ' and ' || p_brand END AS sentence, 'bert_model_prediction' AS source FROM part""")
def tagged_pairs(spark, d):
    text = F.expr("CASE WHEN p_partkey % 4 > 0 THEN '<e1>' || p_name || ' </e1>acts on <E2>' || p_brand || '</E2>.' ELSE p_name || ' and <e2>' || p_brand || '</e2>' END")
    return _table(spark, d, "part").select("p_partkey", *(c.alias(n) for n, c in A.tagged_pair(text).items()), F.lit("bert_model_prediction").alias("source"))


_DOCS = "SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN ' given ' ELSE ' ' END AS evidence FROM documents"


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'given' WHEN doc_id % 5 = 0 THEN '' ELSE coalesce([s FOR s IN string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF contains(lower(s), 'the')][1], '') END AS evidence FROM documents""")
def evidence_backfill(spark, d):
    docs = _table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("pmid"), F.lit("The").alias("entity_name"), F.when(F.col("doc_id") % 3 == 0, " given ").otherwise(" ").alias("evidence"))
    articles = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("pmid"), F.col("text").alias("abstract"))
    return A.filled_evidence(rows, articles).select(F.col("pmid").alias("doc_id"), "evidence")


@query("SELECT DISTINCT coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'K' || c_custkey END, 'Entity-' || substring(md5(lower(c_name)), 1, 10)) AS entity_id, 'Predicted ' || c_mktsegment AS entity_type, 'bert_model_prediction' AS source FROM customer")
def tbl_entity_types_pred(spark, d):
    c = _table(spark, d, "customer")
    known = c.where("c_custkey % 2 = 0").select(F.upper("c_name").alias("name"), F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("entity_id"))
    rows = A.with_ids(c.select(F.concat(F.lit(" "), "c_name").alias("name"), "c_mktsegment"), known)
    return rows.select("entity_id", F.concat(F.lit("Predicted "), "c_mktsegment").alias("entity_type"), F.lit("bert_model_prediction").alias("source")).distinct()


@query("""SELECT 'N' || c_nationkey AS entity_id, min(c_name) AS entity_name, string_agg(c_mktsegment, ';' ORDER BY c_mktsegment) AS pref_label, coalesce(string_agg(CASE WHEN c_custkey % 3 = 0 THEN 'def ' || c_custkey END, ';' ORDER BY 'def ' || c_custkey), '') AS definitions,
'{' || array_to_string(['"' || replace(x, '"', '\\"') || '"' FOR x IN list_sort(list_concat(list(c_name), list('s"' || c_custkey)))], ',') || '}' AS synonyms, '' AS ontology FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) c GROUP BY c_nationkey""")
def entity_catalog_full(spark, d):
    c = _table(spark, d, "customer").where("c_custkey % 2 = 0")
    rows = c.selectExpr("'N' || c_nationkey AS entity_id", "c_name AS entity_name", "c_mktsegment AS pref_label", "CASE WHEN c_custkey % 3 = 0 THEN 'def ' || c_custkey ELSE ' ' END AS definitions", "array(c_name, ' ', 's\"' || c_custkey) AS synonyms", "CAST(NULL AS STRING) AS ontology")
    return A.catalog(rows)


@query("""WITH r AS (SELECT 'N' || c_nationkey AS entity_id, c_name AS entity_name, c_mktsegment AS l FROM customer UNION ALL SELECT 'N' || s_nationkey, s_name, 'Supplier' FROM supplier)
SELECT entity_id, CASE WHEN CAST(substring(entity_id, 2) AS INT) % 2 = 0 THEN (SELECT n_name FROM nation WHERE 'N' || n_nationkey = entity_id) ELSE min(entity_name) END AS name,
array_to_string(list_sort(list_distinct(list_append(list(l), 'Entity'))), '|') AS label FROM r GROUP BY entity_id""")
def graph_nodes_labels(spark, d):
    rows = _table(spark, d, "customer").selectExpr("'N' || c_nationkey AS entity_id", "c_name AS entity_name", "c_mktsegment AS source_label")
    rows = rows.union(_table(spark, d, "supplier").selectExpr("'N' || s_nationkey", "s_name", "'Supplier'"))
    names = _table(spark, d, "nation").where("n_nationkey % 2 = 0").selectExpr("'N' || n_nationkey AS entity_id", "n_name AS name")
    return A.graph_nodes(rows, names)


@query("SELECT p_name AS entity_name, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS entity_type, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS source FROM part GROUP BY p_name")
def unified_nodes_by_name(spark, d):
    return A.unified_nodes(_table(spark, d, "part").selectExpr("p_name AS entity_name", "p_type AS entity_type", "p_brand AS source"))


_SPELL = """WITH sp AS (SELECT CASE WHEN p_size % 2 = 0 THEN p_name ELSE upper(p_name) END AS name FROM part UNION ALL SELECT p_brand FROM part),
sy AS (SELECT p_type AS p, p_brand AS s FROM part WHERE p_size > 40), g AS (SELECT s AS name, max(p) AS p FROM sy GROUP BY s),
c AS (SELECT name, count(*) AS n FROM sp GROUP BY name), o AS (SELECT * FROM c WHERE name NOT IN (SELECT name FROM g))"""
_UP = "'Entity-' || substring(md5(upper({})), 1, 10)"


def _spelled(spark, d):
    part = _table(spark, d, "part")
    spellings = part.selectExpr("CASE WHEN p_size % 2 = 0 THEN p_name ELSE ' ' || upper(p_name) END AS name").union(part.selectExpr("p_brand"))
    return A.spelled_ids(spellings, part.where("p_size > 40").selectExpr("p_type AS primary", "p_brand AS synonym"))


@query(f"{_SPELL} SELECT name, {_UP.format('p')} AS entity_id FROM g UNION ALL SELECT name, {_UP.format('name')} FROM o")
def name_to_id(spark, d):
    return _spelled(spark, d)[0]


@query(f"""{_SPELL}, pr AS (SELECT {_UP.format('p')} AS entity_id, min(p) AS name FROM sy GROUP BY 1)
SELECT * FROM pr UNION ALL SELECT entity_id, name FROM (SELECT {_UP.format('name')} AS entity_id, name, row_number() OVER (PARTITION BY upper(name) ORDER BY n DESC, name) AS k FROM o) x WHERE k = 1 AND entity_id NOT IN (SELECT entity_id FROM pr)""")
def id_to_name(spark, d):
    return _spelled(spark, d)[1]


_SEEDS = ["Cold_Widget", "gizmo", "RAPAMYCIN", "no such", "hot bolt"]
_SEED_NAMES = "SELECT 'P' || p_partkey AS entity_id, p_name || CASE WHEN p_partkey % 25 = 0 THEN ' with sirolimus' ELSE '' END AS name FROM part"
_SEED_SQL = f"""WITH n AS ({_SEED_NAMES}), w AS (SELECT 'P' || p_partkey AS entity_id, CAST(p_size AS DOUBLE) AS weight FROM part WHERE p_size > 10), s(seed) AS (VALUES {', '.join(f"('{s}')" for s in _SEEDS)}),
e AS (SELECT DISTINCT seed, entity_id, 'exact' AS mode FROM n JOIN s ON regexp_replace(upper(name), '[\\s_]+', '', 'g') = regexp_replace(upper(seed), '[\\s_]+', '', 'g')),
r AS (SELECT DISTINCT seed, entity_id, 'regex' AS mode FROM n JOIN s ON regexp_matches(name, '\\b' || seed || '\\b' || CASE seed WHEN 'RAPAMYCIN' THEN '|\\bSirolimus\\b' ELSE '' END, 'i') WHERE seed NOT IN (SELECT seed FROM e)),
h AS (SELECT x.*, w.weight FROM (SELECT * FROM e UNION ALL SELECT * FROM r) x LEFT JOIN w ON w.entity_id = x.entity_id WHERE x.entity_id <> 'P7')"""


def _seed_hits(spark, d):
    part = _table(spark, d, "part")
    names = part.selectExpr("'P' || p_partkey AS entity_id", "p_name || CASE WHEN p_partkey % 25 = 0 THEN ' with sirolimus' ELSE '' END AS name")
    weights = part.where("p_size > 10").selectExpr("'P' || p_partkey AS entity_id", "CAST(p_size AS DOUBLE) AS weight")
    return A.seed_ids(spark.createDataFrame([(s,) for s in _SEEDS], "seed string"), names, weights, ["P7"])


@query(f"{_SEED_SQL} SELECT * FROM h")
def seed_hits(spark, d):
    return _seed_hits(spark, d)


@query(f"{_SEED_SQL} SELECT seed, count(*) AS n_ids, string_agg(entity_id, ';' ORDER BY k) FILTER (WHERE k <= 12) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY weight DESC NULLS LAST, entity_id) AS k FROM h) x GROUP BY seed")
def seed_hits_summary(spark, d):
    return A.seed_summary(_seed_hits(spark, d))


_BARE = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH s AS (SELECT DISTINCT item_id % 20 AS sample_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM benchmark), k AS (SELECT *, length(t) AS chars, row_number() OVER (PARTITION BY sample_id ORDER BY length(t) DESC, t) AS r FROM s WHERE length(t) >= 40),
d AS (SELECT doc_id, ' ' || {_BARE.format('text')} || ' ' AS t FROM documents), f AS (SELECT sample_id, doc_id, 1000 * count(*) + max(chars) AS score FROM k JOIN d ON contains(d.t, ' ' || {_BARE.format('k.t')} || ' ') WHERE r <= 8 GROUP BY 1, 2)
SELECT sample_id, doc_id AS id, score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, doc_id) AS k FROM f) x WHERE k = 1""")
def sample_match(spark, d):
    samples = _table(spark, d, "benchmark").select((F.col("item_id") % 20).alias("sample_id"), "text")
    return A.best_texts(samples, _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


_CELLS = f"{_NATION}, cells AS (SELECT c.entity_id AS candidate, s.entity_id AS seed, coalesce(max(b.w), 0) AS w FROM (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS entity_id FROM nation) c CROSS JOIN seeds s LEFT JOIN b ON b.src = c.entity_id AND b.dst = s.entity_id GROUP BY 1, 2)"


def _cells(spark, d):
    nodes = _table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("entity_id"))
    return G.seed_grid(view(spark, d, "nation_edges"), nodes, view(spark, d, "seeds_aging"))


@query(f"{_CELLS} SELECT candidate, seed, round(w, 6) AS w, round(CASE WHEN max(w) OVER (PARTITION BY candidate) > 0 THEN w / max(w) OVER (PARTITION BY candidate) ELSE 0 END, 6) AS by_row, round(w / max(w) OVER (), 6) AS by_all FROM cells")
def heatmap_scaled(spark, d):
    out = A.matrix_scaled(_cells(spark, d), "candidate", "w")
    return out.select("candidate", "seed", *(F.round(c, 6).alias(c) for c in ("w", "by_row", "by_all")))


@query(f"{_CELLS}, t AS (SELECT candidate, sum(w) AS total, avg(w) AS mean, max(w) AS top FROM cells GROUP BY candidate) SELECT candidate, round(total, 6) AS total, round(mean, 6) AS mean, round(top, 6) AS top FROM t WHERE total >= (SELECT quantile_cont(total, 0.5) FROM t) - 1e-9")
def heatmap_strongest(spark, d):
    out = A.strongest_columns(_cells(spark, d), "candidate", "w", 0.5)
    return out.select("candidate", *(F.round(c, 6).alias(c) for c in ("total", "mean", "top")))


@query(f"""{_W}, p AS (SELECT * FROM tw WHERE rank_in_entity = 1 AND evidence_count >= 2 AND sources_unique >= 1), e AS (SELECT quantile_cont(weight_norm, 0.85) AS q FROM tw WHERE rank_in_entity = 1 AND entity_type = 'EGR')
SELECT 'aging' AS seed_set, entity_id, entity_type FROM p WHERE entity_type = 'BMC' AND weight_norm >= 0.6 UNION ALL SELECT 'longevity', entity_id, entity_type FROM p, e WHERE entity_type = 'EGR' AND weight_norm >= q - 1e-12""")
def select_seed_sets(spark, d):
    weights = N.type_weights(view(spark, d, "etype"))
    out = N.select_sets(weights, {"aging": (["BMC"], Selection()), "longevity": (["EGR"], Selection(min_weight_norm=None))})
    return out.select("seed_set", "entity_id", "entity_type")


_SCORED = "SELECT 'C' || c_custkey AS entity_id, c_mktsegment AS entity_type, (c_custkey % 11) / 10.0 AS a, (c_custkey % 7) / 6.0 AS l FROM customer"


@query(f"SELECT entity_id, round(CAST(a - l AS DOUBLE), 6) AS delta, round(CAST(abs(a - l) AS DOUBLE), 6) AS abs_delta, round(CAST(greatest(a, l) AS DOUBLE), 6) AS strength FROM ({_SCORED}) x WHERE (entity_type IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND entity_type <> 'FURNITURE' AND abs(a - l) > 0.25 AND greatest(a, l) >= 0.55) OR entity_id IN ('C1', 'C2')")
def balance_quadrant(spark, d):
    scored = _table(spark, d, "customer").selectExpr("'C' || c_custkey AS entity_id", "c_mktsegment AS entity_type", "CAST(c_custkey % 11 AS DOUBLE) / 10 AS A_score", "CAST(c_custkey % 7 AS DOUBLE) / 6 AS L_score")
    out = A.balance(scored, ["BUILDING", "MACHINERY", "FURNITURE"], ["FURNITURE"], ["C1", "C2"], "abs_delta > 0.25", 0.55)
    return out.select("entity_id", *(F.round(c, 6).alias(c) for c in ("delta", "abs_delta", "strength")))


@query("""SELECT o_orderkey, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN '1998-15' WHEN 1 THEN '1998-01' WHEN 2 THEN '1998-07' ELSE '' END AS pub_date, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 1998 WHEN 1 THEN 1998 END AS year,
CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS pmid, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN '1234-5678' WHEN 1 THEN '12345678 (x)' ELSE '' END AS issn FROM orders""")
def medline_fields(spark, d):
    k = F.col("o_orderkey") % 4
    pick = lambda *v: F.when(k == 0, v[0]).when(k == 1, v[1]).when(k == 2, v[2]).otherwise(v[3])
    date = pick("1998 Jan 15", "1998 Mar", "1998/7/2", "spring")
    number = F.col("o_orderkey").cast("string")
    ids = pick(F.concat(number, F.lit(".0")), number, F.lit("x"), F.lit(None).cast("string"))
    issn = pick("1234-5678 (Print) 8765-4321 (Linking)", "12345678 (x)", "", "")
    return _table(spark, d, "orders").select("o_orderkey", T.pub_date(date).alias("pub_date"), T.publication_year(date, 2030).cast("bigint").alias("year"), T.pmid(ids).alias("pmid"), T.first_issn(issn).alias("issn"))


@query("""SELECT p_partkey, 'Ageanno' AS label, 'ageanno__' || p_brand AS file, CASE WHEN p_partkey % 3 = 0 THEN '{}' ELSE '{"' || p_name || '","a\\"b\\\\c"}' END AS literal, lower(p_name) AS normal, CASE WHEN p_size > 25 THEN 'DeepSeekV3' ELSE 'OtherModel' END AS model FROM part""")
def name_functions(spark, d):
    name = F.expr("'set_ageanno__' || p_brand || '__std.csv'")
    items = F.expr("CASE WHEN p_partkey % 3 = 0 THEN CAST(array() AS array<string>) ELSE array(p_name, 'a\"b\\\\c') END")
    padded = F.expr("'  _' || upper(p_name) || '. '")
    model = F.expr("CASE WHEN p_size > 25 THEN 'JCRQ1-IF10-DeepSeekV3' ELSE 'x' END")
    return _table(spark, d, "part").select("p_partkey", T.source_label(name, "set_").alias("label"), T.source_file(name, "set_").alias("file"), T.pg_array(items).alias("literal"), T.normal_name(padded).alias("normal"), T.model_label(model).alias("model"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS pmid, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'A title' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'no meta' ELSE 'x:y' || doc_id END AS body,
substring('abcdefghij', CAST(least(doc_id % 13, (doc_id * 7) % 13) AS INT) + 1, CAST(greatest(least(greatest(doc_id % 13, (doc_id * 7) % 13), 10) - least(doc_id % 13, (doc_id * 7) % 13), 0) AS INT)) AS piece FROM documents""")
def gold_fields(spark, d):
    text = F.expr("CASE WHEN doc_id % 3 = 0 THEN 'no meta' ELSE 'PMID ' || doc_id || ':A title:x:y' || doc_id END")
    piece = T.safe_slice(F.lit("abcdefghij"), F.col("doc_id") % 13, (F.col("doc_id") * 7) % 13)
    return _table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in T.gold_meta(text).items()), piece.alias("piece"))


@query(f"""{_EV}, k AS (SELECT pmid % 3 AS task, tp, fp, fn FROM st), s AS (SELECT CAST(task AS VARCHAR) AS task, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM k GROUP BY 1 UNION ALL SELECT '_ALL_', sum(tp), sum(fp), sum(fn) FROM k) SELECT task, {_PRF_COLS} FROM {_prf('s')} y""")
def prf_by_task(spark, d):
    counts = V.strict_counts(view(spark, d, "gold"), view(spark, d, "pred"), ["ent"])
    out = V.by_task(counts.withColumn("task", (F.col("pmid") % 3).cast("string")))
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query(f"SELECT source_entity_id, target_entity_id, relation_type FROM ({plain('rel')}) v WHERE (source_entity_id = 'C1' AND target_entity_id = 'S1') OR (source_entity_id = 'S1' AND target_entity_id = 'C1') OR contains(lower(target_entity_name), 'supplier 10')")
def relation_search(spark, d):
    rel = view(spark, d, "rel")
    return N.relations_between(rel, "C1", "S1").union(N.search_relations(rel, "SUPPLIER 10", ["target_entity_name"])).select("source_entity_id", "target_entity_id", "relation_type")


@query("""SELECT o_custkey AS u, count(*) AS n_rows, CAST(max(o_totalprice) AS DOUBLE) AS confidence, max(struct_pack(n := length(o_orderpriority), d := o_orderpriority)).d AS description,
string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS synonyms FROM orders GROUP BY 1""")
def merged_entities(spark, d):
    rows = _table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_totalprice").alias("confidence"), F.col("o_orderpriority").alias("description"), F.array(F.col("o_orderstatus")).alias("synonyms"))
    return N.merge_duplicates(rows).select(F.col("name").alias("u"), F.col("n_merged").alias("n_rows"), "confidence", "description", F.array_join("synonyms", ";").alias("synonyms"))


_ENTITIES = "SELECT c_custkey AS entity_id, c_name AS name, c_mktsegment AS entity_type, 'Customer of nation ' || CAST(c_nationkey AS VARCHAR(20)) AS description, CAST(c_acctbal AS DOUBLE) AS confidence FROM {customer}"


def _entities(spark, d):
    return spark.sql(_ENTITIES, customer=_table(spark, d, "customer")).withColumn("synonyms", F.array(F.concat(F.lit("Alias"), F.col("entity_id").cast("string"))))


@query(f"SELECT entity_id, name FROM ({_ENTITIES.format(customer='customer')}) x WHERE (contains(lower(name), '12') OR contains(lower(description), '12') OR contains(lower('Alias' || entity_id), '12')) AND entity_type = 'BUILDING'")
def entity_search(spark, d):
    """Entities of a type that have a text in their name, description or synonyms."""
    return N.search(_entities(spark, d), "12", "BUILDING").select("entity_id", "name")


@query(f"""WITH e AS ({_ENTITIES.format(customer='customer')}) SELECT entity_type, count(*) AS n, round(avg(confidence), 4) AS mean_confidence FROM e GROUP BY 1
UNION ALL SELECT '_ALL_', count(*), round(avg(confidence), 4) FROM e""")
def entity_statistics(spark, d):
    """Number and mean confidence of each type of entity, and of all."""
    return N.statistics(_entities(spark, d)).withColumn("mean_confidence", F.round("mean_confidence", 4))


_PRINT = r"sha1(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{Nd}\p{Pc}]+', '', 'g'))"


@query(f"""WITH t AS (SELECT {_PRINT} AS f, min(doc_id) AS text_id FROM documents GROUP BY 1 HAVING count(*) = 1), s AS (SELECT item_id AS sample_id, {_PRINT} AS f FROM benchmark
UNION ALL SELECT -doc_id, {_PRINT} FROM documents WHERE lang = 'en') SELECT sample_id, text_id FROM s JOIN t ON s.f = t.f""")
def unique_fingerprints(spark, d):
    """Samples whose fingerprint is that of exactly one text."""
    texts = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    samples = _table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text").union(texts.where("lang = 'en'").select(-F.col("id"), "text"))
    return V.fingerprint_matches(samples, texts.select("id", "text"))


_SAID = "' Alpha ' || p_name || '.  Beta v1.5 here! Gamma ' || p_brand || ' end'"


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Alpha ' || p_name || '. Gamma ' || p_brand || ' end' WHEN 1 THEN 'Beta v1.5 here!' WHEN 2 THEN 'Alpha ' || p_name || '.' END AS sentences FROM part""")
def sentences_covering(spark, d):
    """Offsets in the first and last sentence; in the second; over the end of the first; none at all."""
    text, n = F.expr(_SAID), F.length("p_name")
    pair = lambda a, b: F.struct(F.lit(a).alias("start") if isinstance(a, int) else a.alias("start"), F.lit(b).alias("end") if isinstance(b, int) else b.alias("end"))
    none = F.expr("CAST(array() AS array<struct<start:int,end:int>>)")
    offsets = F.expr("p_partkey % 4")
    where = F.when(offsets == 0, F.array(pair(F.length(text) - 3, F.length(text)), pair(1, 6))).when(offsets == 1, F.array(pair(n + 15, n + 19))).when(offsets == 2, F.array(pair(3, n + 12))).otherwise(none)
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", T.covering_sentences(text, where).alias("sentences"))
