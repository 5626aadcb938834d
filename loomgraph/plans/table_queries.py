"""Queries over names, articles, texts and streams, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import classifier as C
from loomgraph.operators import tables as B
from loomgraph.plans.views import plain, view
from loomgraph.streaming import edges as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SEEDS = ["COLD WIDGET", "hot_bolt", "large bracket"]
PATTERNS = {"COLD": [r"\bcold\b", r"\bcool\b"], "WIDGET": [r"\bwidgets?\b"], "BOLT": [r"\bbolt\b"]}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _id(c: str, case: str = "lower") -> str:
    return f"'Entity-' || substring(md5({case}(trim({c}))), 1, 10)"


@query(f"SELECT DISTINCT {_id('n', 'upper')} AS id, upper(trim(n)) AS name FROM (SELECT unnest([p_name, p_brand]) AS n FROM part) x WHERE trim(n) <> ''")
def id_mapping(spark, d):
    return B.id_mapping(read(spark, d, "part").select(F.concat_ws("|", "p_name", "p_brand").alias("name")))


_DATES = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-13') ELSE 'spring' END"


def _dates():
    k, at = F.col("o_orderkey") % 5, F.col("o_orderdate")
    forms = [F.date_format(at, "yyyy"), F.date_format(at, "yyyy-MM"), F.date_format(at, "yyyy-MM-dd"), F.concat(F.date_format(at, "yyyy"), F.lit("-13"))]
    return F.when(k == 0, forms[0]).when(k == 1, forms[1]).when(k == 2, forms[2]).when(k == 3, forms[3]).otherwise("spring")


@query(f"SELECT o_orderkey, CASE WHEN length(t) = 4 THEN t || '-01-01' WHEN t LIKE '%-13' AND length(t) = 7 THEN '' WHEN length(t) = 7 THEN t || '-01' WHEN length(t) = 10 THEN t ELSE '' END AS day FROM (SELECT o_orderkey, {_DATES} AS t FROM orders) x")
def norm_dates(spark, d):
    return read(spark, d, "orders").select("o_orderkey", T.normal_date(_dates()).alias("day"))


@query("SELECT doc_id, trim(replace(replace(replace(replace(text, ',', ';'), chr(10), ' '), '\"', ''), '''', '')) AS name FROM documents")
def clean_names(spark, d):
    return read(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("name"))


#: A name's brackets by p_partkey % 6, and the main text, contents and kinds that follow.
_BRACKETS = [
    ("p_name || ' (AB' || CAST(p_partkey % 10 AS VARCHAR(20)) || ')'", "p_name", ["'AB' || CAST(p_partkey % 10 AS VARCHAR(20))"], ["abbreviation"]),
    ("p_name || ' (some further words)'", "p_name", ["'some further words'"], ["info"]),
    ("p_name", "p_name", [], []),
    ("p_name || ' (A) y (B) '", "p_name || ' (A) y'", ["'B'"], ["abbreviation"]),
    ("p_name || ' (A) y'", "p_name || '  y'", ["'A'"], ["abbreviation"]),
    ("p_name || ' (A1) y (2005) z'", "p_name || '  y  z'", ["'A1'", "'2005'"], ["abbreviation", "info"]),
]


def _by_remainder(values: list[str]) -> str:
    return "CASE CAST(p_partkey % 6 AS INT) " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


@query(f"""SELECT p_partkey, {_by_remainder([m for _, m, _, _ in _BRACKETS])} AS main_text, {_by_remainder([" || ';' || ".join(c) or "''" for _, _, c, _ in _BRACKETS])} AS contents,
{_by_remainder(["'" + ";".join(k) + "'" for _, _, _, k in _BRACKETS])} AS kinds FROM part""")
def abbrev_parse(spark, d):
    x = read(spark, d, "part").select("p_partkey", T.bracket_parts(F.expr(_by_remainder([t for t, _, _, _ in _BRACKETS]))).alias("x"))
    part = lambda field: F.array_join(F.transform("x.details", lambda p: p[field]), ";")
    return x.select("p_partkey", "x.main_text", part("content").alias("contents"), part("type").alias("kinds"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("The answer:\n```JSON\n"), "props", F.lit("\n```\nThat is all."))).otherwise(F.col("props"))
    return read(spark, d, "events").select("event_id", F.get_json_object(T.json_payload(fenced), "$.k").try_cast("bigint").alias("k"))


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 50) AS BIGINT) AS batch FROM documents")
def batch_split(spark, d):
    return B.batches(read(spark, d, "documents").select("doc_id"), 50, "doc_id")


@query("""SELECT p_partkey, '{"model":"m1","messages":[{"role":"user","content":"' || p_name || '"}],"request_id":"r' || CAST(p_partkey AS VARCHAR) || '"}' AS request FROM part""")
def llm_requests(spark, d):
    message = F.struct(F.lit("user").alias("role"), F.col("p_name").alias("content"))
    body = F.struct(F.lit("m1").alias("model"), F.array(message).alias("messages"), F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("request_id"))
    return read(spark, d, "part").select("p_partkey", F.to_json(body).alias("request"))


@query(f"SELECT pmid, journal_abbr FROM ({plain('art')}) a WHERE jcr = 'Q1' AND factor > 10 AND trim(abstract) <> ''")
def journal_filter(spark, d):
    return view(spark, d, "art").where("jcr = 'Q1' AND factor > 10 AND trim(abstract) <> ''").select("pmid", "journal_abbr")


@query(f"SELECT pmid, factor FROM ({plain('art')}) a ORDER BY factor DESC, pmid LIMIT 100")
def topn_by_score(spark, d):
    return view(spark, d, "art").select("pmid", "factor").orderBy(F.desc("factor"), "pmid").limit(100)


@query("SELECT min(d.doc_id) AS doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 AND length(d.text) >= 200 GROUP BY d.text")
def article_clean(spark, d):
    good = read(spark, d, "labels").where("quality = 1").select("doc_id")
    docs = read(spark, d, "documents").join(good, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text")
    return B.clean_articles(docs, 200).select(F.col("id").alias("doc_id"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def incremental_merge(spark, d):
    o = read(spark, d, "orders").select("o_orderkey")
    return B.merged(o.where("o_orderkey % 2 = 0").withColumn("origin", F.lit("old")), o.where("o_orderkey % 3 = 0").withColumn("origin", F.lit("new")), "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def resume_antijoin(spark, d):
    done = read(spark, d, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query(r"WITH p AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Pc}]+', '', 'g') AS f FROM documents), g AS (SELECT f, min(doc_id) AS first_id FROM p GROUP BY f) SELECT p.doc_id AS id, g.first_id FROM p JOIN g ON p.f = g.f WHERE p.doc_id <> g.first_id")
def fingerprint_match(spark, d):
    return B.same_fingerprint(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


_BARE = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH b AS (SELECT item_id, {_BARE.format('text')} AS t FROM benchmark), x AS (SELECT doc_id, {_BARE.format('text')} AS t FROM documents) SELECT b.item_id AS snippet_id, x.doc_id AS id FROM b JOIN x ON contains(' ' || x.t || ' ', ' ' || b.t || ' ') WHERE b.t <> ''")
def snippet_match(spark, d):
    return B.snippet_places(read(spark, d, "benchmark").select(F.col("item_id").alias("snippet_id"), "text"), read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


_EVID = "CASE WHEN doc_id % 2 = 0 THEN substring(text, 11, 40) ELSE substring(text, 11, 20) || ' nowhere zq' END"
_NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, contains({_NORM.format('text')}, {_NORM.format(_EVID)}) AS valid FROM documents")
def evidence_valid(spark, d):
    return read(spark, d, "documents").select("doc_id", T.evidence_in(F.expr(_EVID), F.col("text")).alias("valid"))


@query("SELECT doc_id, [s FOR s IN string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF contains(lower(s), 'the')][1] AS sentence FROM documents")
def first_sentence(spark, d):
    return read(spark, d, "documents").select("doc_id", T.first_sentence(F.col("text"), F.lit("the")).alias("sentence"))


_KEY = "regexp_replace(upper(trim({})), '[\\s_]+', '', 'g')"
_SEED_ROWS = "(VALUES " + ", ".join(f"('{s}')" for s in SEEDS) + ") s(seed)"


@query(f"SELECT DISTINCT n.entity_id, s.seed FROM ({plain('names')}) n JOIN {_SEED_ROWS} ON {_KEY.format('n.name')} = {_KEY.format('s.seed')}")
def seed_exact_match(spark, d):
    return B.matched_by_key(view(spark, d, "names"), spark.createDataFrame([(s,) for s in SEEDS], "seed string"))


_PATTERN_SQL = " UNION ALL ".join(f"SELECT entity_id, '{s}' AS seed FROM n WHERE regexp_matches(name, '{'|'.join(p)}', 'i')" for s, p in PATTERNS.items())


@query(f"WITH n AS ({plain('names')}) {_PATTERN_SQL}")
def seed_regex_match(spark, d):
    return B.matched_by_pattern(view(spark, d, "names"), PATTERNS)


@query(f"WITH n AS ({plain('names')}) SELECT seed, count(*) AS n FROM ({_PATTERN_SQL}) x GROUP BY seed")
def seed_summary(spark, d):
    return seed_regex_match(spark, d).groupBy("seed").agg(F.count("*").alias("n"))


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders GROUP BY 1")
def yearly_counts(spark, d):
    return read(spark, d, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("year")).agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_titles(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(f"SELECT lower(trim(name)) AS name, min(entity_id) AS entity_id, count(*) AS n, string_agg(DISTINCT type, ';' ORDER BY type) AS types FROM ({plain('names')}) n GROUP BY lower(trim(name))")
def merge_duplicates(spark, d):
    return B.merged_names(view(spark, d, "names"))


@query(f"SELECT entity_id, name FROM ({plain('names')}) n WHERE contains(lower(name), 'cold')")
def search_entities(spark, d):
    return view(spark, d, "names").where(F.lower("name").contains("cold")).select("entity_id", "name")


@query(f"SELECT type, count(*) AS n, count(DISTINCT name) AS n_names FROM ({plain('names')}) n GROUP BY type")
def entity_stats(spark, d):
    return view(spark, d, "names").groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"))


@query(f"SELECT {_id('name')} AS entity_id, min(trim(name)) AS name, count(*) AS n_rows FROM ({plain('names')}) n WHERE trim(name) <> '' GROUP BY 1")
def tbl_entity_catalog(spark, d):
    return B.catalog(view(spark, d, "names"))


@query(f"SELECT DISTINCT pmid, {_id('source_entity_name')} AS entity_id, source FROM ({plain('rel')}) v")
def tbl_entity_evidence(spark, d):
    return view(spark, d, "rel").select("pmid", T.entity_id(F.col("source_entity_name")).alias("entity_id"), "source").distinct()


@query(f"SELECT DISTINCT entity_id, entity_type, source FROM ({plain('etype')}) v")
def tbl_entity_types(spark, d):
    return view(spark, d, "etype").distinct()


_RELATION = f"'Relation-' || substring({_id('source_entity_name')}, 8) || '-' || substring({_id('target_entity_name')}, 8)"


def _relation_id():
    return T.relation_id(T.entity_id(F.col("source_entity_name")), T.entity_id(F.col("target_entity_name"))).alias("relation_id")


@query(f"SELECT {_RELATION} AS relation_id, relation_type, count(*) AS n FROM ({plain('rel')}) v GROUP BY 1, 2")
def tbl_relations(spark, d):
    return view(spark, d, "rel").groupBy(_relation_id(), "relation_type").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT {_RELATION} AS relation_id, pmid FROM ({plain('rel')}) v")
def tbl_relation_evidence(spark, d):
    return view(spark, d, "rel").select(_relation_id(), "pmid").distinct()


@query(f"SELECT DISTINCT {_RELATION} AS relation_id, relation_type, source FROM ({plain('rel')}) v")
def tbl_relation_types(spark, d):
    return view(spark, d, "rel").select(_relation_id(), "relation_type", "source").distinct()


@query(f"SELECT pmid, strftime(pub_date, '%Y-%m-%d') AS pub_date, factor, aging_prob FROM ({plain('art')}) a")
def tbl_articles(spark, d):
    return view(spark, d, "art").select("pmid", F.date_format("pub_date", "yyyy-MM-dd").alias("pub_date"), "factor", "aging_prob")


@query(f"SELECT DISTINCT entity_id, entity_type FROM ({plain('etype')}) v UNION SELECT entity_id, entity_type FROM ({plain('ctype')}) c")
def unified_nodes(spark, d):
    return view(spark, d, "etype").select("entity_id", "entity_type").union(view(spark, d, "ctype")).distinct()


@query(f"WITH v AS ({plain('rel')}), c AS ({plain('ctype')}) SELECT DISTINCT v.source_entity_id, v.target_entity_id, v.relation_type, a.entity_type AS source_type FROM v JOIN c a ON v.source_entity_id = a.entity_id")
def unified_rels(spark, d):
    types = view(spark, d, "ctype").select(F.col("entity_id").alias("source_entity_id"), F.col("entity_type").alias("source_type"))
    return view(spark, d, "rel").select("source_entity_id", "target_entity_id", "relation_type").distinct().join(types, "source_entity_id")


def _labelled(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs, read(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")).dropna()


@query()
def classifier_scores(spark, d):
    """The probability of each document by a classifier that is fitted on the labelled ones."""
    return C.scores(*_labelled(spark, d)).select("doc_id", vector_to_array("probability")[1].alias("score"))


@query()
def classifier_folds(spark, d):
    """(fold, auc) of five folds by the hash of doc_id, each scored by a classifier of the others."""
    docs, labels = _labelled(spark, d)
    return C.fold_scores(docs.join(labels, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(5))))


def _streamed(spark, d, name):
    batch = read(spark, d, name)
    return spark.readStream.schema(batch.schema).parquet(f"{d}/{name}*.parquet")


@query("SELECT least(l_suppkey, l_partkey) AS u, greatest(l_suppkey, l_partkey) AS v, count(*) AS count FROM lineitem GROUP BY 1, 2")
def stream_edges_equals_batch(spark, d):
    return S.drained(S.edge_counts(_streamed(spark, d, "lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"))))


@query("SELECT date_trunc('hour', ts) AS hour, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_events(spark, d):
    return S.drained(S.hourly(_streamed(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind")))).withColumn("hour", F.col("hour").cast("timestamp_ntz"))
