"""Queries over relations, entity types, articles and gold annotations, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.scoring import chart_relation_type, relation_type
from loomgraph.operators import edges as E
from loomgraph.operators import entities as N
from loomgraph.operators import evaluation as V
from loomgraph.operators import graph as G
from loomgraph.params import CHART_RELATION_TYPES, CLASSES, ENTITY_SOURCES, RELATION_SOURCES, RELATION_TYPES, SUBGRAPH_SOURCES, TYPE_PAIR_PRIOR, Aging, Selection, SourceWeights
from loomgraph.plans.views import plain, view
from loomgraph.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AGING = Aging(as_of="2000-01-01")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _rounded(df: DataFrame, *skip: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" and c not in skip else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def _sources(p: SourceWeights, of: str) -> str:
    """CTEs hit(source, k) and sw(source, w, n) for the sources of a CTE."""
    if p.after_colon:
        low = "split_part(lower(replace(trim(t), ' ', '')), '__', 1)"
        canon = f"trim(CASE WHEN contains({low}, ':') THEN regexp_replace({low}, '^[^:]*:', '') ELSE {low} END, '[]()')"
    else:
        canon = "trim(replace(split_part(lower(trim(t)), '__', 1), ' ', ''), '[]()')"
    alias = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in p.aliases.items())
    keys = ", ".join(f"('{k}', {p.weights[k]}, {i})" for i, k in enumerate(p.keys()))
    best = f"greatest({p.default}, coalesce(max(w), 0))" if p.floor else f"coalesce(max(w), {p.default})"
    return f"""src AS (SELECT DISTINCT source FROM {of}),
tok AS (SELECT source, {canon} AS t FROM (SELECT source, unnest(regexp_split_to_array(source, '[;,|]+')) AS t FROM src) x),
ali AS (SELECT source, CASE t {alias} ELSE t END AS t FROM tok WHERE t <> ''),
keys(k, w, o) AS (VALUES {keys}),
hit AS (SELECT DISTINCT source, k, w FROM (SELECT source, k, w, row_number() OVER (PARTITION BY source, t ORDER BY (t = k) DESC, o) AS r FROM ali JOIN keys ON contains(t, k)) x WHERE r = 1),
sw AS (SELECT src.source, CAST({best} AS DOUBLE) AS w, count(k) AS n FROM src LEFT JOIN hit ON src.source = hit.source GROUP BY src.source)"""


_CANON = "CASE " + " ".join(f"WHEN lower(trim(relation_type)) IN ({', '.join(repr(a) for a in names)}) THEN '{c}'" for c, names in RELATION_TYPES.items()) + " ELSE trim(relation_type) END"
_REL = f"""WITH v AS ({plain('rel')}),
e AS (SELECT least(source_entity_id, target_entity_id) AS u, greatest(source_entity_id, target_entity_id) AS v, {_CANON} AS label, relation_type AS raw, source FROM v WHERE source_entity_id <> target_entity_id),
{_sources(RELATION_SOURCES, 'v')}"""
_TOP = "SELECT u, v, label AS reltype_top FROM (SELECT u, v, label, row_number() OVER (PARTITION BY u, v ORDER BY count(*) DESC, label) AS r FROM e GROUP BY u, v, label) x WHERE r = 1"
_EDGES = f"""{_REL},
top AS ({_TOP}),
srcs AS (SELECT u, v, count(DISTINCT k) AS sources_unique FROM e JOIN hit ON e.source = hit.source GROUP BY u, v),
agg AS (SELECT u, v, count(*) AS count, sum(w) AS weight_sum, avg(w) AS weight_mean, max(w) AS weight_max, count(*) FILTER (WHERE n = 0) AS default_hits FROM e JOIN sw ON e.source = sw.source GROUP BY u, v)
SELECT agg.u, agg.v, count, round(weight_sum, 6) AS weight_sum, round(weight_mean, 6) AS weight_mean, round(weight_max, 6) AS weight_max, CAST(default_hits AS BIGINT) AS default_hits, default_hits > 0 AS any_default, coalesce(sources_unique, 0) AS sources_unique, reltype_top
FROM agg JOIN top ON agg.u = top.u AND agg.v = top.v LEFT JOIN srcs ON agg.u = srcs.u AND agg.v = srcs.v"""


@query(_EDGES)
def edges_weighted(spark, d):
    return _rounded(E.weighted_edges(view(spark, d, "rel")))


@query(f"SELECT * FROM ({_EDGES}) y WHERE count >= 3")
def edges_weighted_min_count(spark, d):
    return _rounded(E.weighted_edges(view(spark, d, "rel"), min_count=3))


@query(f"{_REL} SELECT u, v, rank, label, n FROM (SELECT u, v, label, count(*) AS n, row_number() OVER (PARTITION BY u, v ORDER BY count(*) DESC, label) AS rank FROM e GROUP BY u, v, label) x WHERE rank <= 6")
def edges_reltype_json(spark, d):
    return _rounded(E.relation_type_histogram(view(spark, d, "rel")))


@query(f"""{_REL}, h AS (SELECT u, v, label, count(*) AS n, row_number() OVER (PARTITION BY u, v ORDER BY count(*) DESC, label) AS k FROM e GROUP BY u, v, label)
SELECT u, v, '{{' || string_agg('"' || label || '":' || n, ',' ORDER BY k) || '}}' AS reltype_json FROM h WHERE k <= 5 GROUP BY u, v""")
def edges_type_json(spark, d):
    """The five most frequent types of each edge with their numbers, as a JSON object."""
    return E.type_json(E.relation_type_histogram(view(spark, d, "rel"), 5))


_COUNT = f"""{_REL},
lab AS (SELECT u, v, raw AS label, count(*) AS n FROM e GROUP BY u, v, raw),
ctop AS (SELECT u, v, label AS reltype_top FROM (SELECT u, v, label, row_number() OVER (PARTITION BY u, v ORDER BY n DESC, label) AS r FROM lab) x WHERE r = 1),
ce AS (SELECT l.u, l.v, CAST(sum(n) AS BIGINT) AS weight, min(reltype_top) AS reltype_top FROM lab l JOIN ctop ON l.u = ctop.u AND l.v = ctop.v GROUP BY l.u, l.v HAVING sum(n) >= 2),
ns AS (SELECT entity_id, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM (SELECT u AS entity_id, weight FROM ce UNION ALL SELECT v, weight FROM ce) x GROUP BY entity_id),
mm AS (SELECT min(degree) AS d0, max(degree) AS d1, min(strength) AS s0, max(strength) AS s1 FROM ns),
sc AS (SELECT entity_id, degree, strength, CASE WHEN d1 > d0 THEN (degree - d0) * 1.0 / (d1 - d0) ELSE 0 END AS degree_norm, CASE WHEN s1 > s0 THEN (strength - s0) * 1.0 / (s1 - s0) ELSE 0 END AS strength_norm FROM ns, mm),
scored AS (SELECT *, CAST(0.6 AS DOUBLE) * degree_norm + CAST(1 - CAST(0.6 AS DOUBLE) AS DOUBLE) * strength_norm AS score FROM sc),
best AS (SELECT * FROM scored ORDER BY score DESC, entity_id LIMIT 200),
sub AS (SELECT ce.* FROM ce WHERE u IN (SELECT entity_id FROM best) AND v IN (SELECT entity_id FROM best) ORDER BY weight DESC, u, v LIMIT 5000)"""


@query(f"{_COUNT} SELECT * FROM ce")
def edges_count_graph(spark, d):
    return E.count_edges(view(spark, d, "rel"))


@query(f"{_REL} SELECT source_key, count(*) AS n_rows FROM (SELECT coalesce(hit.k, '__DEFAULT__') AS source_key FROM e LEFT JOIN hit ON e.source = hit.source) x GROUP BY source_key")
def rel_source_coverage(spark, d):
    return E.source_coverage(view(spark, d, "rel"))


@query(f"{_REL} SELECT label AS relation_type, count(*) AS n_rows FROM e GROUP BY label")
def reltype_coverage(spark, d):
    return E.type_coverage(view(spark, d, "rel"))


@query(f"""WITH v AS ({plain('rel')}), n AS (SELECT source_entity_id AS entity_id, source_entity_name AS name FROM v UNION ALL SELECT target_entity_id, target_entity_name FROM v)
SELECT entity_id, name AS best_name FROM (SELECT entity_id, name, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, name) AS r FROM n GROUP BY entity_id, name) x WHERE r = 1""")
def id_best_name(spark, d):
    return E.best_names(view(spark, d, "rel"))


_W = f"""WITH v AS ({plain('etype')}),
{_sources(ENTITY_SOURCES, 'v')},
srcs AS (SELECT entity_id, entity_type, count(DISTINCT k) AS sources_unique FROM v JOIN hit ON v.source = hit.source GROUP BY entity_id, entity_type),
agg AS (SELECT entity_id, entity_type, count(*) AS evidence_count, sum(w) AS weight_sum, avg(w) AS weight_mean, max(w) AS weight_max, CAST(count(*) FILTER (WHERE n = 0) AS BIGINT) AS default_hits FROM v JOIN sw ON v.source = sw.source GROUP BY entity_id, entity_type),
tw AS (SELECT agg.entity_id, agg.entity_type, evidence_count, coalesce(sources_unique, 0) AS sources_unique, weight_sum, weight_mean, weight_max, default_hits, default_hits > 0 AS any_default,
  sum(weight_sum) OVER (PARTITION BY agg.entity_id) AS weight_total_entity, weight_sum / sum(weight_sum) OVER (PARTITION BY agg.entity_id) AS weight_norm,
  row_number() OVER (PARTITION BY agg.entity_id ORDER BY round(weight_sum, 9) DESC, agg.entity_type) AS rank_in_entity
  FROM agg LEFT JOIN srcs ON agg.entity_id = srcs.entity_id AND agg.entity_type = srcs.entity_type)"""
_WCOLS = "entity_id, entity_type, evidence_count, sources_unique, round(weight_sum, 6) AS weight_sum, round(weight_mean, 6) AS weight_mean, round(weight_max, 6) AS weight_max, default_hits, any_default, round(weight_total_entity, 6) AS weight_total_entity, round(weight_norm, 10) AS weight_norm, rank_in_entity"


@query(f"{_W} SELECT {_WCOLS} FROM tw")
def entity_type_weights(spark, d):
    out = N.type_weights(view(spark, d, "etype"))
    return _rounded(out.withColumn("weight_norm", F.round("weight_norm", 10)), "weight_norm")


@query(f"{_W} SELECT entity_id, entity_type, rank_in_entity FROM tw WHERE rank_in_entity <= 2")
def entity_type_topk(spark, d):
    return N.type_weights(view(spark, d, "etype")).where("rank_in_entity <= 2").select("entity_id", "entity_type", F.col("rank_in_entity").cast("bigint").alias("rank_in_entity"))


@query(f"""{_W} SELECT hit.k AS source_key, count(*) AS n_rows, round(avg(sw.w), 6) AS mean_weight, CAST(max(keys.w) AS DOUBLE) AS key_weight
FROM v JOIN sw ON v.source = sw.source LEFT JOIN hit ON v.source = hit.source LEFT JOIN keys ON keys.k = hit.k GROUP BY hit.k""")
def entity_source_coverage(spark, d):
    return _rounded(N.source_coverage(view(spark, d, "etype")))


@query(f"{_W} SELECT entity_id, entity_type, round(weight_norm, 6) AS weight_norm FROM tw WHERE rank_in_entity = 1 AND weight_norm >= 0.6 AND evidence_count >= 2 AND sources_unique >= 1")
def select_high_confidence(spark, d):
    return _rounded(N.select_entities(N.type_weights(view(spark, d, "etype"))).select("entity_id", "entity_type", "weight_norm"))


@query(f"""{_W}, p AS (SELECT * FROM tw WHERE rank_in_entity = 1), q AS (SELECT entity_type, quantile_cont(weight_norm, 0.85) AS edge FROM p GROUP BY entity_type)
SELECT p.entity_id, p.entity_type, round(weight_norm, 6) AS weight_norm FROM p JOIN q ON p.entity_type = q.entity_type WHERE weight_norm >= edge - 1e-12 AND evidence_count >= 2 AND sources_unique >= 1""")
def select_high_confidence_quantile(spark, d):
    return _rounded(N.select_entities(N.type_weights(view(spark, d, "etype")), s=Selection(min_weight_norm=None)).select("entity_id", "entity_type", "weight_norm"))


@query(f"""{_W} SELECT tw.entity_id, tw.entity_type, n.name FROM tw JOIN ({plain('names')}) n ON tw.entity_id = n.entity_id
WHERE rank_in_entity = 1 AND weight_norm >= 0.6 AND evidence_count >= 2 AND sources_unique >= 2 AND length(n.name) BETWEEN 2 AND 60""")
def entity_pool(spark, d):
    return N.entity_pool(N.type_weights(view(spark, d, "etype")), view(spark, d, "names")).select("entity_id", "entity_type", "name")


@query(f"{_COUNT} SELECT * FROM ns")
def node_stats(spark, d):
    return E.node_stats(E.count_edges(view(spark, d, "rel")))


@query(f"{_COUNT} SELECT entity_id, degree, strength, round(degree_norm, 6) AS degree_norm, round(strength_norm, 6) AS strength_norm, round(score, 6) AS score FROM scored")
def node_scores(spark, d):
    return _rounded(E.node_scores(E.node_stats(E.count_edges(view(spark, d, "rel")))))


@query(f"{_COUNT} SELECT * FROM sub")
def top_subgraph_edges(spark, d):
    return E.top_subgraph(E.count_edges(view(spark, d, "rel")))[1]


@query(f"""{_COUNT}, ds AS (SELECT entity_id, count(*) AS degree_sub, sum(weight) AS strength_sub FROM (SELECT u AS entity_id, weight FROM sub UNION ALL SELECT v, weight FROM sub) x GROUP BY entity_id)
SELECT best.entity_id, degree, strength, CAST(coalesce(degree_sub, 0) AS BIGINT) AS degree_sub, CAST(coalesce(strength_sub, 0) AS BIGINT) AS strength_sub FROM best LEFT JOIN ds ON best.entity_id = ds.entity_id""")
def top_subgraph_nodes(spark, d):
    return E.top_subgraph(E.count_edges(view(spark, d, "rel")))[0].select("entity_id", "degree", "strength", "degree_sub", "strength_sub")


_SEED = f"""WITH v AS ({plain('rel')}), seeds AS ({plain('seeds')}),
{_sources(SUBGRAPH_SOURCES, 'v')},
sr AS (SELECT CASE WHEN source_entity_id IN (SELECT entity_id FROM seeds) THEN source_entity_id ELSE target_entity_id END AS seed, CASE WHEN source_entity_id IN (SELECT entity_id FROM seeds) THEN target_entity_id ELSE source_entity_id END AS neighbour, w
  FROM v JOIN sw ON v.source = sw.source WHERE source_entity_id IN (SELECT entity_id FROM seeds) OR target_entity_id IN (SELECT entity_id FROM seeds)),
sn AS (SELECT seed, neighbour, count(*) AS count, sum(w) AS weight_sum, avg(w) AS weight_mean, max(w) AS weight_max, row_number() OVER (PARTITION BY seed ORDER BY round(sum(w), 9) DESC, count(*) DESC, neighbour) AS r FROM sr GROUP BY seed, neighbour),
near AS (SELECT * FROM sn WHERE r <= 25),
pick AS (SELECT neighbour FROM near GROUP BY neighbour ORDER BY round(sum(weight_sum), 9) DESC, neighbour LIMIT 300),
nodes AS (SELECT entity_id FROM seeds UNION SELECT neighbour FROM pick),
e AS (SELECT least(source_entity_id, target_entity_id) AS u, greatest(source_entity_id, target_entity_id) AS v, {_CANON} AS label, w FROM v JOIN sw ON v.source = sw.source WHERE source_entity_id <> target_entity_id AND source_entity_id IN (SELECT entity_id FROM nodes) AND target_entity_id IN (SELECT entity_id FROM nodes)),
top AS ({_TOP}),
ce AS (SELECT e.u, e.v, count(*) AS count, sum(w) AS weight_sum, avg(w) AS weight_mean, max(w) AS weight_max, min(reltype_top) AS reltype_top FROM e JOIN top ON e.u = top.u AND e.v = top.v GROUP BY e.u, e.v),
cap AS (SELECT quantile_cont(weight_sum, 0.99) AS cap FROM ce),
cc AS (SELECT ce.*, least(weight_sum, cap) AS capped FROM ce, cap),
mm AS (SELECT min(weight_sum) AS a0, max(weight_sum) AS a1, min(capped) AS c0, max(capped) AS c1 FROM cc),
conf AS (SELECT u, v, count, weight_sum, weight_mean, weight_max, reltype_top, weight_sum AS confidence, CASE WHEN a1 > a0 THEN (weight_sum - a0) / (a1 - a0) ELSE 0 END AS conf_norm_mm, CASE WHEN c1 > c0 THEN (capped - c0) / (c1 - c0) ELSE 0 END AS conf_norm_q FROM cc, mm)"""


@query(f"{_SEED} SELECT seed, neighbour, count, round(weight_sum, 6) AS weight_sum, round(weight_mean, 6) AS weight_mean, round(weight_max, 6) AS weight_max FROM near")
def seed_neighbors_topk(spark, d):
    return _rounded(G.seed_neighbours(view(spark, d, "rel"), view(spark, d, "seeds")))


def _nodes(spark, d):
    return G.seeded_subgraph(view(spark, d, "rel"), view(spark, d, "seeds"), view(spark, d, "ctype"))


@query(f"{_SEED} SELECT u, v, count, round(weight_sum, 6) AS weight_sum, round(weight_mean, 6) AS weight_mean, round(weight_max, 6) AS weight_max, reltype_top, round(confidence, 6) AS confidence, round(conf_norm_mm, 6) AS conf_norm_mm, round(conf_norm_q, 6) AS conf_norm_q FROM conf")
def seeded_edges_confidence(spark, d):
    return _rounded(G.confidence_edges(view(spark, d, "rel"), _nodes(spark, d)[0]))


_PRIOR = " ".join(f"WHEN a = '{x}' AND b = '{y}' THEN {w}" for (s, t), w in TYPE_PAIR_PRIOR.items() for x, y in ((s, t), (t, s)))


@query(f"""{_SEED}, ty AS ({plain('ctype')}),
f AS (SELECT u, v, reltype_top, conf_norm_q * CASE WHEN a = b THEN 0.7 {_PRIOR} ELSE 0.6 END AS w_final FROM (SELECT conf.*, coalesce(x.entity_type, 'Other') AS a, coalesce(y.entity_type, 'Other') AS b FROM conf LEFT JOIN ty x ON x.entity_id = u LEFT JOIN ty y ON y.entity_id = v
  WHERE reltype_top IN ('Causal', 'Regulatory', 'Interaction & Feedback', 'Association', '')) z),
q AS (SELECT quantile_cont(w_final, 0.2) AS edge FROM f)
SELECT u, v, round(w_final, 6) AS w_final, reltype_top FROM f, q WHERE w_final >= edge - 1e-12""")
def seeded_edges_final(spark, d):
    return _rounded(_nodes(spark, d)[1])


@query(f"""{_SEED}, ends AS (SELECT entity_id, count(*) AS n, sum(confidence) AS s FROM (SELECT u AS entity_id, confidence FROM conf UNION ALL SELECT v, confidence FROM conf) x GROUP BY entity_id)
SELECT nodes.entity_id, CASE WHEN nodes.entity_id IN (SELECT entity_id FROM seeds) THEN 'seed' ELSE 'neighbor' END AS role, CAST(coalesce(n, 0) AS BIGINT) AS degree_sub, round(coalesce(s, 0), 6) AS strength_sub
FROM nodes LEFT JOIN ends ON nodes.entity_id = ends.entity_id""")
def seeded_nodes(spark, d):
    return _rounded(_nodes(spark, d)[0])


@query("""WITH RECURSIVE ne AS (""" + plain("nation_edges") + """), seeds AS (""" + plain("seeds_aging") + """),
e AS (SELECT u AS src, v AS dst, w FROM ne UNION ALL SELECT v, u, w FROM ne), o AS (SELECT src, sum(w) AS total FROM e GROUP BY src),
a AS (SELECT e.src, e.dst, e.w / o.total AS share FROM e JOIN o ON e.src = o.src),
sd AS (SELECT entity_id AS id FROM seeds WHERE entity_id IN (SELECT src FROM o)),
base AS (SELECT src AS id, CASE WHEN src IN (SELECT id FROM sd) THEN 1.0 / (SELECT count(*) FROM sd) ELSE 0.0 END AS restart FROM o),
r AS (SELECT 0 AS step, (SELECT list({'id': id, 'p': CAST(1.0 / (SELECT count(*) FROM base) AS DOUBLE)}) FROM base) AS ranks
  UNION ALL
  SELECT step + 1, (SELECT list({'id': b.id, 'p': CAST(0.85 * coalesce(f.flow, 0) + 0.15 * b.restart AS DOUBLE)}) FROM base b LEFT JOIN (SELECT a.dst, sum(x.p * a.share) AS flow FROM (SELECT unnest(ranks, recursive := true)) x(id, p) JOIN a ON a.src = x.id GROUP BY a.dst) f ON f.dst = b.id)
  FROM r WHERE step < 100)
SELECT id AS entity_id, round(p, 6) AS ppr FROM (SELECT unnest(ranks, recursive := true) FROM r WHERE step = 100) y(id, p)""")
def ppr_scores(spark, d):
    edges = written(view(spark, d, "nation_edges"))
    nodes = edges.select(F.explode(F.array("u", "v")).alias("entity_id")).distinct()
    return _rounded(G.pagerank(edges, nodes, view(spark, d, "seeds_aging")))


_NATION = f"WITH ne AS ({plain('nation_edges')}), seeds AS ({plain('seeds_aging')}), b AS (SELECT u AS src, v AS dst, w FROM ne UNION ALL SELECT v, u, w FROM ne)"


@query(f"{_NATION} SELECT src AS entity_id, round(sum(w), 6) AS local FROM b WHERE dst IN (SELECT entity_id FROM seeds) GROUP BY src")
def one_hop_seed_weight(spark, d):
    return _rounded(G.local_weight(view(spark, d, "nation_edges"), view(spark, d, "seeds_aging")))


@query(f"""{_NATION} SELECT src AS entity_id, string_agg(dst || ':' || printf('%.3f', w), ';' ORDER BY w DESC, dst) AS explain
FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM b WHERE dst IN (SELECT entity_id FROM seeds)) x WHERE r <= 6 GROUP BY src""")
def top_seed_neighbors(spark, d):
    return G.top_seed_neighbours(view(spark, d, "nation_edges"), view(spark, d, "seeds_aging"))


_QUALITY = f"""{_W}, p AS (SELECT *, (0.35 * ln(1 + evidence_count) + 0.25 * ln(1 + sources_unique) + 0.25 * ln(1 + weight_sum) + 0.10 * ln(1 + weight_max) + 0.05 * ln(1 + weight_mean) + 0.10 * ln(1 + default_hits)) / 1.1 AS raw FROM tw WHERE rank_in_entity = 1),
m AS (SELECT min(raw) AS a, max(raw) AS b FROM p)"""


@query(f"{_QUALITY} SELECT entity_id, entity_type, round(CASE WHEN b > a THEN (raw - a) / (b - a) ELSE 0 END, 6) AS quality_norm FROM p, m")
def quality_table(spark, d):
    return _rounded(N.quality(N.type_weights(view(spark, d, "etype"))))


@query()
def bridge_candidates(spark, d):
    edges = written(view(spark, d, "nation_edges"))
    nodes = E.node_stats(edges, "w").select("entity_id", F.col("degree").alias("degree_sub"), F.col("strength").alias("strength_sub"))
    types = view(spark, d, "etype").withColumn("entity_id", F.concat(F.lit("N"), F.pmod(F.substring("entity_id", 2, 20).cast("int"), F.lit(25)).cast("string")))
    scored = G.bridge_candidates(edges, nodes, N.type_weights(types), view(spark, d, "seeds_aging"), view(spark, d, "seeds_longevity"))
    return _rounded(G.candidates(scored, "B_total"))


@query()
def connected_components(spark, d):
    """Over all relations; a recursive SQL of it is too slow, so tests/test_graph.py compares with brute force."""
    return G.connected_components(view(spark, d, "rel").select(F.col("source_entity_id").alias("u"), F.col("target_entity_id").alias("v")))


_AGING = f"""WITH art AS ({plain('art')}), evid AS ({plain('evid')}), m AS (SELECT min(ln(1 + factor)) AS a, max(ln(1 + factor)) AS b FROM art),
sc AS (SELECT pmid, aging_prob AS prob, aging_prob * (1 + CASE WHEN b > a THEN (ln(1 + factor) - a) / (b - a) ELSE 0 END) * CASE WHEN date_diff('day', pub_date, DATE '2000-01-01') > 0 THEN pow(0.5, date_diff('day', pub_date, DATE '2000-01-01') / 365.25 / 6.0) ELSE 1 END AS row_score FROM art, m),
pr AS (SELECT DISTINCT entity_id, pmid FROM evid), j AS (SELECT pr.entity_id, sc.* FROM pr JOIN sc ON pr.pmid = sc.pmid)"""


@query(f"""{_AGING}, g AS (SELECT entity_id, count(*) AS n_pmids_total, avg(prob) AS mean_prob, sum(prob) AS sum_prob, sum(row_score) AS score_sum, count(*) FILTER (WHERE prob >= 0.7) AS n_high FROM j GROUP BY entity_id), x AS (SELECT min(score_sum) AS a, max(score_sum) AS b FROM g)
SELECT entity_id, n_pmids_total, round(mean_prob, 10) AS mean_prob, round(round(sum_prob, 9), 5) AS sum_prob, round(round(score_sum, 9), 5) AS score_sum, CAST(n_high AS BIGINT) AS n_high, round(round((score_sum - a) / (b - a), 9), 5) AS aging_score FROM g, x""")
def aging_rank(spark, d):
    out = N.aging_rank(view(spark, d, "art"), view(spark, d, "evid"), AGING)
    return out.select(*((F.round(c, 10) if c == "mean_prob" else F.round(F.round(c, 9), 5)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query(f"{_AGING} SELECT entity_id, rank, pmid, round(row_score, 5) AS row_score FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY round(row_score, 9) DESC, pmid) AS rank FROM j) x WHERE rank <= 3")
def aging_top_articles(spark, d):
    out = N.top_articles(view(spark, d, "art"), view(spark, d, "evid"), AGING)
    return out.select("entity_id", F.col("rank").cast("bigint").alias("rank"), "pmid", F.round("row_score", 5).alias("row_score"))


_EV = f"""WITH g0 AS ({plain('gold')}), p0 AS ({plain('pred')}), both_ids AS (SELECT pmid FROM g0 INTERSECT SELECT pmid FROM p0),
g AS (SELECT DISTINCT pmid, ent FROM g0 WHERE pmid IN (SELECT pmid FROM both_ids)), p AS (SELECT DISTINCT pmid, ent FROM p0 WHERE pmid IN (SELECT pmid FROM both_ids)),
f AS (SELECT coalesce(g.pmid, p.pmid) AS pmid, g.ent AS ge, p.ent AS pe FROM g FULL JOIN p ON g.pmid = p.pmid AND g.ent = p.ent),
st AS (SELECT pmid, count(*) FILTER (WHERE ge IS NOT NULL AND pe IS NOT NULL) AS tp, count(*) FILTER (WHERE ge IS NULL) AS fp, count(*) FILTER (WHERE pe IS NULL) AS fn FROM f GROUP BY pmid),
ln AS (SELECT a.pmid, a.ge, min(b.pe) AS pe FROM (SELECT pmid, ge FROM f WHERE pe IS NULL) a JOIN (SELECT pmid, pe FROM f WHERE ge IS NULL) b ON a.pmid = b.pmid AND (contains(a.ge, b.pe) OR contains(b.pe, a.ge)) GROUP BY a.pmid, a.ge),
lm AS (SELECT pmid, count(*) AS mg, count(DISTINCT pe) AS mp FROM ln GROUP BY pmid),
le AS (SELECT st.pmid, tp + coalesce(mg, 0) + coalesce(mp, 0) AS tp, fp - coalesce(mp, 0) AS fp, fn - coalesce(mg, 0) AS fn FROM st LEFT JOIN lm ON st.pmid = lm.pmid)"""


def _prf(of: str) -> str:
    p, r = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END"
    return f"(SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM (SELECT *, {p} AS pr, {r} AS re FROM {of}) x1)"


_PRF_COLS = "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CAST(pr AS DOUBLE), 6) AS precision, round(CAST(re AS DOUBLE), 6) AS recall, round(CAST(f1 AS DOUBLE), 6) AS f1"


@query(f"{_EV} SELECT pmid, {_PRF_COLS} FROM {_prf('st')} y")
def prf_strict(spark, d):
    return _pmid_int(V.with_scores(V.strict_counts(view(spark, d, "gold"), view(spark, d, "pred"), ["ent"])))


def _pmid_int(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"{_EV} SELECT pmid, {_PRF_COLS} FROM {_prf('le')} y")
def prf_lenient_reference(spark, d):
    return _pmid_int(V.with_scores(V.lenient_counts(view(spark, d, "gold"), view(spark, d, "pred"))))


@query(f"{_EV} SELECT pmid, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM (SELECT st.pmid, tp + coalesce(mp, 0) AS tp, fp - coalesce(mp, 0) AS fp, fn - coalesce(mg, 0) AS fn FROM st LEFT JOIN lm ON st.pmid = lm.pmid) z")
def prf_lenient_one_to_one(spark, d):
    return V.lenient_counts(view(spark, d, "gold"), view(spark, d, "pred"), one_to_one=True)


@query(f"""{_EV}, lab AS (SELECT coalesce(g.label, p.label) AS label, count(*) FILTER (WHERE g.ent IS NOT NULL AND p.ent IS NOT NULL) AS tp, count(*) FILTER (WHERE g.ent IS NULL) AS fp, count(*) FILTER (WHERE p.ent IS NULL) AS fn
FROM (SELECT DISTINCT * FROM g0 WHERE pmid IN (SELECT pmid FROM both_ids)) g FULL JOIN (SELECT DISTINCT * FROM p0 WHERE pmid IN (SELECT pmid FROM both_ids)) p ON g.pmid = p.pmid AND g.ent = p.ent AND g.label = p.label GROUP BY 1)
SELECT label, {_PRF_COLS} FROM {_prf('lab')} y""")
def prf_by_label(spark, d):
    return _pmid_int(V.by_label(view(spark, d, "gold"), view(spark, d, "pred")))


@query(f"""{_EV}, s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM st), mac AS (SELECT avg(pr) AS a, avg(re) AS b, avg(f1) AS c FROM {_prf('st')} y)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CAST(pr AS DOUBLE), 6) AS micro_precision, round(CAST(re AS DOUBLE), 6) AS micro_recall, round(CAST(f1 AS DOUBLE), 6) AS micro_f1, round(a, 6) AS macro_precision, round(b, 6) AS macro_recall, round(c, 6) AS macro_f1 FROM {_prf('s')} y, mac""")
def prf_micro_macro(spark, d):
    return _pmid_int(V.micro_macro(V.strict_counts(view(spark, d, "gold"), view(spark, d, "pred"), ["ent"])))


@query(f"{_EV} SELECT pmid, ge AS ent FROM f WHERE pe IS NULL")
def fn_detail(spark, d):
    return V.misses(view(spark, d, "gold"), view(spark, d, "pred"), ["ent"])


@query(f"{_EV} SELECT pmid, pe AS ent FROM f WHERE ge IS NULL")
def fp_detail(spark, d):
    return V.misses(view(spark, d, "pred"), view(spark, d, "gold"), ["ent"])


@query(f"""WITH v AS ({plain('rel')}), t AS ({plain('ctype')}) SELECT a.entity_type AS source_type, """ + ", ".join(f"count(*) FILTER (WHERE b.entity_type = '{c}') AS {c}" for c in CLASSES) + """ FROM v JOIN t a ON v.source_entity_id = a.entity_id JOIN t b ON v.target_entity_id = b.entity_id GROUP BY a.entity_type""")
def class_matrix(spark, d):
    return V.class_matrix(view(spark, d, "rel"), view(spark, d, "ctype"), CLASSES)


@query(f"SELECT entity_type, count(*) AS n FROM ({plain('etype')}) v GROUP BY entity_type")
def entity_type_counts(spark, d):
    return view(spark, d, "etype").where(F.col("entity_type").isin(CLASSES)).groupBy("entity_type").agg(F.count("*").alias("n"))


@query(f"{_REL} SELECT k AS relation_type, count(label) AS n, round(100.0 * count(label) / (SELECT count(*) FROM e), 6) AS pct FROM (VALUES " + ", ".join(f"('{c}')" for c in [*RELATION_TYPES, "Unknown"]) + f") c(k) LEFT JOIN (SELECT CASE WHEN label IN ({', '.join(repr(c) for c in RELATION_TYPES)}) THEN label ELSE 'Unknown' END AS label FROM e) l ON l.label = c.k GROUP BY k")
def relation_type_pct(spark, d):
    known = list(RELATION_TYPES)
    label = relation_type(F.col("relation_type"))
    counts = E.undirected(view(spark, d, "rel")).groupBy(F.when(label.isin(known), label).otherwise("Unknown").alias("relation_type")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    every = spark.createDataFrame([(c,) for c in [*known, "Unknown"]], "relation_type string")
    out = every.join(counts, "relation_type", "left").na.fill(0, ["n"]).crossJoin(F.broadcast(total))  # one row
    return out.select("relation_type", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct"))


_GRAPH = f"WITH v AS ({plain('rel')}), n AS (SELECT entity_id FROM ({plain('ctype')}) t WHERE entity_id NOT LIKE '%7')"


@query(f"{_GRAPH}, x AS (SELECT source_entity_id, target_entity_id, source_entity_id NOT IN (SELECT entity_id FROM n) AS source_missing, target_entity_id NOT IN (SELECT entity_id FROM n) AS target_missing FROM v) SELECT source_missing, target_missing, count(*) AS n_relations FROM x WHERE source_missing OR target_missing GROUP BY 1, 2")
def graph_dangling(spark, d):
    nodes = view(spark, d, "ctype").where("entity_id NOT LIKE '%7'")
    return E.dangling(view(spark, d, "rel"), nodes).groupBy("source_missing", "target_missing").agg(F.count("*").alias("n_relations"))


@query(f"{_GRAPH} SELECT source_entity_id, target_entity_id, relation_type, source, pmid FROM v WHERE source_entity_id IN (SELECT entity_id FROM n) AND target_entity_id IN (SELECT entity_id FROM n)")
def graph_clean(spark, d):
    nodes = view(spark, d, "ctype").where("entity_id NOT LIKE '%7'")
    return E.without_dangling(view(spark, d, "rel"), nodes).select("source_entity_id", "target_entity_id", "relation_type", "source", "pmid")


@query(f"{_NATION} SELECT c.entity_id AS candidate, s.entity_id AS seed, round(coalesce(max(b.w), 0), 6) AS w FROM (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS entity_id FROM nation) c CROSS JOIN seeds s LEFT JOIN b ON b.src = c.entity_id AND b.dst = s.entity_id GROUP BY 1, 2")
def heatmap_cells(spark, d):
    nodes = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("entity_id"))
    return _rounded(G.seed_grid(view(spark, d, "nation_edges"), nodes, view(spark, d, "seeds_aging")))


_CHART = ", ".join(f"({k}, '{a}', '{c}')" for k, (c, a) in enumerate((c, a) for c, names in CHART_RELATION_TYPES.items() for a in names))


@query(f"""WITH m AS (SELECT a, arg_max(c, k) AS c FROM (VALUES {_CHART}) t(k, a, c) GROUP BY a), v AS ({plain('rel')})
SELECT coalesce(m.c, 'Unknown') AS relation_type, count(*) AS n FROM (SELECT CASE WHEN source_entity_id LIKE '%5' THEN 'Evidence-based' WHEN source_entity_id LIKE '%6' THEN upper(relation_type) ELSE ' ' || relation_type END AS t FROM v) x LEFT JOIN m ON m.a = trim(t) GROUP BY 1""")
def chart_relation_types(spark, d):
    said = F.expr("CASE WHEN source_entity_id LIKE '%5' THEN 'Evidence-based' WHEN source_entity_id LIKE '%6' THEN upper(relation_type) ELSE ' ' || relation_type END")
    return view(spark, d, "rel").groupBy(chart_relation_type(said).alias("relation_type")).agg(F.count("*").alias("n"))


@query(f"""WITH x AS (SELECT entity_id, CAST(sum(w) AS DOUBLE) AS s FROM (SELECT u AS entity_id, w FROM ({plain('nation_edges')}) a UNION ALL SELECT v, w FROM ({plain('nation_edges')}) b) e GROUP BY entity_id)
SELECT entity_id, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 9) AS importance FROM x""")
def node_importance(spark, d):
    return E.importance(view(spark, d, "nation_edges"), "w").select("entity_id", F.round("importance", 9).alias("importance"))
