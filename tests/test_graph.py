"""Iterative graph operators against brute force, where SQL has no equivalent."""

import random

import numpy as np

from loomgraph.operators import graph as G
from loomgraph.operators.edges import node_stats


def random_edges(n, m, seed):
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}
    return [(f"N{a:02d}", f"N{b:02d}", float(r.randrange(1, 9))) for a, b in sorted(pairs)]


def ranks(edges, nodes, seeds):
    """Power iteration on a dense matrix until nothing moves."""
    at = {x: i for i, x in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for u, v, x in edges:
        w[at[u], at[v]] += x
        w[at[v], at[u]] += x
    total = w.sum(axis=1)
    restart = np.array([1.0 if x in seeds else 0.0 for x in nodes])
    restart /= max(1, restart.sum())
    p = np.full(len(nodes), 1 / len(nodes))
    for _ in range(500):
        flow = (p[total > 0, None] * w[total > 0] / total[total > 0, None]).sum(axis=0)
        p = 0.85 * (flow + p[total == 0].sum() * restart) + 0.15 * restart
    return dict(zip(nodes, p, strict=True)), w


def scaled(x):
    span = max(x.values()) - min(x.values())
    return {k: (v - min(x.values())) / span if span else 0.0 for k, v in x.items()}


def test_components_equal_union_find(spark):
    edges = random_edges(300, 190, 4) + [("Z1", "Z1", 1.0)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for u, v, _ in edges[:-1]:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    got = {r.entity_id: r.component for r in G.connected_components(spark.createDataFrame(edges, "u string, v string, w double")).collect()}
    assert got == {x: root(x) for x in parent} and len(set(got.values())) > 5
    assert G.connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_pagerank_equals_a_dense_iteration(spark):
    edges = random_edges(20, 40, 5)
    nodes = sorted({x for u, v, _ in edges for x in (u, v)}) + ["alone"]
    df = spark.createDataFrame(edges, "u string, v string, w double")
    ids = spark.createDataFrame([(x,) for x in nodes], "entity_id string")
    seeds = spark.createDataFrame([("N01",), ("N07",), ("missing",)], "entity_id string")
    got = {r.entity_id: r.ppr for r in G.pagerank(df, ids, seeds).collect()}
    want, _ = ranks(edges, nodes, {"N01", "N07"})
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in nodes)
    assert {r.ppr for r in G.pagerank(df, ids, seeds.where("entity_id = 'missing'")).collect()} == {0.0}


def test_bridge_candidates_equal_their_formulas(spark):
    edges = random_edges(12, 26, 6)
    nodes = sorted({x for u, v, _ in edges for x in (u, v)})
    df = spark.createDataFrame(edges, "u string, v string, w double")
    stats = node_stats(df, "w").selectExpr("entity_id", "degree AS degree_sub", "strength AS strength_sub")
    weights = spark.createDataFrame([], "entity_id string, entity_type string, weight_sum double, evidence_count long")
    axes = {"A": ["N01", "N03"], "L": ["N05"]}
    seeds = {k: spark.createDataFrame([(x,) for x in v], "entity_id string") for k, v in axes.items()}
    got = {r.entity_id: r for r in G.bridge_candidates(df, stats, weights, seeds["A"], seeds["L"]).collect()}
    score = {}
    for axis, ids in axes.items():
        p, w = ranks(edges, nodes, set(ids))
        local = {x: w[i, [nodes.index(s) for s in ids]].sum() for i, x in enumerate(nodes)}
        p, local = scaled(p), scaled(local)
        score[axis] = scaled({x: 0.6 * p[x] + 0.4 * local[x] for x in nodes})
    _, w = ranks(edges, nodes, set())
    deg, strength = scaled({x: int((w[i] > 0).sum()) for i, x in enumerate(nodes)}), scaled({x: w[i].sum() for i, x in enumerate(nodes)})
    for x in nodes:
        a, b = score["A"][x], score["L"][x]
        bridge = 2 * a * b / (a + b + 1e-12)
        assert abs(got[x].A_score - a) < 1e-5 and abs(got[x].L_score - b) < 1e-5 and abs(got[x].bridge_score - bridge) < 1e-5
        assert abs(got[x].B_total - (0.6 * bridge + 0.15 * strength[x] + 0.15 * deg[x])) < 1e-5
        assert abs(got[x].A_total - (0.55 * a + 0.15 * strength[x] + 0.10 * deg[x])) < 1e-5
        assert got[x].is_seed == (x in ("N01", "N03", "N05"))
    best = [r.entity_id for r in G.candidates(G.bridge_candidates(df, stats, weights, seeds["A"], seeds["L"]), "B_total", 3).collect()]
    assert len(best) == 3 and not {"N01", "N03", "N05"} & set(best)


def test_giant_component_keeps_the_edges_of_the_largest_part(spark):
    edges = random_edges(60, 35, 9)
    near = {}
    for u, v, _ in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    parts, seen = [], set()
    for x in sorted(near):
        part, todo = set(), [x]
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                part.add(y)
                todo += near[y]
        if part:
            parts.append(part)
    largest = min(parts, key=lambda p: (-len(p), min(p)))
    got = G.giant_component(spark.createDataFrame(edges, "u string, v string, w double")).collect()
    assert {tuple(r) for r in got} == {e for e in edges if e[0] in largest} and len(parts) > 1
