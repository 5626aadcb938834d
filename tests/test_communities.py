"""Communities and betweenness against brute force."""

import heapq
import random
from collections import defaultdict

import pytest

from loomgraph.operators.centrality import betweenness, sources_needed
from loomgraph.operators.communities import communities, modularity

SCHEMA = "u string, v string, w double"


def planted(groups, size, inside, across, seed):
    r = random.Random(seed)
    name = lambda g, k: f"N{g:02d}_{k:02d}"
    nodes = [(g, k) for g in range(groups) for k in range(size)]
    return [(name(*a), name(*b), float(r.randrange(1, 5))) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if r.random() < (inside if a[0] == b[0] else across)]


def quality(edges, of):
    k, inside, m2 = defaultdict(float), 0.0, 0.0
    for u, v, w in edges:
        k[of[u]] += w
        k[of[v]] += w
        m2 += 2 * w
        inside += 2 * w * (of[u] == of[v])
    return inside / m2 - sum((x / m2) ** 2 for x in k.values())


def greedy(edges):
    """Join the two communities that gain most, until none gain."""
    of = {x: x for e in edges for x in e[:2]}
    m2 = 2 * sum(w for *_, w in edges)
    while True:
        k, between = defaultdict(float), defaultdict(float)
        for u, v, w in edges:
            k[of[u]] += w
            k[of[v]] += w
            if of[u] != of[v]:
                between[tuple(sorted((of[u], of[v])))] += w
        gain, pair = max(((2 * w / m2 - 2 * k[a] * k[b] / m2**2, (a, b)) for (a, b), w in between.items()), default=(0, None))
        if gain <= 1e-12:
            return of
        of = {x: pair[0] if c == pair[1] else c for x, c in of.items()}


def star(leaves):
    return [("hub", f"leaf{k:03d}", 1.0) for k in range(leaves)] + [(f"leaf{k:03d}", f"leaf{k + 1:03d}", 3.0) for k in range(0, leaves - 1, 2)]


@pytest.mark.parametrize("edges", [planted(5, 8, 0.5, 0.1, 2), star(60)], ids=["blurred", "star"])
def test_communities_are_as_good_as_greedy_ones(spark, edges):
    df = spark.createDataFrame(edges, SCHEMA)
    found = communities(df)
    of = {r.entity_id: r.community for r in found.collect()}
    assert set(of) == {x for e in edges for x in e[:2]}
    assert all(of[c] == c and c == min(x for x in of if of[x] == c) for c in set(of.values()))
    ours, theirs = quality(edges, of), quality(edges, greedy(edges))
    assert ours >= theirs - 0.02 * abs(theirs), (ours, theirs)
    assert abs(modularity(df, found) - ours) < 1e-9


def test_communities_of_odd_edges(spark):
    assert communities(spark.createDataFrame([], SCHEMA)).count() == 0
    assert communities(spark.createDataFrame([("a", "b", 0.0)], SCHEMA)).count() == 0
    rows = [("a", "b", 1.0), ("b", "a", 1.0), ("c", "c", 5.0), ("x", "y", 2.0), ("a", "q", -1.0)]
    got = {r.entity_id: r.community for r in communities(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "x": "x", "y": "x"}


def brandes(edges, weighted, sources=None):
    near = defaultdict(dict)
    for u, v, w in edges:
        if u != v:
            d = w if weighted else 1
            near[u][v] = min(d, near[u].get(v, d))
            near[v][u] = near[u][v]
    names = sorted({x for e in edges for x in e[:2]})
    total, start = dict.fromkeys(names, 0.0), names if sources is None else sources
    for s in start:
        dist, paths, before, order, heap = {}, defaultdict(float, {s: 1.0}), defaultdict(list), [], [(0.0, s)]
        best = {s: 0.0}
        while heap:
            d, x = heapq.heappop(heap)
            if x in dist:
                continue
            dist[x] = d
            order.append(x)
            for y, w in near[x].items():
                if y not in best or d + w < best[y] - 1e-9:
                    best[y], before[y], paths[y] = d + w, [x], paths[x]
                    heapq.heappush(heap, (d + w, y))
                elif abs(d + w - best[y]) < 1e-9 and y not in dist:
                    before[y].append(x)
                    paths[y] += paths[x]
        part = defaultdict(float)
        for y in reversed(order):
            for x in before[y]:
                part[x] += paths[x] / paths[y] * (1 + part[y])
            if y != s:
                total[y] += part[y]
    n = len(names)
    return {x: v * n / len(start) / ((n - 1) * (n - 2)) for x, v in total.items()}


@pytest.mark.parametrize("weighted,batch", [(False, 16), (True, 256)])
def test_betweenness_equals_brute_force(spark, weighted, batch):
    edges = planted(3, 9, 0.35, 0.03, 7) + [("island", "islet", 1.0), ("N00_00", "N00_00", 2.0)]
    got = {r.entity_id: r.betweenness for r in betweenness(spark.createDataFrame(edges, SCHEMA), weighted=weighted, batch=batch).collect()}
    want = brandes(edges, weighted)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want) and max(want.values()) > 0.05


def test_betweenness_by_some_sources_is_as_near_as_stated(spark):
    edges = planted(4, 20, 0.2, 0.01, 8)
    df, names = spark.createDataFrame(edges, SCHEMA), sorted({x for e in edges for x in e[:2]})
    k = sources_needed(len(names), 0.35)
    some = random.Random(1).sample(names, k)
    got = {r.entity_id: r.betweenness for r in betweenness(df, spark.createDataFrame([(x,) for x in some], "entity_id string")).collect()}
    want, alike = brandes(edges, False), brandes(edges, False, some)
    assert k < len(names) and all(abs(got[x] - alike[x]) < 1e-9 and abs(got[x] - want[x]) <= 0.35 for x in names)


def test_betweenness_of_odd_edges(spark):
    assert betweenness(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.betweenness for r in betweenness(spark.createDataFrame([("a", "b", 1.0)], SCHEMA)).collect()} == {0.0}
    with pytest.raises(ValueError):
        betweenness(spark.createDataFrame([("a", "b", 0.0), ("b", "c", 1.0)], SCHEMA), weighted=True)
