"""What is read several times is made once: rows are counted as they pass."""

import math
import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loomgraph.operators import centrality as Y
from loomgraph.operators import classifier as C
from loomgraph.operators import edges as E
from loomgraph.operators import entities as N
from loomgraph.operators import graph as G
from loomgraph.params import SourceWeights
from loomgraph.sources import standard as S


@pytest.fixture
def passed(spark):
    """(df with a column that counts its rows whenever they are made, the counter)."""

    def watch(rows, schema, column):
        seen = spark.sparkContext.accumulator(0)

        def count(value):
            seen.add(1)
            return value

        df = spark.createDataFrame(rows, schema)
        return df.withColumn(column, F.udf(count, df.schema[column].dataType).asNondeterministic()(column)), seen

    return watch


RING = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 1.0), ("d", "e", 3.0), ("a", "e", 1.0), ("b", "d", 1.0)]


def test_bridge_candidates_make_their_edges_once(spark, passed):
    edges, seen = passed(RING, "u string, v string, w double", "w")
    types, made = passed([(n, "BMC", "uniprot") for n in "abcde"], "entity_id string, entity_type string, source string", "source")
    nodes = E.node_stats(spark.createDataFrame(RING, "u string, v string, w double"), "w").select("entity_id", F.col("degree").alias("degree_sub"), F.col("strength").alias("strength_sub"))
    seeds = [spark.createDataFrame([(n,)], "entity_id string") for n in "ac"]
    assert G.bridge_candidates(edges, nodes, N.type_weights(types), *seeds).count() == 5
    assert (seen.value, made.value) == (6, 5)


def test_quality_makes_its_weights_once(spark):
    """What is scaled is read back: neither the scale's ends nor the result rank an entity's types again."""
    types = spark.createDataFrame([(f"P{k}", "BMC", "uniprot") for k in range(5) for _ in range(k + 1)], "entity_id string, entity_type string, source string")
    quality = N.quality(N.type_weights(types))
    assert "Window" not in quality._jdf.queryExecution().executedPlan().toString()
    out = {r.entity_id: r.quality_norm for r in quality.collect()}
    assert (out["P0"], out["P4"]) == (0.0, 1.0)


def test_components_make_their_edges_once(spark, passed):
    """Two paths whose ids are out of order, so that roots fall together over several rounds."""
    order = [3, 9, 0, 7, 5, 1, 8, 2, 6, 4]
    rows = [(f"{p}{a}", f"{p}{b}") for p in "xy" for a, b in zip(order, order[1:], strict=False)]
    edges, seen = passed(rows, "u string, v string", "u")
    out = {r.entity_id: r.component for r in G.connected_components(edges).collect()}
    assert out == {f"{p}{k}": f"{p}0" for p in "xy" for k in range(10)} and seen.value == len(rows)


def test_edges_are_dealt_out_once(spark):
    rows = [(a, b, t, s) for a, b in (("x", "y"), ("y", "x"), ("x", "z")) for t in ("REG", "Causal") for s in ("uniprot", "unknown_src")]
    relations = spark.createDataFrame(rows, "source_entity_id string, target_entity_id string, relation_type string, source string")
    edges = E.weighted_edges(relations, min_count=3)
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.u, r.v): r["count"] for r in edges.collect()} == {("x", "y"): 8, ("x", "z"): 4}


def test_betweenness_makes_its_edges_once(spark, passed):
    edges, seen = passed(RING, "u string, v string, w double", "u")
    out = {r.entity_id: round(r.betweenness, 6) for r in Y.betweenness(edges).collect()}
    assert out == {"a": 0.083333, "b": 0.25, "c": 0.0, "d": 0.25, "e": 0.083333} and seen.value == 6


WORDS = [(k, f"common w{k % 7} " + ("red green blue" if k % 4 == 0 else "green red blue"), float(k % 4 == 0), k % 5) for k in range(80)]


def test_folds_make_their_texts_twice(spark, passed):
    """Once to count terms, once for vectors, whatever the number of folds."""
    known, seen = passed(WORDS, "doc_id long, text string, label double, fold int", "text")
    assert [(r.fold, r.auc) for r in C.fold_scores(known).collect()] == [(k, 1.0) for k in range(5)] and seen.value == 160


def test_a_fold_has_a_vocabulary_of_its_own(spark):
    """Each fold's scores are those of a model that was fitted on the texts of the others alone."""
    rows = [(k, f"w{k % 7} v{k * k % 11} " + " ".join(f"u{(k + j) % 5}" for j in range(k % 4)), float(k % 3 == 0), k % 2) for k in range(60)]
    known = spark.createDataFrame(rows, "doc_id long, text string, label double, fold int")
    measure = C.BinaryClassificationEvaluator(metricName="areaUnderROC")
    want = [(k, round(measure.evaluate(C.fitted(known.where(f"fold <> {k}"), features=9).transform(known.where(f"fold = {k}"))), 9)) for k in (0, 1)]
    assert [(r.fold, round(r.auc, 9)) for r in C.fold_scores(known, features=9).collect()] == want


def test_scores_make_their_texts_twice(spark, passed):
    """Once to count the terms of labelled ones, once for vectors; a row of each document, labelled or not."""
    docs, seen = passed([r[:2] for r in WORDS] + [(99, "")], "doc_id long, text string", "text")
    labels = spark.createDataFrame([(k, y) for k, _, y, _ in WORDS], "doc_id long, label double")
    out = {r.doc_id: r.p for r in C.scores(docs, labels).select("doc_id", vector_to_array("probability")[1].alias("p")).collect()}
    assert len(out) == 81 and all((out[k] >= 0.5) == (y == 1) for k, _, y, _ in WORDS) and seen.value == 162


def test_best_names_make_their_relations_once(spark, passed):
    rows = [("a", "b", "A", "B"), ("b", "a", "B", "A"), ("a", "c", "alpha", ""), ("c", "b", None, "bee"), ("d", "d", "x", "y"), (None, "", "n", "m")]
    relations, seen = passed(rows, "source_entity_id string, target_entity_id string, source_entity_name string, target_entity_name string", "source_entity_name")
    assert {r.entity_id: r.best_name for r in E.best_names(relations).collect()} == {"a": "A", "b": "B", "d": "x"} and seen.value == len(rows)


def test_umls_relations_make_their_names_once(spark, passed):
    """Names of a kind alone are grouped; both ends read the same written names."""
    rows = [("C1", "ENG", "PT", " one "), ("C1", "ENG", "PN", "uno"), ("C2", "ENG", "SY", "two"), ("C3", "FRE", "PT", "trois"), ("C3", "ENG", "PN", "three")]
    names, seen = passed(rows, "cui string, lat string, tty string, str string", "str")
    relations = spark.createDataFrame([("C1", "RB", "C3", "isa", "MSH")] * 2 + [("C3", "RB", "C2", None, "MSH")], "cui1 string, rel string, cui2 string, rela string, sab string")
    out = {(r.source_entity_name, r.rel_type, r.target_entity_name) for r in S.umls_relations(relations, S.umls_names(names)).collect()}
    assert out == {("uno", "isa", "three"), ("three", "RB", None)} and seen.value <= len(rows)


def test_source_rules_run_once_for_each_source(spark, monkeypatch):
    """However many entities and types name a source; beyond the bound for a broadcast, on each row, with the same result."""
    given, rules = [], N.with_source_weights
    monkeypatch.setattr(N, "with_source_weights", lambda df, p: (given.append(df.count()), rules(df, p))[1])
    sources = ["uniprot;bert_model_prediction", "nothing known", None]
    types = spark.createDataFrame([(f"P{k % 9}", "BMC" if k % 2 else "EGR", sources[k % 3]) for k in range(90)], "entity_id string, entity_type string, source string")
    few = sorted(N.type_weights(types).collect())
    monkeypatch.setattr(N, "BROADCAST_SOURCES", 2, raising=False)
    assert sorted(N.type_weights(types).collect()) == few and given == [3, 90]


def test_weights_of_many_keys_equal_a_loop(spark):
    """Keys of several numbers of bits, and sums that don't depend on the order of the rows."""
    p = SourceWeights({f"key{k:03d}": (k % 7 + 1) / 10 for k in range(150)}, {}, 0.05)
    r = random.Random(5)
    rows = [(f"P{k % 4}", f"T{k % 3}", ";".join(f"key{r.randrange(160):03d}" for _ in range(k % 3 + 1))) for k in range(3000)]
    want = {}
    for entity, kind, source in rows:
        hits = {k for k in source.split(";") if k in p.weights}
        n, keys, weights, defaults = want.get((entity, kind), (0, set(), [], 0))
        want[entity, kind] = n + 1, keys | hits, [*weights, max((p.weights[k] for k in hits), default=p.default)], defaults + (not hits)
    columns = ["entity_id", "entity_type", "evidence_count", "sources_unique", "weight_sum", "weight_max", "default_hits"]
    got = [N.type_weights(spark.createDataFrame(x, "entity_id string, entity_type string, source string"), p).select(columns).collect() for x in (rows, rows[::-1])]
    assert sorted(got[0]) == sorted(got[1]) and len(got[0]) == len(want) == 12
    for x in got[0]:
        n, keys, weights, defaults = want[x.entity_id, x.entity_type]
        assert (x.evidence_count, x.sources_unique, x.weight_max, x.default_hits) == (n, len(keys), max(weights), defaults)
        assert x.weight_sum == pytest.approx(math.fsum(weights), rel=1e-14) and len(keys) > 63
