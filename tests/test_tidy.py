"""Nulls, ties, empty tables and unknown names in what puts tables into shape."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import tidy as D


def test_scaling_of_nulls_constants_and_nothing(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0), (3, None, 5.0)], "id long, a double, c double")
    got = {r.id: r for r in D.scaled(df, {"x": ("a", "plain"), "y": ("c", "guarded"), "z": ("c", "soft")}).collect()}
    assert [got[k].x for k in (1, 2, 3)] == [0.0, 1.0, 0.0] and {(r.y, r.z) for r in got.values()} == {(0.0, 0.0)}
    assert D.scaled(df.limit(0), {"x": ("a", "soft")}).count() == 0


def test_clean_records_keep_one_of_equal_keys(spark):
    schema = "pmid string, title string, publication_type string, extra long"
    rows = [("1", "b", None, 9), ("1", "a", "Review", 1), ("2", None, None, 1), ("3", "c", "x; Retracted Publication", 1), (None, "d", None, 1)]
    got = D.clean_records(spark.createDataFrame(rows, schema), ["pmid", "title"]).collect()
    assert [tuple(r) for r in got] == [("1", "a", "Review", 1)]
    with pytest.raises(ValueError):
        D.clean_records(spark.createDataFrame(rows, schema), ["abstract"])


def test_edges_under_other_names(spark):
    edges = spark.createDataFrame([("b", "a", 2.0, "x"), ("a", "b", 4.0, None), ("c", "a", None, None)], "src string, tgt string, confidence double, reltype_top_x string")
    got = {(r.u, r.v): r for r in D.standard_edges(edges, clip=1.0).collect()}
    assert got["a", "b"].reltype_top == "x" and abs(got["a", "b"].w_vis - 1) < 1e-6 and got["a", "c"].reltype_top == "" and got["a", "c"].w_vis == 0
    plain = D.standard_edges(spark.createDataFrame([("a", "b")], "u string, v string")).first()
    assert tuple(plain) == ("a", "b", "", 0.0, 0.0)
    capped = D.standard_edges(spark.createDataFrame([("a", "b", 1.7)], "u string, v string, w_final double"), gamma=1.0).first()
    assert capped.w_norm == 1.0 and capped.w_vis == 1.0
    with pytest.raises(ValueError):
        D.standard_edges(spark.createDataFrame([("a", "b")], "x string, y string"))


def test_last_types_and_dictionaries(spark):
    entities = spark.createDataFrame([(1, "a", "T1", 1), (1, "a", "T2", 2), (2, "a", "T3", 1)], "pmid long, name string, type string, place long")
    relations = spark.createDataFrame([(1, "a", "b"), (2, "b", "a")], "pmid long, source string, target string")
    got = {(r.pmid, r.source_type, r.target_type) for r in D.with_types(relations, entities).collect()}
    assert got == {(1, "T2", None), (2, None, "T3")}
    names = D.entity_dictionary(spark.createDataFrame([("a (b)",), (" ",), (None,)], "entity string"), spark.createDataFrame([("a (b)",), ("c",)], "entity string"))
    assert sorted((r.entity, r.main_text) for r in names.collect()) == [("a (b)", "a"), ("c", "c")]
    known = spark.createDataFrame([("a", "{1}"), ("a", "{0}")], "main_text string, annotation string")
    assert sorted((r.entity, r.annotation) for r in D.annotated(names, known).collect()) == [("a (b)", "{0}"), ("c", "{}")]


def test_exported_ids_and_statistics_of_nothing(spark):
    ranking = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.5), ("d", None)], "entity_id string, score double")
    assert json.loads(D.top_ids(ranking, "score", 2).first().ids) == ["a", "b"]
    assert json.loads(D.top_ids(ranking.limit(0), "score", 2).first().ids) == []
    rel = spark.createDataFrame([("a", "b", "binds", 1.0), ("b", "c", "causes", 0.5)], "source string, target string, relation_type string, confidence double")
    got = {r.relation_type: tuple(r)[1:] for r in D.relation_statistics(rel, ["binds"]).collect()}
    assert got == {"binds": (1, 0, 2, 1.0), "causes": (1, 1, 2, 0.5), "_ALL_": (2, 1, 3, 0.75)}
    assert D.neighbour_types(spark.createDataFrame([("s", "n", "b"), ("s", "n", "a")], "seed string, neighbour string, type string")).select(F.col("type")).first()[0] == "a"
