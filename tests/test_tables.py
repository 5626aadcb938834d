"""Small cases: nulls, empty tables, ties, and round trips of sources and sinks."""

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import tables as B
from loomgraph.sources import readers, sinks


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_ids_and_dates(spark):
    assert one(spark, T.entity_id, " ") is None and one(spark, T.entity_id, None) is None
    assert one(spark, T.entity_id, "A ") == one(spark, T.entity_id, "a")
    assert [one(spark, T.normal_date, x) for x in ("2001", "2001-02", "2001-02-31", "2001-13", "May")] == ["2001-01-01", "2001-02-01", "2001-02-31", "", ""]
    assert one(spark, T.strict_clean, "--12;") is None and one(spark, T.strict_clean, '"é,β"') == "é;β"


def test_batches_number_all_rows(spark):
    df = spark.range(0, 1003).withColumn("x", F.lit(1)).repartition(7)
    rows = B.batches(df, 100, "id").orderBy("id").collect()
    assert [r.batch for r in rows] == [r.id // 100 for r in rows] and len(rows) == 1003
    assert B.batches(df.where("id < 0"), 100, "id").count() == 0


def test_snippets(spark):
    texts = spark.createDataFrame([(1, "One two, THREE four five six"), (2, "two three four five"), (3, None), (4, "")], "id long, text string")
    asked = spark.createDataFrame([(7, "two three four five six"), (8, "two three"), (9, None)], "snippet_id long, text string")
    assert sorted(tuple(r) for r in B.snippet_places(asked, texts).collect()) == [(7, 1), (8, 1), (8, 2)]
    assert B.snippet_places(asked, texts.where("id < 0")).count() == 0


def test_merged_keeps_new(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c")], "k long, v string")
    assert sorted(map(tuple, B.merged(old, new, "k").collect())) == [(1, "a"), (2, "c")]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("n1", "x", "t"), ("n2", 'a "b", c', "t"), ("", "y", "t")], "k string, info string, kind string")
    for fmt in ("csv", "tsv", "json", "parquet"):
        sinks.write(df, f"{tmp_path}/{fmt}", fmt)
        got = readers.nodes(spark, readers.Source(f"{tmp_path}/{fmt}", fmt, key="k", primary="info", kind_column="kind", extra={"kind": "kind"}, options={"escape": '"'})).orderBy("entity_name").collect()
        assert [(r.entity_name, r.primary_info, r.entity_type, r.source_file, r.extra_json) for r in got] == [("n1", "x", "t", fmt, '{"kind": "t"}'), ("n2", 'a "b", c', "t", fmt, '{"kind": "t"}')]
    (tmp_path / "r.xml").write_text("<all><rec><a>x</a><b>y</b></rec><rec><a/><b>z</b></rec></all>")
    got = readers.relations(spark, readers.Source(f"{tmp_path}/r.xml", "xml", source="a", target="b", kind="Link", options={"rowTag": "rec"})).collect()
    assert [tuple(r) for r in got] == [("x", "y", "Link", "r.xml")]
    sinks.graph_import(spark.createDataFrame([("1", "a", "T")], "entity_id string, name string, type string"), spark.createDataFrame([("1", "1", "R")], "source string, target string, type string"), str(tmp_path / "g"))
    assert spark.read.csv(str(tmp_path / "g/nodes"), header=True).columns == [":ID", "name", ":LABEL"]


def test_json_rows_pass_over_what_is_no_json(spark, tmp_path):
    (tmp_path / "lines.jsonl").write_text("\ufeff" + '{"a": "x"}\nnot json\n\n[1]\n{"a": null, "b": 2}\n', "utf-8")
    (tmp_path / "array.json").write_text('[{"a": "x"},\n {"b": 2}]', "utf-8")
    for name, array in (("lines.jsonl", False), ("array.json", True)):
        rows = readers.json_rows(spark, str(tmp_path / name), "a string, b int", array)
        assert sorted(map(tuple, rows.collect()), key=str) == [("x", None), (None, 2)] or sorted(map(tuple, rows.collect()), key=str) == [(None, 2), ("x", None)]


def test_files_by_a_glob_keep_their_names(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"part_Y200{k}.csv").write_text(f"name\nn{k}\n\n")
    (tmp_path / "ids.txt").write_text(" a \n\nb\na\n")
    got = readers.nodes(spark, readers.Source(f"{tmp_path}/part_Y*.csv", key="name", kind="T")).collect()
    assert sorted((r.entity_name, r.source_file) for r in got) == [("n1", "part_Y2001.csv"), ("n2", "part_Y2002.csv")]
    years = readers.tagged(spark.read.csv(f"{tmp_path}/part_Y*.csv", header=True), "year", r"_Y(\d{4})")
    assert sorted(r.year for r in years.collect()) == ["2001", "2002"]
    assert sorted(r.entity_id for r in readers.id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
