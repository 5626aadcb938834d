import json
from xml.etree import ElementTree

from loomgraph.sources.sinks import save_subgraph


def test_subgraph_files_read_back(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 'A & "B" <c>', 2), ("b", None, 1), ("c", "\u4e2d\x01", 1)], "entity_id string, name string, degree int")
    edges = spark.createDataFrame([("a", "b", 3, "Causal"), ("a", "c", 1, None)], "u string, v string, weight long, reltype_top string")
    at = str(tmp_path / "graph")
    for _ in range(2):  # a second run replaces the first
        save_subgraph(nodes, edges, at, {"top": 2, "name": "\u4e2d"})
    gexf = "\n".join(r.value for r in spark.read.text(f"{at}/gexf").collect())
    assert spark.read.text(f"{at}/gexf").inputFiles().__len__() == 1
    ns = {"g": "http://www.gexf.net/1.2draft"}
    root = ElementTree.fromstring(gexf)
    assert {n.get("id"): n.get("label") for n in root.iterfind(".//g:node", ns)} == {"a": 'A & "B" <c>', "b": "", "c": "\u4e2d"}
    found = [(e.get("source"), e.get("target"), e.get("weight"), e.find(".//g:attvalue", ns).get("value")) for e in root.iterfind(".//g:edge", ns)]
    assert sorted(found) == [("a", "b", "3", "Causal"), ("a", "c", "1", "")]
    assert json.loads(spark.read.text(f"{at}/meta").first().value) == {"top": 2, "name": "\u4e2d"}
    assert spark.read.parquet(f"{at}/nodes").count() == 3


def test_an_empty_subgraph(spark, tmp_path):
    save_subgraph(spark.createDataFrame([], "entity_id string, name string"), spark.createDataFrame([], "u string, v string, weight long"), str(tmp_path / "g"), {})
    assert len(ElementTree.fromstring("".join(r.value for r in spark.read.text(str(tmp_path / "g/gexf")).collect()))) == 1
