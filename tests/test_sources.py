import json
import random

from pyspark.sql import functions as F

from loomgraph.plans.source_queries import QUERIES, _documents
from loomgraph.sources.large_json import json_members
from loomgraph.sources.robust import read_robust
from loomgraph.sources.standard import read_mesh_names


def members(doc):
    arrays = {None: doc} if isinstance(doc, list) else {k: v for k, v in doc.items() if isinstance(v, list)}
    return sorted((str(k), json.dumps(x, sort_keys=True)) for k, v in arrays.items() for x in v if isinstance(x, dict))


def test_a_large_document_is_read_by_several_tasks(spark, tmp_path):
    r = random.Random(1)
    odd = ['a } b', 'say \\"hi\\" {', "back\\\\", "[", "]}", "é日本", "", "nodes", '}"']
    value = lambda d: r.choice([r.choice(odd), r.randrange(99), None, [r.choice(odd), {"x": r.choice(odd)}, []], {}]) if d < 1 else {r.choice(odd) + "k": value(d - 1) for _ in range(r.randrange(3))}
    record = lambda: {"id": r.randrange(10**6), "v": value(r.randrange(3)), "w": r.choice(odd) * r.choice([1, 1, 30])}
    docs = {
        "graph": {"meta": {"nodes": "}", "list": [{"no": 1}]}, "nodes": [record() for _ in range(150)] + [3, "}", [{"deep": 1}]], "kinds": ["a", "}"], "edges": [record() for _ in range(200)], "none": []},
        "list": [record() for _ in range(120)], "empty": {}, "one": [{"only": "}" * 3000}],
    }
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (300, 2000, 10**7):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            for name, doc in docs.items():
                for indent in (None, 1):
                    at = tmp_path / f"{name}-{size}-{indent}.json"
                    at.write_text(json.dumps(doc, indent=indent, ensure_ascii=indent is None) + ("\n" if indent else ""))
                    got = json_members(spark, str(at)).collect()
                    want = [m for m in members(doc) if m[0] not in ("meta",)]
                    assert sorted((str(x.key), json.dumps(json.loads(x.record), sort_keys=True)) for x in got) == want, (name, size, indent)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "graph-300-None.json")).rdd.getNumPartitions() > 5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_records_of_one_xml_document_are_read_by_several_tasks(spark, tmp_path):
    name = lambda k: f"n{k} &amp; <![CDATA[<b>]]>" + "é" * (k % 50)
    record = lambda k: f'<QualifierRecord a="{k}">\n<QualifierUI>Q{k}</QualifierUI><!-- x --><QualifierName><String>{name(k)}</String></QualifierName></QualifierRecord>\n'
    at = tmp_path / "qual.xml"
    at.write_text('<?xml version="1.0"?><!-- <QualifierRecord> --><QualifierRecordSet>' + "".join(map(record, range(400))) + f"<!-- {record(1000)} -->" + record(400) + "</QualifierRecordSet>", encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (700, 3000, 10**7):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            rows = read_mesh_names(spark, str(at), "Qualifier")
            assert sorted((r.mesh_id, r.entity_name) for r in rows.collect()) == sorted((f"Q{k}", f"n{k} & <b>" + "é" * (k % 50)) for k in range(401)), size
            assert size > 10**6 or rows.rdd.getNumPartitions() > 5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_stand_in_documents_are_written_by_several_tasks(spark, sf):
    names = ["src_graph_edges", "src_mesh_names", "src_uniprot", "src_icd10_index"]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        whole = {n: sorted(map(str, QUERIES[n](spark, sf).collect())) for n in names}
        rows = spark.range(100, numPartitions=4).selectExpr("'<i>' || id || '</i>' AS value")
        lines = _documents(rows, "<Set>", "</Set>", ", ").rdd.mapPartitions(lambda x: ["".join(r.value for r in x)]).collect()
        assert lines == ["<Set>" + ", ".join(f"<i>{k}</i>" for k in range(p, p + 25)) + "</Set>" for p in range(0, 100, 25)]
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
        assert {n: sorted(map(str, QUERIES[n](spark, sf).collect())) for n in names} == whole
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_mixed_files_are_read_in_one_go(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿id,name,note\r\n1,基因,"x, ""y"""\r\n2,b\r\n\r\n3,c,d,e\r\n4,,z\r\n'.encode())
    (tmp_path / "b.tsv").write_bytes("id\tname\n5\t衰老, 基因\n6\tb\tmore\n".encode("gbk"))
    (tmp_path / "c.csv").write_bytes("id,other\n7,o\n".encode())
    (tmp_path / "d.csv").write_bytes("id,name,note\r\n8,h,i\r\n".encode("utf-8"))
    (tmp_path / "e.csv").write_bytes(b"")
    rows, bad = read_robust(spark, str(tmp_path))
    got = {tuple(x) for x in rows.select("id", "name", "note", "other", "source_file").collect()}
    assert got == {("1", "基因", 'x, "y"', None, "a.csv"), ("4", None, "z", None, "a.csv"), ("5", "衰老, 基因", None, None, "b.tsv"), ("7", None, None, "o", "c.csv"), ("8", "h", "i", None, "d.csv")}
    assert {tuple(x) for x in bad.collect()} == {("a.csv", "2,b"), ("a.csv", "3,c,d,e"), ("b.tsv", "6\tb\tmore")}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_bytes(b"")
    assert read_robust(spark, str(tmp_path / "none"))[0].count() == 0


def test_standard_names_are_distinct():
    from loomgraph.sources.listed import OWN, RENAMED, TABLES, standard_names

    for table in TABLES:
        names = list(standard_names(table).values())
        assert len(set(names)) == len(names) and all(names), table
    assert set(OWN) <= set(TABLES) and {t.split("__")[0] for t in TABLES} == set(RENAMED)
    got = standard_names("ageanno__related_diseases")
    assert got["geneId"] == "ageanno_gene_id" and got["number of pmid"] == "number_of_pmid" and standard_names("opengenes__lifespan_change")["lifespan_%_change_min"] == "lifespan_%_change_min"
