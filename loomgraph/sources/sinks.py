"""Writers: Parquet, delimited text, JSON lines, and the node and relation files of a graph import."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """One directory of part files; nothing is gathered in one task."""
    options = {"csv": ("csv", {"header": "true", "escape": '"'}), "tsv": ("csv", {"header": "true", "sep": "\t", "escape": '"'})}
    name, more = options.get(fmt, (fmt, {}))
    writer = df.write.mode("overwrite").format(name).options(**more)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def graph_import(nodes: DataFrame, relations: DataFrame, path: str) -> None:
    """Files for a bulk graph import: nodes (entity_id, name, type), relations (source, target, type)."""
    write(nodes.select(F.col("entity_id").alias(":ID"), F.col("name").alias("name"), F.col("type").alias(":LABEL")), f"{path}/nodes", "csv")
    write(relations.select(F.col("source").alias(":START_ID"), F.col("target").alias(":END_ID"), F.col("type").alias(":TYPE")), f"{path}/relations", "csv")


#: Rows of a sub-graph that go into one file.
MAX_GEXF_ROWS = 100_000


def _xml_text(c):
    """A value as XML attributes hold it; characters that XML has no form for are left out."""
    text = F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _attributes(columns: list[str]):
    return F.concat(F.lit("<attvalues>"), *(F.concat(F.lit(f'<attvalue for="{c}" value="'), _xml_text(c), F.lit('"/>')) for c in columns), F.lit("</attvalues>"))


def save_subgraph(nodes: DataFrame, edges: DataFrame, path: str, meta: dict) -> None:
    """nodes (entity_id, name, ...) and edges (u, v, weight, ...) as Parquet, as one GEXF file, and meta as JSON.

    A sub-graph is a top-k selection: with more than MAX_GEXF_ROWS rows there is no GEXF file, but an error after the rest
    is written. Further columns become attributes.
    """
    write(nodes, f"{path}/nodes")
    write(edges, f"{path}/edges")
    spark = nodes.sparkSession
    spark.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if (n := nodes.count() + edges.count()) > MAX_GEXF_ROWS:
        raise ValueError(f"{n} rows are too many for one GEXF file")
    more = {"node": [c for c in nodes.columns if c not in ("entity_id", "name")], "edge": [c for c in edges.columns if c not in ("u", "v", "weight")]}
    declared = "".join(f'<attributes class="{k}">' + "".join(f'<attribute id="{c}" title="{c}" type="string"/>' for c in cs) + "</attributes>" for k, cs in more.items())
    fixed = [(0, f'<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="undirected">{declared}<nodes>'), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>")]
    node = F.concat(F.lit('<node id="'), _xml_text("entity_id"), F.lit('" label="'), _xml_text("name"), F.lit('">'), _attributes(more["node"]), F.lit("</node>"))
    ends = (F.lit('<edge source="'), _xml_text("u"), F.lit('" target="'), _xml_text("v"), F.lit('" weight="'), _xml_text("weight"))
    lines = spark.createDataFrame(fixed, "part int, value string").union(nodes.select(F.lit(1), node)).union(edges.select(F.lit(3), F.concat(*ends, F.lit('">'), _attributes(more["edge"]), F.lit("</edge>"))))
    lines.repartition(1).sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(f"{path}/gexf")
