"""Declared sources: a format, the columns that name nodes or relations, and the standard tables made of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FORMATS = {"csv": ("csv", {"header": "true"}), "tsv": ("csv", {"header": "true", "sep": "\t"}), "psv": ("csv", {"sep": "|", "quote": ""}), "json": ("json", {}), "xml": ("xml", {}), "parquet": ("parquet", {})}


@dataclass(frozen=True)
class Source:
    """Where a table lies and which columns it gives: key and primary of nodes, source and target of relations."""

    path: str
    format: str = "csv"
    key: str | None = None
    primary: str | None = None
    source: str | None = None
    target: str | None = None
    kind: str | None = None
    kind_column: str | None = None
    extra: dict[str, str] = field(default_factory=dict)
    options: dict[str, str] = field(default_factory=dict)


def read(spark: SparkSession, s: Source) -> DataFrame:
    name, options = _FORMATS[s.format]
    return spark.read.format(name).options(**(options | s.options)).load(s.path)


def _file(s: Source):
    """The name of the file that a row comes from; a directory that a writer made stands for its parts."""
    named = F.element_at(F.split(F.lit(s.path), "/"), -1)
    return F.col("_metadata.file_name") if re.search(r"[*?\[{]", s.path) else named


def _kind(s: Source):
    return F.col(s.kind_column).cast("string") if s.kind_column else F.lit(s.kind)


def _quoted(x):
    """A string as JSON writes it."""
    whole = F.to_json(F.array(x))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def _extra(columns: dict[str, str]):
    """A JSON object of the columns that have a value; one with `;` or `|` is a list of its parts."""

    def member(name: str, c: str):
        value = F.col(c).cast("string")
        parts = F.filter(F.transform(F.split(value, r"[;|]"), lambda p: F.trim(p)), lambda p: p != "")
        shown = F.when(value.rlike(r"[;|]"), F.concat(F.lit("["), F.array_join(F.transform(parts, _quoted), ", "), F.lit("]"))).otherwise(_quoted(value))
        return F.when(value != "", F.concat(_quoted(F.lit(name)), F.lit(": "), shown))

    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*(member(n, c) for n, c in columns.items()))), ", "), F.lit("}"))


def nodes(spark: SparkSession, s: Source) -> DataFrame:
    """(entity_name, entity_type, primary_info, extra_json, source_file); rows without a name are left out."""
    out = read(spark, s).select(
        F.trim(F.col(s.key).cast("string")).alias("entity_name"), F.trim(_kind(s)).alias("entity_type"),
        (F.coalesce(F.trim(F.col(s.primary).cast("string")), F.lit("")) if s.primary else F.lit("")).alias("primary_info"),
        (_extra(s.extra) if s.extra else F.lit("{}")).alias("extra_json"), _file(s).alias("source_file"),
    )
    return out.where("entity_name <> ''")


def relations(spark: SparkSession, s: Source) -> DataFrame:
    """(source_name, target_name, relation_type, source_file); rows without both names are left out."""
    name = lambda c: F.trim(F.col(c).cast("string"))
    out = read(spark, s).select(name(s.source).alias("source_name"), name(s.target).alias("target_name"), F.trim(_kind(s)).alias("relation_type"), _file(s).alias("source_file"))
    return out.where("source_name <> '' AND target_name <> ''")


def collected(spark: SparkSession, sources: list[Source], of=nodes) -> DataFrame:
    """Nodes, or relations, of all sources in one table; each source is read as its own columns say."""
    first, *rest = (of(spark, s) for s in sources)
    for more in rest:
        first = first.unionByName(more)
    return first


def tagged(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """df as read from files, with the first group of pattern in each row's file name."""
    return df.withColumn(column, F.regexp_extract(F.col("_metadata.file_name"), pattern, 1))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id) of a text file with one a line; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("entity_id")).where("entity_id <> ''").distinct()


def json_rows(spark: SparkSession, path: str, schema: str, array: bool = False) -> DataFrame:
    """Rows of JSON lines, or of files that hold one array; a byte order mark and lines that are no JSON are passed over."""
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    if array:
        return reader.json(path, multiLine=True)
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\\uFEFF", "").alias("value")).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("v"))
    return parsed.where(F.schema_of_variant("v").startswith("OBJECT")).select("r.*")
