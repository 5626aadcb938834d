"""Delimited files of unknown make: charset and delimiter are decided for each file, and lines that don't fit are kept apart.

A folder's files are read as bytes, line by line and in splits. The first split of each file decides: its charset is UTF-8 if all
of its lines are, else the other one; its header line has more commas or more tabs. Files of one make are parsed together.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Different makes (charset, delimiter and header) that one call reads, and files that are broadcast, at most.
MAX_MAKES = 500
BROADCAST_FILES = 100_000

_BAD = "__malformed"


def _decode(raw: Column, charset: str) -> Column:
    @F.pandas_udf(StringType())
    def decoded(lines: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else bytes(x).decode(charset, "replace") for x in lines], dtype=object)

    return decoded(raw)


def file_makes(lines: DataFrame, other: str) -> DataFrame:
    """(file, charset, sep, header as bytes) of lines (file, start, line, at), by the first split of each file."""
    head = lines.where("start = 0")
    out = head.groupBy("file").agg(F.min_by("line", "at").alias("header"), F.bool_and(F.is_valid_utf8(F.col("line"))).alias("utf8"))
    count = lambda c: F.length(F.regexp_replace("header", f"[^{c}]", ""))
    sep = F.when(count(",") > count("\t"), ",").otherwise("\t")
    return out.select("file", F.when(F.col("utf8"), "UTF-8").otherwise(other).alias("charset"), sep.alias("sep"), F.col("header").cast("binary").alias("header"))


def read_robust(spark: SparkSession, path: str, other: str = "GB18030") -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of the delimited files under path, whatever their charset (UTF-8 or `other`) and delimiter (comma or tab).

    rows has a column of strings for each name in any header, null where a file doesn't have it, and `source_file`. malformed
    (source_file, line) holds the lines with more or fewer fields than their header; count it for their number. Quotes may hold
    delimiters, but no line ends; a byte order mark is passed over, as are blank lines. An empty folder gives no rows and no columns but
    `source_file`. Files of one make are parsed in one pass; more than MAX_MAKES makes are refused.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    makes = file_makes(lines, other)
    kinds = makes.select("charset", "sep", "header").distinct().limit(MAX_MAKES + 1).collect()
    if len(kinds) > MAX_MAKES:
        raise ValueError(f"files of more than {MAX_MAKES} makes")
    if makes.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
        makes = F.broadcast(makes)
    with_make = lines.join(makes, "file").where((F.col("start") > 0) | (F.col("line").cast("binary") != F.col("header")))
    rows = malformed = None
    for kind in kinds:
        names = [n.strip().strip('"').strip() for n in bytes(kind.header).decode(kind.charset, "replace").lstrip("﻿").rstrip("\r\n").split(kind.sep)]
        names = [n or f"column_{k}" for k, n in enumerate(names)]
        names = [n if names.index(n) == k else f"{n}_{k}" for k, n in enumerate(names)]
        own = with_make.where((F.col("charset") == kind.charset) & (F.col("sep") == kind.sep) & (F.col("header") == F.lit(bytes(kind.header))))
        text = F.col("line") if kind.charset == "UTF-8" else _decode(F.col("line").cast("binary"), kind.charset)
        own = own.select("source_file", F.rtrim(text, F.lit("\r\n")).alias("line")).where(F.trim("line") != "")
        schema = StructType([StructField(n, StringType()) for n in [*names, _BAD]])
        parsed = own.withColumn("r", F.from_csv("line", _ddl(schema), {"sep": kind.sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}))
        good = parsed.where(F.col(f"r.{_BAD}").isNull()).select(*(F.col("r").getField(n).alias(n) for n in names), "source_file")
        bad = parsed.where(F.col(f"r.{_BAD}").isNotNull()).select("source_file", "line")
        rows = good if rows is None else rows.unionByName(good, allowMissingColumns=True)
        malformed = bad if malformed is None else malformed.unionByName(bad)
    if rows is None:
        return spark.createDataFrame([], "source_file string"), spark.createDataFrame([], "source_file string, line string")
    return rows, malformed


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` STRING" for f in schema.fields)
