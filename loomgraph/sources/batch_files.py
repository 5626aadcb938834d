"""Numbered ranges of rows as named files of exactly so many rows, and chat requests with their index."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import checkpointed
from loomgraph.sources.publish import Store

#: Renames of files at the same time.
RENAMES = 16


def batched(rows: DataFrame, group: str, size: int, order: list[str]) -> DataFrame:
    """rows with `batch`: in each group, numbers from 0 of `size` rows each in a unique order.

    Rows are dealt out by ranges of group and order, and numbered in each; a group over many ranges goes on counting where the range
    before ends, which only the ranges' sizes say.
    """
    dealt = checkpointed(rows.repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(group).alias("__group"), F.col("__part").alias("__at"), F.coalesce(before, F.lit(0)).alias("__before"))
    inside = dealt.withColumn("__row", F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order)) - 1)
    out = inside.join(starts, (F.col("__part") == F.col("__at")) & F.col(group).eqNullSafe(F.col("__group")))
    return out.withColumn("batch", F.floor((F.col("__before") + F.col("__row")) / size)).select(*rows.columns, "batch")


def batch_name(year: Column, task: str, batch: Column) -> Column:
    return F.format_string("BATCH_Y%s_%s_B%s", year.cast("string"), F.lit(task), batch.cast("string"))


def write_named(rows: DataFrame, path: str, file: str, order: list[str], fmt: str = "csv", suffix: str = ".csv", **options: str) -> list[str]:
    """Write rows as one file for each value of the column `file`, in order; the files' names.

    Each value's rows are one task's: it must be what a single file may hold. Spark writes the parts, whose tasks commit them
    side by side into a staging folder, and the driver renames them, several at a time, so that a file is there whole or not at all.
    """
    spark, stage = rows.sparkSession, f".staged-{uuid.uuid4().hex}"
    given = {"header": "true", "escape": '"', "encoding": "UTF-8"} if fmt == "csv" else {}
    given["mapreduce.fileoutputcommitter.algorithm.version"] = "2"
    dealt = rows.withColumn("__file", F.col(file)).repartition("__file").sortWithinPartitions("__file", *order)
    dealt.drop(*([] if fmt != "text" else [c for c in rows.columns if c != "value"])).write.partitionBy("__file").format(fmt).options(**(given | options)).save(f"{path}/{stage}")
    store = Store(spark, path)
    old = set(store.files(""))
    folders = [f for f in store.files(stage) if f.startswith("__file=")]

    def rename(folder: str) -> str:
        parts = [p for p in store.files(f"{stage}/{folder}") if p.startswith("part-")]
        if len(parts) != 1:
            raise OSError(f"{folder} has {len(parts)} parts")
        name = f"{folder.removeprefix('__file=')}{suffix}"
        if name in old:
            store.remove(name)
        store.move(f"{stage}/{folder}/{parts[0]}", name)
        return name

    with ThreadPoolExecutor(RENAMES) as pool:
        names = list(pool.map(rename, folders))
    store.remove(stage)
    return names


def yearly_files(rows: DataFrame, path: str, prefix: str, year: str, order: list[str]) -> list[str]:
    """One file `{prefix}_Y{year}.csv` for each year."""
    return write_named(rows.withColumn("__name", F.format_string(f"{prefix}_Y%s", F.col(year).cast("string"))), path, "__name", order)


def batch_files(rows: DataFrame, path: str, task: str, year: str, order: list[str], size: int = 200) -> list[str]:
    """Files `BATCH_Y{year}_{task}_B{number}.csv` of `size` rows each; a year's last one has the rest."""
    numbered = batched(rows, year, size, order)
    return write_named(numbered.withColumn("__name", batch_name(F.col(year), task, F.col("batch"))).drop("batch"), path, "__name", order)


def request_files(articles: DataFrame, path: str, task: str, system: str, model: str, size: int = 200) -> list[str]:
    """JSON lines of chat requests for articles (pmid, year, abstract), and beside each an index `.meta.csv` (pmid, request_id).

    A request's id is its article's with eight hexadecimal digits of the prompt's hash, so that a second run gives the same.
    """
    rows = batched(articles.select("pmid", "year", "abstract"), "year", size, ["pmid", "abstract"])
    ident = F.concat(F.col("pmid").cast("string"), F.lit("_"), F.substring(F.sha2(F.coalesce("abstract", F.lit("")), 256), 1, 8))
    rows = rows.select(batch_name(F.col("year"), task, F.col("batch")).alias("__name"), F.col("pmid").cast("string").alias("pmid"), ident.alias("request_id"), "abstract")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    request = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", F.coalesce("abstract", F.lit("")))).alias("messages"), "request_id", F.col("pmid").alias("user"))
    lines = rows.select("__name", F.to_json(request).alias("value"))
    names = write_named(lines, path, "__name", ["value"], "text", ".jsonl")
    return names + write_named(rows.select("__name", "pmid", "request_id"), path, "__name", ["pmid", "request_id"], suffix=".meta.csv")
