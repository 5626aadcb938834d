"""Edge counts and hourly windows kept up to date over files that arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import checkpoint_folder


def drained(stream: DataFrame) -> DataFrame:
    """The aggregate of a stream after all that is there now; each batch replaces the result written before it."""
    spark = stream.sparkSession
    at = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out")
    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def edge_counts(relations: DataFrame) -> DataFrame:
    """(u, v, count) of relations (u, v), undirected, as a streaming aggregate."""
    return relations.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("count"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(hour, kind, n) of events (ts, kind); rows later than `late` are left out where output is appended."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(F.count("*").alias("n"))
    return windows.select(F.col("w.start").alias("hour"), "kind", "n")
