"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "edges_weighted", "edges_count_graph", "entity_type_weights", "id_best_name", "top_subgraph_nodes", "seeded_edges_confidence", "aging_rank", "prf_strict", "graph_clean",
    "tbl_relations", "unified_rels", "fingerprint_match", "snippet_match", "stream_edges_equals_batch",
]


def main() -> None:
    from loomgraph import queries as core

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="checkpoints-")}
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderstatus").count().collect()  # starts the JVM's compiler
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        core.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
