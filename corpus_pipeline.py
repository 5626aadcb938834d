"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common, quality
from loomgraph.llm.byte_bpe import encoded_documents
from loomgraph.llm.common import by_ids, table
from loomgraph.llm.decontaminate import contained_items
from loomgraph.llm.line_dedup import dedup_lines
from loomgraph.llm.near_dedup import near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep; the verdicts are made where the rows are read."""
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(quality.judged(trees, batch.column(at).to_pylist())["kept"]))

    return docs.mapInArrow(run, docs.schema)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their later repeated runs of lines; those of which nothing but blanks is left are dropped."""
    return dedup_lines(docs).where(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id."""
    gone = common.checkpointed(near_duplicates(docs).where("NOT kept").select("doc_id"))
    return by_ids(docs, gone, "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return by_ids(docs, contained_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "left_anti")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document."""
    return encoded_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: Trained trees are not SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each other stage is written as Parquet to the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = f"{common.checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
