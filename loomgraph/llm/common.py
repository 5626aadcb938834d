"""What the operators of this subpackage share: checkpoints, Arrow batches, words and shingles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in a shingle, and the least similarity of near duplicates in hundredths.
SHINGLE_WORDS = 5
MIN_SIMILARITY = 75

#: Rows of one Arrow batch. Texts reach megabytes, so a batch stays short.
BATCH_ROWS = 256

#: Ids that are broadcast at most.
BROADCAST_IDS = 200_000

#: Entries that a worker's table of word hashes holds before it starts anew.
WORD_CACHE = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints; a folder of our own only where none is set and all runs in one process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the cluster's checkpoint folder; a lost executor costs nothing of it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to a folder of its own beside the checkpoints, and read from there."""
    at = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def by_ids(df: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """df joined (left_semi or left_anti) with the distinct doc_ids of ids, which must be cheap to read twice.

    Up to BROADCAST_IDS of them, 8 bytes each, are counted first and then broadcast, so that texts stay where they
    are; more of them are shuffled.
    """
    ids = ids.select(F.col("doc_id").alias("__id"))
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, df[id_col].cast("long") == F.col("__id"), how)


def map_columns(df: DataFrame, fn: Callable[..., dict], schema: str) -> DataFrame:
    """map_batches with fn(column as list, ...) -> {column: list or array}; fn keeps or changes the number of rows.

    Column names of df must be distinct; fn gets them in order.
    """
    arrow = df.sparkSession.createDataFrame([], schema).schema
    fields = [(f.name, _arrow_type(f.dataType.simpleString())) for f in arrow]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(*(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=t) for n, t in fields], names=[n for n, _ in fields])

    return map_batches(df, run, schema)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow in batches of BATCH_ROWS rows at most.

    Spark reads that bound when the plan runs, so it stays set in the session; smaller ones are left as they are.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(rows)) <= BATCH_ROWS:
        df.sparkSession.conf.set(rows, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def _arrow_type(name: str) -> pa.DataType:
    plain = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    if name.startswith("array<"):
        return pa.list_(_arrow_type(name[6:-1]))
    if name.startswith("struct<"):
        return pa.struct([(f.split(":")[0], _arrow_type(f.split(":")[1])) for f in name[7:-1].split(",")])
    return plain[name]


def words_lower(text: str | None) -> list[bytes]:
    """Words of `[^\\x20\\x09-\\x0D]+` as UTF-8, A-Z lower-cased; bytes.lower and bytes.split know ASCII alone."""
    return text.encode("utf-8", "replace").lower().split() if text else []


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(hashes: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """A hash of each window of `size` words, in order; none if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = hashes[:n].copy()
    for k in range(1, size):
        h = h * _STEP + hashes[k : n + k]
    return mix(h)


def shingle_sequence(words: list[bytes]) -> np.ndarray:
    """Hashes of the shingles in order; fewer words than a shingle make one, of the whole sequence; no words, none."""
    if 0 < len(words) < SHINGLE_WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    return window_hashes(word_hashes(words))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_sequence(words_lower(text)))


def coefficients(k: int, seed: int) -> np.ndarray:
    """Odd multipliers of k hash functions."""
    return mix(np.arange(1, k + 1, dtype=np.uint64) * _STEP + np.uint64(seed)) | np.uint64(1)


def with_id(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, under fixed names: other columns of df can't clash with its own."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def one_text(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), where rows that repeat an id all have the largest of its texts."""
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not again.take(1):
        return docs
    largest = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("largest"))
    return docs.join(largest, "doc_id", "left").select("doc_id", F.coalesce("largest", "text").alias("text"))
