"""Importance resampling towards a target distribution (operator 11).

Features are the runs of one to three words of a text, hashed to buckets by CRC. Each task unnests the words of its texts
and windows them to n-grams in DuckDB, with zlib's CRC as a registered function; what it counts in each bucket is spilled
to Parquet in the shared folder. Spark merges the counts, turns them into a gain for each bucket, and the same SQL sums up
the gains of a document's features. Documents are drawn by weight and a hash of their id (Gumbel's trick), so that a
run can be repeated and any partitioning draws the same ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import map_batches, with_id, written

BUCKETS = 10_000

#: Words that a drawn document has at least.
LEAST_WORDS = 20

#: Characters of the texts that DuckDB gets at once, and from which a text is cut into parts. Neither changes a result.
AT_ONCE = 4_000_000
PART = 1_000_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD, _GAP = re.compile(WORD), re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")

#: The polynomial of zlib's CRC (a fixed value), and the lengths in bytes for which joining has tables.
POLYNOMIAL = 0xEDB88320
TABLED = 96

#: (part, c, cc, ccc): the CRC of each word and of the two and three words from it on, null beyond a part's end. DuckDB
#: runs on one thread and keeps the order of rows, so a window without an order looks at the next words.
GRAMS = f"""
WITH coded AS (SELECT part, unnest(zlib_crcs(regexp_extract_all(text, '{WORD}'))) AS x FROM texts),
words AS (SELECT part, x & 4294967295 AS c, x >> 32 AS n FROM coded),
follow AS (SELECT part, c, lead(c, 1) OVER () AS c2, lead(n, 1) OVER () AS n2, lead(part, 1) OVER () AS p2,
           lead(c, 2) OVER () AS c3, lead(n, 2) OVER () AS n3, lead(part, 2) OVER () AS p3 FROM words),
pairs AS (SELECT part, c, CASE WHEN p2 = part THEN zlib_join(c, c2, n2) END AS cc, c3, n3, p3 FROM follow),
grams AS (SELECT part, c, cc, CASE WHEN p3 = part THEN zlib_join(cc, c3, n3) END AS ccc FROM pairs),
features AS (SELECT part, unnest([c, cc, ccc]) % {BUCKETS} AS bucket FROM grams)
"""
COUNTS = f"{GRAMS} SELECT bucket, sum(sign(part))::BIGINT AS n FROM features WHERE bucket IS NOT NULL GROUP BY bucket"
WEIGHTS = f"""{GRAMS}, valued AS (SELECT part, cc, ccc, getvariable('gains')[c % {BUCKETS} + 1] AS a, getvariable('gains')[cc % {BUCKETS} + 1] AS b,
           getvariable('gains')[ccc % {BUCKETS} + 1] AS d FROM grams),
each AS (SELECT part, count(*) AS n_words, count(*) + count(cc) + count(ccc) AS n_features, sum(a + coalesce(b, 0) + coalesce(d, 0)) AS weight FROM valued GROUP BY part)
SELECT doc, sum(sign(part) * n_words)::BIGINT AS n_words, sum(sign(part) * n_features)::BIGINT AS n_features, sum(sign(part) * weight)::BIGINT AS weight
FROM parts JOIN each USING (part) GROUP BY doc"""


def _joining() -> tuple[np.ndarray, np.ndarray]:
    """For n < TABLED: what n further bytes make of each of a CRC's four bytes, and the CRC of a space moved by n bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1)
    on = lambda c: (c >> np.uint32(8)) ^ byte[c & np.uint32(255)]
    shift = np.empty((TABLED, 4, 256), np.uint32)
    shift[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
    space = np.full(TABLED, zlib.crc32(b" "), np.uint32)
    for n in range(1, TABLED):
        shift[n], space[n] = on(shift[n - 1]), on(space[n - 1])
    return shift.ravel(), space


_SHIFT, _SPACE = _joining()


def _moved(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs with n bytes to come after them; n < TABLED."""
    at, c = n << 10, c.astype(np.int64)
    out = _SHIFT.take(at + (c & 255)) ^ _SHIFT.take(at + (c >> 8 & 255) + 256)
    return out ^ _SHIFT.take(at + (c >> 16 & 255) + 512) ^ _SHIFT.take(at + (c >> 24) + 768)


def joined_crc(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRC of a, a space and b, of those of a and b and of b's length in bytes."""
    n = np.asarray(n, np.int64)
    if len(n) and n.max() >= TABLED - 1:  # a long word, in steps
        first, space, left = _moved(np.asarray(first), np.ones_like(n)), np.full(len(n), zlib.crc32(b" "), np.uint32), n
        while left.any():
            step = np.minimum(left, TABLED - 1)
            first, space, left = _moved(first, step), _moved(space, step), left - step
        return first ^ space ^ np.asarray(second).astype(np.uint32)
    return _moved(np.asarray(first), n + 1) ^ _SPACE.take(n) ^ np.asarray(second).astype(np.uint32)


def _chunks(column) -> list[pa.Array]:
    return column.chunks if isinstance(column, pa.ChunkedArray) else [column]


def _codes(words: pa.StringArray) -> np.ndarray:
    """length << 32 | CRC of each word, read where Arrow has its bytes."""
    if not len(words):
        return np.empty(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw, at = words.buffers()[2].to_pybytes(), ends.tolist()
    crcs = np.fromiter(map(zlib.crc32, map(raw.__getitem__, map(slice, at, at[1:]))), np.int64, len(words))
    return np.diff(ends) << 32 | crcs


def _word_crcs(lists) -> pa.Array:
    """Of each list of words: length in bytes and CRC of each word, as length << 32 | CRC."""
    out = []
    for chunk in _chunks(lists):
        coded = chunk.flatten().cast(pa.string()).dictionary_encode()  # a word that recurs is hashed once
        codes = _codes(coded.dictionary)
        values = codes[coded.indices.to_numpy()] if len(codes) else codes
        sizes = pc.fill_null(pc.list_value_length(chunk), 0).to_numpy()
        out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values)))
    return pa.chunked_array(out, pa.list_(pa.int64())).combine_chunks() if out else pa.array([], pa.list_(pa.int64()))


def _joined(first, second, n) -> pa.Array:
    columns = ([c.to_numpy(zero_copy_only=False) for c in _chunks(x)] for x in (first, second, n))
    return pa.array(joined_crc(*(np.concatenate(c) if c else np.empty(0, np.int64) for c in columns)).astype(np.int64))


_CONNECTED: list[duckdb.DuckDBPyConnection] = []


def connection() -> duckdb.DuckDBPyConnection:
    """The worker's own database in memory, on one thread and with the CRC functions."""
    if not _CONNECTED:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": "", "preserve_insertion_order": True})
        con.create_function("zlib_crcs", _word_crcs, ["VARCHAR[]"], "BIGINT[]", type="arrow")
        con.create_function("zlib_join", _joined, ["BIGINT", "BIGINT", "BIGINT"], "BIGINT", type="arrow")
        _CONNECTED.append(con)
    return _CONNECTED[0]


def parts_of(text: str) -> Iterator[tuple[str, int]]:
    """(part, sign): parts whose features, added and taken away, are those of the text.

    A very long text is cut between words. A part has the next two words too, and what these alone make is taken away.
    """
    start = 0
    while len(text) - start > PART and (gap := _GAP.search(text, start + PART)):
        ahead = [m.end() for m in islice(_WORD.finditer(text, gap.start()), 2)]
        if not ahead:
            break
        yield text[start : ahead[-1]], 1
        yield text[gap.start() : ahead[-1]], -1
        start = gap.start()
    yield text[start:], 1


def _loaded(texts: list[str | None]) -> duckdb.DuckDBPyConnection:
    """The database with tables texts (part, text), A-Z in lower case, and parts (part, doc); a part taken away has a number below 0."""
    rows = [(doc, sign, part) for doc, text in enumerate(texts) if text for part, sign in parts_of(text)]
    con = connection()
    ids = pa.array([sign * k for k, (_, sign, _) in enumerate(rows, 1)], pa.int64())
    con.register("texts", pa.table({"part": ids, "text": pc.ascii_lower(pa.array([part for *_, part in rows], pa.large_string()))}))
    con.register("parts", pa.table({"part": ids, "doc": pa.array([doc for doc, *_ in rows], pa.int64())}))
    return con


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(ids, texts) of at least AT_ONCE characters, or of what is left."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids.append(key)
            texts.append(text)
            size += len(text or "")
            if size >= AT_ONCE:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n): features of docs (doc_id, text) in each bucket, a row for each task that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, texts in _gathered(batches):
            found = _loaded(texts).sql(COUNTS).to_arrow_table()
            total[found["bucket"].to_numpy()] += found["n"].to_numpy()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return map_batches(docs, run, "bucket long, n long")


def bucket_gains(spark: SparkSession, corpus: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of every bucket from counts (bucket, n): how much likelier its features are in the target, floor(1000 * ln)."""
    merged = lambda df, name: df.groupBy("bucket").agg(F.sum("n").alias(name))
    both = spark.range(BUCKETS).withColumnRenamed("id", "bucket").join(merged(corpus, "s"), "bucket", "left").join(merged(target, "t"), "bucket", "left").na.fill(0)
    both = written(both, "buckets")
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    real = lambda c: F.col(c).cast("double")
    ratio = (real("t") + 1) * (real("all_s") + BUCKETS) / ((real("s") + 1) * (real("all_t") + BUCKETS))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))  # one row


def weighted(docs: DataFrame, gains: list[int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connection().execute("SET VARIABLE gains = ?", [shared.value])
        for ids, texts in _gathered(batches):
            found = _loaded(texts).sql(WEIGHTS).to_arrow_table()
            out = np.zeros((3, len(ids)), np.int64)
            out[:, found["doc"].to_numpy()] = [found[c].to_numpy() for c in ("n_words", "n_features", "weight")]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, out)], names=["doc_id", "n_words", "n_features", "weight"])

    return map_batches(docs, run, "doc_id long, n_words long, n_features long, weight long")


def scored(weights: DataFrame, seed: int) -> DataFrame:
    """weights with score: weight + floor(-1000 * ln(-ln(u))), u from a hash of seed and doc_id; null where doc_id is."""
    key = F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return weights.withColumn("score", F.col("weight") + F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))))


def drawn(rows: DataFrame, percent: int) -> DataFrame:
    """rows (doc_id, n_words, n_features, weight, score) with rank.

    Of those with LEAST_WORDS words or more, and an id, floor(percent * N / 100) are drawn. Rows are dealt out by ranges of
    their order and counted in each; only the ranges' sizes meet in one task.
    """
    fit = (F.col("n_words") >= LEAST_WORDS) & F.col("score").isNotNull()
    order = [F.desc("score"), "doc_id", "n_features", "weight", "n_words"]
    dealt = written(rows.where(fit).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))  # one row for each range
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    wanted = sizes.agg(F.floor(F.coalesce(F.sum("__n"), F.lit(0)) * percent / 100).alias("__wanted"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    placed = dealt.withColumn("__at", place).join(F.broadcast(starts), "__part").crossJoin(F.broadcast(wanted))  # a row for each range; one row
    rank = F.col("__before") + F.col("__at")
    placed = placed.withColumn("rank", F.when(rank <= F.col("__wanted"), rank).cast("long")).select(*rows.columns, "rank")
    return placed.union(rows.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def resampled(documents: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of documents; rank is null where it isn't drawn.

    A null or empty text has no features and weighs 0. Rows that repeat count and are drawn each, rows of one id and score
    by n_features. A row without an id has no score and isn't drawn. Without target texts only the hash and the corpus
    decide. Other columns are ignored.
    """
    spark = documents.sparkSession
    docs = with_id(documents, id_col, text_col)
    wanted = target.select(F.xxhash64(target_id).alias("doc_id"), F.col(target_text).cast("string").alias("text"))
    counts = [written(bucket_counts(rows), name) for name, rows in (("corpus-buckets", docs), ("target-buckets", wanted))]
    gains = [r.gain for r in bucket_gains(spark, *counts).orderBy("bucket").collect()]  # BUCKETS rows
    weights = written(scored(weighted(docs, gains), seed), "weights")
    return drawn(weights, percent).select("doc_id", "n_features", "weight", "score", "rank")
