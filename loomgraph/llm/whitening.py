"""Embedding whitening (operator 12): the covariance of a large table of vectors by tiles.

Vectors are digitised to whole numbers and each distinct one is fitted once. Distinct vectors are gathered to row blocks, cut
to column blocks and dealt out by row block; where the column blocks of a row block meet, each pair of them is multiplied to
a tile of the covariance, tiles are summed in the task and then by their key, a pair of blocks of dimensions. Only the
sums of the tiles, of the size of dimensions squared, reach the driver, which puts them together and takes the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import map_batches, written

#: x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000

COMPONENTS = 16

#: Dimensions of a column block, entries of a row block at most, and the groups in which a tile's sums are added up first.
TILE = 128
BLOCK = 1_000_000
GROUPS = 32

#: Eigenvalues below this share of the largest, times the dimensions, are rounding: no component.
RANK = 1e-13

#: How the entries of a vector are kept: the narrowest of these that holds x - OFFSET.
WIDTHS = ("<i2", "<i4", "<i8")


def digitised(vectors: pa.Array) -> list[bytes | None]:
    """x - OFFSET of each vector as bytes; None where it is null or holds a null or a value that isn't finite.

    Entries beyond the range of 64 bits after scaling are held at its ends.
    """
    vectors = vectors.cast(pa.list_(pa.float64()))
    n, sizes = len(vectors), vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)  # a null entry becomes nan
    starts = np.concatenate([[0], np.cumsum(sizes)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    keep = (bad[starts[1:]] == bad[starts[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False)
    with np.errstate(all="ignore"):
        scaled = np.floor(SCALE * np.where(np.isfinite(flat), flat, 0.0))
    edge = 2.0**62
    x = np.clip(scaled, -edge, edge).astype(np.int64)
    most = np.maximum.reduceat(np.abs(np.append(x, 0)), np.minimum(starts[:-1], len(x))) if n else np.empty(0, np.int64)
    kinds = np.where(most < 2**15, 0, np.where(most < 2**31, 1, 2))
    out: list[bytes | None] = [None] * n
    for kind in np.unique(kinds[keep]):
        raw, width = x.astype(WIDTHS[kind]).tobytes(), int(WIDTHS[kind][2])
        for k in np.flatnonzero(keep & (kinds == kind)).tolist():
            out[k] = raw[starts[k] * width : starts[k + 1] * width]
    return out


def _numbers(raw: bytes, size: int) -> np.ndarray:
    """The entries of `size` numbers in one of WIDTHS."""
    return np.frombuffer(raw, WIDTHS[(len(raw) // size).bit_length() - 2]).astype(np.int64)


def digits(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, size, x) of the vectors that are whole: their length, and entries as of digitised()."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).value_lengths().cast(pa.int32()), pa.array(digitised(batch.column(1)), pa.binary())], names=["vec_id", "size", "x"])
            yield out.filter(out.column(2).is_valid())

    return map_batches(rows, run, "vec_id long, size int, x binary")


def row_blocks(fit: DataFrame, size: int) -> DataFrame:
    """(rows, x) of distinct vectors (x): x - OFFSET of up to BLOCK // size vectors, one after the other."""
    most = max(1, BLOCK // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[np.ndarray] = []

        def full() -> pa.RecordBatch:
            x = np.stack(block)
            width = WIDTHS[int(np.abs(x).max() >= 2**15) + int(np.abs(x).max() >= 2**31)]
            out = pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([x.astype(width).tobytes()], pa.binary())], names=["rows", "x"])
            block.clear()
            return out

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                block.append(_numbers(raw, size))
                if len(block) == most:
                    yield full()
        if block:
            yield full()

    return map_batches(fit, run, "rows int, x binary")


def column_sums(blocks: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and sum of x - OFFSET in each dimension, as whole numbers of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, low, high = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = _numbers(raw, n * size).reshape(n, size)
                rows += n
                low += (x & 0xFFFFFFFF).sum(axis=0)
                high += (x >> 32).sum(axis=0)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([rows] * size, pa.int64()), pa.array(low), pa.array(high)], names=["dim", "rows", "low", "high"])

    sums = map_batches(blocks.select("rows", "x"), run, "dim int, rows long, low long, high long")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = sums.groupBy("dim").agg(total("rows"), total("low"), total("high")).orderBy("dim").collect()  # one row for each dimension
    return (int(rows[0].rows), [(int(r.high) << 32) + int(r.low) for r in rows]) if rows else (0, [])


def _summed(tiles: DataFrame) -> DataFrame:
    """(i, j, tile): the tiles of each key in a task added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tile = np.frombuffer(raw, "<f8")
                total[i, j] = total[i, j] + tile if (i, j) in total else tile
        yield from _tile_rows(total)

    return map_batches(tiles.select("i", "j", "tile"), run, "i int, j int, tile binary")


def _tile_rows(total: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (i, j), tile in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([tile.astype("<f8").tobytes()], pa.binary())], names=["i", "j", "tile"])


def covariance(blocks: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    """The covariance of the rows of blocks (rows, x), divisor n, centred by `mean` (of x - OFFSET) before it is multiplied."""
    size = len(mean)
    edges = list(range(0, size, TILE))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, rows, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(raw, WIDTHS[(len(raw) // (rows * size)).bit_length() - 2]).reshape(rows, size)
                parts = [np.ascontiguousarray(x[:, k : k + TILE]).tobytes() for k in edges]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(edges), pa.int64()), pa.array([rows] * len(edges), pa.int32()), pa.array(range(len(edges)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "rows", "i", "x"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        have: dict[int, np.ndarray] = {}
        now = None
        for batch in batches:
            for block, rows, i, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    have, now = {}, block
                middle = mean[edges[i] : edges[i] + TILE]
                x = _numbers(raw, rows * len(middle)).reshape(rows, -1) - middle
                have[i] = x
                for j, y in have.items():  # tiles (j, i), j <= i, since blocks come in order
                    tile = (y.T @ x).ravel()
                    total[j, i] = total[j, i] + tile if (j, i) in total else tile
        yield from _tile_rows(total)

    # a row block's own bytes name it: a task that is run again gives the same blocks, whatever their order
    keyed = blocks.select(F.xxhash64("x").alias("block"), "rows", "x")
    dealt = map_batches(keyed, cut, "block long, rows int, i int, x binary").repartition("block").sortWithinPartitions("block", "rows", "i")
    tiles = map_batches(dealt, multiply, "i int, j int, tile binary").withColumn("group", F.spark_partition_id() % GROUPS)
    tiles = _summed(_summed(tiles.repartition("i", "j", "group")).repartition("i", "j"))
    out = np.zeros((size, size))
    for r in tiles.collect():  # all tiles together are of the size of the covariance
        a, b = edges[r.i], edges[r.j]
        tile = np.frombuffer(r.tile, "<f8").reshape(min(TILE, size - a), -1)
        out[a : a + TILE, b : b + TILE] = tile
        out[b : b + TILE, a : a + TILE] = tile.T
    return out / n


def projection(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, components) weights that project on unit eigenvectors over sqrt(e), and the shares e / trace; largest eigenvalue first."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(0.0, values.max(initial=0.0)) * RANK * max(1, len(v))] if len(v) else order
    signs = np.sign(vectors[np.abs(vectors[:, order]).argmax(axis=0), order]) if len(order) else np.empty(0)
    return vectors[:, order] * signs / np.sqrt(values[order]), values[order] / np.trace(v) if len(order) else np.empty(0)


def identity_error(blocks: DataFrame, n: int, mean: np.ndarray, weights: np.ndarray) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    size, k = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for rows, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                y = (_numbers(raw, rows * size).reshape(rows, size) - mean) @ weights
                tile = np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])
                total[0, 0] = total[0, 0] + tile if total else tile
        yield from _tile_rows(total)

    parts = map_batches(blocks.select("rows", "x"), run, "i int, j int, tile binary").withColumn("group", F.spark_partition_id() % GROUPS)
    parts = [np.frombuffer(r.tile, "<f8") for r in _summed(parts.repartition("i", "j", "group")).collect()]  # GROUPS rows at most
    both, middle = sum(p[: k * k] for p in parts).reshape(k, k) / n, sum(p[k * k :] for p in parts) / n
    return float(np.abs(both - np.outer(middle, middle) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Of each row of x the sum over dimensions of (n * x - S)**2; None where a long doesn't hold it."""
    s = np.array(sums, object)
    largest = n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums), default=0)
    if len(sums) * largest**2 < 2**63:
        d = n * x - s.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    # dimensions far from 0 but near their mean: only the differences have to fit
    base = [v // n for v in sums]
    near = x.astype(object) - np.array(base, object)
    rest = np.array([v - n * b for v, b in zip(sums, base, strict=True)], object)
    exact = ((n * near - rest) ** 2).sum(axis=1).tolist()
    return [v if v < 2**63 else None for v in exact]


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each whole vector and component.

    Vectors that are null or hold nulls or values that aren't finite are dropped; so are those whose length isn't the one
    that most vectors have (of equally frequent ones the longest), as they have no place in one covariance, and those of length 0.
    Rows that repeat are projected each and fitted once; a null vec_id is kept. Directions without variance are no
    components: an empty table, or one distinct vector, gives no rows. deviation is null where a long doesn't hold it.
    """
    spark, rows = embeddings.sparkSession, digits(embeddings, id_col, vector_col)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    most = rows.where("size > 0").groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    size = most["size"]
    rows = rows.where(F.col("size") == size)
    blocks = written(row_blocks(rows.select("x").distinct(), size), "blocks")
    n, sums = column_sums(blocks, size)
    mean = np.array([s / n for s in sums])
    weights, explained = projection(covariance(blocks, n, mean), components)
    if not len(explained):
        return spark.createDataFrame([], schema)
    error = identity_error(blocks, n, mean, weights)
    k = len(explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([_numbers(raw, size) for raw in batch.column(1).to_pylist()])
            each = lambda c, kind: pa.array(c, kind).take(np.repeat(np.arange(len(x)), k))
            y = (x - mean) @ weights
            m = len(x) * k
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(m, n), each(deviations(x, n, sums), pa.int64()), y.ravel(), np.tile(explained, len(x)), np.full(m, error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_batches(rows.select("vec_id", "x"), run, schema)
