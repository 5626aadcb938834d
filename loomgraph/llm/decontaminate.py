"""Benchmark decontamination (operator 8): size-partitioned MinHash containment search, verified exactly.

A short test item and a long document are far from similar even if the one contains the other. So items are
partitioned by size, and for each partition a document is cut into overlapping windows of twice the partition's
largest size: an item of a document lies whole in one of them, and then item and window agree in at least about one
coordinate in six. All sizes come from one pass: minima of eight shingles are joined to those of 16, 32 and so on.

A window is a candidate for the items that have one of its (partition, coordinate, value) keys. A bitmap of the
items' keys, of bounded size, drops most windows at the scan; the rest are joined with the items by key. Candidates
are then verified on the full sets: the share of the item's distinct 5-word shingles that the whole document has.

With 64 coordinates an item that is contained at the threshold of 0.75 is missed with a chance of at most one in
200,000; the test compares with SQL over all pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import MIN_SIMILARITY, by_ids, checkpointed, coefficients, map_columns, mix, one_text, shingle_sequence, shingle_set, with_id, words_lower

COORDINATES = 64
#: Shingles of the smallest block; partitions have 1, 2, 4, ... blocks.
BLOCK = 8
#: Bits of the bitmap for each key of an item, and bits at most (16 MB).
BITS_PER_KEY = 2048
MAX_BITS = 1 << 27

#: Candidates of a document whose shingles are gathered in one row.
ITEMS_AT_ONCE = 64

_A = coefficients(COORDINATES, 8)


def partition_of(length: int) -> int:
    """Of an item of so many shingles: the power of two of blocks that hold it."""
    return max(0, (max(1, -(-length // BLOCK)) - 1).bit_length())


def block_minima(shingles: np.ndarray) -> np.ndarray:
    """Smallest hash of each coordinate (columns) in each block of shingles in order (rows); bounded memory at a time."""
    parts = []
    for start in range(0, len(shingles), 512 * BLOCK):
        part = shingles[start : start + 512 * BLOCK]
        rows = -(-len(part) // BLOCK)
        part = np.concatenate([part, np.repeat(part[-1:], rows * BLOCK - len(part))])
        hashed = (part[:, None] * _A[None, :]) >> np.uint64(32)
        parts.append(hashed.astype(np.uint32).reshape(rows, BLOCK, COORDINATES).min(axis=1))
    return np.concatenate(parts) if parts else np.empty((0, COORDINATES), np.uint32)


def _paired(minima: np.ndarray) -> np.ndarray:
    """Minima of blocks twice as large."""
    if len(minima) % 2:
        minima = np.concatenate([minima, minima[-1:]])
    return np.minimum(minima[::2], minima[1::2])


def keys_of(minima: np.ndarray, partition: int) -> np.ndarray:
    """A number for each (partition, coordinate, value)."""
    place = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32) | np.uint64(partition) << np.uint64(48)
    return mix(minima.astype(np.uint64) | place)


def item_keys(text: str | None) -> tuple[int, np.ndarray]:
    shingles = shingle_sequence(words_lower(text))
    if not len(shingles):
        return 0, np.empty(0, np.uint64)
    partition = partition_of(len(shingles))
    return partition, keys_of(block_minima(shingles).min(axis=0), partition)


def window_keys(text: str | None, partitions: list[int], bitmap: np.ndarray) -> np.ndarray:
    """Distinct keys of a whole text's windows that the bitmap holds, for partitions in rising order."""
    minima = block_minima(shingle_sequence(words_lower(text)))
    found = [np.empty(0, np.uint64)]
    size = 0
    for partition in partitions:
        while size < partition:
            minima, size = _paired(minima), size + 1
        if len(minima):
            windows = np.minimum(minima[:-1], minima[1:]) if len(minima) > 1 else minima
            keys = keys_of(windows, partition).ravel()
            found.append(keys[_held(bitmap, keys)])
    return np.unique(np.concatenate(found))


def _held(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bitmap(keys: DataFrame, n_items: int) -> np.ndarray:
    """The items' keys as bits, OR-ed in Spark; a long benchmark fills it, so that more windows pass, and no more."""
    bits = 1 << min((BITS_PER_KEY * COORDINATES * max(1, n_items)).bit_length(), MAX_BITS.bit_length() - 1)
    words = keys.selectExpr(f"shiftright(key & {bits - 1}L, 5) AS word", "shiftleft(1L, CAST(key & 31 AS INT)) AS bit")
    bitmap = np.zeros(bits // 32, np.uint32)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toLocalIterator():
        bitmap[row.word] = row.bit
    return bitmap.view(np.uint8)


def contained_items(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): pairs where the document has at least 0.75 of the item's distinct shingles.

    Words are split and lower-cased as for near duplicates. An item of fewer than five words is one shingle, its whole
    sequence, and is contained only in a document that is the same sequence. Items without words, and null ids or
    texts on either side, are in no pair. Rows that repeat an id count as one, with the largest of their texts; other
    columns are ignored; empty tables give no pairs.
    """
    docs = one_text(with_id(documents, id_col, text_col).where("doc_id IS NOT NULL"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).dropna()
    items = items.groupBy("item_id").agg(F.max("text").alias("text"))

    def of_items(ids: list, texts: list) -> dict:
        found = [item_keys(t) for t in texts]
        return {"item_id": ids, "part": [p for p, _ in found], "keys": [k.view(np.int64) for _, k in found], "shingles": [shingle_set(t).view(np.int64) for t in texts]}

    items = checkpointed(map_columns(items, of_items, "item_id long, part long, keys array<long>, shingles array<long>").where(F.size("keys") > 0))
    partitions = sorted(r.part for r in items.select("part").distinct().collect())  # a few powers of two
    keys = items.select("item_id", F.explode("keys").alias("key"))
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(keys, items.count()))

    def of_documents(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "keys": [window_keys(t, partitions, bitmap.value).view(np.int64) for t in texts]}

    hits = map_columns(docs, of_documents, "doc_id long, keys array<long>").select("doc_id", F.explode("keys").alias("key"))
    pairs = checkpointed(hits.join(keys, "key").select("doc_id", "item_id").distinct())
    # a document's candidates are verified ITEMS_AT_ONCE or so at a time
    parts = pairs.groupBy("doc_id").agg(F.ceil(F.count("*") / ITEMS_AT_ONCE).alias("parts"))
    dealt = pairs.join(parts, "doc_id").withColumn("part", F.pmod(F.xxhash64("item_id"), "parts"))
    wanted = dealt.join(items.select("item_id", "shingles"), "item_id").groupBy("doc_id", "part").agg(F.collect_list(F.struct("item_id", "shingles")).alias("items")).drop("part")
    texts = by_ids(docs, pairs.select("doc_id").distinct(), "left_semi")

    def verify(ids: list, texts: list, items: list) -> dict:
        out = []
        for text, asked in zip(texts, items, strict=True):
            own = shingle_set(text)
            counted = [(x["item_id"], len(x["shingles"]), int(np.isin(np.array(x["shingles"], np.int64).view(np.uint64), own).sum())) for x in asked]
            out.append([{"item_id": i, "n_item": n, "n_shared": k} for i, n, k in counted if 100 * k >= MIN_SIMILARITY * n])
        return {"doc_id": ids, "items": out}

    found = map_columns(texts.join(wanted, "doc_id").select("doc_id", "text", "items"), verify, "doc_id long, items array<struct<item_id:bigint,n_item:bigint,n_shared:bigint>>")
    return checkpointed(found.select("doc_id", F.explode("items").alias("x")).select("doc_id", "x.*").groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared")))


DECONTAMINATE_SQL = r"""
WITH d AS (
  SELECT doc_id AS id, [x FOR x IN string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+') IF x <> ''] AS w
  FROM (SELECT doc_id, max(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id) x
), b AS (
  SELECT item_id AS id, [x FOR x IN string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+') IF x <> ''] AS w
  FROM (SELECT item_id, max(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id) x
), ds AS (
  SELECT DISTINCT id, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, greatest(len(w) - 3, 2))]) AS s FROM d WHERE len(w) > 0
), bs AS (
  SELECT DISTINCT id, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, greatest(len(w) - 3, 2))]) AS s FROM b WHERE len(w) > 0
), n AS (SELECT id, count(*) AS n_item FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, max(n.n_item) AS n_item, count(*) AS n_shared
FROM ds JOIN bs ON ds.s = bs.s JOIN n ON n.id = bs.id
GROUP BY ds.id, bs.id HAVING 100 * count(*) >= 75 * max(n.n_item)
"""
