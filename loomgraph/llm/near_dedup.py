"""Near duplicates (operator 1): an inverted join on MinHash signature coordinates.

1. Every document gets a signature of K coordinates over its whole set of 5-word shingles. Documents with equal
   sets form one class; its smallest doc_id stands for it from here on.
2. A similarity of 0.75 means that about 3/4 of the K coordinates agree; pairs with at least T agreeing are
   wanted. A class with fewer than T (coordinate, value) pairs that another has too is in no such pair. Of m shared
   ones it is posted under the m - T + 1 rarest: two classes that agree in T coordinates then share one of these
   (prefix merging), and lists of boilerplate, being frequent, are not merged for documents that have rarer coordinates.
3. In each list every class meets the list's leader, its most often posted class; pairs that agree in T coordinates
   are confirmed on the full sets, and the links' components are found. Lists that lie in one component are skipped:
   whatever they hold is joined already (skip merging).
4. Short lists that are left give their pairs across components. In long ones, the classes around one component are
   put together, and shingles that many of them have are told from rare ones. Two classes that share no rare shingle
   have at most their frequent shingles in common, and how many these are is known from a bit for each; only where they
   reach the threshold, or where a rare shingle is shared, are the sets compared. This loses no link, and thousands of
   near copies cost about one pair each.

Agreement is counted on the coordinates' low bytes, eight to a number; the full sets decide. A document that is
compared with many is sent once for each block of BLOCK of them.

At K = 64 and T = 32 a pair of similarity 0.75 is missed with a chance near 3 in a million; the test compares
with brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import MIN_SIMILARITY, by_ids, checkpointed, coefficients, map_batches, map_columns, one_text, shingle_set, with_id, written
from loomgraph.llm.components import connected_components

#: Coordinates of a signature, the least number that must agree, and the length from which a list counts as frequent.
COORDINATES = 64
MATCHES = 32
FREQUENT = 16

#: Documents that are compared with one in a block, classes around one component that are compared side by side, and
#: words of 64 bits for its most frequent shingles.
BLOCK = 64
SIDE = 2000
WORDS = 8


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):  # bounds the memory of very long texts
        low = np.minimum(low, (shingles[None, start : start + 2048] * multipliers[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_hash, sig, low) of docs (doc_id, text); low has the low bytes of sig."""
    multipliers = coefficients(COORDINATES, 1)

    def run(ids: list, texts: list) -> dict:
        sets = [shingle_set(t) for t in texts]
        sigs = [signature(s, multipliers) if len(s) else None for s in sets]
        return {
            "doc_id": ids,
            "n_shingles": [len(s) for s in sets],
            "set_hash": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
            "sig": sigs,
            "low": [None if s is None else s.astype(np.uint8).view(np.int64) for s in sigs],
        }

    return map_columns(docs, run, "doc_id long, n_shingles long, set_hash binary, sig array<int>, low array<bigint>")


def _similar_size(a: str, b: str):
    return F.expr(f"100 * least({a}, {b}) >= {MIN_SIMILARITY} * greatest({a}, {b})")


def _agree(a: str, b: str) -> Column:
    """Whether MATCHES of the low bytes agree, and so also where MATCHES coordinates do."""
    bits = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    bits = F.transform(bits, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 4)))  # each byte's lowest bit becomes the OR of all eight
    bits = F.transform(bits, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 2)))
    bits = F.transform(bits, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1)))
    return F.aggregate(bits, F.lit(0), lambda n, x: n + F.bit_count(x.bitwiseAND(0x0101010101010101))) <= COORDINATES - MATCHES


def _postings(classes: DataFrame) -> DataFrame:
    """(key, doc_id, n, size, leader, n_leader) for each list with two classes or more."""
    keys = F.transform("sig", lambda v, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(v.cast("long").bitwiseAND(0xFFFFFFFF)))
    single = classes.select("doc_id", F.col("n_shingles").alias("n"), F.explode(keys).alias("key"))
    shared = single.groupBy("key").agg(F.count("*").alias("freq")).where("freq > 1")
    own = single.join(shared, "key").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "key"))).alias("own"))  # COORDINATES at most
    own = own.where(F.size("own") >= MATCHES).withColumn("own", F.slice("own", 1, F.size("own") - (MATCHES - 1)))
    often = F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["freq"])
    posts = own.select("doc_id", "n", often.alias("often"), F.explode(F.col("own")["key"]).alias("key"))
    leader = F.max(F.struct("often", (-F.col("doc_id")).alias("id"), "n"))
    lists = posts.groupBy("key").agg(F.count("*").alias("size"), leader.alias("first")).where("size > 1")
    lists = lists.select("key", "size", (-F.col("first.id")).alias("leader"), F.col("first.n").alias("n_leader"))
    return posts.drop("often").join(lists, "key")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the documents in ids."""

    def run(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "shingles": [shingle_set(t).view(np.int64) for t in texts]}

    return map_columns(by_ids(docs, ids, "left_semi").dropDuplicates(["doc_id"]), run, "doc_id long, shingles array<long>")


def _by_common(near: DataFrame) -> DataFrame:
    """Pairs of near (top, doc_id, n, part, low, common, ranked, bits) around one component that share no rare shingle.

    What such a pair has in common is counted on the bits of the component's most frequent shingles; of the others at
    most the smaller number is shared. A partner is at most a third larger, so it lies in the same or the next class of
    sizes; large groups are dealt out in blocks of SIDE, so that no task meets all of one.
    """
    enough = near.where(100 * F.col("common") >= MIN_SIMILARITY * F.col("n"))
    blocks = enough.groupBy("top").agg(F.ceil(F.count("*") / SIDE).alias("blocks"))
    enough = enough.join(blocks, "top").withColumns({"size": F.floor(F.log("n") / F.log(F.lit(100 / MIN_SIMILARITY))), "others": F.col("common") - F.col("ranked")})
    x = enough.withColumn("size", F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1))).withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks"))))
    y = enough.where("part <> top").withColumn("block", 1 + F.pmod(F.xxhash64("doc_id"), "blocks"))
    apart = F.expr("x.top = y.top AND x.size = y.size AND x.block = y.block AND x.part <> y.part AND (x.part = x.top OR x.doc_id < y.doc_id)") & _similar_size("x.n", "y.n")
    fits = F.expr(f"{100 + MIN_SIMILARITY} * least(x.common, y.common) >= {MIN_SIMILARITY} * (x.n + y.n)")
    shared = F.aggregate(F.zip_with("x.bits", "y.bits", lambda v, w: v.bitwiseAND(w)), F.lit(0), lambda n, v: n + F.bit_count(v)) + F.least("x.others", "y.others")
    similar = (100 + MIN_SIMILARITY) * shared >= MIN_SIMILARITY * (F.col("x.n") + F.col("y.n"))
    return x.alias("x").join(y.alias("y"), apart & fits).where(similar).where(_agree("x.low", "y.low")).selectExpr(*_PAIR)


_PAIR = ("least(x.doc_id, y.doc_id) AS hub", "greatest(x.doc_id, y.doc_id) AS doc_id")


def _around(open_: DataFrame, low: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (hub, doc_id) to compare in long lists: rows (top, doc_id, n, part) are the classes around component top."""
    near = checkpointed(open_.select("top", "doc_id", "n", "part").distinct().join(low, "doc_id"))
    sets = checkpointed(_sets(docs, near))
    each = near.select("top", "doc_id").join(sets, "doc_id").select("top", "doc_id", F.explode("shingles").alias("shingle"))
    counts = each.groupBy("top", "shingle").agg(F.count("*").alias("freq"), F.min("doc_id").alias("doc_id"))
    place = F.row_number().over(Window.partitionBy("top").orderBy(F.desc("freq"), "shingle")) - 1
    ranked = counts.where(F.col("freq") > FREQUENT).withColumn("place", place).where(F.col("place") < 64 * WORDS)
    known = counts.where((F.col("freq") > 1) & (F.col("freq") <= FREQUENT)).select("top", "shingle", F.lit(-1).alias("place")).union(ranked.select("top", "shingle", "place"))
    hits = each.join(known, ["top", "shingle"])

    shared = checkpointed(hits.where("place < 0").drop("place"))
    alone = counts.where("freq = 1").select("top", "doc_id")
    rare = alone.union(shared.select("top", "doc_id")).groupBy("top", "doc_id").agg(F.count("*").alias("rare"))
    bit = F.expr("shiftleft(1L, place % 64)")
    words = [F.coalesce(F.bit_or(F.when(F.floor(F.col("place") / 64) == k, bit)), F.lit(0).cast("long")) for k in range(WORDS)]
    bits = hits.where("place >= 0").groupBy("top", "doc_id").agg(F.count("*").alias("ranked"), F.array(*words).alias("bits"))
    near = near.join(rare, ["top", "doc_id"], "left").join(bits, ["top", "doc_id"], "left")
    none = F.array(*(F.lit(0).cast("long") for _ in range(WORDS)))
    near = near.withColumns({"common": F.col("n") - F.coalesce("rare", F.lit(0)), "ranked": F.coalesce("ranked", F.lit(0)), "bits": F.coalesce("bits", none)})
    near = checkpointed(near.drop("rare"))

    shared = shared.join(near.select("top", "doc_id", "n", "part", "low"), ["top", "doc_id"])
    apart = F.expr("x.top = y.top AND x.shingle = y.shingle AND x.part <> y.part AND y.part <> y.top AND (x.part = x.top OR x.doc_id < y.doc_id)") & _similar_size("x.n", "y.n")
    by_rare = shared.alias("x").join(shared.alias("y"), apart).where(_agree("x.low", "y.low")).selectExpr(*_PAIR)
    return by_rare.union(_by_common(near))


def _confirmed(pairs: DataFrame, low: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): of pairs (hub, doc_id), those that agree in MATCHES coordinates and are similar by their full sets."""
    near = pairs.join(low.select(F.col("doc_id").alias("hub"), F.col("low").alias("low_hub")), "hub").join(low, "doc_id")
    near = written(near.where(_agree("low_hub", "low")).select("hub", "doc_id"), "near")
    blocks = near.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = near.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("doc_id"), "blocks").alias("block"), F.lit(1).alias("place"), "doc_id")
    hubs = blocks.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("place"), F.col("hub").alias("doc_id"))
    texts = by_ids(docs, near.select(F.explode(F.array("hub", "doc_id")).alias("doc_id")), "left_semi")
    rows = members.union(hubs).join(texts, "doc_id").select("hub", "block", "place", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.empty(0, np.uint64)
        for batch in batches:
            links = []
            for a, block, place, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not place:
                    hub, own = (a, block), shingle_set(text)
                    continue
                assert hub == (a, block)
                other = shingle_set(text)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * shared >= MIN_SIMILARITY * (len(own) + len(other) - shared):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = rows.repartition("hub", "block").sortWithinPartitions("hub", "block", "place")
    return written(map_batches(dealt, run, "a long, b long"), "links")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of documents.

    Texts without words, and null texts, have no shingles and are linked with nothing. Rows that repeat a doc_id
    are one document, that of the largest of their texts, and each get its result. A null doc_id is
    linked with nothing: its component_id is null and it is kept. Other columns are ignored.
    """
    docs = one_text(with_id(documents, id_col, text_col))
    sig = checkpointed(signatures(docs))
    first = F.min(F.struct("doc_id", "n_shingles", "sig", "low")).alias("first")
    classes = checkpointed(sig.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_hash").agg(first).select("set_hash", "first.*"))
    low = classes.select("doc_id", "low")
    posts = written(_postings(classes), "postings")

    met = posts.where("doc_id <> leader").where(_similar_size("n", "n_leader")).select(F.col("leader").alias("hub"), "doc_id").distinct()
    links = _confirmed(met, low, docs)
    parts = connected_components(links)

    open_ = posts.where("size > 2").join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id"))
    tops = open_.groupBy("key", "part").count().groupBy("key").agg(F.count("*").alias("parts"), F.max_by("part", F.struct("count", "part")).alias("top")).where("parts > 1")
    open_ = written(open_.join(tops, "key").select("key", "size", "doc_id", "n", "part", "leader", "top"), "open")
    short = open_.where(F.col("size") <= FREQUENT)
    x, y = short.alias("x"), short.where("part <> top AND doc_id <> leader").alias("y")
    apart = F.expr("x.key = y.key AND x.part <> y.part AND x.doc_id <> x.leader AND (x.part = x.top OR x.doc_id < y.doc_id)")
    rest = x.join(y, apart & _similar_size("x.n", "y.n")).selectExpr(*_PAIR)
    rest = rest.union(_around(open_.where(F.col("size") > FREQUENT), low, docs)).distinct()
    more = _confirmed(rest, low, docs)
    if more.take(1):
        parts = connected_components(links.union(more))

    members = classes.select("set_hash", F.col("doc_id").alias("rep"))
    out = sig.join(members, "set_hash", "left").join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)))
