"""Exact order statistics, quantiles and samples of exact size, by narrowing histograms: no sort and no task with all values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import checkpointed

#: Buckets of a histogram, and groups whose statistics are looked for at once, at most: both bound what reaches the driver.
BUCKETS = 512
MAX_GROUPS = 10_000


def _spread(v: Column) -> Column:
    """A monotone scale on which values of very different sizes lie apart."""
    return F.signum(v) * F.log1p(F.abs(v))


def order_statistics(values: DataFrame, ranks: list[tuple[str, int]]) -> dict[tuple[str, int], float]:
    """The values at ranks (group, from 0) of values (grp string, v double), which has no nulls and is read several times.

    Each pass counts the buckets of what is still possible for each rank and goes on with the values of one of them, by even steps
    or on a scale of logarithms in turn. Ranks beyond a group have no entry.
    """
    spark = values.sparkSession
    ends = values.groupBy("grp").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ends = {r.grp: r for r in ends.where(F.col("grp").isin(sorted({g for g, _ in ranks}))).collect()}  # MAX_GROUPS rows at most
    todo = {(g, k): (k, ends[g].low, ends[g].high) for g, k in set(ranks) if g in ends and 0 <= k < ends[g].n}
    found = {key: high if rank == ends[key[0]].n - 1 else low for key, (rank, low, high) in todo.items() if low == high or rank in (0, ends[key[0]].n - 1)}
    todo = {key: x for key, x in todo.items() if key not in found}
    turn = 0
    while todo:
        keys = list(todo)
        wanted = spark.createDataFrame([(i, key[0], float(todo[key][1]), float(todo[key][2])) for i, key in enumerate(keys)], "target int, grp string, low double, high double")
        v, low, high = F.col("v"), F.col("low"), F.col("high")
        even = (v / 2 - low / 2) / (high / 2 - low / 2)
        logs = (_spread(v) - _spread(low)) / (_spread(high) - _spread(low))
        share = F.when(_spread(high) > _spread(low), logs).otherwise(even) if turn % 2 else even
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).alias("bucket")
        near = values.join(F.broadcast(wanted), "grp").where((v >= low) & (v <= high))  # a row for each rank
        rows = near.groupBy("target", bucket).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("target", "bucket").collect()
        turn += 1
        seen = dict.fromkeys(range(len(keys)), 0)
        for r in rows:
            key, before = keys[r.target], seen[r.target]
            seen[r.target] += r.n
            rank = todo[key][0] if key in todo and key not in found else -1
            if before <= rank < before + r.n:
                if r.low == r.high or rank in (before, before + r.n - 1):
                    found[key] = r.low if rank == before else r.high
                else:
                    todo[key] = (rank - before, r.low, r.high)
                    seen[r.target] = math.inf  # the rest lies above
        todo = {key: x for key, x in todo.items() if key not in found}
    return found


def exact_quantiles(df: DataFrame, value: str, q: float, group: str | None = None) -> dict[str, float]:
    """The quantile q of a column in each group (or of all, under `""`), between two values in a straight line, as percentile() gives it.

    Nulls and NaN don't count; a group without values, or null, has no entry. The groups are few: more than MAX_GROUPS are refused.
    df should be cheap to read.
    """
    grp = F.col(group).cast("string") if group else F.lit("")
    v = F.col(value).cast("double")
    rows = df.select(grp.alias("grp"), v.alias("v")).where("grp IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    counts = rows.groupBy("grp").count().limit(MAX_GROUPS + 1).collect()
    if len(counts) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    at = {r.grp: (r["count"] - 1) * q for r in counts}
    got = order_statistics(rows, [(g, k) for g, x in at.items() for k in {math.floor(x), math.ceil(x)}])
    line = lambda x, low, high: low if math.floor(x) == math.ceil(x) else (math.ceil(x) - x) * low + (x - math.floor(x)) * high
    return {g: line(x, got[g, math.floor(x)], got[g, math.ceil(x)]) for g, x in at.items()}


def at_least_quantile(df: DataFrame, value: str, q: float, group: str | None = None) -> DataFrame:
    """Rows whose value reaches the quantile q of its group, or of all; df is written first, since it is read several times."""
    df = checkpointed(df)
    edges = exact_quantiles(df, value, q, group)
    if not group:
        return df.where(F.col(value) >= edges.get("", 0.0))
    rows = df.sparkSession.createDataFrame(list(edges.items()), "__grp string, __edge double")
    joined = df.join(F.broadcast(rows), F.col(group).cast("string") == F.col("__grp"))  # MAX_GROUPS rows at most
    return joined.where(F.col(value) >= F.col("__edge")).drop("__grp", "__edge")


def hashed(seed: int, *keys: str) -> Column:
    """A number from 0 to 2**52 - 1 by seed and keys, alike in every engine that knows MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")


def exact_sample(df: DataFrame, sizes: dict[str, int], group: str, keys: list[str], seed: int = 42) -> DataFrame:
    """Of each group named in sizes, that many rows with the smallest hashes of keys, or all it has.

    The same rows in any partitioning, as long as keys tell rows apart; of rows that share the last hash, those of the smallest keys.
    """
    df = checkpointed(df.withColumns({"__grp": F.col(group).cast("string"), "__hash": hashed(seed, *keys)}))
    values = df.select(F.col("__grp").alias("grp"), F.col("__hash").alias("v")).where("grp IS NOT NULL")
    counts = {r.grp: r["count"] for r in values.where(F.col("grp").isin(list(sizes))).groupBy("grp").count().collect()}  # as many as sizes
    last = order_statistics(values, [(g, min(k, counts.get(g, 0)) - 1) for g, k in sizes.items() if min(k, counts.get(g, 0)) > 0])
    rows = df.sparkSession.createDataFrame([(g, float(v), int(k) + 1) for (g, k), v in last.items()], "__grp string, __last double, __want long")
    near = df.join(F.broadcast(rows), "__grp").where("__hash <= __last")  # a row for each group
    below = near.where("__hash < __last")
    inside = below.groupBy("__grp").agg(F.count("*").alias("__in"))
    from pyspark.sql import Window

    order = Window.partitionBy("__grp").orderBy(*keys)
    ties = near.where("__hash = __last").join(F.broadcast(inside), "__grp", "left").withColumn("__at", F.row_number().over(order))  # rows of one hash
    ties = ties.where(F.col("__at") <= F.col("__want") - F.coalesce("__in", F.lit(0)))
    return below.select(*df.columns).union(ties.select(*df.columns)).drop("__grp", "__hash")


def training_set(positives: DataFrame, negatives: DataFrame, ratio: float, keys: list[str], text: str = "abstract", seed: int = 42) -> DataFrame:
    """Rows of both with label 1 and 0: of the negatives at most ratio times as many as there are positives, by exact_sample().

    Rows of both have the same columns. Rows with a blank text are left out after the draw.
    """
    both = checkpointed(positives.withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0))))
    counts = {r.label: r["count"] for r in both.groupBy("label").count().collect()}  # two rows
    sizes = {"1": counts.get(1, 0), "0": min(counts.get(0, 0), math.floor(counts.get(1, 0) * ratio))}
    return exact_sample(both, sizes, "label", keys, seed).where(F.trim(text) != "")
