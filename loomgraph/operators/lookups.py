"""Look-ups that try several ways: keys in order, and patterns by the characters that they need."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the pieces by which names are looked up for patterns.
GRAM = 3


def first_hit(rows: DataFrame, table: DataFrame, row_id: str, steps: list[tuple[Column, Column]], value: Column, order: list[Column], more: DataFrame | None = None) -> DataFrame:
    """(row_id, step, value): for each row the table's value by the first of steps (key of a row, key of the table) that hits.

    Of several rows of the table with a key, the first in `order`. more (row_id, step, value) holds hits found in another way.
    Null and blank keys hit nothing; rows without a hit have a null step and value. All steps are one join: rows and
    table give a row for each key that they have.
    """
    def each(df: DataFrame, keys: list[Column], **columns: Column) -> DataFrame:
        tried = F.array(*(F.struct(F.lit(k).alias("step"), key.cast("string").alias("key")) for k, key in enumerate(keys, 1)))
        out = df.select(*(c.alias(n) for n, c in columns.items()), F.explode(tried).alias("x"))
        return out.select(*columns, "x.step", "x.key").where("trim(key) <> ''")

    right = each(table, [k for _, k in steps], __value=value, __order=F.struct(*order))
    right = right.groupBy("step", "key").agg(F.min_by("__value", "__order").alias("value"))
    left = each(rows, [k for k, _ in steps], __row=F.col(row_id))
    hits = left.join(right, ["step", "key"]).select("__row", "step", "value")
    if more is not None:
        hits = hits.unionByName(more.select(F.col(row_id).alias("__row"), "step", "value"))
    best = hits.groupBy("__row").agg(F.min(F.struct("step", "value")).alias("b"))
    return rows.select(row_id).join(best, F.col(row_id) == F.col("__row"), "left").select(row_id, "b.step", "b.value")


def literal_of(pattern: str) -> str:
    """The longest run of plain characters that every match of a simple pattern has, in lower case.

    Groups, classes and what a quantifier makes optional are passed over; a pattern with `|` outside groups has none.
    """
    depth, runs, at = 0, [""], 0
    while at < len(pattern):
        c = pattern[at]
        taken = 2 if c == "\\" else 1
        plain = pattern[at + 1] if c == "\\" and not pattern[at + 1 : at + 2].isalnum() else c if c not in r"\.[](){}*+?|^$" else ""
        if c == "[":
            taken = (pattern.find("]", at + 2) - at + 1) or 1
        depth += (c == "(") - (c == ")")
        after = pattern[at + taken : at + taken + 1]
        if c == "|" and not depth:
            return ""
        if plain and not depth and after not in ("?", "*", "{"):
            runs[-1] += plain
        else:
            runs.append("")
        if plain and after == "+":
            runs.append("")
        at += taken
    return max(runs, key=len).translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def _low(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _grams(text: Column, n: int) -> Column:
    """All runs of n characters; a shorter text has none."""
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def matched_patterns(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(entity_id, seed) of names (entity_id, name) that a pattern (seed, pattern, needs) matches somewhere.

    needs lists texts of which every match has at least one, A-Z in any case, and none of which is empty. Each is looked up
    by its piece of GRAM characters that the fewest names have; only names with that piece meet the pattern. Any number
    of patterns may be given.
    """
    asked = patterns.select("seed", "pattern", F.explode(F.array_distinct(F.transform("needs", _low))).alias("need"))
    asked = asked.withColumn("size", F.least(F.length("need"), F.lit(GRAM)))
    sizes = sorted(r.size for r in asked.select("size").distinct().collect())  # GRAM rows at most
    if sizes and sizes[0] < 1:
        raise ValueError("a pattern needs an empty text")
    own = asked.select("seed", "need", F.explode(F.array_distinct(_sized(F.col("need"), F.col("size"), sizes))).alias("gram")) if sizes else asked.select("seed", "need", F.lit("").alias("gram"))
    low = _low(F.col("name"))
    pieces = F.array_distinct(F.flatten(F.array_compact(F.array(*(_grams(low, n) for n in sizes))))) if sizes else F.array(F.lit(""))
    held = names.select("entity_id", "name", F.explode(pieces).alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi")
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "gram", "left").groupBy("seed", "need").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = held.join(rarest, "gram").join(patterns.select("seed", "pattern"), "seed").where(F.expr("name RLIKE pattern"))
    return found.select("entity_id", "seed").distinct()


def _sized(need: Column, size: Column, sizes: list[int]) -> Column:
    """The pieces of a text, of its own size."""
    return F.coalesce(*(F.when(size == n, _grams(need, n)) for n in sizes))
