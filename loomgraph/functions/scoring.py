"""Source weights, relation types, scores and normalisation as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.params import CHART_RELATION_TYPES, OTHER_PRIOR, RELATION_TYPES, SAME_TYPE_PRIOR, TYPE_PAIR_PRIOR, SourceWeights


def lookup(table: dict) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))


def source_hits(source: Column, p: SourceWeights) -> Column:
    """Distinct keys that a source field names: exactly, or else the longest key within a part of it."""

    def token(t: Column) -> Column:
        t = F.lower(F.trim(t))
        if p.after_colon:
            t = F.substring_index(F.replace(t, F.lit(" "), F.lit("")), "__", 1)
            t = F.when(t.contains(":"), F.regexp_replace(t, "^[^:]*:", "")).otherwise(t)
        else:
            t = F.replace(F.substring_index(t, "__", 1), F.lit(" "), F.lit(""))
        t = F.btrim(t, F.lit("[]()"))
        return F.coalesce(F.try_element_at(lookup(p.aliases), t), t)

    keys = F.array(*map(F.lit, p.keys()))
    hit = lambda t: F.when(F.array_contains(keys, t), t).when(t != "", F.get(F.filter(keys, lambda k: t.contains(k)), 0))
    return F.array_distinct(F.array_compact(F.transform(F.transform(F.split(F.coalesce(source, F.lit("")), "[;,|]+"), token), hit)))


def weight_of(hits: Column, p: SourceWeights) -> Column:
    best = F.array_max(F.transform(hits, lambda h: F.try_element_at(lookup(p.weights), h)))
    return F.greatest(best, F.lit(p.default)) if p.floor else F.coalesce(best, F.lit(p.default))


def with_source_weights(df: DataFrame, p: SourceWeights, column: str = "source") -> DataFrame:
    """df with hits and w, by the rules on each row: no join. Rows are best counted by their source before."""
    return df.withColumn("hits", source_hits(F.col(column), p)).withColumn("w", weight_of(F.col("hits"), p))


def relation_type(text: Column) -> Column:
    """One of five types by its spellings in any case, else the text itself; null as empty."""
    spelled = {a: canon for canon, names in RELATION_TYPES.items() for a in names}
    raw = F.trim(F.coalesce(text, F.lit("")))
    return F.coalesce(F.try_element_at(lookup(spelled), F.lower(raw)), raw)


def chart_relation_type(text: Column) -> Column:
    """One of five types by its spellings in their own case, else `Unknown`."""
    spelled = {a: canon for canon, names in CHART_RELATION_TYPES.items() for a in names}
    return F.coalesce(F.try_element_at(lookup(spelled), F.trim(F.coalesce(text, F.lit("")))), F.lit("Unknown"))


def min_max(df: DataFrame, columns: dict[str, str], constant: float = 0.0) -> DataFrame:
    """df with each column's values scaled to 0..1 under its new name; a constant column gives `constant`.

    One aggregate over df, a single row that is joined back; never a window over all rows.
    """
    edges = df.agg(*(f(c).alias(f"__{n}_{k}") for k, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max))))
    out = df.crossJoin(F.broadcast(edges))  # one row
    for k, (c, new) in enumerate(columns.items()):
        span = F.col(f"__high_{k}") - F.col(f"__low_{k}")
        out = out.withColumn(new, F.when(span > 0, (F.col(c) - F.col(f"__low_{k}")) / span).otherwise(F.lit(constant)))
    return out.drop(*(f"__{n}_{k}" for k in range(len(columns)) for n in ("low", "high")))


def recency(date: Column, as_of: str, half_life: float) -> Column:
    """0.5 to the age in half-lives; without a date, or with a later one, 1."""
    days = F.datediff(F.to_date(F.lit(as_of)), date)
    return F.when(days > 0, F.pow(F.lit(0.5), days / F.lit(365.25) / F.lit(half_life))).otherwise(1.0)


def type_pair_prior(a: Column, b: Column) -> Column:
    pairs = {f"{x}|{y}": w for (s, t), w in TYPE_PAIR_PRIOR.items() for x, y in ((s, t), (t, s))}
    return F.when(a == b, F.lit(SAME_TYPE_PRIOR)).otherwise(F.coalesce(F.try_element_at(lookup(pairs), F.concat_ws("|", a, b)), F.lit(OTHER_PRIOR)))


def bridge(a: Column, b: Column) -> Column:
    return 2 * a * b / (a + b + F.lit(1e-12))


def precision_recall(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    zero = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    p, r = zero(tp, tp + fp), zero(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": zero(2 * p * r, p + r)}
