import random
from collections import Counter

import numpy as np

from loomgraph.operators import quantiles
from loomgraph.operators.quantiles import exact_quantiles, exact_sample, order_statistics, training_set


def test_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BUCKETS", 4)
    r = random.Random(1)
    groups = {"even": [r.uniform(-5, 5) for _ in range(300)], "ties": [float(r.randrange(3)) for _ in range(200)], "one": [7.0] * 50, "far": [2.0**k for k in range(-300, 300, 10)] + [-(10.0**k) for k in range(0, 300, 20)], "wide": [-1.7e308, 0.0, 1.7e308]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "grp string, v double").repartition(5).cache()
    ranks = [(g, k) for g, vs in groups.items() for k in sorted({0, 1, len(vs) // 2, len(vs) - 1})] + [("none", 0), ("one", 50)]
    assert order_statistics(df, ranks) == {(g, k): sorted(groups[g])[k] for g, k in ranks if g in groups and k < len(groups[g])}


def test_exact_quantiles(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.choice([r.gauss(0, 1), 1.0, None, float("nan")])) for _ in range(500)] + [(None, 3.0), ("empty", None)]
    df = spark.createDataFrame(rows, "kind string, x double").cache()
    good = lambda g: [v for k, v in rows if k == g and v is not None and v == v]
    for q in (0.0, 0.37, 0.5, 0.95, 1.0):
        got = exact_quantiles(df, "x", q, "kind")
        assert got.keys() == {"a", "b"} and all(abs(got[g] - np.quantile(good(g), q)) < 1e-12 for g in "ab")
    assert exact_quantiles(df.limit(0), "x", 0.5) == {}


def test_samples_have_their_size_in_any_partitioning(spark):
    rows = [(i, "big" if i % 10 else "small", "text") for i in range(2000)] + [(5, "big", "text"), (None, "small", "x")]
    df = spark.createDataFrame(rows, "id long, kind string, abstract string")
    draw = lambda d, n: sorted(map(tuple, exact_sample(d, {"big": n, "small": 5000, "none": 3}, "kind", ["id"]).collect()), key=str)
    a, b = draw(df.repartition(3), 700), draw(df.repartition(11, "id"), 700)
    assert a == b and Counter(r[1] for r in a) == {"big": 700, "small": 201}
    assert {x for x in draw(df, 300) if x[1] == "big"} <= set(a) and draw(df, 1801) == draw(df, 9999)
    assert exact_sample(df.limit(0), {"big": 3}, "kind", ["id"]).count() == 0


def test_training_sets(spark):
    pos = spark.createDataFrame([(i, "p" if i else " ") for i in range(40)], "id long, abstract string")
    neg = spark.createDataFrame([(i, "n") for i in range(100, 500)], "id long, abstract string")
    assert Counter(r.label for r in training_set(pos, neg, 3, ["id"]).collect()) == {1: 39, 0: 120}
    assert Counter(r.label for r in training_set(pos, neg, 50, ["id"]).collect()) == {1: 39, 0: 400}
    assert training_set(pos.limit(0), neg, 3, ["id"]).count() == 0
