import random

import numpy as np
import pytest

from loomgraph.llm import whitening
from loomgraph.llm.whitening import OFFSET, SCALE, deviations, whitened

SCHEMA = "vec_id long, embedding array<float>, extra string, x string"


def brute(rows, components):
    """All rows by one dense matrix."""
    kept = [(i, np.floor(SCALE * np.array(v, np.float32).astype(float)).astype(int) + OFFSET) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in kept}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for i, x in kept:
        y = (x - sums / n) @ vectors / np.sqrt(values)
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        out += [(i, k + 1, n, deviation, y[k], values[k] / np.trace(centred.T @ centred / n)) for k in range(len(values))]
    return out


def compared(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    a, b = np.array([r[4] for r in got]), np.array([r[4] for r in want])
    for k in {r[1] for r in got}:  # either sign, the same for all rows
        own = np.array([r[1] == k for r in got])
        assert min(np.abs(a[own] - b[own]).max(), np.abs(a[own] + b[own]).max()) < 1e-6
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9) and all(r[6] < 1e-4 for r in got)


@pytest.mark.parametrize("tile", [128, 5])
def test_equals_a_dense_matrix(spark, monkeypatch, tile):
    monkeypatch.setattr(whitening, "TILE", tile)
    monkeypatch.setattr(whitening, "BLOCK", 12 * 40)
    r = np.random.default_rng(5)
    v = (r.standard_normal((400, 12)) @ r.standard_normal((12, 12))).tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [(1000 + i, v[7]) for i in range(300)] + [(7, v[7]), (None, v[9])]
    bad = [(2000, None), (2001, [None] + v[0][1:]), (2002, [float("nan")] + v[0][1:]), (2003, [float("inf")] + v[0][1:]), (2004, v[0][:5]), (2005, [])]
    df = spark.createDataFrame([(i, x, "a", "b") for i, x in rows + bad], SCHEMA)
    compared(whitened(df, components=4).collect(), brute(rows, 4))


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    compared(whitened(df).collect(), brute([(r.vec_id, r.embedding) for r in df.collect()], 16))


def test_degenerate_tables(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 5, [(1, [])]):
        assert whitened(spark.createDataFrame([(i, x, "a", "b") for i, x in rows], SCHEMA)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 5.0, -float(i)], "a", "b") for i in range(8)], SCHEMA)
    got = whitened(flat).collect()
    assert {r.component for r in got} == {1} and len(got) == 8 and abs(got[0].explained - 1) < 1e-12
    large = spark.createDataFrame([(i, [3e38 * (i % 2), 1e6 * i], "a", "b") for i in range(6)], SCHEMA)
    assert {r.deviation for r in whitened(large).collect()} == {None}


def test_deviations_are_exact():
    r = random.Random(2)
    for scale in (10, 10**6, 10**9):
        x = np.array([[r.randrange(-scale, scale) for _ in range(6)] for _ in range(20)])
        n, sums = 20, [int(s) for s in x.sum(axis=0)]
        want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
        assert deviations(x, n, sums) == [w if w < 2**63 else None for w in want]
