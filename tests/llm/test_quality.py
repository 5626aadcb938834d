import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from loomgraph.llm import quality
from loomgraph.llm.quality import FEATURES, Trees, base_failed, quality_verdicts, statistics, train


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    return [len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)]


def test_counts_equal_brute_force(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()
    for t in [r.text for r in texts] + [None, "", " \n\t", "a b c d e a b c d e", "é # é\n\né # é", "x " * 3000, "a b c d e f a b c d e f a b"]:
        assert statistics(t)[0] == brute(t)


def test_verdicts_on_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_verdicts(docs, labels)
    text = dict(zip(*pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True))
    for r in got.collect():
        want = brute(text[r.doc_id])
        assert [r[c] for c in quality.COUNTS] == want
        assert r.base_failed == base_failed(want[0], want[4]) and not (r.base_failed and r.kept)
    held = got.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).select("quality", F.col("kept").cast("int").alias("kept")).collect()
    assert np.mean([r.quality == r.kept for r in held]) > 0.9


def test_constraints_hold():
    r = np.random.default_rng(1)
    x = r.random((2000, len(FEATURES)))
    y = (x[:, 2] + r.normal(0, 0.3, 2000) > 0.5).astype(float)  # against the constraint
    trees = train(x, y, list(FEATURES.values()))
    for f, sign in enumerate(FEATURES.values()):
        if sign:
            z = np.repeat(r.random((50, len(FEATURES))), 30, axis=0)
            z[:, f] = np.tile(np.linspace(0, 1, 30), 50)
            assert (sign * np.diff(trees.scores(z).reshape(50, 30), axis=1) >= -1e-12).all()


def test_nulls_empty_repeats_and_no_labels(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "w " * 9, 5), (3, " ".join(f"w{i}" for i in range(20)), 5), (3, " ".join(f"w{i}" for i in range(20)), 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted((str(r.doc_id), r.n_words, r.kept) for r in quality_verdicts(docs, labels).collect())
    assert got == [("1", 0, False), ("2", 0, False), ("3", 20, True), ("3", 20, True), ("None", 9, False)]
    assert quality_verdicts(docs.limit(0), labels).count() == 0
    assert isinstance(train(np.zeros((0, len(FEATURES))), np.zeros(0), list(FEATURES.values())), Trees)
