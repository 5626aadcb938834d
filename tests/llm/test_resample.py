import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import resample
from loomgraph.llm.resample import BUCKETS, WORD, joined_crc, resampled

SCHEMA = "doc_id long, text string, bucket long, part string"


def features(text):
    words = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, seed=42):
    bucket = lambda f: zlib.crc32(f.encode()) % BUCKETS
    s, t = (Counter(bucket(f) for _, x in rows for f in features(x)[1]) for rows in (docs, target))
    all_s, all_t = float(s.total()), float(t.total())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + BUCKETS) / ((s[b] + 1.0) * (all_t + BUCKETS)))) for b in range(BUCKETS)]
    out = []
    for i, x in docs:
        words, found = features(x)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) if i is not None else None, None, len(words)])
    order = sorted((r for r in out if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for k, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in out)


def test_joined_crcs():
    r = random.Random(1)
    words = ["".join(r.choice("abcé日9") for _ in range(r.choice([1, 2, 9, 40, 94, 95, 96, 97, 150, 700]))).encode() for _ in range(2000)]
    for some in (words, [w for w in words if len(w) < 90]):
        a, b = some[::2], some[1::2][: len(some[::2])]
        a = a[: len(b)]
        got = joined_crc(np.array([zlib.crc32(x) for x in a]), np.array([zlib.crc32(x) for x in b]), np.array([len(x) for x in b]))
        assert got.tolist() == [zlib.crc32(x + b" " + y) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("part,at_once", [(1_000_000, 4_000_000), (60, 500)])
def test_equals_brute_force(spark, monkeypatch, part, at_once):
    monkeypatch.setattr(resample, "PART", part)
    monkeypatch.setattr(resample, "AT_ONCE", at_once)
    r = random.Random(2)
    words = ["alpha", "Beta", "GAMMA9", "é日本", "ÀÉ", "x-y", "12", "w" * 200, "a\x00b", "_", "don't"]
    texts = [r.choice([" ", "\n", ", "]).join(r.choice(words) for _ in range(r.choice([1, 2, 3, 19, 20, 21, 60, 300]))) for _ in range(300)]
    texts += [None, "", " - \n", "one", "one two", "x" * 3000] + ["the very same text " * 6] * 200
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, "another text " * 12), (None, "no id at all " * 9)]
    target = [(i, " ".join(r.choice(words[:4]) for _ in range(25))) for i in range(20)] + [(99, None)]
    df = spark.createDataFrame([(i, t, 7, "p") for i, t in docs], SCHEMA).repartition(5)
    bench = spark.createDataFrame([(str(i), t) for i, t in target], "item_id string, text string")
    got = Counter(map(tuple, resampled(df, bench, percent=30).collect()))
    assert got == brute(docs, target, 30)


def test_whole_tables(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = Counter(map(tuple, resampled(docs, bench).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id string, text string")
    assert resampled(df, bench).count() == 0
    one = spark.createDataFrame([(1, "some words " * 30, 0, "")], SCHEMA)
    assert Counter(map(tuple, resampled(one, bench, percent=100).collect())) == brute([(1, "some words " * 30)], [], 100)
