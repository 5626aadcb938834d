import random
import re

import pyarrow.parquet as pq

from loomgraph.llm.components import connected_components
from loomgraph.llm import near_dedup
from loomgraph.llm.near_dedup import near_duplicates


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """{id: (n, component)} by comparing every pair that shares a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    done = set()
    for ids in by.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = root(a), root(b)
                        parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_equals_brute_force_on_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    t = pq.read_table(path, columns=["doc_id", "text"]).to_pydict()
    want = brute(list(zip(t["doc_id"], t["text"], strict=True)))
    assert result(near_duplicates(spark.read.parquet(path))) == want
    assert len({c for _, c in want.values()}) < len(want)


def test_large_group_of_near_copies_and_a_chain(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 3 * (i % 60)] + [f"x{i}"] + base[3 * (i % 60) + 1 :])) for i in range(300)]
    chain = [f"c{i}" for i in range(400)]
    rows += [(1000 + k, " ".join(chain[10 * k : 10 * k + 150])) for k in range(20)]
    got = result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert {c for i, (_, c) in got.items() if i >= 1000} == {1000}


def test_copies_around_the_threshold_and_a_common_line(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(r.randrange(14)):
            words[r.randrange(150)] = f"x{r.randrange(400)}"
        rows.append((i, " ".join(words)))
    line = [f"line{k}" for k in range(12)]
    rows += [(1000 + i, " ".join(line + [f"z{r.randrange(40)}" for _ in range(r.randrange(12))])) for i in range(200)]
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_nulls_empty_short_ties_and_extra_columns(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE\ttwo "), (6, "one two three"), (7, "É one"), (8, "é one"), (9, "x " * 5000), (9, "x " * 5000), (None, "one two")]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, component_id int, key string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 9, True), (9, 1, 9, True), (None, 1, None, True)], key=str)


def test_rows_that_repeat_an_id_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, c), (4, c), (8, None), (8, a), (6, None), (6, None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # the largest of 5's texts is b, of 8's it is a
    want = [(3, 56, 3, True), (4, 56, 4, True), (5, 56, 5, True), (5, 56, 5, True), (6, 0, 6, True), (6, 0, 6, True), (7, 56, 5, False), (8, 56, 3, False), (8, 56, 3, False), (9, 56, 4, False), (9, 56, 4, False)]
    assert got == want


def test_many_classes_around_one_component_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SIDE", 7)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w for w in base if r.random() > 0.06) + (f" y{i}" if i % 3 else "")) for i in range(160)]
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rounds_of_few_edges_have_few_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 64)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = connected_components(spark.range(40).selectExpr("id AS a", "id + 1 AS b"))
        assert out.rdd.getNumPartitions() < 100  # 64 are those of the smallest nodes
        assert {tuple(r) for r in out.collect()} == {(k, 0) for k in range(41)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
