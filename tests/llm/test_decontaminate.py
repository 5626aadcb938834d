import random

import duckdb
import numpy as np

from loomgraph.llm import decontaminate
from loomgraph.llm.decontaminate import DECONTAMINATE_SQL, block_minima, contained_items, partition_of


def sql(documents, benchmark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM {documents}")
    duckdb.sql(f"CREATE OR REPLACE VIEW benchmark AS SELECT * FROM {benchmark}")
    return sorted(duckdb.sql(DECONTAMINATE_SQL).fetchall())


def test_partitions_and_minima():
    assert [partition_of(n) for n in (1, 8, 9, 16, 17, 64, 65)] == [0, 0, 1, 1, 2, 3, 4]
    x = np.random.default_rng(1).integers(0, 2**63, 20_001).astype(np.uint64)
    whole = block_minima(x)
    assert len(whole) == 2501 and (whole[:512] == block_minima(x[:4096])).all() and (whole[-1] == block_minima(x[20_000:])).all()


def test_documents_equal_sql(spark):
    d = "/root/testdata/sf0.01"
    want = sql(f"'{d}/documents.parquet'", f"'{d}/benchmark.parquet'")
    got = sorted(tuple(r) for r in contained_items(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")).collect())
    assert got == want and len(want) > 10


def test_edited_items_anywhere_in_long_texts(spark):
    r = random.Random(6)
    word = lambda: f"w{r.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(r.choice([3, 5, 9, 12, 20, 40, 70, 130])))) for i in range(60)]
    docs = []
    for k in range(300):
        words = items[k % 60][1].split()
        for _ in range(r.choice([0, 0, 1, 2])):
            words[r.randrange(len(words))] = "edit"
        docs.append((k, " ".join([word() for _ in range(r.randrange(3000))] + words + [word() for _ in range(r.randrange(3000))])))
    docs += [(1000 + i, t.upper() + "\n") for i, t in items]
    got = sorted(tuple(x) for x in contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    import pandas as pd

    d, b = pd.DataFrame(docs, columns=["doc_id", "text"]), pd.DataFrame(items, columns=["item_id", "text"])
    duckdb.register("d", d)
    duckdb.register("b", b)
    want = sql("d", "b")
    assert got == want and len(want) > 150


def test_nulls_empty_and_repeats(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, item, 1), (3, item, 1), (3, item, 1), (4, "two words", 1)], "doc_id long, text string, key int")
    items = spark.createDataFrame([(1, item, 1), (1, item, 1), (2, None, 1), (3, "", 1), (None, item, 1), (5, "Two words", 1)], "item_id long, text string, keys int")
    assert sorted(tuple(r) for r in contained_items(docs, items).collect()) == [(3, 1, 3, 3), (4, 5, 1, 1)]
    assert contained_items(docs.limit(0), items).count() == 0 and contained_items(docs, items.limit(0)).count() == 0


def test_rows_that_repeat_an_id_have_the_largest_text(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 1)
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " z"), (3, a + " " + b)], "doc_id long, text string")
    items = spark.createDataFrame([(7, a), (8, b), (9, a), (9, b)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items).collect())
    assert got == [(1, 8), (1, 9), (2, 7), (3, 7), (3, 8), (3, 9)]
