from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.sources.batch_files import batch_files, batched, request_files, yearly_files
from loomgraph.sources.publish import append_distinct, cached, manifest, publish, read_published, retire


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_a_table_is_the_old_or_the_new_one(spark, tmp_path):
    at = str(tmp_path / "t")
    a, b = spark.range(5), spark.range(3)
    assert manifest(spark, at) is None and publish(a, at, {"k": 1}) and not publish(b, at) and read_published(spark, at).count() == 5
    fails = F.udf(lambda x: 1 // (x - 2), "long")
    with pytest.raises(Exception):
        publish(b.repartition(3).select(fails("id").alias("id")), at, force=True)  # dies with some tasks done
    assert read_published(spark, at).count() == 5 and manifest(spark, at)["params"] == {"k": 1}
    held = read_published(spark, at)
    assert publish(b, at, force=True) and read_published(spark, at).count() == 3 and held.count() == 5
    assert retire(spark, at) == 2 and read_published(spark, at).count() == 3
    with pytest.raises(FileNotFoundError):
        read_published(spark, str(tmp_path / "none"))


def test_appends_are_idempotent(spark, tmp_path):
    schema = "pmid string, name string, kind string"
    old = spark.createDataFrame([("1", "a", "x"), ("1", "a", "x"), ("2", "b", None)], schema)
    new = spark.createDataFrame([("2", "b", None), ("2", "b", "y"), ("3", "c", "z"), ("3", "c", "w")], schema)
    at, by = str(tmp_path / "all"), str(tmp_path / "subset")
    for _ in range(2):
        append_distinct(old, at)
    for _ in range(2):
        append_distinct(new, at)
        assert rows_of(read_published(spark, at)) == Counter([("1", "a", "x"), ("2", "b", None), ("2", "b", "y"), ("3", "c", "z"), ("3", "c", "w")])
    append_distinct(old, by, ["pmid"])
    for _ in range(2):
        append_distinct(new, by, ["pmid"])
        assert rows_of(read_published(spark, by)) == Counter([("1", "a", "x"), ("2", "b", None), ("3", "c", "w")])
    append_distinct(spark.createDataFrame([("9", "more")], "pmid string, extra string"), by, ["pmid"])
    assert read_published(spark, by).where("pmid = '9'").first().extra == "more"


def test_a_cache_has_a_table_for_each_set_of_parameters(spark, tmp_path):
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    for n in (3, 4, 3):
        assert cached(spark, str(tmp_path), {"n": n, "name": "é"}, lambda n=n: build(n)).count() == n
    assert built == [3, 4] and cached(spark, str(tmp_path), {"name": "é", "n": 3}, lambda: build(3)).count() == 3 and len(built) == 2


def test_batches_of_exact_size(spark):
    rows = [(i, 2000 + (i % 10 == 0)) for i in range(905)] + [(1000, None), (1001, None)]
    got = batched(spark.createDataFrame(rows, "id long, year int").repartition(6), "year", 100, ["id"]).collect()
    sizes = Counter((r.year, r.batch) for r in got)
    assert len(got) == len(rows) and sizes[2000, 8] == 14 and sizes[2001, 0] == 91 and sizes[None, 0] == 2 and all(sizes[2000, k] == 100 for k in range(8))
    first = sorted(r.id for r in got if (r.year, r.batch) == (2000, 0))
    assert first == sorted(i for i, y in rows if y == 2000)[:100]


def test_named_files(spark, tmp_path):
    df = spark.createDataFrame([(f"{i:04d}", 2001 + i % 2, f'text, "{i}"\nmore é') for i in range(450)], "pmid string, year int, abstract string")
    at = str(tmp_path / "b")
    names = batch_files(df, at, "NER", "year", ["pmid"], 100)
    assert sorted(names) == sorted(f"BATCH_Y{y}_NER_B{k}.csv" for y in (2001, 2002) for k in range(3))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(at)
    counts = {r.f: r.n for r in back.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n")).collect()}
    assert counts == {n: 25 if n.endswith("B2.csv") else 100 for n in names}
    assert {r.abstract for r in back.collect()} == {r.abstract for r in df.collect()}
    assert sorted(batch_files(df, at, "NER", "year", ["pmid"], 100)) == sorted(names)  # again, over what is there
    assert yearly_files(df, str(tmp_path / "y"), "ARTICLES", "year", ["pmid"]) == ["ARTICLES_Y2001.csv", "ARTICLES_Y2002.csv"]
    made = request_files(df, str(tmp_path / "r"), "NER", "Find names.", "some-model", 200)
    lines = spark.read.json(str(tmp_path / "r" / "*.jsonl"))
    index = spark.read.option("header", True).csv(str(tmp_path / "r" / "*.meta.csv"))
    assert len(made) == 8 and lines.count() == index.count() == 450 and rows_of(lines.select("user", "request_id")) == rows_of(index.select("pmid", "request_id"))
    assert lines.first().messages[0].content == "Find names."
