"""Compares queries with their DuckDB equivalents: python tests/oracle.py [SF_DIR] [NAME...]"""

import sys
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda x: None if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(columns), sorted((tuple(cell(r[k]) for k in order) for r in data), key=str)


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert got[0] == want[0], (name, got[0], want[0])
    assert len(got[1]) == len(want[1]), (name, len(got[1]), len(want[1]))
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not bad, (name, len(bad), bad[:3])
    return len(got[1])


if __name__ == "__main__":
    import time
    import traceback

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    from loomgraph import queries as core

    sf_dir = sys.argv[1]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    for name in sys.argv[2:] or core.QUERIES:
        t = time.time()
        try:
            if name in core.ORACLE_SQL:
                n = compare(spark, con, name, core.QUERIES[name], core.ORACLE_SQL[name], sf_dir)
            else:
                n = f"{core.QUERIES[name](spark, sf_dir).count()} (no SQL)"
            print("ok", name, n, f"{time.time() - t:.1f}s", flush=True)
        except Exception as e:
            print("BAD", name, str(e)[:700].replace("\n", " | ") or traceback.format_exc()[-500:], flush=True)
