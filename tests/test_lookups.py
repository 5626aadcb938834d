import re

from pyspark.sql import functions as F

from loomgraph.operators.lookups import first_hit, literal_of, matched_patterns


def test_literals():
    given = {r"\bPGC1A\b": "pgc1a", r"PGC-?1α": "pgc", r"\bAMPK( pathway| signaling)?\b": "ampk", "mTOR signaling": "mtor signaling", r"\bCR\b": "cr", "a|b": "", r"x[ab]+long\.end": "long.end", "ab+c": "ab", r"\d+": ""}
    assert {p: literal_of(p) for p in given} == given


def test_patterns_find_what_a_nested_loop_finds(spark):
    names = [(f"E{i}", n) for i, n in enumerate(["AMPK pathway", "ampk", "xAMPKy", "Sirolimus (drug)", "a CR b", "ACRE", "PGC1α x", "x (y", "É x", "é x", "", None, "x", "say mTOR signaling"])]
    patterns = [("AMPK", r"(?i)\bAMPK\b", ["AMPK"]), ("RAPA", r"(?i)\bRAPAMYCIN\b|\bSirolimus\b", ["rapamycin", "sirolimus"]), ("CR", r"(?i)\bCR\b", ["CR"]), ("PGC", r"(?i)PGC-?1α", ["pgc"]), ("P", r"(?i)\Qx (Y\E", ["X (Y"]), ("É", r"(?i)\QÉ\E", ["É"]), ("X", r"(?i)\bX\b", ["x"])]
    got = matched_patterns(spark.createDataFrame(names, "entity_id string, name string"), spark.createDataFrame(patterns, "seed string, pattern string, needs array<string>"))
    plain = {"P": re.compile(re.escape("x (y"), re.I), "É": re.compile("É")}
    want = {(e, s) for e, n in names if n for s, p, _ in patterns if (plain.get(s) or re.compile(p, re.I | re.A if s != "PGC" else re.I)).search(n)}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 8
    none = spark.createDataFrame([], "seed string, pattern string, needs array<string>")
    assert matched_patterns(spark.createDataFrame(names, "entity_id string, name string"), none).count() == 0


def test_first_hits(spark):
    table = spark.createDataFrame([("1", "alpha", 3.0), ("1", "beta", 2.0), ("2", "alpha", 9.0), (None, "gamma", 1.0), (" ", "", 5.0)], "issn string, title string, factor double")
    rows = spark.createDataFrame([(1, "1", "x"), (2, "9", "ALPHA"), (3, None, "Gamma"), (4, " ", " "), (5, "none", "none"), (6, "2", "beta"), (6, "2", "beta")], "id long, issn string, title string")
    got = first_hit(rows, table, "id", [(F.col("issn"), F.col("issn")), (F.lower("title"), F.lower("title"))], F.col("factor"), [-F.col("factor")])
    assert sorted(map(tuple, got.collect())) == [(1, 1, 3.0), (2, 2, 9.0), (3, 2, 1.0), (4, None, None), (5, None, None), (6, 1, 9.0), (6, 1, 9.0)]
    more = spark.createDataFrame([(5, 3, 0.5), (1, 3, 0.1)], "id long, step int, value double")
    got = first_hit(rows, table, "id", [(F.col("issn"), F.col("issn"))], F.col("factor"), [-F.col("factor")], more)
    assert {tuple(r) for r in got.collect()} >= {(1, 1, 3.0), (5, 3, 0.5), (4, None, None)}
