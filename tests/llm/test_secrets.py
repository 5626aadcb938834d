import hashlib
import random
import re

from loomgraph.llm.secrets import candidates, secret_spans

KEY = "Zk3Vq9Lx1Bn7Tw5Yr2Mc8Hd4Js6Pf0Ga"


def base(text):
    """Spans of the three kinds as the definition words it: match, then drop what fails."""
    kinds = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I, lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    ]
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, flags, ok) in enumerate(kinds) for m in re.finditer(p, text or "", flags | re.A) if ok(m)]
    return [x[2] for x in sorted(found)]


def random_text(r):
    bits = ["password", "Token", "api_key", "APIKEY", "=", ": ", '"', "'", "abcdef12", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", " ", "\n", "é", "ſecret", "toKen=", KEY]
    return "".join(r.choice(bits) for _ in range(60))


def test_equals_the_definition_on_random_texts(spark):
    r = random.Random(4)
    rows = [(i, random_text(r), f"s{i}") for i in range(300)]
    got = {x.doc_id: x for x in secret_spans(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i, text, _ in rows:
        want = base(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("key")] == want


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = secret_spans(docs).collect()
    assert len(got) == len(text) and sum(r.n_assign + r.n_access + r.n_hex for r in got) > 0
    assert all(r.base_sha256 == hashlib.sha256(",".join(base(text[r.doc_id])).encode()).hexdigest() for r in got)


def test_ownership(spark):
    live, example = KEY, KEY[::-1]
    rows = [(i, f"x {example} y", f"s{i % 4}") for i in range(40)] + [(100, f"x {live} y", "s0"), (101, f"x {live} y", "s0"), (102, "token=abcdef1", "s1")]
    got = {x.doc_id: (x.spans, x.n_key, x.n_live, x.n_example) for x in secret_spans(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == ("", 0, 0, 0)
    assert got[100] == got[101] == ("key:2:34", 1, 1, 0)
    assert got[102] == ("assign:0:13", 0, 1, 0)


def test_copies_within_one_owner_are_an_example(spark):
    few, many, base_many = KEY, KEY[::-1], "abcdef123456"
    rows = [(i, f"x {many} y password={base_many}", "s0") for i in range(10)] + [(100 + i, f"x {few} y", "s0") for i in range(9)] + [(200, f"x {few} y", "s0")] * 5
    rows = [r for r in rows if r[0] != 108]
    got = {x.doc_id: (x.spans, x.n_key, x.n_live, x.n_example) for x in secret_spans(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == ("assign:37:58", 0, 0, 1)
    assert got[100] == got[200] == ("key:2:34", 1, 1, 0)


def test_nulls_empty_and_repeats(spark):
    rows = [(1, None, None, 1), (2, "", None, 1), (None, "secret: abcdef", None, 1), (3, "🙂 token=abcdef", "s", 1), (3, "🙂 token=abcdef", "s", 1), (4, "a" * 200_000, "s", 1)]
    got = sorted((str(r.doc_id), r.spans) for r in secret_spans(spark.createDataFrame(rows, "doc_id long, text string, source string, row int")).collect())
    assert got == [("1", ""), ("2", ""), ("3", "assign:2:14"), ("3", "assign:2:14"), ("4", "hex:0:200000"), ("None", "assign:0:14")]
    assert secret_spans(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert candidates(None) == []
