import random

import duckdb

from loomgraph.llm.line_dedup import LINE_DEDUP_SQL, WINDOW, WORDS, dedup_lines, line_digests


def brute(rows):
    """{id: text} with every line deleted that lies in a window that was there before."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        full = [(k, x.strip(" \t\r")) for k, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for s in range(len(full)):
            size = next((k for k in range(1, WINDOW) if sum(len(x.split()) for _, x in full[s : s + k]) >= WORDS), WINDOW)
            window = tuple(x for _, x in full[s : s + size])
            if len(window) < size:
                continue
            if window in seen:
                gone.update(range(full[s][0], full[s + size - 1][0] + 1))
            seen.add(window)
        out[i] = text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_random_documents_equal_brute_force(spark):
    r = random.Random(5)
    blocks = [[r.choice(["a", "b", "c ", "", "d\r", "e", "f"]) for _ in range(r.randrange(1, 8))] for _ in range(60)]
    rows = [(i, "\n".join(x for _ in range(r.randrange(6)) for x in r.choice(blocks))) for i in range(300)]
    rows += [(1000, "x\n" * 50), (1001, "p\nq\n" * 40), (1002, "\n".join(f"u{k}" for k in range(3000)) + "\n" + "\n".join(f"u{k}" for k in range(3000)))]
    got = {x.doc_id: x.text for x in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    want = brute(rows)
    assert got == want
    assert got[1000] == "x\n" and got[1001] == "p\nq\n"
    assert any(t == "" for t in got.values()) and sum(got[i] != t for i, t in rows) > 50


def test_long_lines_are_found_alone_or_by_two(spark):
    line = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    a, b, c = line("a", 60), line("b", 30), line("c", 21)
    rows = [(1, f"x\n{a}\ny"), (2, a), (3, f"{a}\nz"), (4, f"u\n{b}\n\n{c}\nv"), (5, f"{b}\n{c}"), (6, f"p\n{b}\nq"), (7, line("d", 49)), (8, line("d", 49)), (9, line("e", 50)), (10, line("e", 50))]
    r = random.Random(6)
    lines = [line(k, r.choice([1, 2, 10, 24, 25, 26, 49, 50, 51, 80])) for k in "fghijklmnopq"]
    rows += [(100 + i, "\n".join(r.choice(lines) for _ in range(r.randrange(6)))) for i in range(150)]
    got = {x.doc_id: x.text for x in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert [got[k] for k in (2, 3, 5, 6, 8, 10)] == ["", "z", "", f"p\n{b}\nq", line("d", 49), ""]


def test_rows_that_repeat_an_id_keep_what_is_their_own(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\ny\nz"), (2, "a\nb\nc"), (2, "x\ny\nz"), (3, "x\ny\nz\nq")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, __id string, h int")
    out = dedup_lines(df, length_col=None)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "a\nb\nc\nd"), (2, ""), (2, "x\ny\nz"), (2, "x\ny\nz"), (3, "q")]


def test_documents_equal_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(duckdb.sql(LINE_DEDUP_SQL).fetchall())
    got = sorted(tuple(r) for r in line_digests(spark.read.parquet(path)).collect())
    assert got == want and sum(r[2] for r in got) > 0


def test_nulls_empty_repeats_and_other_columns(spark):
    rows = [(1, None, 7, "k"), (2, "", 7, "k"), (None, "a\nb\nc", 7, "k"), (3, "a\nb\nc", 7, "k"), (4, "a\nb\nc\nd", 7, "k"), (4, "a\nb\nc\nd", 7, "k"), (5, "a\nb", 7, "k")]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_chars int, run string"))
    assert out.columns == ["doc_id", "text", "n_chars", "run"] and dict(out.dtypes)["n_chars"] == "int"
    got = sorted(((str(r.doc_id), r.text, r.n_chars) for r in out.collect()), key=str)
    assert got == [("1", None, 7), ("2", "", 7), ("3", "a\nb\nc", 7), ("4", "d", 1), ("4", "d", 1), ("5", "a\nb", 7), ("None", "a\nb\nc", 7)]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_windows_are_the_same_only_by_both_hashes(spark):
    from loomgraph.llm.line_dedup import _fingerprints, _runs

    rows = [(1, 0, 0, 2, 7, 1), (2, 0, 0, 2, 7, 2), (3, 0, 4, 6, 7, 1), (3, 0, 5, 7, 8, 1)]
    got = _runs(spark.createDataFrame(rows, "doc_id long, h long, first int, last int, w long, v long")).collect()
    assert [(r.doc_id, [tuple(x) for x in r.runs]) for r in got] == [(3, [(4, 6)])]
    docs = spark.createDataFrame([(i, f"line {i}\nb\nc") for i in range(50)], "doc_id long, text string")
    keys = [(x.w, x.v) for r in _fingerprints(docs).collect() for x in r.own]
    assert len(set(keys)) == len({w for w, _ in keys}) == len({v for _, v in keys}) == 50 and not {w for w, _ in keys} & {v for _, v in keys}
