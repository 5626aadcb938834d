import random
import time

from loomgraph.llm.license_scan import CUE, TEMPLATES, Templates, license_spans


def test_each_template_wins_for_itself():
    t = Templates(TEMPLATES)
    for k, text in TEMPLATES.items():
        assert t.scan(f"first\n{text}\nlast")[0][:5] == (6, 6 + len(text), k, 0, 0) if "icen" in text or "ights" in text or "Perm" in text or "Redis" in text else True
    assert t.scan("Licensed under the license of the moon, which nobody knows")[0][2] is None
    assert t.scan("ALL RIGHTS  RESERVED")[0][2:5] == ("All-rights-reserved", 0, 0)


def test_documents_equal_a_search_for_the_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = license_spans(docs).collect()
    assert len(got) == len(text) and sum(r.n_exact for r in got) > 10
    for r in got:
        lines = text[r.doc_id].split("\n")
        assert r.n_exact == sum(x.strip() in TEMPLATES.values() for x in lines)
        assert all(TEMPLATES[k] in text[r.doc_id] for k in r.licenses.split(",") if k) or r.n_confirmed > r.n_exact


def test_nulls_empty_and_repeats(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "All rights reserved.", 1), (3, "é\nAll rights reserved.", 1), (3, "é\nAll rights reserved.", 1), (4, "x " * 100_000, 1)]
    got = sorted((str(r.doc_id), r.spans) for r in license_spans(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect())
    one = "All-rights-reserved:2:22"
    assert got == [("1", ""), ("2", ""), ("3", one), ("3", one), ("4", ""), ("None", "All-rights-reserved:0:20")]
    assert license_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wrapped_and_several_notices_and_whole_licences():
    t = Templates(TEMPLATES)
    lines = lambda text, n, mark: "".join(f"{mark}{' '.join(text.split()[i : i + n])}\n" for i in range(0, len(text.split()), n))
    for mark in ("", " * ", "# ", "// "):
        for k in ("MIT-permission", "BSD", "Apache-2.0-notice"):
            found = t.scan(f"int x;\n{lines(TEMPLATES[k], 6, mark)}int y;\n")
            assert [x[2:5] for x in found] == [(k, 0, 0)] and found[0][0] == 7 + len(mark)
    both = f"{TEMPLATES['MIT']} Or: {TEMPLATES['GPL-2.0']} {TEMPLATES['MIT']}"
    assert [both[x[0] : x[1]] for x in t.scan(both)] == [TEMPLATES["MIT"], TEMPLATES["GPL-2.0"], TEMPLATES["MIT"]]
    for k in TEMPLATES:
        if k.endswith("-text"):
            words = TEMPLATES[k].split()
            words[len(words) // 2] = "changed"
            found = [x for x in t.scan(f"Copyright (c) 2020 A\n\n{lines(' '.join(words), 9, '# ')}\nmore") if x[2]]
            assert [x[2] for x in found] == [k] and found[0][3] <= 2
    every = "\n".join(TEMPLATES.values())
    assert [(x[2], every[x[0] : x[1]], *x[3:5]) for x in t.scan(every)] == [(k, x, 0, 0) for k, x in TEMPLATES.items()]


def test_other_versions_and_common_words_are_not_confirmed():
    t = Templates(TEMPLATES)
    found = lambda x: [y[2] for y in t.scan(x)]
    gpl = "This work is licensed under the GNU General Public License, version {}."
    assert found(gpl.format(2)) == ["GPL-2.0"] and found(gpl.format(3)) == ["GPL-3.0"] and found(gpl.format(1)) == [None]
    assert found("Licensed under the Apache License, Version 1.1.") == [None] and found("Licensed under CC BY 3.0.") == [None]
    assert found("You need a driving license. All visitors have equal rights here. Some tables are reserved for staff.") == [None]


def test_compression_decides(monkeypatch):
    notice = TEMPLATES["Apache-2.0-notice"]
    t = Templates(TEMPLATES)
    assert [(x[2], x[0], x[1]) for x in t.scan(notice)] == [("Apache-2.0-notice", 0, len(notice))]
    for constant in (0, 1, 10_000):  # of templates that fit the words, the savings choose
        monkeypatch.setattr(t, "saved", lambda k, words: constant)
        assert [x[2] for x in t.scan(notice)] != ["Apache-2.0-notice"]
    monkeypatch.undo()
    t.given = {k: t.alone for k in t.given}  # and without savings nothing is looked for
    assert [x[2] for x in t.scan(notice)] == [None]


def test_notices_are_found_anywhere_in_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    t, rng = Templates(TEMPLATES), random.Random(1)
    texts = [r.text.split(" ") for r in docs if r.text and not CUE.search(r.text)][:300] + [["so"] * 500, ["a1" * i for i in range(200)]]
    for words in texts:
        for k in rng.sample(sorted(TEMPLATES), 4):
            i = rng.randrange(len(words) + 1)
            text = " ".join([*words[:i], TEMPLATES[k], *words[i:]])
            start = len(" ".join(words[:i])) + (i > 0)
            assert (start, start + len(TEMPLATES[k]), k, 0, 0) in [x[:5] for x in t.scan(text)], (k, text)


def test_work_grows_with_the_text_for_near_misses():
    t, rng = Templates(TEMPLATES), random.Random(1)
    words = TEMPLATES["GPL-3.0-text"].split()
    near = lambda share, n: " ".join(w for _ in range(n) for w in words if rng.random() > share)
    since = time.process_time()
    text = near(0.12, 30)  # 0.9 MB, none near enough
    assert len(text) > 900_000 and not any(x[2] for x in t.scan(text))
    assert [x[2] for x in t.scan(near(0.05, 30))] == ["GPL-3.0-text"] * 30
    assert time.process_time() - since < 40  # about 5; time must not grow with the square of the text
