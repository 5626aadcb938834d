import html
import json
import random
import re
import time

from pyspark.sql import functions as F

from loomgraph.llm import html_text
from loomgraph.llm.html_text import aligned, folded, host_container, main_text, page_texts, stream, template_texts, tokens, wrapper_of


def test_streams_fold_and_align():
    a, b = (folded(stream(f"<body><ul>{'<li>x' * n}</ul><div class=x1>{t}</div></body>")) for n, t in ((2, "<p>a<p>b"), (5, "<h1>t</h1><p>a")))
    both = aligned(a, b)
    assert ["+", ["<li", "#", ">"]] in both and ["?", ["<h1"]] in both
    assert aligned(a, a) == a and len(aligned(both, a)) <= len(both) + len(a)
    assert json.loads(wrapper_of([json.dumps(a), json.dumps(b)])) == aligned(*sorted((a, b), key=lambda x: (-len(json.dumps(x)), json.dumps(x))))


def test_pages_equal_the_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    text = {r.page_id: r.html for r in pages.collect()}
    for r in page_texts(pages).collect():
        inside = re.search("<article>(.*)</article>", text[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:h1|p)>", inside)
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", " " if "<br" in b else "", b)).split()) for b in blocks]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


PAGE = """<!doctype html><html><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="content"><h2>T{k} &amp; more</h2><p>First  para {k} <b>bo</b>ld,<br>line &lt;two&gt; of the article<p>Second
para &eacute; with more words of the article<form><input value=x>Sign up</form><div class="ad-box">Buy</div><ul><li>one<li>two</ul><script>var x = "<p>no</p>";</script></div>
<aside>Side</aside><section class="comments"><p>A comment</p></section><footer>(c)</footer></body></html>"""


def test_unmarked_article_and_boilerplate(spark):
    rows = [(k, f"http://h{k % 2}.net/{k}", PAGE.replace("{k}", str(k))) for k in range(6)]
    got = {r.page_id: r.text for r in page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"T{k} & more\nFirst para {k} bold, line <two> of the article\nSecond para é with more words of the article\none\ntwo" for k in range(6)}


def test_nulls_empty_and_repeats(spark):
    rows = [(1, None, None, "x"), (2, "", "", "x"), (None, "http://A.com", "<article><p>a</article>", "x"), (3, None, "<p>only text", "x"), (3, None, "<p>only text", "x"), (4, "http://a.com/", "<", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    assert sorted((str(r.page_id), r.text) for r in page_texts(df).collect()) == [("1", ""), ("2", ""), ("3", "only text"), ("3", "only text"), ("4", ""), ("None", "a")]
    assert page_texts(df.limit(0)).count() == 0
    assert main_text("<div>" * 3000 + "x", ()) == "x"


def test_equal_texts_of_a_host_are_template(spark):
    page = """<html><body class="has-sidebar"><form><div class="zone"><p>Read our other stories too</p><h2>Title {k}</h2><p>Story {k} goes on for a good many words that no other page has: {k}.</p>
<p>Call {k} now</p><div class="blurb"><p>Printed on paper</p></div></div></form></body></html>"""
    rows = [(k, f"http://h.net/{k}", page.replace("{k}", str(k))) for k in range(8)] + [(20 + k, f"http://copies.net/{k}", page.replace("{k}", "x")) for k in range(8)]
    rows += [(40, "http://h.net/none", "<html><body><p>Not found</p></body></html>")]
    got = {r.page_id: r.text for r in page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert got[k] == f"Title {k}\nStory {k} goes on for a good many words that no other page has: {k}.\nCall {k} now"
        assert got[20 + k].startswith("Read our other stories too\nTitle x\n") and got[20 + k].endswith("Printed on paper")
    assert got[40] == "Not found"


def test_differing_texts_become_a_slot():
    a, b = ["<p", "=1", ">", "<p", "=2", ">"], ["<p", "=1", ">", "<p", "=3", ">"]
    assert aligned(a, b) == ["<p", "=1", ">", "<p", "#", ">"]


def test_tokens_and_broken_tags():
    get = lambda x: list(tokens(x))
    assert get('a<p class="x>y">b</P >c<br/>') == [("#", "a", ""), ("<", "p", ' class="x>y"'), ("#", "b", ""), (">", "p", " "), ("#", "c", ""), ("<", "br", "/")]
    assert get("a < b<!-- <p> -->c<?x?><!doctype html>d</>e") == [("#", "a ", ""), ("#", "<", ""), ("#", " b", ""), ("#", "c", ""), ("#", "d", ""), ("#", "e", "")]
    assert get('x<p title="a>b<i>c') == [("#", "x", ""), ("<", "p", ' title="a'), ("#", "b", ""), ("<", "i", ""), ("#", "c", "")]
    assert get("x<b y<script>var a = '<p>'</ScRiPt >z<style>q") == [("#", "x", ""), ("<", "b", " y<script"), ("#", "var a = '", ""), ("<", "p", ""), ("#", "'", ""), (">", "script", " "), ("#", "z", "")]
    assert get("x<script>var a = '<p>'</ScRiPt >z<a") == [("#", "x", ""), ("#", "z", ""), ("#", "<a", "")]


def test_long_and_broken_pages_take_linear_time():
    began = time.process_time()
    for page in ("<a " * 330_000, "<p>x" * 50_000, "<div>" * 50_000 + "x", '<a ">" ' * 50_000 + "'", "<!--" * 100_000, "<script" * 100_000, "<a ' " * 100_001 + ">", "<ul><li>x" * 30_000):
        main_text(page, ())
        stream(page)
    a, b = (folded(stream("".join(f"<p class={'abcde'[i % k]}>x{i}</p>" for i in range(20_000)))) for k in (5, 4))
    assert aligned(a, b)
    assert time.process_time() - began < 60
    assert main_text("<div>" * 2000 + "x" + "</div>" * 1999 + "y</div>z", ()) == "x\ny\nz"


def test_text_of_the_article_is_whole():
    page = "<article><p>a <math><mi>x</mi></math> <object>o</object> <noscript>n</noscript> <select><option>s</select><svg><text>v</svg> z</article>"
    assert main_text(page, ()) == "a x o n z"


def test_the_wrapper_decides(spark, monkeypatch):
    page = "<html><body><div class=q><p>Same on all pages, and much longer than the rest of what is here</p></div><div class=r><p>Words of {k}, {k} and {k}</p><p>Also {k}</p></div></body></html>"
    rows = [(k, f"http://h.net/{k}", page.replace("{k}", "".join(chr(97 + int(d)) for d in str(k)))) for k in range(10, 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    with_wrapper = {r.text.split("\n")[0].split()[0] for r in page_texts(df).collect()}
    slots = html_text._slots(rows[0][2])
    assert with_wrapper == {"Words"} and "Same on all" in main_text(rows[0][2], host_container(slots, "[]")[0])
    monkeypatch.setattr(html_text, "STREAMS", 2)
    assert {r.text.split("\n")[0].split()[0] for r in page_texts(df).collect()} == {"Words"}


def test_long_wrappers_keep_their_texts(monkeypatch):
    a, b = ["<p", "=1", ">", "=2", "<q", "=9"], ["<p", "=1", ">", "=3", "=4", "<q", "=9"]
    monkeypatch.setattr(html_text, "CELLS", 1)
    assert aligned(a, b) == ["<p", "=1", ">", ["?", ["=2"]], ["?", ["=3"]], ["?", ["=4"]], "<q", "=9"]
    assert template_texts(json.dumps(aligned(a, b))) == {1, 2, 3, 4, 9}


def test_alignment_is_the_same_at_any_length():
    part_a, part_b = ["<p", "=1", ">", "=2", "<q", "=5", ">", "=9"], ["<p", "=1", ">", "=3", "=4", "<q", "=5", ">", "=8"]
    want = ["<p", "=1", ">", "#", ["?", ["=4"]], "<q", "=5", ">", "#"]
    assert aligned(part_a, part_b) == want
    ends = [f"<{k}" for k in range(1200)]
    assert aligned(["<x", *part_a, *ends, "<y"], ["<z", *part_b, *ends, "<w"]) == [["?", ["<x"]], ["?", ["<z"]], *want, *ends, ["?", ["<y"]], ["?", ["<w"]]]


def test_common_rows_equal_the_table():
    r = random.Random(3)
    for _ in range(300):
        n, m, kinds = r.randrange(40), r.randrange(40), r.choice([2, 4, 30])
        a, b = ([str(r.randrange(kinds)) for _ in range(k)] for k in (n, m))
        table = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        assert [[(row & (1 << m - j) - 1).bit_count() for j in range(m + 1)] for row in html_text._common_rows(a, b)] == table


def test_what_all_articles_have_stays(spark):
    told = "<html><body><nav>Menu</nav><article><p>By the desk</p><h1>Title {k}</h1><p>Story {k} has words of its own, {k}.</p><h2>Background</h2><p>More of {k}.</p><p>Sources: us</p></article><footer>(c)</footer></body></html>"
    plain = "<html><body><div><p>Menu and more</p></div><div><p>Title {k}</p><p>Story {k} has words of its own, {k}.</p><p>Background</p><p>More of {k} to read.</p></div></body></html>"
    names = ["".join(chr(97 + int(d)) for d in f"{k:02d}") for k in range(40)]
    rows = [(k, f"http://told.net/{k}", told.replace("{k}", n)) for k, n in enumerate(names)] + [(100 + k, f"http://plain.net/{k}", plain.replace("{k}", n)) for k, n in enumerate(names)]
    got = {r.page_id: r.text for r in page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, n in enumerate(names):
        assert got[k] == f"By the desk\nTitle {n}\nStory {n} has words of its own, {n}.\nBackground\nMore of {n}.\nSources: us"
        assert got[100 + k] == f"Title {n}\nStory {n} has words of its own, {n}.\nBackground\nMore of {n} to read."


def test_one_odd_page_changes_no_other(spark):
    page = "<html><body><p>{notice}</p><p>Title {k}</p><p>Story {k} has words of its own, {k}.</p><p>{notice}</p></body></html>"
    names = ["".join(chr(97 + int(d)) for d in f"{k:02d}") for k in range(40)]
    rows = [(k, f"http://h.net/{k}", page.replace("{k}", n).replace("{notice}", "Quite another thing" if k == 7 else "We use cookies")) for k, n in enumerate(names)]
    got = {r.page_id: r.text for r in page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, n in enumerate(names):
        if k != 7:
            assert got[k] == f"Title {n}\nStory {n} has words of its own, {n}."


def test_pages_are_read_once_for_the_wrappers_and_once_for_the_texts(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(value):
        seen.add(1)
        return value

    rows = [(k, f"http://h{k % 2}.net/{k}", PAGE.replace("{k}", str(k))) for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = page_texts(pages.withColumn("html", F.udf(count, "string").asNondeterministic()("html"))).collect()
    assert all(r.text.startswith(f"T{r.page_id} & more\n") for r in got)
    assert seen.value == 2 * len(rows)


def test_marks_hold_what_a_page_is_reduced_to():
    page = "<body><div id=a><p>x</p><p>x <a href=/>link</a></div><div id=a><p>y</body>"
    found, texts, _ = html_text.marks(page)
    frequent = {k for _, k, *_ in texts[:1]}
    assert found == stream(page) and html_text.with_texts(found, [k for _, k, *_ in texts], frequent) == stream(page, frequent)
    assert [p[-2:] for p in html_text.paths_of(found)] == [("div.a", "p")] * 3
    assert sorted(html_text._slots(page, frequent).values()) == [[1, 0], [6, 4]] and len(html_text._slots(page)) == 1
