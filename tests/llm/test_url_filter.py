import random

import numpy as np

from loomgraph.llm import url_filter
from loomgraph.llm.url_filter import bloom_filter, canonical, example_list, host_and_path, lookups, possible, rule_of, url_verdicts


def test_parts_and_rules():
    assert host_and_path("HTTPS://WWW.Éx.COM?x#y") == ("www.Éx.com", "")
    assert host_and_path("a://b://c/d#e?f") == ("b:", "//c/d")
    assert host_and_path("no scheme") == host_and_path(None) == host_and_path("x://") == ("", "")
    rules = url_filter.RULES
    assert rule_of("www.example.org", "/en/12", rules) == ("example.org/en/1", "block")
    assert rule_of("example.org", "/en/2", rules) == ("org/", "allow")
    assert rule_of("x.com", "/de/", rules) == ("com/de/", "block")
    assert rule_of("xcom", "/de/", rules) == (None, None)
    assert rule_of("", "", rules) == (None, None)
    assert rule_of("a.org", "", rules) == (None, None)


def test_lookups_hold_the_canonical_prefix():
    assert canonical("http://Bad.com") == "bad.com/" and canonical("x/y/z") == "x/y/z" and canonical(None) is None
    for listed, page in (("http://bad.com/", "http://www.bad.com:80/a/b?c"), ("bad.com/a/", "http://bad.com/a/b"), ("bad.com/a/b", "https://x.y.bad.com/a/b#z")):
        assert canonical(listed) in lookups(*host_and_path(page))


def test_user_info_and_hostile_urls():
    assert canonical("http://u:p@Bad.com:8/x") == "bad.com/x" and "bad.com/" in lookups(*host_and_path("http://u@x:y@www.bad.com:1/"))
    asked = lookups("a." * 20_000 + "com", "/" * 20_000, 3, 12)
    assert len(asked) == 3 * 12 and max(map(len, asked)) == len("a.a.com") + 12
    for host, path in (("a.b.c", "/x/y/z"), ("a", ""), ("b.c", "x"), ("", "/x"), ("a.b.", "//")):
        every = lookups(host, path)
        assert [k for k in every if k.partition("/")[0].count(".") < 2 and len(k) - k.index("/") <= 3] == lookups(host, path, 2, 3)


def test_a_list_of_many_thousand(spark):
    """Against a plain join of every prefix with the list, written anew."""
    r = random.Random(7)
    site = lambda: ".".join(r.choice(["a", "b", "shop", "w"]) + str(r.randrange(9000)) for _ in range(r.randrange(1, 3))) + r.choice([".net", ".com"])
    path = lambda n: "".join(f"/{r.choice('xyz')}{r.randrange(4)}" for _ in range(r.randrange(n)))
    listed = [r.choice(["http://", "", "https://u@"]) + site() + r.choice(["", ":8080"]) + path(3) + r.choice(["", "/"]) for _ in range(60_000)]
    urls = [(i, "http://" + r.choice(["www.", "", "m@"]) + site() + path(4) + r.choice(["", "?q=/", "#/"])) for i in range(20_000)]
    entries = {}
    for u in listed:
        host, slash, rest = u.split("://")[-1].rpartition("@")[2].partition("/")
        entries.setdefault(host.split(":")[0], set()).add("/" + rest)
    want = {}
    for i, u in urls:
        host, _, rest = u[7:].rpartition("@")[2].partition("#")[0].partition("?")[0].partition("/")
        whole, names = "/" + rest, host.split(".")
        found = [".".join(names[k:]) + e for k in range(len(names)) for e in entries.get(".".join(names[k:]), ()) if whole == e or e.endswith("/") and whole.startswith(e)]
        want[i] = min(found, default=None)
    got = {x.page_id: x.listed_as for x in url_verdicts(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame([(u,) for u in listed], "url string"), rules=[]).collect()}
    assert got == want and 100 < sum(v is not None for v in got.values()) < len(got)


def test_filter_has_no_false_negative(spark, monkeypatch):
    keys = [f"k{i}.com/" for i in range(5000)]
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(5)
    words = bloom_filter(df)
    assert possible(words, keys).all()
    assert possible(words, [f"other{i}.com/" for i in range(20000)]).mean() < 0.02
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)
    assert possible(bloom_filter(df), keys).all()


def brute(url, listed):
    host, path = host_and_path(url)
    rule, verdict = rule_of(host, path, url_filter.RULES)
    hit = any(k in listed for k in lookups(host, path))
    return host, path, rule, verdict or ("block" if hit else "allow")


def test_pages_equal_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    listed = {canonical(r.url) for r in example_list(pages).collect()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_verdicts(pages, example_list(pages)).collect()}
    want = {r.page_id: brute(r.url, listed) for r in pages.select("page_id", "url").collect()}
    assert got == want and {"allow", "block"} == {v[3] for v in want.values() if v[2] is None}


def test_a_full_filter_decides_alike(spark, monkeypatch):
    r = random.Random(2)
    urls = [(i, f"http://h{r.randrange(50)}.net/{r.choice('abc')}/{r.randrange(30)}") for i in range(500)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.net/a/",) for i in range(0, 50, 3)] + [(None,), ("h3.net/a/",)], "url string")
    want = sorted(map(tuple, url_verdicts(pages, listed).collect()))
    monkeypatch.setattr(url_filter, "possible", lambda words, keys: np.ones(len(keys), bool))
    assert sorted(map(tuple, url_verdicts(pages, listed).collect())) == want
    assert {v[4] for v in want} == {"allow", "block"}


def test_nulls_and_empty(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "http://a.com", "x"), (3, "http://adult-x.example.com/q", "x"), (3, "http://adult-x.example.com/q", "x")], "page_id long, url string, verdict string")
    got = sorted((str(r.page_id), r.host, r.path, r.verdict) for r in url_verdicts(pages, example_list(pages)).collect())
    assert got == [("1", "", "", "allow"), ("2", "", "", "allow"), ("3", "adult-x.example.com", "/q", "block"), ("3", "adult-x.example.com", "/q", "block"), ("None", "a.com", "", "allow")]
    assert url_verdicts(pages.limit(0), example_list(pages).limit(0)).count() == 0
