from __future__ import annotations

import random
import time

import pytest

from strandline.llm import url_filter as u


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, stops: s[: min([s.find(c) for c in stops if c in s], default=len(s))]
    host = cut(rest, "/?#")
    return "".join(c.lower() if c.isascii() else c for c in host), cut(rest[len(host) :], "?#")


def judge(url, rules, default="allow"):
    host, path = split(url)
    fit = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/1?x#y", "https://example.com/en/", "https://example.com/en", "https://a.www.example.com/en/x",
    "https://xexample.com/en/", "http://a.net/es/1", "http://a.net/ES/1", "http://net/fr/", "http://a.org/x", "http://a.com#://b.net/es/", "ftp://a.com?q=/en/", "a\nb://c.net/fr/\n", "http://ÉXample.com/", "://net/es/",
    "http://..com/", "x://y://example.com/en/", "http://com:80/", "http://" + "a." * 300 + "com/en/",
]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(1)
    rows = list(enumerate(URLS)) + [(0, None), (3, "http://a.net/es/1"), (None, "http://com/")]
    rows += [(100 + i, f"http://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['example', 'b'])}.{rng.choice(['com', 'net'])}/{rng.choice(['en/', 'es/', 'fr/', ''])}{i}") for i in range(300)]
    return rows


@pytest.fixture(params=["broadcast", "joined"])
def way(request, monkeypatch):
    if request.param == "joined":
        monkeypatch.setattr(u, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(u, "COMMON", 4)
        monkeypatch.setattr(u, "SHELF", 16)


def check(spark, pages, rules):
    df = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'mine' as key", "'mine' as bloom", "'mine' as rid").repartition(3)
    got = u.judge_urls(df, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
    expected = [(i, *judge(url, rules)) for i, url in pages]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_contract_rules(spark, pages, way):
    check(spark, pages, u.RULES)


def test_many_rules(spark, pages, way):
    rng = random.Random(2)
    rules = u.RULES + [("block", f"h{i}.example.{rng.choice(['com', 'net'])}", "/" + "p" * rng.randrange(9)) for i in range(3000)] + [("block", "b.net", "/e"), ("allow", "b.net", "/es/1")]
    check(spark, pages, rules)


def test_no_rules_and_no_pages(spark, pages, way):
    empty = spark.createDataFrame([], "verdict string, host string, path string")
    df = spark.createDataFrame(pages, "page_id long, url string")
    assert {r["verdict"] for r in u.judge_urls(df, empty).collect()} == {"allow"}
    assert u.judge_urls(df.limit(0), spark.createDataFrame(u.RULES, "verdict string, host string, path string")).collect() == []


def test_unsound_rules(spark, pages):
    rules = spark.createDataFrame([("block", None, "/"), (None, "com", "/"), ("block", "com", None), ("block", "com", "/"), ("allow", "com", "/")], "verdict string, host string, path string")
    got = u.judge_urls(spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string"), rules).collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [("com/", "allow")]


def test_a_million_rules(spark):
    """Time grows with the rules, not with their square: this ends within two minutes."""
    n = 1_000_000
    rules = spark.range(n).selectExpr("if(id % 3 = 0, 'allow', 'block') as verdict", "concat('h', id, '.example.com') as host", "'/' as path")
    pages = spark.range(4000).selectExpr("id as page_id", f"concat('http://', if(id % 2 = 0, 'www.', ''), 'h', id * 499, '.example.com/x') as url")
    began = time.perf_counter()
    got = u.judge_urls(pages, rules).collect()
    assert time.perf_counter() - began < 120
    assert len(got) == 4000
    for r in got:
        i = r["page_id"] * 499
        assert (r["rule"], r["verdict"]) == ((f"h{i}.example.com/", "allow" if i % 3 == 0 else "block") if i < n else (None, "allow"))
