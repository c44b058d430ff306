"""URL filters against plain string tests."""

import random

import duckdb
import pytest

from tidewatch.llm import url_filters

CAPITALS = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(url, rules, default="allow"):
    """Host, path, rule and verdict by the words of the docstring."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = lambda s, stops: s[: min([s.find(c) for c in stops if c in s], default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = host.translate(CAPITALS)
    best = None
    for h, p, v in rules:
        h, p = h and h.translate(CAPITALS), p or ""
        if h and v and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, 0, "", ""), (len(h + p), len(h), v, h + p))
    return host, path, best[3] if best else None, best[2] if best else default


URLS = [
    None, "", "no scheme", "example.net/en/1", "http://", "https://net", "http://NET/", "http://a.net?x=/en/", "http://example.net/en/", "http://Example.NET/en", "http://x.example.net/EN/1", "http://example.net:80/en/1",
    "http://notexample.com/de/1", "http://example.com/de/", "https://m.example.com/de/5?page=2#t", "http://a.org/fr/#x", "http://org/fr/", "http://user@a.org/fr/1", "ftp://b.net/x://y.org/fr/", "x://y.net#/a", "http://.net/", "http://net./",
    "http://münchen.org/fr/é?à", "http://ÀB.ORG/fr/\n1", "http://😀.net/😀/en/", "//a.net/", "://a.net/b", "http://a.net/" + "y" * 40_000, "http://" + "a." * 5000 + "org/fr/2", "http:///net/", "http://a.b.c.example.net/en/x", " http://a.net/ ",
]


def table(spark, urls):
    return spark.createDataFrame([(i if i % 9 else None, u, "h", "p", "r", 3) for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string, row int").repartition(3)


def rows(df):
    return sorted(map(tuple, df.select("page_id", "host", "path", "rule", "verdict").collect()), key=str)


def test_registered_rules(spark):
    rng = random.Random(2)
    made = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'M.'])}{rng.choice(['example.net', 'example.com', 'b.org', 'org', 'net', 'com'])}{rng.choice(['', '/', '/en/', '/de/', '/fr/x', '/en'])}{rng.choice(['', '?a', '#b'])}" for _ in range(200)]
    urls = URLS + made + URLS[8:12]
    got = rows(url_filters.url_report(table(spark, urls)))
    assert got == sorted(((i if i % 9 else None, *plain(u, url_filters.RULES)) for i, u in enumerate(urls)), key=str)
    pages = table(spark, urls).toPandas()  # noqa: F841  DuckDB reads it
    assert sorted(duckdb.sql(url_filters.REPORT_SQL).fetchall(), key=str) == sorted(((*(None if x != x else x for x in r),) for r in got), key=str)


@pytest.mark.parametrize("most", [100_000, 5])
def test_many_shapes_ties_and_collisions(spark, monkeypatch, most):
    """Rules of many shapes, equal lengths, both verdicts, short hash prefixes that collide; broadcast and salted."""
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", most)
    monkeypatch.setattr(url_filters, "PREFIX_HEX", 1)
    rng = random.Random(7)
    piece = lambda: rng.choice(["a", "b", "ab", "c"])
    host = lambda n: ".".join(piece() for _ in range(rng.randint(1, n)))
    path = lambda: "".join("/" + piece() for _ in range(rng.randint(0, 4)))
    rules = [(host(3), path(), rng.choice(["allow", "block"])) for _ in range(60)] + [("A.b", None, "block"), ("a.b", "", "allow"), ("", "/a", "block"), (None, "/", "block"), ("c", "/x", None)]
    urls = [f"http://{host(5)}{path()}" for _ in range(300)]
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = rows(url_filters.judge(table(spark, urls), listed, default="allow"))
    assert got == sorted(((i if i % 9 else None, *plain(u, rules)) for i, u in enumerate(urls)), key=str)
    assert {r[4] for r in got} == {"allow", "block"}


def test_no_rules_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert rows(url_filters.judge(table(spark, ["http://a.net/b?c"]), none, default="block")) == [(None, "a.net", "/b", None, "block")]
    assert url_filters.url_report(table(spark, URLS).limit(0)).collect() == []
