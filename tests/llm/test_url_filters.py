"""Aliases and rules of urls."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cedrela.llm import common, url_filters


@pytest.fixture(scope="module")
def pages(spark):
    link = lambda u: f'<html><head><LINK href="{u}" rel="canonical"></head>'
    fresh = lambda u: f"<meta http-equiv='refresh' content='0; url={u}'>"
    rows = [
        (1, "http://a.org/x", link("http://bad.net/1")), (2, "http://b.org/y#top", fresh("http://a.org/x")), (3, "http://bad.net/1", ""),
        (4, "http://c.org/", link("https://Www.Example.NET/en/1")), (5, "http://d.org/fr/1", link("http://bad.net/3")), (6, None, None), (7, "no url", None),
        (8, "http://e.org/", link("http://f.org/")), (9, "http://f.org/", None), (10, "http://x.net", ""), (11, "http://notnet/", ""), (12, "http://www.example.com/de/a?b#c", ""), (3, "http://bad.net/1", ""),
        (13, "http://g.org/q", link("/relative")), (14, "http://h.org/", link("http://bad.net/2") + fresh("https://Www.Example.NET/en/1")),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("clash")).withColumn("own", F.lit(1))


def test_verdicts(pages):
    got = {r["page_id"]: r for r in url_filters.filter_urls(pages, url_filters.page_links(pages), url_filters.RULES).collect()}
    verdict = {k: (r["rule"], r["verdict"]) for k, r in got.items()}
    assert verdict[1] == verdict[2] == (None, "block")  # aliases of a blocked page
    assert verdict[3] == ("net/", "block") and verdict[5] == ("org/fr/", "allow")  # explicit rules stay
    assert verdict[4] == (None, "allow") and verdict[14] == (None, "allow")  # an explicit allow among the aliases
    assert verdict[6] == verdict[7] == (None, "allow") and (got[6]["host"], got[6]["path"]) == ("", "")
    assert verdict[8] == verdict[9] == (None, "allow") and verdict[10] == (None, "allow") and verdict[11] == (None, "allow")
    assert verdict[12] == ("example.com/de/", "block") and (got[12]["host"], got[12]["path"]) == ("www.example.com", "/de/a")


def test_targets_that_are_relative_or_not_the_first(spark):
    link = lambda *us: "".join(f'<link rel=canonical href="{u}">' for u in us)
    fresh = '<meta http-equiv="refresh" content="0; url=../../b?q=http://x.y#z">'
    rows = [
        ("http://www.example.com/a", link("/de/x")), ("https://a.org/", link("//bad.net/x")), ("http://www.example.com/x/y?z", link("../de/./x")), ("http://b.org/c/d/e", fresh),
        ("http://c.org/", link("http://ok.org/", "http://bad.net/2")), ("http://d.org/x?y", link("?k=1")), ("http://e.org", link("mailto:a@bad.net", "#top", "p")), ("http://f.org/q/", '<base href="/de/">' + link("r")),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    links = url_filters.page_links(df)
    assert {tuple(r) for r in links.collect()} == {
        ("http://www.example.com/a", "http://www.example.com/de/x"), ("https://a.org/", "https://bad.net/x"), ("http://www.example.com/x/y?z", "http://www.example.com/de/x"),
        ("http://b.org/c/d/e", "http://b.org/b?q=http://x.y"), ("http://c.org/", "http://ok.org/"), ("http://c.org/", "http://bad.net/2"), ("http://d.org/x?y", "http://d.org/x?k=1"), ("http://e.org", "http://e.org/p"),
        ("http://f.org/q/", "http://f.org/de/r"),
    }
    got = {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(df, links, url_filters.RULES).collect()}
    assert [k for k in sorted(got) if got[k] == "block"] == [0, 1, 2, 4]


HUBS = [
    (1, "http://a.org/1", '<link rel="canonical" href="http://HUB.org/p">'), (2, "HTTP://hub.org/p", '<link rel=canonical href="http://bad.net/p">'),
    (3, "http://a.org/3", '<link rel="canonical" href="http://hub2.org/p?a=1&amp;b=2">'), (4, "http://hub2.org/p?a=1&b=2", '<LINK REL="alternate Canonical" HREF=" http://bad.net/q ">'),
    (5, "http://a.org/5", '<!-- <link rel="canonical" href="http://bad.net/r"> -->'), (6, "http://a.org/6", '<!-- open <link rel="canonical" href="http://bad.net/r">'),
    (7, "http://a.org/7", '<link rel="alternate" href="http://bad.net/s"><link rel="uncanonical" href="http://bad.net/s"><meta name="canonical">'),
    (8, "https://a.org:443", '<link data-href="http://ok.org/" rel="canonical" href="//bad.net/t">'), (9, "https://A.org/", None),
    (10, "http://a.org/10", "<meta content='3;URL=http://bad.net/u' http-equiv='Refresh'>"), (11, "http://www.Example.com/", '<link rel="canonical" href="/de/x">'),
]


def test_hosts_references_comments_and_words(spark):
    df = spark.createDataFrame(HUBS, "page_id long, url string, html string")
    got = url_filters.filter_urls(df, url_filters.page_links(df), url_filters.RULES)
    assert sorted(r["page_id"] for r in got.where("verdict = 'block'").collect()) == [1, 2, 3, 4, 8, 9, 10, 11]
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", HUBS)
    want = con.sql(url_filters.OP9_SQL)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_numeric_references(spark):
    df = spark.createDataFrame([(1, "http://a.org/", '<link rel="canonical" href="http:&#x2F;&#47;bad.net/">')], "page_id long, url string, html string")
    assert url_filters.filter_urls(df, url_filters.page_links(df), url_filters.RULES).first()["verdict"] == "block"


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    df = url_filters.op9_url_filters(spark, sf)
    want = con.sql(url_filters.OP9_SQL)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, df.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_rows(pages):
    assert url_filters.filter_urls(pages, url_filters.page_links(pages), url_filters.RULES).count() == 15
    none = pages.where("page_id < 0")
    assert url_filters.filter_urls(none, url_filters.page_links(none), url_filters.RULES).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(500 + i, 501 + i) for i in range(60)] + [(700, 701 + i) for i in range(80)] + [(5, 5), (None, 4)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
