"""The catalogue's queries against their SQL."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from pagelens.functions import urls
from pagelens.plans import catalog, site_catalog

SF = "/root/testdata/sf0.001"
QUERIES = catalog.QUERIES | site_catalog.QUERIES
ORACLES = catalog.ORACLES | site_catalog.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_as_its_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    rows = QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    want = c.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert Counter(map(tuple, rows.select(*columns).collect())) == Counter(want.project(", ".join(columns)).fetchall())


def test_normalized_urls(spark):
    cases = {
        "HTTP://WWW.Example.com:80//a//b/?utm_source=x&q=1&ref=z#f": "http://www.example.com/a/b?q=1",
        "https://example.com": "https://example.com/",
        "https://example.com:8443/x/": "https://example.com:8443/x",
        "mailto:me@example.com": None,
        "#top": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    from pyspark.sql import functions as F

    assert {r.url: r.n for r in df.select("url", urls.normalize_absolute(F.col("url")).alias("n")).collect()} == cases


ODD = """https://u:p@e.com/a|https://[::1]/a|https://[::1]:8080/a/|https://e.com/?x|https://e.com/?x=&y|https://e.com/a b?q=1 2|https://e.com/?q=a+b|https://e.com/?q=a%20b&utm_source=1|https://e.com/?a=b=c
https://e.com:443/|http://e.com:080/|http://e.com:99999/|https://e.com:/x|https://e.com/%7Ea//b/|https://e.com/a;b/c;d?x=1|https://É.com/é?ü=ö|HTTPS://E.COM/A?REF=1&B=2#f?x|https://e.com?x=1&&y=2&|https://e.com/?&=1
https:///a|//e.com/a|ftp://e.com/|javascript:1|mailto:a@b.c|  https://e.com/a/  |https://e_x.com/a|https://e.com/a?b=1,2|https://e.com/a?b=c/d|https://e.com/a?b=c#d=e&f|https://e.com/#|https://e.com/a/?""".replace("\n", "|").split("|")


def test_native_and_resolved_addresses_agree(spark):
    from pyspark.sql import functions as F

    from pagelens.functions import resolve

    df = spark.createDataFrame([(x,) for x in [*ODD, "", None]], "url string")
    got = {r.url: r.n for r in df.select("url", urls.normalize_absolute(F.col("url")).alias("n")).collect()}
    assert {k: v for k, v in got.items() if v != resolve.normal(k)} == {}
    assert got["https://u:p@e.com/a"] == "https://e.com/a" and got["https://[::1]/a"] == "https://[::1]/a" and got["https://e.com/?x"] == "https://e.com/?x="
    assert df.limit(0).select(urls.normalize_absolute(F.col("url"))).count() == 0


def test_attributes_without_and_with_either_quote(spark):
    from pyspark.sql import functions as F

    from pagelens.functions import html

    pages = ["<html lang=en><A HREF='/a'>x</A> <a class=b href=/c>y</a><a\nhref=\"/d e\">", "<HTML class='x' LANG = 'de-AT'><a name=q>z</a>", '<html lang="fr ">', "", None]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, page string").select("i", html.lang(F.col("page")).alias("lang"), html.hrefs(F.col("page")).alias("hrefs")).orderBy("i").collect()
    assert [r.lang for r in rows] == ["en", "de-AT", "fr", "", None]
    assert [r.hrefs for r in rows] == [["/a", "/c", "/d e"], [], [], [], None]
