"""Visits to sites: a web of answers in memory for the rules, and one real server through the data source."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from pagelens.sources import crawl
from pagelens.sources.crawl import Answer, Limits, Visit

HTML = {"content-type": "text/html; charset=utf-8"}


def page(*links):
    return Answer(200, HTML, ("<html><body>" + "".join(f"<a href='{x}'>x</a>" for x in links) + "</body></html>").encode())


def to(where, status=301):
    return Answer(status, {"location": where}, b"")


def visit(web, start="https://e.example/", **limits):
    asked = []

    def get(url):
        asked.append(url)
        got = web.get(url, Answer(404, HTML, b"<p>none"))
        if isinstance(got, Exception):
            raise got
        return got

    v = Visit(start, Limits(delay=0)._replace(**limits), get, private=lambda host: host.startswith("10."))
    return v, asked


def test_pages_are_visited_level_by_level_and_within_bounds():
    web = {
        "https://e.example/": page("/a", "/b/", "/a#x", "/a?utm_source=1", "/pic.png", "/login", "https://other.example/", "mailto:x@y"),
        "https://e.example/a": page("/a/deep", "/b"),
        "https://e.example/b": page(),
        "https://e.example/a/deep": page("/a/deep/er"),
        "https://e.example/a/deep/er": page("/too/deep/for/this"),
    }
    rows = list(visit(web)[0].pages())
    assert [(r["url"].removeprefix("https://e.example"), r["depth"]) for r in rows] == [("/", 0), ("/a", 1), ("/b", 1), ("/a/deep", 2), ("/a/deep/er", 3)]
    assert [r["is_home"] for r in rows] == [True, False, False, False, False] and rows[1]["from_url"] == "https://e.example/"
    assert len(list(visit(web, pages=2)[0].pages())) == 2 and len(list(visit(web, depth=1)[0].pages())) == 3


def test_sitemaps_are_read_and_top_up():
    index = Answer(200, {}, b"<sitemapindex><sitemap><loc>https://e.example/s1.xml</loc></sitemap><sitemap><loc>/gone.xml</loc></sitemap></sitemapindex>")
    urls = Answer(200, {}, b"<urlset><url><loc>https://e.example/only/here</loc></url><url><loc>https://e.example/a/b/c/d/e</loc></url><url><loc>https://e.example/x.pdf</loc></url><url><loc>https://else.example/</loc></url></urlset>")
    web = {"https://e.example/robots.txt": Answer(200, {}, b"Sitemap: https://e.example/index.xml\nUser-agent: *\nDisallow: /shut"), "https://e.example/index.xml": index, "https://e.example/s1.xml": urls, "https://e.example/": page("/shut/x"), "https://e.example/only/here": page()}
    v, _ = visit(web)
    rows = {r["url"].removeprefix("https://e.example"): r for r in v.pages()}
    assert set(rows) == {"/", "/shut/x", "/only/here", "/x.pdf"}
    assert rows["/only/here"]["in_sitemap"] and not rows["/"]["in_sitemap"] and rows["/only/here"]["from_url"] == "sitemap"
    assert not rows["/shut/x"]["robots_allowed"] and rows["/shut/x"]["outcome"] == "refused_robots" and rows["/shut/x"]["status"] is None
    assert v.sitemaps == ["https://e.example/index.xml", "https://e.example/s1.xml"]


@pytest.mark.parametrize(
    ("web", "outcome", "home", "hops"),
    [
        ({"/": to("/new"), "/new": page()}, "followed", "ok", 1),
        ({"/": to("/1", 302), "/1": to("/2", 307), "/2": page()}, "followed", "ok", 2),
        ({"/": to("https://other.example/")}, "refused_external_domain", "external_redirect", 1),
        ({"/": to("https://www.e.example/x"), "https://www.e.example/x": page()}, "followed", "ok", 1),
        ({"/": to("/a"), "/a": to("/")}, "loop", "redirect_loop", 1),
        ({"/": to("")}, "bad_location", "bad_location", 0),
        ({"/": to("ftp://e.example/")}, "bad_location", "bad_location", 0),
        ({"/": to("/0"), **{f"/{i}": to(f"/{i + 1}") for i in range(9)}}, "limit_exceeded", "redirect_limit", 5),
        ({"/": OSError("gone")}, "transport_error", "transport_error", 0),
        ({"/": Answer(503, HTML, b"busy")}, "none", "http_error", 0),
        ({"/robots.txt": Answer(200, {}, b"User-agent: *\nDisallow: /"), "/": page()}, "refused_robots", "robots_blocked", 0),
        ({"/robots.txt": Answer(200, {}, b"User-agent: *\nDisallow: /shut"), "/": to("/shut/a")}, "refused_robots", "robots_redirect", 1),
    ],
)
def test_redirects_and_home_outcomes(spark, web, outcome, home, hops):
    row = next(visit({k if "://" in k else f"https://e.example{k}": v for k, v in web.items()})[0].pages())
    assert (row["outcome"], row["redirects"]) == (outcome, hops)
    rows = spark.createDataFrame([tuple((row | {"page_id": 1}).values())], crawl.PAGES)
    assert [r.home_outcome for r in crawl.homes(rows).collect()] == [home]


def test_private_addresses_are_refused():
    row = next(visit({}, "http://10.0.0.1/")[0].pages())
    assert row["outcome"] == "refused_non_public_address" and not row["fetched"]
    assert crawl.is_private("127.0.0.1") and crawl.is_private("no-such-host.invalid") and not crawl.is_private("8.8.8.8")


class _Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        found = {"/": page("/a", "/big"), "/a": page("/"), "/robots.txt": Answer(200, {"content-type": "text/plain"}, b"User-agent: *\nDisallow: /none"), "/big": Answer(200, HTML, b"<p>" + b"x" * 5000)}.get(self.path, Answer(404, HTML, b"<p>none"))
        self.send_response(found.status)
        for k, v in found.headers.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(found.body)

    def log_message(self, *_):
        pass


def test_the_data_source_reads_a_real_server(spark):
    server = HTTPServer(("127.0.0.1", 0), _Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    start = f"http://127.0.0.1:{server.server_port}/"
    spark.dataSource.register(crawl.SiteCrawl)
    read = lambda **options: spark.read.format("site_crawl").options(sites=f"{start}\n{start}\n", private="true", delay="0", page_bytes="1000", **options).load()
    rows = read().orderBy("page_id").collect()
    assert [(r.url.removeprefix(start), r.status, r.truncated) for r in rows] == [("", 200, False), ("a", 200, False), ("big", 200, True)]
    files = read(what="files").collect()
    assert [(r.robots.startswith("User-agent"), r.robots_status, r.sitemap_urls) for r in files] == [(True, 200, [])]
    assert spark.read.format("site_crawl").load().count() == 0
    server.shutdown()
