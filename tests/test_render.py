"""Rendered pages beside raw ones, crawl summaries, and the command line from a server to its reports."""

import threading
from http.server import HTTPServer

from pyspark.sql import functions as F

from pagelens import cli
from pagelens.operators import render, site
from pagelens.sources import tables
from tests.test_audit import PATHS, SITES
from tests.test_crawl import _Handler

PAGES = "page_id long, site string, url string, status int, is_home boolean, in_sitemap boolean, html string"


def test_rendered_pages(spark):
    words = " ".join(f"word{i}" for i in range(60))
    pages = spark.createDataFrame([(1, "https://e.org/", "<p>Short start."), (2, "https://e.org/b", f"<p>{words}"), (3, "https://e.org/c", None), (4, None, None)], "page_id long, url string, html string")
    rendered = spark.createDataFrame([("https://e.org/", True, f"<p>Short start. {words} and this is the end. Tiny. Another sentence that is long enough.", None), ("https://e.org/b", True, f"<p>{words}", None), ("https://e.org/c", False, None, "timeout"), ("https://e.org/c", None, None, None)], "url string, ok boolean, html string, error string")
    got = {r.page_id: r for r in render.render_evidence(pages, rendered).collect()}
    assert (got[1].script_dependent, got[1].rendered, got[1].excerpt[:11]) == (True, True, "word0 word1") and got[1].excerpt.endswith("...") and len(got[1].excerpt) == 263
    assert (got[2].added_words, got[2].script_dependent, got[2].excerpt) == (0, False, "") and (got[3].rendered, got[3].added_ratio) == (False, 0.0) and not got[4].rendered
    status = render.render_status(rendered).first()
    assert (status.site, status.attempted, status.rendered, status.failed) == ("e.org", 4, 2, 2)
    assert render.render_evidence(pages.limit(0), rendered).count() == 0


def test_candidates_summaries_and_evidence_round_trip(spark, tmp_path):
    rows = [(i, "good.example", f"https://good.example/{p}", 200, not p, True, SITES["good"](p)) for i, p in enumerate(PATHS)] + [(90, "good.example", "https://good.example/api/v1", 200, False, False, "{}")]
    evidence = site.page_evidence(spark.createDataFrame(rows, PAGES)).cache()
    best = render.render_candidates(evidence, 3).orderBy("place").collect()
    assert best[0].url == "https://good.example/" and len(best) == 3
    assert [r.resources[0].url for r in tables.non_pages(evidence).collect()] == ["https://good.example/api/v1"]
    tables.write_json(evidence, str(tmp_path / "e"))
    again = tables.read_json(spark, str(tmp_path / "e"), evidence.schema)
    assert again.exceptAll(evidence).count() == 0 == evidence.exceptAll(again).count()
    raw = spark.createDataFrame([("s", 200, 0, "text/html", True), ("s", 404, 2, None, False), ("s", None, 1, "text/html", None)], "site string, status int, depth int, content_type string, ok boolean")
    r = render.crawl_summary(raw).first()
    assert (r.pages, r.in_order, r.shallowest, r.deepest, r.statuses, r.content_types) == (3, 1, 0, 2, {"200": 1, "404": 1, "none": 1}, {"none": 1, "text/html": 2})
    dependent = evidence.withColumns({"script_dependent": F.lit(True), "added_ratio": F.col("depth") / 10})
    assert render.most_dependent(dependent).first().added_ratio == 0.2


def test_command_line(spark, tmp_path, capsys):
    server = HTTPServer(("127.0.0.1", 0), _Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    assert cli.main([str(tmp_path / "r"), "--sites", f"http://127.0.0.1:{server.server_port}/", "--private", "--year", "2026", "--evidence", str(tmp_path / "e"), "--module", "engagement"]) == 0
    server.shutdown()
    report = tables.read_reports(spark, str(tmp_path / "r")).first()
    assert report.site == "127.0.0.1" and report.findings and {f.check for f in report.findings} <= set(site.ENGAGEMENT) and "127.0.0.1: " in capsys.readouterr().out
    assert spark.read.json(str(tmp_path / "e")).count() == 3
    assert cli.main([str(tmp_path / "x")]) == 2
