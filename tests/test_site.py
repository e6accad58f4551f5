"""Operators that need Python, and edge cases of the native ones, on small fixtures."""

from pyspark.sql import functions as F

from pagelens.functions import classify, html, resolve, text
from pagelens.operators import names, parse, robots, site
from pagelens.plans import site_catalog
from pagelens.sources import tables as sources
from pagelens.streaming import pages

SF = "/root/testdata/sf0.001"
PAGE = """<!doctype html><html lang=en><head><title>A &amp; B | x</title><meta name="Description" content=" d "><meta property="og:site_name" content="S">
<link rel="canonical" href="/c/?utm_source=1"><script type="application/ld+json">{"@type":"Organization","x":[{"@type":["Offer","Y"]}]}</script>
<script type="application/ld+json">{bad}</script></head><body><nav><a href="/a">Go<b>!</a><a href="https://other.org/z">Contact us</a></nav>
<h1>Hi <i>you</i></h1><p>one<p>two<script>var x="<p>no"</script><img src=x><img alt="y" src=z><footer>Me. <a href="/a/">A</a></footer></body></html>"""


def test_parsed_page(spark):
    pages = spark.createDataFrame([(1, "https://www.e.com/p", PAGE), (2, None, None), (3, "x", "<p>open <b")], "page_id int, url string, html string")
    out = {r.page_id: r for r in parse.parsed_pages(pages).collect()}
    one = out[1]
    assert (one.title, one.lang, one.description, one.canonical, one.og) == ("A & B | x", "en", "d", "https://www.e.com/c", {"site_name": "S"})
    assert (one.h1, one.headings_total, one.images, one.images_without_alt) == (["Hi you"], 1, 2, 1)
    assert (one.internal_links, one.external_links, one.nav_links, one.footer_links) == (["https://www.e.com/a"], ["https://other.org/z"], ["https://www.e.com/a"], ["https://www.e.com/a"])
    assert one.jsonld_types == ["Offer", "Organization", "Y"] and len(one.jsonld_errors) == 1 and one.ctas == ["contact us"]
    assert one.text == "Go ! Contact us Hi you one two Me. A" and (one.has_nav, one.has_footer, one.has_main) == (True, True, False)
    assert out[2].words == 0 and out[3].text.startswith("open")
    assert parse.parsed_pages(pages.limit(0)).count() == 0


def test_parser_agrees_with_the_native_columns(spark):
    rows, page = site_catalog.derived_pages(spark, SF), F.col("html")
    n = html.counts(page)
    native = rows.select("page_id", html.title(page).alias("title"), n["h1_total"], n["images_total"].alias("images"), html.flags(page)["has_nav"].alias("has_nav"), text.word_count(site.visible_text(page)).alias("words"))
    native = native.toDF("page_id", "title", "h1_total", "images", "has_nav", "words")
    both = native.join(parse.parsed_pages(rows).select("page_id", F.col("title").alias("t"), F.size("h1").alias("h"), F.col("images").alias("i"), F.col("has_nav").alias("n"), F.col("words").alias("w")), "page_id")
    assert both.count() > 0
    assert both.filter("title <> t or h1_total <> h or images <> i or has_nav <> n or words <> w").count() == 0


def test_robots(spark):
    file = "User-agent: a # x\nUser-agent: GPTBot\nDisallow: /\nAllow: /y\n\nUser-agent: *\nDisallow: /p\nDisallow:\nUser-agent: ccbot\nDisallow: /q\nnonsense"
    files = spark.createDataFrame([("s", file), ("t", "Disallow: /"), ("u", None), ("v", "")], "site string, robots string")
    block = {r.site: (r.blocks_site, r.paths) for r in robots.site_block(files).collect()}
    assert block == {"s": (False, ["/p"]), "t": (True, []), "u": (False, []), "v": (False, [])}
    agents = {(r.site, r.agent): (r.blocked, r.paths) for r in robots.ai_agents(files).collect()}
    assert agents == {("s", "gptbot"): (True, ["/"]), ("s", "ccbot"): (False, ["/q"])}
    pages = spark.createDataFrame([("s", "https://s/p/1"), ("s", "https://s/z"), ("u", "https://u/"), ("none", None)], "site string, url string")
    assert [r.robots_allowed for r in robots.may_fetch(pages, files, "pagelens").orderBy("site", "url").collect()] == [True, False, True, True]


def test_sitemaps(spark):
    maps = spark.createDataFrame([("s", "https://s.org/m.xml", "<urlset xmlns='x'><url><loc> https://s.org/a&amp;b/ </loc></url><url><loc>/c</loc><loc>/c/</loc><loc>cut"), ("s", "https://s.org/i", "<sitemapindex><sitemap><loc>https://s.org/m.xml</loc></sitemap></sitemapindex>"), ("t", None, None)], "site string, url string, xml string")
    assert sorted((r.url, r.is_index) for r in robots.sitemap_urls(maps).collect()) == [("https://s.org/a&b", False), ("https://s.org/c", False), ("https://s.org/m.xml", True)]


def test_addresses():
    base = "https://www.e.com/a/b"
    assert resolve.normal("../x//y/?b=1&utm_source=2&c=#f", base) == "https://www.e.com/x/y?b=1&c="
    assert [resolve.normal(x, base) for x in ("", None, "#a", "mailto:x@y", "ftp://e/x", "http://e:bad/")] == [None] * 6
    assert resolve.absolute("x/?ref=1", base) == "https://www.e.com/a/x/?ref=1"
    assert resolve.same_site("https://shop.e.com/", base) and not resolve.same_site("https://he.com", base)
    assert [resolve.private_address(x) for x in ("127.0.0.1", "10.1.1.1", "8.8.8.8", "::1", "e.com")] == [True, True, False, True, None]
    assert resolve.target("E.com/x/") == "https://e.com/x"
    for bad in ("ftp://e.com", "https://u:p@e.com", "http://127.0.0.1", "http://no_host"):
        try:
            resolve.target(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_similarity_of_names():
    cases = {("acme", "acme"): 1.0, ("acme", ""): 0.0, (None, "acme"): 0.0, ("acme", "acme corp"): 0.95, ("acme corporation", "acm"): 0.95, ("ab corp", "abx corp"): None, ("international business machines", "ibm"): 0.93}
    for (a, b), want in cases.items():
        got = names.similarity(a, b)
        assert got == names.similarity(b, a) and (got == want if want is not None else got < 0.95)
    assert names.similarity("acme tools", "acme paint") >= 0.8 > names.similarity("red fox", "blue whale")


def test_names(spark):
    assert [names.similarity(*p) for p in (("", "a"), ("a b", "a b"), ("acme tech", "acme technologies"), ("ibm", "international business machines"))] == [0.0, 1.0, 0.95, 0.93]
    rows = [("s", i, n) for i, n in enumerate(["acme", "acme corp tools", "zenith", "acme", "zenith", None, ""])] + [("t", 1, "solo")]
    df = spark.createDataFrame(rows, "site string, seq int, name string")
    found = {(r.site, r.leader): r["size"] for r in names.name_clusters(df).collect()}
    assert found == {("s", "acme"): 3, ("s", "zenith"): 2, ("t", "solo"): 1}
    assert [(r.site, r.leaders) for r in names.name_conflicts(df).collect()] == [("s", ["acme", "zenith"])]
    facts = spark.createDataFrame([("s", "phone", "1112223333", "jsonld"), ("s", "phone", "9998887777", "text"), ("s", "email", "a@b.c", "jsonld"), ("s", "email", "x.a@b.c", "text"), ("t", "phone", "1", "jsonld"), ("t", "phone", None, "text")], "site string, kind string, value string, source string")
    assert [(r.site, r.kind) for r in names.contact_conflicts(facts).collect()] == [("s", "phone")]
    years = spark.createDataFrame([("s", y) for y in ("2019", "2020", "2026", None)] + [("t", "2026")], "site string, year string")
    assert {r.site: (r.dated, r.stale, r.at_risk) for r in names.freshness(years, 2026).collect()} == {"s": (3, 2, True), "t": (1, 0, False)}


def test_rounding_is_on_the_binary_value(spark):
    row = spark.range(1).select(classify.rounded(F.lit(201) / F.lit(400), 3).alias("x"), classify.rounded(F.lit(0.0625), 3).alias("y")).first()
    assert (row.x, row.y) == (round(201 / 400, 3), round(0.0625, 3))


def test_lower_median(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 7), ("b", 1), ("b", 4), ("c", 5), ("c", 5), ("c", 5), ("c", 9)], "k string, v int")
    assert {r.k: r["median"] for r in site.lower_median(df, "k", "v").collect()} == {"a": 2, "b": 2, "c": 5}


def test_latest_year(spark):
    assert spark.createDataFrame([(["2019-01-02", "May 3, 2024", "x"],), ([],)], "d array<string>").select(text.latest_year(F.col("d")).alias("y")).collect() == [("2024",), (None,)]


def test_report_round_trip(spark, tmp_path):
    rows = site_catalog.evidence(spark, SF)
    found = site.ranked(site.findings(rows))
    report = sources.reports(found, site.scores(site.findings(rows), rows))
    assert sources.problems(report).count() == 0
    report.write.json(str(tmp_path / "r"))
    again = sources.read_reports(spark, str(tmp_path / "r"))
    assert again.count() == report.count() == rows.select("site").distinct().count()
    broken = again.withColumn("findings", F.transform("findings", lambda f: f.withField("severity", F.lit("odd")).withField("finding_id", F.lit("F-001"))))
    assert {r.problem for r in sources.problems(broken).collect()} >= {"unknown severity", "finding id used twice"}
    page = sources.viewer(again.first())
    assert page.startswith("<!doctype html>") and "<script" not in page


def test_arriving_pages_are_parsed_once(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for run, rows in enumerate([[(1, "https://e.com/", PAGE)], [(2, "https://e.com/2", PAGE), (3, None, None)]]):
        spark.createDataFrame(rows, pages.PAGES).write.mode("append").parquet(source)
        pages.parse_arriving(spark, source, sink, mark).awaitTermination(120)
        assert sorted(r.page_id for r in spark.read.parquet(sink).select("page_id").collect()) == [[1], [1, 2, 3]][run]


def test_home_and_agent_findings(spark):
    outcomes = ["ok", "external_redirect", "redirect_loop", "private_redirect", "robots_blocked", "timeout", None]
    sites = spark.createDataFrame([(f"s{i}", False, o) for i, o in enumerate(outcomes)] + [("x", True, "ok")], "site string, blocks_site boolean, home_outcome string")
    found = {r.site: (r.check, r.severity) for r in site.home_findings(sites).collect()}
    assert found == {
        "s1": ("homepage_redirects_offsite", "low"), "s2": ("redirect_configuration_error", "high"), "s3": ("redirect_to_private_address", "high"),
        "s4": ("important_page_robots_blocked", "high"), "s5": ("site_unreachable", "critical"), "s6": ("site_unreachable", "critical"), "x": ("robots_blocks_site", "critical"),
    }
    rules = spark.createDataFrame([("s", "gptbot", True), ("s", "ccbot", True), ("t", "ccbot", False)], "site string, agent string, blocked boolean")
    assert [(r.site, r.check, r.severity) for r in site.agent_findings(rules).collect()] == [("s", "ai_crawler_blocked", "high")]


def test_navigation_findings(spark):
    rows = [("a", 10, 0.2, "strong"), ("b", 10, 0.9, "strong"), ("c", 10, 0.0, "weak"), ("d", 10, 0.0, "absent"), ("e", 3, 0.0, "absent")]
    found = {r.site: (r.check, r.severity, r.reach, r.affected) for r in site.navigation_findings(spark.createDataFrame(rows, "site string, pages long, landmark_share double, strength string")).collect()}
    assert found == {"a": ("missing_nav_landmark", "low", 0.8, 8), "c": ("weak_navigation", "medium", 0.5, 10), "d": ("weak_navigation", "high", 1.0, 10)}


def test_checks_over_wider_evidence(spark):
    base = site_catalog.evidence(spark, SF).withColumn("canonical_status", F.lit(200))
    first = F.col("page_id") < 8
    plain = {r.check for r in site.findings(base).collect()}
    wide = base.withColumns({
        "robots_allowed": ~first, "redirects": F.when(first, 2), "robots_header": F.when(first, "NoIndex"), "rendered": first, "script_dependent": first,
        "canonical": F.when(first, "https://elsewhere.example/"), "jsonld_errors": F.when(first, F.array(F.lit("x"))), "defects": F.when(first, F.array(F.lit("x"))), "name_likeness": F.when(first, 0.1), "ctas": F.when(~first, F.array(F.lit("x"))),
    })
    found = site.findings(wide).filter("site = 'site0.example'").collect()
    added = {r.check: (r.affected, r.urls) for r in found if r.check not in plain}
    home = ["https://site0.example/"]
    assert set(added) >= set(site._wider_checks()) - {"no_next_step"}
    assert all(v == (1, home) for v in added.values())
