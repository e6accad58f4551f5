"""Whole audits of small sites that are each wrong in one way, written for these tests: what must be reported, and that nothing else is."""

import json

import pytest
from pyspark.sql import functions as F

from pagelens.operators import facts, parse, site

PATHS = ["", "about", "contact", "pricing", "products/lamp", "products/chair", "products/stool", "services", "faq", "blog/light"]
WORDS = " ".join(f"calm word {i} about lamps and chairs that people use at home every day" for i in range(14))
ORG = {"@type": "Organization", "name": "Brightwood", "url": "https://x.example/", "telephone": "+44 20 7946 0000", "email": "hello@brightwood.example", "sameAs": ["https://www.linkedin.com/company/brightwood"]}


def page(path, at, org=ORG, ld=(), title=None, h1=None, nav=PATHS, body=WORDS, date="2026-05-01", lang="en", description="What this page tells.", more="", cta="Get started", footer="© 2026 Brightwood. hello@brightwood.example +44 20 7946 0000"):
    product = {"@type": "Product", "name": path.split("/")[-1].title(), "offers": {"price": "20", "priceCurrency": "GBP"}} if path.startswith("products/") else None
    blocks = [x for x in (org, product, *ld) if x]
    name = path.split("/")[-1].title() or "Brightwood makes calm lamps"
    links = "".join(f'<a href="/{p}">{p or "front"}</a>' for p in nav)
    title = f"{name} for quiet homes | Brightwood" if title is None else title
    h1 = name if h1 is None else h1
    return (
        f"<!doctype html><html lang='{lang}'><head><title>{title}</title>" + (f"<meta content='{description}' name='description'>" if description else "")
        + "".join(f"<script type='application/ld+json'>{x if isinstance(x, str) else json.dumps(x)}</script>" for x in blocks)
        + f"</head><body>{f'<nav>{links}</nav>' if nav else ''}" + (f"<h1>{h1}</h1>" if h1 else "")
        + f"<p>We offer lamps. {body}</p>" + (f"<time datetime='{date}'>then</time>" if date else "") + f"<a href='/contact'>{cta}</a>{more}<footer>{footer}</footer></body></html>"
    )


def bare(path, **other):
    return page(path, 0, nav=[], **other).replace("<a href='/contact'>Get started</a>", "")


SITES = {
    "good": lambda p: page(p, 0),
    "german": lambda p: page(p, 0, lang="de-DE", title="Startseite" if not p else None, cta="Los"),
    "noschema": lambda p: page(p, 0, org=None).replace('"@type": "Product"', '"@type": "Thing"'),
    "typelist": lambda p: page(p, 0, org={**ORG, "@type": ["Thing", "Organization"]}),
    "badjson": lambda p: page(p, 0, ld=["{broken"] if p == "about" else ()),
    "halfschema": lambda p: page(p, 0, ld=[{"@type": "Article", "headline": ""}] if p == "faq" else ()),
    "mismatch": lambda p: page(p, 0, h1="Garden furniture covers" if p == "products/lamp" else None),
    "stale": lambda p: page(p, 0, date="2019-02-03", footer="© Brightwood. hello@brightwood.example +44 20 7946 0000"),
    "names": lambda p: page(p, 0, footer="© 2026 Quarrystone Partners."),
    "contacts": lambda p: page(p, 0, footer="© 2026 Brightwood. 0161 496 0123 999"),
    "nosocial": lambda p: page(p, 0, org={k: v for k, v in ORG.items() if k != "sameAs"}),
    "vague": lambda p: page(p, 0, **({"title": "Home", "h1": "Welcome"} if not p else {})),
    "noindex": lambda p: page(p, 0, more="<meta content='noindex' name='robots'>" if p == "pricing" else ""),
    "deadend": lambda p: page(p, 0, nav=PATHS[:2], cta="see") if p == "pricing" else page(p, 0),
    "nolandmark": lambda p: page(p, 0).replace("<nav>", "<div>").replace("</nav>", "</div>"),
    "lost": lambda p: bare(p) if p else page(p, 0, nav=PATHS[:2], cta="Get started"),
    "broken": lambda p: page(p, 0),
    "shut": lambda p: page(p, 0),
    "moved": lambda p: page(p, 0, org=None),
}
#: Checks that must be raised, and others that may be.
EXPECTED = {
    "good": set(), "german": set(), "typelist": set(), "noschema": {"missing_organization_identity", "missing_product_structured_data"}, "badjson": {"invalid_structured_data"},
    "halfschema": {"incomplete_structured_data"}, "mismatch": {"structured_visible_mismatch"}, "stale": {"freshness_risk"}, "names": {"entity_name_conflict"}, "contacts": {"contact_fact_conflict"},
    "nosocial": {"no_corroborating_entity_links"}, "vague": {"home_purpose_unclear"}, "noindex": {"noindex_on_important_page"}, "deadend": {"no_next_step"}, "nolandmark": {"missing_nav_landmark"},
    "broken": {"sitemap_broken_urls", "important_page_http_error"}, "shut": {"robots_blocks_site"}, "moved": {"homepage_redirects_offsite", "missing_organization_identity"},
}


@pytest.fixture(scope="module")
def audited(spark):
    rows = []
    for name, build in SITES.items():
        for i, p in enumerate(PATHS):
            status = 404 if name == "broken" and p == "services" else 200
            rows.append((len(rows), f"{name}.example", f"https://{name}.example/{p}", status, not p, True, build(p) if status == 200 else "", ["nosocial"] if p == "lamp" else None))
    pages = spark.createDataFrame(rows, "page_id long, site string, url string, status int, is_home boolean, in_sitemap boolean, html string, product_names array<string>").drop("product_names")
    evidence = site.page_evidence(pages).cache()
    edges = site.link_edges(site.page_columns(pages))
    homes = spark.createDataFrame([("shut.example", True, "ok"), ("moved.example", False, "external_redirect"), ("good.example", False, "ok")], "site string, blocks_site boolean, home_outcome string")
    agents = spark.createDataFrame([("shut.example", "gptbot", True)], "site string, agent string, blocked boolean")
    return evidence, site.audit(evidence, edges, 2026, homes, agents)


def test_each_site_is_wrong_in_its_own_way(audited):
    found = {}
    for r in audited[1].collect():
        found.setdefault(r.site.split(".")[0], set()).add(r.check)
    wrong = {name: (sorted(found.get(name, ())), sorted(want)) for name, want in EXPECTED.items() if found.get(name, set()) != want}
    assert wrong == {}
    assert found["lost"] >= {"weak_navigation", "important_page_orphaned", "context_loss_orphan", "no_next_step"} and "home_purpose_unclear" not in found["lost"]


def test_scores_have_six_dimensions(audited):
    evidence, found = audited
    got = {}
    for r in site.scores(found, evidence).collect():
        got.setdefault(r.site.split(".")[0], {})[r.dimension] = r.score
    assert all(len(x) == 7 for x in got.values())
    assert set(got["good"].values()) == {100} and got["stale"]["freshness"] < 100 and got["contacts"]["fact_consistency"] < 100
    undated = site.scores(found, evidence.withColumns({"year": F.lit(None).cast("string"), "facts": F.slice("facts", 1, 0), "text_facts": F.slice("text_facts", 1, 0)}))
    assert {r.score for r in undated.filter("site = 'good.example' and dimension in ('freshness', 'fact_consistency')").collect()} == {None}


def test_findings_are_ranked_and_merged(audited):
    rows = site.ranked(audited[1]).filter("site = 'lost.example'").orderBy("finding_id").collect()
    assert [r.finding_id for r in rows] == [f"F-{i + 1:03d}" for i in range(len(rows))] and [r["rank"] for r in rows] == sorted((r["rank"] for r in rows), reverse=True)


def test_facts_of_a_page(audited):
    got = {(r.kind, r.value, r.normalized, r.source) for r in facts.page_facts(audited[0].filter("url = 'https://good.example/contact'")).collect()}
    assert got >= {("organization_name", "Brightwood", "brightwood", "jsonld"), ("organization_name", "Brightwood", "brightwood", "footer"), ("phone", "+44 20 7946 0000", "2079460000", "jsonld"), ("email", "hello@brightwood.example", "hello@brightwood.example", "text"), ("social", "https://www.linkedin.com/company/brightwood", "https://www.linkedin.com/company/brightwood", "jsonld")}
    assert {r.source for r in facts.page_facts(audited[0].filter("url = 'https://good.example/faq'")).filter("kind = 'phone'").collect()} == {"jsonld", "footer"}
    price = facts.page_facts(audited[0].filter("url = 'https://good.example/products/lamp'")).filter("kind = 'price'").first()
    assert (price.value, price.normalized) == ("GBP 20", "20")
    assert facts.facts_by_kind(facts.page_facts(audited[0])).filter("kind = 'organization_name' and site = 'names.example'").first().distinct_values == 2


def test_empty_tables_and_clashing_columns(spark, audited):
    none = audited[0].limit(0)
    edges = spark.createDataFrame([], "src long, dst long, is_nav boolean")
    found = site.audit(none, edges, 2026)
    assert found.count() == 0 and site.ranked(found).count() == 0 and site.scores(found, none).count() == 0
    pages = spark.createDataFrame([(None, None, None, None, None, None, None)], "page_id long, site string, url string, status int, is_home boolean, in_sitemap boolean, html string")
    assert site.page_evidence(pages).count() == 1
    with pytest.raises(ValueError, match="title"):
        parse.parsed_pages(pages.withColumn("title", F.lit(1)), keep=["title"])


def test_typed_nodes_are_met_once_and_in_order():
    blocks = [json.dumps({"@graph": [{"@type": "A", "name": "a"}, {"@type": "B", "x": [{"@type": "C"}]}], "@type": "G"}), json.dumps([{"@type": "A", "name": "a"}, {"no": "type"}])]
    assert [n["@type"] for n in parse.typed_nodes(blocks)] == ["A", "B", "C", "G"]
    assert parse.judged_nodes(parse.typed_nodes([json.dumps({"@type": "Organization", "name": " ", "url": "{{url}}"})])) == (["Organization has an empty name", "Organization url holds a placeholder: {{url}}"], "")
    assert parse.dates_of({"updated_time": "2020-01-01"}, ["2021"], [{"datePublished": "2022"}, {"dateModified": 5}], "On May 3, 2019 and in 1985, 2020-01-01") == ["2020-01-01", "2021", "2022", "May 3, 2019", "1985"]
