"""Site evidence: the link graph, page verdicts, findings and scores as DataFrame operators.

Everything is grouped by site. A hot site is no hazard: counts combine before the shuffle, the listed addresses of a finding
come from a ranked window that Spark limits before the shuffle, and only one row for each (site, check) meets the sites' totals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import classify, html, text, urls
from pagelens.functions import facts as facts_functions
from pagelens.functions import vocab as V
from pagelens.operators import facts, names, parse
from pagelens.session import stored

IMPORTANT = 0.5
LISTED = 25
_HIDDEN = "|".join(rf"<{t}\b.*?</{t}\s*>" for t in ("head", "script", "style", "noscript", "template", "svg", "canvas"))
#: What no visitor reads: hidden elements, comments, tags and character references.
INVISIBLE = [rf"(?is){_HIDDEN}|<!--.*?-->", r"(?s)<[^>]*>", parse.PARTING]


def visible_text(page: Column) -> Column:
    return F.trim(F.regexp_replace(reduce(lambda c, p: F.regexp_replace(c, p, " "), INVISIBLE, page), r"\s+", " "))


def page_columns(pages: DataFrame) -> DataFrame:
    """What each page's HTML and address say by themselves: one pass of the parser, no text kept. A null page is an empty one; other columns of ``pages`` stay, a crawled page's depth among them."""
    c = F.col
    page = F.coalesce(c("html"), F.lit(""))
    flags = html.flags(page)
    own = [x for x in pages.columns if x not in ("html", "has_html", "has_head")]
    rows = pages.withColumns({"has_html": flags["has_html"], "has_head": flags["has_head"]})
    rows = parse.parsed_pages(rows, keep=[*own, "has_html", "has_head"])
    kinds = F.transform(F.concat("jsonld_types", "microdata_types"), F.lower)
    listed = lambda words: F.arrays_overlap(kinds, classify._list(words))
    return rows.select(
        *own, "has_html", "has_head", "title", "lang", "has_nav", "words", "images", "images_without_alt", "ctas", "jsonld_errors", "defects", "canonical", "primary_name", "internal_links", "nav_links",
        F.lower(F.array_join("h1", " ")).alias("h1"),
        F.size("h1").cast("long").alias("h1_total"),
        F.get("h1", F.lit(0)).alias("first_h1"),
        F.forall("h1", lambda x: F.size(F.split(F.trim(x), r"\s+")) <= 2).alias("h1_short"),
        ((c("description") != "") | (F.coalesce(c("og")["description"], F.lit("")) != "")).alias("described"),
        (c("description") != "").alias("has_description"),
        F.contains("robots", F.lit("noindex")).alias("noindex"),
        listed(V.ORGANISATION_TYPES).alias("names_organisation"),
        listed(V.PRODUCT_TYPES).alias("names_product"),
        (F.size("header_links") >= 2).alias("header_cluster"),
        (F.size("footer_links") >= 2).alias("footer_cluster"),
        F.left(c("text"), F.lit(400)).rlike(text.OFFER).alias("offers"),
        text.latest_year(c("dates")).alias("year"),
        *facts.fact_columns(c("site") if "site" in own else F.lit("")),
        *([] if "depth" in own else [urls.path_depth(c("url")).alias("depth")]),
        urls.path_shape(c("url")).alias("shape"),
    )


def link_edges(rows: DataFrame) -> DataFrame:
    """(src, dst, is_nav): links between pages of the table, by address, from the rows of ``page_columns``. Of pages that share an address the least id is linked."""
    aims = rows.filter("url is not null").groupBy(F.col("url").alias("__aim")).agg(F.min("page_id").alias("dst"))
    links = rows.select(F.col("page_id").alias("src"), F.explode("internal_links").alias("__aim"), "nav_links").withColumn("is_nav", F.array_contains("nav_links", F.col("__aim")))
    return links.join(aims, "__aim").groupBy("src", "dst").agg(F.max("is_nav").alias("is_nav"))


def link_counts(edges: DataFrame) -> DataFrame:
    """(page_id, incoming, in_nav): pages that link to it, itself left out, and whether navigation does."""
    return edges.filter("src <> dst").groupBy(F.col("dst").alias("page_id")).agg(F.count_distinct("src").alias("incoming"), F.max("is_nav").alias("in_nav"))


def out_counts(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst").groupBy(F.col("src").alias("page_id")).agg(F.count_distinct("dst").alias("out_links"))


def page_evidence(pages: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Every page with its links, role, kind and importance. What is no page has the role ``non_page`` and no importance. A null address or site has no siblings.

    edges: (src, dst, is_nav) by page id; without them the pages' own links count, those to pages outside the table as outgoing ones too."""
    columns = page_columns(pages)
    linked = edges is None
    if linked:
        columns = stored(columns)
        edges = link_edges(columns)
    # The status of the page that an address is canonical for, if it was fetched: the greatest, where it was more than once.
    known = pages.filter("url is not null").groupBy(F.col("url").alias("canonical")).agg(F.max("status").alias("canonical_status"))
    # Counted before they meet the pages, and joined: run-time skew splitting divides the pages of a hot shape, which a window would hold in one task.
    shapes = pages.select("site", urls.path_shape(F.col("url")).alias("shape")).groupBy("site", "shape").agg((F.count("*") - 1).alias("siblings"))
    rows = columns.join(shapes, ["site", "shape"], "left").join(link_counts(edges), "page_id", "left")
    rows = rows.withColumn("out_links", F.size(F.array_remove("internal_links", F.col("url"))).cast("long")) if linked else rows.join(out_counts(edges), "page_id", "left")
    rows = rows.drop("internal_links", "nav_links")
    rows = rows.join(known, "canonical", "left")
    rows = rows.fillna({"incoming": 0, "out_links": 0, "in_nav": False, "siblings": 0})
    kind, sure = classify.resource_kind(F.col("url"), F.lit("text/html"), F.col("status"), F.col("has_html"), F.col("has_head"), F.col("title") != "", F.col("words"), F.col("out_links"), F.col("siblings"))
    rows = rows.withColumn("kind", kind).withColumn("kind_confidence", sure).withColumn("ok", F.coalesce(F.col("status").between(200, 299), F.lit(False)))
    # An address that answers with an error keeps its role: it is missing as a page.
    page = (F.col("kind") == "page") | ~F.col("ok")
    rows = rows.withColumn("role", F.when(page, classify.role(F.col("url"), F.col("title"), F.col("h1"), F.col("is_home"))).otherwise("non_page"))
    worth = classify.importance(F.col("role"), F.col("depth"), F.col("in_nav"), F.col("incoming"), F.col("in_sitemap"), F.col("words"))
    return rows.withColumn("importance", F.when(F.col("role") == "non_page", 0.0).otherwise(worth)).withColumn("is_html", F.col("ok") & (F.col("kind") == "page") & (F.col("words") > 0))


def role_histogram(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("site", "role").agg(F.count("*").alias("pages"), F.round(F.avg("importance"), 6).alias("mean_importance"))


def sitemap_coverage(evidence: DataFrame) -> DataFrame:
    """Share of the pages in order that the sitemap lists; null where none is in order."""
    return evidence.groupBy("site").agg(classify.rounded(F.count_if(F.col("ok") & F.col("in_sitemap")) / F.nullif(F.count_if("ok"), F.lit(0)), 3).alias("coverage"), F.count_if(F.col("in_sitemap") & (F.col("status").isin(404, 410) | (F.col("status") >= 500))).alias("broken"))


def lower_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The middle of the whole numbers, or the floored mean of the two in the middle; by ranks, never by a collected group."""
    sizes = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(value)
    placed = sizes.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    middle = placed.filter((F.col("upto") >= low) & (F.col("upto") - F.col("n") < high))
    at = lambda place: F.max(F.when((F.col("upto") >= place) & (F.col("upto") - F.col("n") < place), F.col(value)))
    return middle.groupBy(key).agg(F.floor((at(low) + at(high)) / 2).alias("median"))


def repeated_links(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Links that at least three pages and 60 % of their site's pages share."""
    sites = evidence.select("page_id", "site")
    sizes = sites.groupBy("site").agg(F.count("*").alias("n"))
    shared = edges.select("src", "dst").distinct().join(sites, F.col("src") == F.col("page_id")).groupBy("site", "dst").agg(F.count("*").alias("pages"))
    return shared.join(sizes, "site").filter(F.col("pages") >= F.greatest(F.lit(3), F.bround(F.lit(0.6) * F.col("n")))).select("site", F.col("dst").alias("page_id"), "pages", classify.rounded(F.col("pages") / F.col("n"), 3).alias("share"))


def navigation(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """(site, pages, landmark_share, repeated, median_links, home_links, strength) over the sites' HTML pages.

    Header or footer links cluster where half of the pages have two or more of them."""
    pages = evidence.filter("is_html")
    totals = pages.groupBy("site").agg(F.count("*").alias("pages"), classify.rounded(F.avg(F.col("has_nav").cast("int")), 3).alias("landmark_share"), F.coalesce(F.max(F.when(F.col("is_home"), F.col("out_links"))), F.lit(0)).alias("home_links"), *([F.greatest(F.avg(F.col("header_cluster").cast("int")), F.avg(F.col("footer_cluster").cast("int"))).alias("cluster_share")] if "header_cluster" in pages.columns else [F.lit(0.0).alias("cluster_share")]))
    repeated = repeated_links(pages, edges).groupBy("site").agg(F.count("*").alias("repeated"))
    rows = totals.join(repeated, "site", "left").join(lower_median(pages, "site", "out_links").withColumnRenamed("median", "median_links"), "site", "left").fillna({"repeated": 0, "median_links": 0})
    landmark, many, cluster = F.col("landmark_share") >= 0.5, F.col("repeated") >= 3, F.col("cluster_share") >= 0.5
    few = F.when(landmark | (F.col("home_links") >= 4), "probable").when(F.col("home_links") >= 1, "weak").otherwise("absent")
    enough = F.when((landmark & (many | cluster)) | (many & cluster), "strong").when(landmark | many | cluster, "probable").when((F.col("median_links") >= 2) | (F.col("home_links") >= 4), "weak").otherwise("absent")
    return rows.withColumn("strength", F.when(F.col("pages") < 3, few).otherwise(enough)).drop("cluster_share")


# --- findings -------------------------------------------------------------------------------------------------------------


def _page_checks(has: set[str]) -> dict[str, Column]:
    """For each check the pages it is about. A page that depends on scripts is not thin."""
    c = F.col
    scripted = F.coalesce(c("script_dependent"), F.lit(False)) if "script_dependent" in has else F.lit(False)
    important, deep_role = c("importance") >= IMPORTANT, c("role") != "home"
    seen = c("is_html") & important
    return {
        "sitemap_missing_important_pages": c("ok") & important & c("role").isin(V.CONTENT_ROLES) & deep_role & ~c("in_sitemap"),
        "important_page_http_error": (c("status").isin(404, 410) | (c("status") >= 500)) & (c("importance") >= 0.4),
        "noindex_on_important_page": c("noindex") & important,
        "important_page_deep": important & deep_role & (c("depth") >= 3),
        "important_page_orphaned": important & deep_role & (c("incoming") == 0) & c("ok"),
        "thin_important_page": seen & (c("words") < 80) & (c("out_links") < 6) & ~c("role").isin("contact", "legal") & ~scripted,
        "missing_h1": seen & (c("h1_total") == 0),
        "missing_meta_description": seen & ~c("described"),
        "missing_product_structured_data": c("is_html") & (c("role") == "products") & ~c("names_product"),
        "facts_in_images": seen & (c("images") >= 5) & (c("words") < 80) & (c("images_without_alt") >= 0.6 * c("images")),
        "page_identity_unclear": seen & deep_role & text.generic_title(c("title")) & (c("h1_total") == 0),
        "context_loss_orphan": c("is_html") & deep_role & (c("out_links") <= 1) & (c("words") >= 50),
    }


def _wider_checks() -> dict[str, tuple[list[str], Column]]:
    """Checks over columns that only a crawl, a renderer or the parser gives: (the columns, the pages they are about)."""
    c = F.col
    important = c("importance") >= IMPORTANT
    seen = c("is_html") & important
    said = lambda name: F.size(F.coalesce(c(name), F.array().cast("array<string>")))
    astray = ~urls.same_site(urls.registrable_host(urls.host(c("canonical"))), c("site")) | ~F.coalesce(c("canonical_status").between(200, 299), F.lit(True))
    return {
        "important_page_robots_blocked": (["robots_allowed"], ~c("robots_allowed") & important & c("role").isin(V.CONTENT_ROLES)),
        "redirect_chain": (["redirects"], c("redirects") >= 2),
        "noindex_header_on_important_page": (["robots_header"], F.contains(F.lower("robots_header"), F.lit("noindex")) & important),
        "js_dependent_content": (["rendered", "script_dependent"], c("rendered") & c("script_dependent")),
        "canonical_conflict": (["canonical", "canonical_status"], c("is_html") & important & (c("canonical") != c("url")) & astray),
        "invalid_structured_data": (["jsonld_errors"], said("jsonld_errors") > 0),
        "incomplete_structured_data": (["defects"], c("is_html") & (said("defects") > 0)),
        "structured_visible_mismatch": (["name_likeness"], c("is_html") & (c("name_likeness") < names.ALIKE)),
        # Calls are told by English words; on sites in another language only the links count, and fewer of them.
        "no_next_step": (["ctas", "site_lang"], seen & c("role").isin(NEXT_ROLES) & F.when(c("site_lang").isin(ENGLISH), (said("ctas") == 0) & (c("out_links") <= 3)).otherwise(c("out_links") <= 1)),
    }


# Primary languages to which checks of wording apply: English, or none declared.
ENGLISH = ["", "en"]
# Roles whose pages should lead on.
NEXT_ROLES = ["home", "products", "services", "pricing", "about"]
# Check: (pages it is measured against, least number of hits, least share of them, least size of the base)
TRIGGERS = {
    "sitemap_missing_important_pages": ("important", 2, 0.0, 0),
    "important_page_http_error": ("pages", 1, 0.0, 0),
    "noindex_on_important_page": ("important", 1, 0.0, 0),
    "important_page_deep": ("important", 1, 0.0, 0),
    "important_page_orphaned": ("important", 1, 0.0, 0),
    "thin_important_page": ("important", 1, 0.0, 0),
    "missing_h1": ("important", 2, 0.3, 0),
    "missing_meta_description": ("important", 3, 0.5, 0),
    "missing_product_structured_data": ("products", 2, 0.5, 3),
    "facts_in_images": ("important", 1, 0.0, 0),
    "page_identity_unclear": ("important", 1, 0.0, 0),
    "context_loss_orphan": ("inner", 2, 0.3, 3),
    "important_page_robots_blocked": ("important", 1, 0.0, 0),
    "redirect_chain": ("pages", 1, 0.0, 0),
    "noindex_header_on_important_page": ("important", 1, 0.0, 0),
    "js_dependent_content": ("rendered", 1, 0.0, 0),
    "canonical_conflict": ("important", 1, 0.0, 0),
    "invalid_structured_data": ("pages", 1, 0.0, 0),
    "incomplete_structured_data": ("html", 1, 0.0, 0),
    "structured_visible_mismatch": ("html", 1, 0.0, 0),
    "no_next_step": ("leading", 1, 0.0, 0),
}
#: Checks that concern important pages only if one is hit, and those that never do.
IF_HIT, NEVER = ["important_page_http_error", "js_dependent_content"], ["redirect_chain"]
#: Checks that weigh two sources against each other.
TWO_SOURCES = ["structured_visible_mismatch"]
#: Checks whose evidence is weaker without a rendered page.
UNRENDERED = ["thin_important_page", "facts_in_images"]
ENGAGEMENT = ["home_purpose_unclear", "page_identity_unclear", "missing_nav_landmark", "weak_navigation", "no_next_step", "context_loss_orphan"]
DIMENSION = {"invalid_structured_data": "entity_clarity", "incomplete_structured_data": "entity_clarity", "no_corroborating_entity_links": "entity_clarity", "entity_name_conflict": "entity_clarity", "contact_fact_conflict": "fact_consistency", "structured_visible_mismatch": "fact_consistency", "freshness_risk": "freshness", "thin_important_page": "content_accessibility", "facts_in_images": "content_accessibility", "js_dependent_content": "content_accessibility", "missing_organization_identity": "entity_clarity", "missing_product_structured_data": "entity_clarity"}


def findings(evidence: DataFrame) -> DataFrame:
    """One row for each (site, check) that fires, with reach, severity, confidence, priority and at most 25 addresses in page order.

    Checks whose columns the evidence lacks are left out; a null in such a column says nothing against its page."""
    c = F.col
    has = set(evidence.columns)
    checks = _page_checks(has) | {name: cond for name, (need, cond) in _wider_checks().items() if has.issuperset(need)}
    totals = evidence.groupBy("site").agg(
        F.count("*").alias("pages"), F.count_if(c("importance") >= IMPORTANT).alias("important"), F.count_if("is_html").alias("html"),
        F.count_if(c("is_html") & (c("role") == "products")).alias("products"), F.count_if(c("is_html") & (c("role") != "home")).alias("inner"),
        F.count_if(c("is_html") & c("names_organisation")).alias("organisations"), F.max("in_sitemap").alias("sitemap"),
        (F.count_if("rendered") if "rendered" in has else F.lit(0).cast("long")).alias("rendered"),
        F.count_if(c("is_html") & (c("importance") >= IMPORTANT) & c("role").isin(NEXT_ROLES)).alias("leading"),
    )
    hit = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks.items()]))
    hits = evidence.select("site", "url", "importance", "depth", F.explode(hit).alias("check"))
    order = Window.partitionBy("site", "check").orderBy(F.desc("importance"), F.asc_nulls_last("depth"), F.asc_nulls_last("url"))
    listed = hits.withColumn("place", F.row_number().over(order)).filter(c("place") <= LISTED).groupBy("site", "check").agg(F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda x: x.url)).alias("urls"))
    counted = hits.groupBy("site", "check").agg(F.count("*").alias("affected"), F.max(c("importance") >= IMPORTANT).alias("any_important"))
    rows = counted.join(listed, ["site", "check"]).join(totals, "site")
    base = F.coalesce(*[F.when(c("check") == name, c(of)) for name, (of, *_) in TRIGGERS.items()])
    pick = lambda at: F.coalesce(*[F.when(c("check") == name, F.lit(t[at])) for name, t in TRIGGERS.items()])
    rows = rows.withColumn("base", base).filter((c("affected") >= F.greatest(pick(1).cast("double"), pick(2) * c("base"))) & (c("base") >= pick(3)))
    rows = rows.filter((c("check") != "sitemap_missing_important_pages") | c("sitemap"))
    sample = F.greatest(c("base"), F.lit(1))
    by_page = rows.select("site", "check", "urls", "affected", sample.alias("sample"), (c("affected") / sample).alias("reach"), F.when(c("check").isin(IF_HIT), c("any_important")).otherwise(~c("check").isin(NEVER)).alias("hits_important"))
    none = F.array().cast("array<string>").alias("urls")
    no_sitemap = totals.filter(~c("sitemap") & (c("html") >= 5)).select("site", F.lit("sitemap_missing").alias("check"), none, F.lit(1).cast("long").alias("affected"), c("html").alias("sample"), F.lit(0.5).alias("reach"), F.lit(False).alias("hits_important"))
    nameless = totals.filter((c("organisations") == 0) & (c("html") >= 3)).select("site", F.lit("missing_organization_identity").alias("check"), none, c("html").alias("affected"), c("html").alias("sample"), F.lit(1.0).alias("reach"), F.lit(True).alias("hits_important"))
    return judged(by_page.unionByName(no_sitemap).unionByName(nameless))


def judged(rows: DataFrame) -> DataFrame:
    """Raised rows (site, check, urls, affected, sample, reach, hits_important and, if severities are forced, forced) with their verdicts."""
    c = F.col
    forced = c("forced") if "forced" in rows.columns else None
    rows = rows.withColumn("severity", classify.severity(c("check"), c("reach"), c("hits_important"), forced)).drop("forced")
    rows = rows.withColumn("reach", classify.rounded(c("reach"), 3))
    rows = rows.withColumn("confidence", classify.confidence(c("sample"), c("affected"), F.lit(True), c("conflict") if "conflict" in rows.columns else c("check").isin(UNRENDERED), c("sources") if "sources" in rows.columns else F.when(c("check").isin(TWO_SOURCES), 2).otherwise(1)))
    rows = rows.drop("conflict", "sources")
    band, score = classify.priority(c("severity"), c("check"), c("reach"), c("confidence"))
    dimension = F.when(c("check").isin(ENGAGEMENT), "engagement").otherwise(F.coalesce(classify._map(DIMENSION)[c("check")], F.lit("discoverability")))
    ordinal = F.array_position(classify._list([n for n, *_ in V.CHECKS]), c("check")).cast("int")
    return rows.withColumn("priority", band).withColumn("priority_score", score).withColumn("dimension", dimension).withColumn("ordinal", ordinal)


#: Outcomes of a homepage that answer for the site, whether or not the page could be read.
ANSWERED = ["ok", "external_redirect", "private_redirect", "robots_blocked"]
ASTRAY = ["redirect_loop", "redirect_limit", "bad_location"]


def _raised(rows: DataFrame, check: Column, reach: Column, important: Column, forced: Column, affected: Column | None = None, sample: Column | None = None, listed: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    one = F.lit(1).cast("long")
    named = rows.withColumn("check", check).filter("check is not null")
    addresses = F.array().cast("array<string>") if listed is None else listed
    return named.select("site", "check", *(keep or []), addresses.alias("urls"), (one if affected is None else affected).alias("affected"), (one if sample is None else sample).alias("sample"), reach.alias("reach"), important.alias("hits_important"), forced.cast("string").alias("forced"))


def home_findings(sites: DataFrame) -> DataFrame:
    """Sites (site, blocks_site, home_outcome) that cannot be entered as they should: the first reason counts. A null outcome is no answer."""
    c = F.col
    outcome = F.coalesce(c("home_outcome"), F.lit("unknown"))
    cases = [
        (F.coalesce(c("blocks_site"), F.lit(False)), "robots_blocks_site"),
        (outcome == "external_redirect", "homepage_redirects_offsite"),
        (outcome.isin(ASTRAY), "redirect_configuration_error"),
        (outcome == "private_redirect", "redirect_to_private_address"),
        (outcome == "robots_blocked", "important_page_robots_blocked"),
        (~outcome.isin(ANSWERED), "site_unreachable"),
    ]
    forced = F.when(c("check") == "homepage_redirects_offsite", "low")
    return judged(_raised(sites, classify._first_of(cases, None), F.lit(1.0), F.lit(True), forced))


def agent_findings(rules: DataFrame) -> DataFrame:
    """Sites that shut out a known AI agent wholly, from the rows of ``robots.ai_agents``."""
    return judged(_raised(rules.filter("blocked").select("site").distinct(), F.lit("ai_crawler_blocked"), F.lit(1.0), F.lit(True), F.lit(None)))


def navigation_findings(strengths: DataFrame) -> DataFrame:
    """Sites of four pages or more whose navigation is weak, or strong but not marked as such, from the rows of ``navigation``."""
    c = F.col
    sites = strengths.filter("pages >= 4").withColumn("unmarked", c("pages") - F.bround(c("landmark_share") * c("pages")).cast("long"))
    bare = sites.filter(c("strength").isin("strong", "probable") & (c("landmark_share") < 0.5))
    poor = sites.filter(c("strength").isin("weak", "absent"))
    absent = c("strength") == "absent"
    marked = _raised(bare, F.lit("missing_nav_landmark"), 1 - c("landmark_share"), F.lit(False), F.lit("low"), F.greatest(c("unmarked"), F.lit(1)), c("pages"))
    weak = _raised(poor, F.lit("weak_navigation"), F.when(absent, 1.0).otherwise(0.5), absent, F.when(~absent, "medium"), c("pages"), c("pages"))
    return judged(marked.unionByName(weak))


def site_languages(evidence: DataFrame) -> DataFrame:
    """(site, site_lang): the most frequent primary subtag of a site's pages, the least one on a tie; empty where none is declared."""
    lang = F.lower(F.substring_index("lang", "-", 1))
    n = evidence.select("site", lang.alias("lang")).groupBy("site", "lang").agg(F.count("*").alias("n"))
    best = n.groupBy("site").agg(F.min_by("lang", F.when(F.col("lang") != "", F.struct(-F.col("n"), "lang"))).alias("site_lang"))
    return best.select("site", F.coalesce("site_lang", F.lit("")).alias("site_lang"))


def judged_evidence(evidence: DataFrame) -> DataFrame:
    """``evidence`` with its site's language and, where a page has both, how like its stated name and its heading are."""
    a, b = (facts_functions.normalize_org_name(F.coalesce(x, F.lit(""))) for x in ("primary_name", "first_h1"))
    both = (a != "") & (b != "")
    rows = evidence.withColumn("name_likeness", F.when(both, names.name_similarity(F.when(both, a), F.when(both, b))))
    return rows.join(site_languages(evidence), "site", "left")


def home_purpose(evidence: DataFrame) -> DataFrame:
    """Sites whose home page, in order, fails two of: a telling title, a telling heading, a word of what is offered. rows: from ``judged_evidence``."""
    c = F.col
    english = F.coalesce(c("site_lang"), F.lit("")).isin(ENGLISH)
    title = (c("title") == "") | (english & text.generic_title(c("title")))
    heading = (c("h1_total") == 0) | (english & c("h1_short"))
    offer = english & ~c("offers") & ~c("has_description")
    faults = title.cast("int") + heading.cast("int") + offer.cast("int")
    homes = evidence.filter(c("is_home") & c("ok")).filter(faults >= 2).groupBy("site").agg(F.min("url").alias("url"))
    none = F.lit(None)
    return judged(_raised(homes, F.lit("home_purpose_unclear"), F.lit(1.0), F.lit(True), none, listed=F.array("url")))


def sitemap_findings(evidence: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Sites whose sitemap lists pages that answer with an error. sizes: (site, sitemap_size: addresses listed), else the listed pages count."""
    c = F.col
    broken = c("in_sitemap") & (c("status").isin(404, 410) | (c("status") >= 500))
    order = Window.partitionBy("site").orderBy(F.desc("importance"), "depth", "url")
    listed = evidence.filter(broken).withColumn("place", F.row_number().over(order)).filter(c("place") <= 20).groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda x: x.url).alias("addresses"))
    rows = evidence.groupBy("site").agg(F.least(F.count_if(broken), F.lit(20)).alias("broken"), F.count_if("in_sitemap").alias("known")).filter("broken > 0").join(listed, "site")
    size = c("known")
    if sizes is not None:
        rows = rows.join(sizes, "site", "left")
        size = F.coalesce(c("sitemap_size"), c("known"))
    size = F.greatest(size, F.lit(1))
    return judged(_raised(rows, F.lit("sitemap_broken_urls"), F.least(F.lit(1.0), 5 * c("broken") / size), F.lit(False), F.lit(None), c("broken"), size, listed=c("addresses")))


def fact_findings(evidence: DataFrame, found: DataFrame, as_of_year: int) -> DataFrame:
    """Findings over facts: unlike names, contacts that contradict each other, no profile beside a stated organisation, and old dates.

    evidence: of pages; found: the rows of ``facts.page_facts``."""
    c = F.col
    html_pages = evidence.filter("is_html").groupBy("site").agg(F.count("*").alias("html"), F.count_if("names_organisation").alias("stated"))
    size = F.greatest(F.coalesce(c("html"), F.lit(0)), F.lit(1))
    raise_ = lambda rows, check, reach, important, affected, sample, conflict, sources, addresses: judged(
        _raised(rows.withColumns({"conflict": conflict, "sources": sources}), F.lit(check), reach, important, F.lit(None), affected, sample, listed=addresses, keep=["conflict", "sources"])
    )
    none = F.array().cast("array<string>")
    named = names.name_findings(found).join(html_pages, "site", "left")
    one = raise_(named, "entity_name_conflict", F.least(F.lit(1.0), c("pages") / size), F.lit(True), c("pages"), size, ~F.array_contains("kinds", "jsonld"), F.size("kinds"), c("addresses"))
    contacts = names.contact_conflicts(found.filter(c("kind").isin("phone", "email")), value="normalized").withColumnsRenamed({"stated": "in_blocks", "shown": "on_pages"}).join(html_pages, "site", "left")
    two = raise_(contacts.select("site", "html", F.size(F.array_union("in_blocks", "on_pages")).cast("long").alias("n")), "contact_fact_conflict", F.lit(0.4), F.lit(True), c("n"), size, F.lit(False), F.lit(2), none)
    profiles = found.filter("kind = 'social'").select("site").distinct()
    bare = html_pages.filter("stated > 0 and html >= 4").join(profiles, "site", "left_anti")
    three = raise_(bare, "no_corroborating_entity_links", F.lit(0.4), F.lit(False), F.lit(1).cast("long"), c("html"), F.lit(False), F.lit(1), none)
    dated = names.freshness(evidence.filter("is_html"), as_of_year).filter("at_risk")
    four = raise_(dated, "freshness_risk", c("stale") / c("dated"), F.lit(True), c("stale"), c("dated"), F.lit(True), F.lit(1), none)
    return one.unionByName(two).unionByName(three).unionByName(four)


#: Checks of the stage that ends where a site cannot be entered as it should.
ENTRY_CHECKS = ["important_page_robots_blocked", "ai_crawler_blocked", "sitemap_missing", "sitemap_broken_urls", "sitemap_missing_important_pages", "important_page_http_error", "redirect_chain"]


def audit(evidence: DataFrame, edges: DataFrame, as_of_year: int, homes: DataFrame | None = None, agents: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Every finding of every site, before merging: page checks, home outcomes, agents, navigation, sitemaps, facts and dates.

    evidence: written once (``stored``), as it is read many times. homes: (site, blocks_site, home_outcome); agents: rows of
    ``robots.ai_agents``. Where the home page shuts visitors out, the other checks of entering the site are not reported."""
    wide = judged_evidence(evidence)
    rows = findings(wide).unionByName(home_purpose(wide)).unionByName(sitemap_findings(evidence, sizes)).unionByName(navigation_findings(navigation(evidence, edges))).unionByName(fact_findings(evidence, facts.page_facts(evidence), as_of_year))
    if agents is not None:
        rows = rows.unionByName(agent_findings(agents))
    if homes is not None:
        shut = home_findings(homes)
        kept = rows.join(shut.select("site").distinct().withColumn("__shut", F.lit(True)), "site", "left")
        rows = kept.filter(F.col("__shut").isNull() | ~F.col("check").isin(ENTRY_CHECKS)).drop("__shut").unionByName(shut)
    return stored(rows)


def merged(found: DataFrame) -> DataFrame:
    """Deep and orphaned pages of one first address are one finding: the earlier check's, with the greater severity, reach and confidence."""
    c = F.col
    group = F.when(c("check").isin("important_page_deep", "important_page_orphaned"), "reachability").otherwise(c("check"))
    rank = classify.severity_rank(c("severity"))
    rows = found.groupBy("site", group.alias("grp"), F.when(F.size("urls") > 0, c("urls")[0]).otherwise("site").alias("scope")).agg(
        F.min_by("check", "ordinal").alias("check"), F.min("ordinal").alias("ordinal"), F.min_by("dimension", "ordinal").alias("dimension"),
        F.max(rank).alias("rank"), F.max("reach").alias("reach"), F.max("confidence").alias("confidence"), F.max("affected").alias("affected"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "urls"))), lambda x: x.urls))).alias("urls"),
    )
    rows = rows.withColumn("severity", F.element_at(classify._list(V.SEVERITIES), (c("rank") + 1).cast("int")))
    band, score = classify.priority(c("severity"), c("check"), c("reach"), c("confidence"))
    return rows.withColumn("priority", band).withColumn("priority_score", score)


def ranked(found: DataFrame) -> DataFrame:
    """Merged findings in order of severity and priority, with ids F-001 and so on for each site."""
    order = Window.partitionBy("site").orderBy(F.desc("rank"), F.desc("priority_score"), "ordinal", "scope")
    return merged(found).withColumn("place", F.row_number().over(order)).withColumn("finding_id", F.format_string("F-%03d", F.col("place")))


def scores(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """(site, dimension, score) and the overall score of each site; null where there was nothing to judge: no page, or for
    consistency no name, telephone or address, or for freshness no date."""
    c = F.col
    lost = merged(found).groupBy("site", "dimension").agg(F.sum(F.round(classify.penalty(c("severity"), c("reach"), c("confidence")), 6).cast("decimal(20,6)")).alias("lost"))
    page, has = F.count_if("is_html") >= 1, set(evidence.columns)
    known = F.coalesce(F.max(facts.has_fact(["organization_name", "phone", "email"])), F.lit(False)) if "facts" in has else F.lit(False)
    dated = (F.count_if(c("is_html") & c("year").isNotNull()) >= 1) if "year" in has else F.lit(False)
    judged = evidence.groupBy("site").agg(page.alias("page"), known.alias("known"), dated.alias("dated"))
    grid = judged.select("site", F.explode(F.create_map(*[x for name in V.DIMENSION_WEIGHT for x in (F.lit(name), c({"fact_consistency": "known", "freshness": "dated"}.get(name, "page")))])).alias("dimension", "judged"))
    one = grid.join(lost, ["site", "dimension"], "left").withColumn("score", F.when(c("judged"), F.bround(F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(c("lost").cast("double"), F.lit(0.0))), 0).cast("int")))
    weight = classify._map(V.DIMENSION_WEIGHT)[c("dimension")]
    overall = one.groupBy("site").agg(F.bround(F.round(F.sum(weight * c("score")) / F.sum(F.when(c("score").isNotNull(), weight)), 6), 0).cast("int").alias("score")).select("site", F.lit("overall").alias("dimension"), "score")
    return one.select("site", "dimension", "score").unionByName(overall)
