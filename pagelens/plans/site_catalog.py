"""Queries over sites of pages with links between them, and their SQL.

The driver's pages link to none of each other, so the queries deal them to eight sites with fixed paths and links, by rules that
both engines state: site ``page_id % 8``, a path by ``page_id // 8``, a status of 404 for every seventeenth page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions import classify, facts, text
from pagelens.functions import vocab as V
from pagelens.operators import facts as F_
from pagelens.operators import names, parse, robots
from pagelens.operators import site as S
from pagelens.plans.catalog import _TITLE
from pagelens.session import stored, table

SITES = 8
PATHS = ["", "about", "contact", "pricing", "products/a", "services", "faq", "blog", "privacy", "jobs", "login", "misc/x"]
#: Steps of the links: those under ten go to a page of the site's start and are navigation, the others to a page further on.
STEPS = [1, 2, 3, 4, 16, 21]


def derived_pages(spark, d) -> DataFrame:
    page = F.col("page_id")
    # Whole numbers throughout: a quotient of doubles is wrong for ids of 2^53 and more. An id below zero counts from the list's end, as in the SQL; its place 0 holds nothing.
    place = (F.expr(f"page_id div {SITES}") % len(PATHS) + 1).cast("int")
    path = F.when(place != 0, F.element_at(classify._list(PATHS), place))
    site = F.concat(F.lit("site"), page % SITES, F.lit(".example"))
    return table(spark, d, "pages").select(
        "page_id",
        site.alias("site"),
        F.concat(F.lit("https://"), site, F.lit("/"), path, F.when(page >= SITES * len(PATHS), F.concat(F.lit("-"), page)).otherwise("")).alias("url"),
        F.when(page % 17 == 16, 404).otherwise(200).alias("status"),
        (page < SITES).alias("is_home"),
        ((page % SITES != SITES - 1) & (page % 5 != 4)).alias("in_sitemap"),
        "html",
    )


def derived_links(spark, d) -> DataFrame:
    """(src, dst, is_nav). Every page has six links at most, so there are no more than six times the pages."""
    ids = table(spark, d, "pages").select("page_id").distinct()
    step = F.explode(classify._list(STEPS)).alias("step")
    links = ids.select(F.col("page_id").alias("src"), step)
    links = links.select("src", F.when(F.col("step") < 10, F.col("src") % SITES + SITES * F.col("step")).otherwise(F.col("src") + SITES * (F.col("step") - 10)).alias("dst"), (F.col("step") < 10).alias("is_nav"))
    return links.filter("src <> dst").distinct().join(ids, F.col("dst") == F.col("page_id"), "left_semi")


#: What the checks with SQL look at. The wider evidence raises more checks than SQL can follow.
PLAIN = """page_id site url status is_home in_sitemap has_html has_head title h1 h1_total images images_without_alt has_nav described noindex names_organisation names_product words depth shape
 siblings incoming in_nav out_links kind kind_confidence ok role importance is_html facts text_facts year""".split()


def whole_evidence(spark, d) -> DataFrame:
    """Every page's evidence, written once: the HTML is read and parsed in one pass, whatever is asked of it."""
    return stored(S.page_evidence(derived_pages(spark, d), derived_links(spark, d)))


def evidence(spark, d) -> DataFrame:
    return whole_evidence(spark, d).select(*PLAIN)


def checked(spark, d) -> DataFrame:
    """The evidence that findings with SQL need, written once; its facts and dates, which only scores ask for, are not worked out."""
    return stored(S.page_evidence(derived_pages(spark, d), derived_links(spark, d)).select(*[c for c in PLAIN if c not in ("facts", "text_facts", "year")]))


def page_text_words(spark, d):
    return table(spark, d, "pages").select("page_id", text.word_count(S.visible_text(F.coalesce("html", F.lit("")))).cast("long").alias("words"))


def link_indegree(spark, d):
    return S.link_counts(derived_links(spark, d))


def page_role(spark, d):
    return evidence(spark, d).select("page_id", "site", "role", "importance", "incoming", "in_nav", "words")


def resource_kind(spark, d):
    return evidence(spark, d).select("page_id", "kind", "kind_confidence", "siblings")


def role_histogram(spark, d):
    return S.role_histogram(evidence(spark, d))


def sitemap_coverage(spark, d):
    return S.sitemap_coverage(evidence(spark, d))


def repeated_links(spark, d):
    return S.repeated_links(derived_pages(spark, d), derived_links(spark, d))


def navigation_strength(spark, d):
    return S.navigation(evidence(spark, d), derived_links(spark, d))


def site_findings(spark, d):
    rows = S.findings(evidence(spark, d))
    return rows.select("site", F.col("check").alias("check_id"), "affected", "sample", "reach", "severity", "confidence", "priority", "priority_score", "dimension", F.array_join("urls", " ").alias("urls"))


def findings_ranked(spark, d):
    return S.ranked(stored(S.findings(checked(spark, d)))).select("site", "finding_id", F.col("check").alias("check_id"), "severity", "priority", "priority_score", "affected", F.size("urls").alias("listed"))


def dimension_scores(spark, d):
    pages = evidence(spark, d)
    return S.scores(stored(S.findings(pages)), pages)


def _audit(spark, d):
    pages = whole_evidence(spark, d)
    return pages, S.audit(pages, derived_links(spark, d), 2026)


def audit_findings(spark, d):
    """All findings of all kinds, merged and in order."""
    return S.ranked(_audit(spark, d)[1]).select("site", "finding_id", F.col("check").alias("check_id"), "dimension", "severity", "reach", "confidence", "priority", "priority_score", "affected")


def audit_scores(spark, d):
    pages, found = _audit(spark, d)
    return S.scores(found, pages)


def page_facts(spark, d):
    return F_.page_facts(whole_evidence(spark, d)).select("page_id", "seq", "kind", "value", "normalized", "source")


def canonical_to_broken(spark, d):
    """Pages whose canonical address (here the page eight further on) was fetched and is not in order: a self join by address."""
    pages = derived_pages(spark, d)
    aim = pages.select(F.col("page_id").alias("canonical_id"), F.col("status").alias("canonical_status")).filter("canonical_status >= 300")
    return pages.select("page_id", (F.col("page_id") + SITES).alias("canonical_id")).join(aim, "canonical_id")


def org_names(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", facts.normalize_org_name(F.concat("s_name", F.lit(" Technologies Pvt Ltd."))).alias("plain"), facts.normalize_org_name(F.concat(F.lit("The "), "s_name", F.lit(" & Co"))).alias("short"))


def name_prefixes(spark, d):
    s = table(spark, d, "customer").select("c_custkey", facts.normalize_org_name("c_name").alias("a"), facts.normalize_org_name(F.concat(F.substring("c_name", 1, 4), F.lit(" "), F.substring_index("c_name", "#", -1))).alias("b"))
    return s.select("c_custkey", facts.token_prefixes(F.col("a"), F.col("b")).alias("alike"))


def title_brands(spark, d):
    return derived_pages(spark, d).select("page_id", facts.brand_from_title(F.concat(F.lit("Welcome here | "), "site", F.lit(" - about us")), F.col("site")).alias("brand"))


def social_links(spark, d):
    """Profiles among the sitewide links with a made-up host for every third page."""
    link = F.concat(F.when(F.col("page_id") % 3 == 0, "https://www.LinkedIn.com/company/").otherwise("https://www.example.org/"), F.col("page_id") % SITES, F.lit("/"))
    return facts.socials(table(spark, d, "pages").select((F.col("page_id") % SITES).alias("site"), link.alias("link")), "site", "link")


def severity_matrix(spark, d):
    """Severity, confidence and priority of every check over the labels' range of reaches."""
    reach = (F.col("doc_id") % 11 / 10).alias("reach")
    cases = table(spark, d, "labels").select(reach, (F.col("doc_id") % 2 == 0).alias("important"), (F.col("doc_id") % 13).alias("sample")).distinct()
    cases = cases.withColumn("check", F.explode(classify._list([n for n, *_ in V.CHECKS]))).withColumn("affected", F.least(F.col("sample"), F.lit(3)))
    cases = cases.withColumn("severity", classify.severity(F.col("check"), F.col("reach"), F.col("important")))
    cases = cases.withColumn("confidence", classify.confidence(F.col("sample"), F.col("affected"), F.col("important"), F.lit(False), F.lit(1)))
    band, score = classify.priority(F.col("severity"), F.col("check"), F.col("reach"), F.col("confidence"))
    return cases.withColumn("priority", band).withColumn("priority_score", score).withColumnRenamed("check", "check_id")


def script_dependence(spark, d):
    """The script-added share of words, where a rendered page has the words of the document of its number as well."""
    pages, docs = table(spark, d, "pages"), table(spark, d, "documents")
    raw = pages.select("page_id", text.word_count(S.visible_text(F.coalesce("html", F.lit("")))).alias("raw"))
    more = docs.select(F.col("doc_id").alias("page_id"), text.word_count(F.col("text")).alias("more"))
    added, ratio, depends = classify.script_dependence(F.col("raw"), F.col("raw") + F.col("more"))
    return raw.join(more, "page_id").select("page_id", added.cast("long").alias("added"), ratio.alias("ratio"), depends.alias("depends"))


def language_mode(spark, d):
    """The most frequent primary subtag of each site's pages, the least one on a tie."""
    from pagelens.functions import html

    lang = F.lower(F.substring_index(html.lang(F.coalesce("html", F.lit(""))), "-", 1))
    n = derived_pages(spark, d).select("site", lang.alias("lang")).filter("lang <> ''").groupBy("site", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("site").agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("lang"), F.max("n").alias("pages"))


def parsed_pages(spark, d):
    """What the tree walk finds in each page, whatever regular expressions make of it."""
    rows = parse.parsed_pages(table(spark, d, "pages").withColumn("given", F.col("html").isNotNull()), keep=["given"]).withColumn("h1_total", F.size("h1").cast("long"))
    # Of a null page nothing is known but that it shows no words.
    known = [F.when(F.col("given"), F.col(c)).alias(c) for c in ("title", "lang", "headings_total", "images", "forms", "has_nav", "has_main", "h1_total")]
    return rows.select("page_id", "words", *known)


def freshness_risk(spark, d):
    """Sources with stale documents, a document being of the year 2015 + id % 12, seen from 2026."""
    rows = table(spark, d, "documents").select(F.col("source").alias("site"), (F.lit(2015) + F.col("doc_id") % 12).cast("string").alias("year"))
    return names.freshness(rows, 2026)


def contact_conflicts(spark, d):
    """Customers whose stated telephone (one of three) is not the shown one (one of two)."""
    key = F.col("c_custkey")
    facts_ = lambda n, source: table(spark, d, "customer").select(key.alias("site"), F.lit("phone").alias("kind"), F.concat(F.lit("555000000"), key % n).alias("value"), F.lit(source).alias("source"))
    return names.contact_conflicts(facts_(3, "jsonld").unionByName(facts_(2, "text"))).select("site", "kind", F.array_join("stated", " ").alias("stated"), F.array_join("shown", " ").alias("shown"))


#: Files of three kinds of sites, dealt to customers by their keys.
ROBOTS = ["User-agent: *\nDisallow: /private # not public\nDisallow: /tmp", "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: ccbot\nAllow: /", "Disallow: /\nUser-agent: Claude-User\nDisallow: /docs"]


def _robots(spark, d):
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(key.alias("site"), F.element_at(classify._list(ROBOTS), (key % 3 + 1).cast("int")).alias("robots"))


def robots_blocks(spark, d):
    return robots.site_block(_robots(spark, d)).select("site", "blocks_site", F.array_join("paths", " ").alias("paths"))


def ai_agent_rules(spark, d):
    return robots.ai_agents(_robots(spark, d)).select("site", "agent", "blocked", F.array_join("paths", " ").alias("paths"))


QUERIES = {f.__name__: f for f in (freshness_risk, contact_conflicts, robots_blocks, ai_agent_rules, parsed_pages, page_text_words, link_indegree, page_role, resource_kind, role_histogram, sitemap_coverage, repeated_links, navigation_strength, site_findings, findings_ranked, dimension_scores, audit_findings, audit_scores, page_facts, canonical_to_broken, org_names, name_prefixes, title_brands, social_links, severity_matrix, script_dependence, language_mode)}

# --- the SQL --------------------------------------------------------------------------------------------------------------

_in = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_of = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_case = lambda of, values, other: f"CASE {of} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"
_VISIBLE = reduce(lambda c, p: f"regexp_replace({c}, '{p}', ' ', 'g')", S.INVISIBLE, "coalesce(html, '')")
_WORDS = f"len(regexp_extract_all({_VISIBLE}, '{text.WORD.replace(chr(39), chr(39) * 2)}'))::BIGINT"
_N = lambda p: f"len(regexp_extract_all(html, '{p}'))"
_typed = lambda kinds: rf'(?i)"@type"\s*:\s*"({"|".join(kinds)})"'

_r = lambda x, n: f"round_even(({x})::DOUBLE * 1e{n}, 0) / 1e{n}"

_PAGES = f"""pages0 AS (SELECT page_id, 'site' || (page_id % {SITES}) || '.example' AS site,
 'https://site' || (page_id % {SITES}) || '.example/' || {_of(PATHS)}[(page_id // {SITES}) % {len(PATHS)} + 1] || CASE WHEN page_id >= {SITES * len(PATHS)} THEN '-' || page_id ELSE '' END AS url,
 CASE WHEN page_id % 17 = 16 THEN 404 ELSE 200 END AS status, page_id < {SITES} AS is_home, page_id % {SITES} <> {SITES - 1} AND page_id % 5 <> 4 AS in_sitemap, coalesce(html, '') AS html FROM pages)"""
_LINKS = f"""links AS (SELECT DISTINCT p.page_id AS src, q.page_id AS dst, k < 10 AS is_nav FROM pages p, (SELECT unnest({STEPS}) AS k) s
 JOIN pages q ON q.page_id = CASE WHEN k < 10 THEN p.page_id % {SITES} + {SITES} * k ELSE p.page_id + {SITES} * (k - 10) END WHERE p.page_id <> q.page_id)"""
_ROLE = " ".join(f"WHEN list_has_any(tokens, {_of(w)}) THEN '{r}'" for r, w in V.ROLE_WORDS.items()) + " " + " ".join(f"WHEN regexp_matches(lower(title || ' ' || h1), '{'|'.join(p)}') THEN '{r}'" for r, p in V.TITLE_PHRASES.items())
_EVIDENCE = rf"""{_PAGES}, {_LINKS},
said AS (SELECT *, {_TITLE} AS title, lower(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g')) AS h1,
 {_N(r'(?i)<h1[\s>]')} AS h1_total, {_N(r'(?i)<img[\s>]')} AS images, greatest({_N(r'(?i)<img[\s>]')} - {_N(r'(?i)<img[^>]*\salt=["' + chr(39) * 2 + r'][^"' + chr(39) * 2 + r']*[^"' + chr(39) * 2 + r'\s]')}, 0) AS images_without_alt,
 regexp_matches(left(html, 4096), '(?i)<html[\s>]') AS has_html, regexp_matches(left(html, 8192), '(?i)<head[\s>]') AS has_head, regexp_matches(html, '(?i)<nav[\s>]|role=["'']navigation["'']') AS has_nav,
 regexp_matches(html, '(?i)<meta[^>]*(name=["'']description["'']|property=["'']og:description["''])') AS described, regexp_matches(html, '(?i)<meta[^>]*name=["'']robots["''][^>]*noindex') AS noindex,
 regexp_matches(html, '{_typed(V.ORGANISATION_TYPES)}') AS names_organisation, regexp_matches(html, '{_typed(V.PRODUCT_TYPES)}') AS names_product, {_WORDS} AS words, regexp_extract(url, '^https://[^/]*/(.*)$', 1) AS path FROM pages0),
cut AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segments, list_concat(list_filter(string_split(path, '/'), lambda x: x <> ''), list_filter(regexp_split_to_array(path, '[/\-_.]+'), lambda x: x <> '')) AS tokens FROM said),
inc AS (SELECT dst, count(DISTINCT src) AS incoming, bool_or(is_nav) AS in_nav FROM links GROUP BY dst),
outs AS (SELECT src, count(DISTINCT dst) AS out_links FROM links GROUP BY src),
wide AS (SELECT cut.*, coalesce(incoming, 0) AS incoming, coalesce(in_nav, false) AS in_nav, coalesce(out_links, 0) AS out_links, len(segments) AS depth, status < 300 AS ok,
 count(*) OVER (PARTITION BY site, array_to_string(segments[1:2], '/')) - 1 AS siblings, has_html::INT + has_head::INT + (title <> '')::INT AS shape FROM cut LEFT JOIN inc ON dst = page_id LEFT JOIN outs ON src = page_id),
kinds AS (SELECT *, shape < 3 OR words < 25 AS weak, list_has_any(tokens, {_of(V.API_WORDS)}) AS api, list_has_any(tokens, {_of(V.FRAGMENT_WORDS)}) AS frag, list_has_any(tokens, {_of(V.UTILITY_WORDS)}) AS util FROM wide),
verdicts AS (SELECT *, CASE WHEN NOT ok THEN 'other_non_page|0.9' WHEN shape = 0 THEN 'component_fragment|0.94' WHEN api AND weak THEN 'api_resource|0.8' WHEN frag AND weak THEN 'component_fragment|0.85'
 WHEN frag AND siblings >= 2 AND words < 120 THEN 'component_fragment|0.7' WHEN util AND weak THEN 'utility_endpoint|0.75' WHEN title = '' AND words < 25 AND out_links = 0 THEN 'other_non_page|0.72' ELSE 'page|0.9' END AS verdict FROM kinds),
roles AS (SELECT *, split_part(verdict, '|', 1) AS kind, split_part(verdict, '|', 2)::DOUBLE AS kind_confidence,
 CASE WHEN ok AND verdict <> 'page|0.9' THEN 'non_page' WHEN is_home THEN 'home' {_ROLE} ELSE 'other' END AS role FROM verdicts),
sums AS (SELECT *, {_case('role', V.ROLE_WEIGHT, V.OTHER_WEIGHT)} + CASE WHEN in_nav THEN 0.28 ELSE 0 END + CASE WHEN depth <= 1 THEN 0.16 WHEN depth = 2 THEN 0.06 ELSE 0 END
 + CASE WHEN incoming >= 5 THEN 0.16 WHEN incoming >= 2 THEN 0.08 ELSE 0 END + CASE WHEN in_sitemap THEN 0.05 ELSE 0 END + CASE WHEN words >= 400 THEN 0.06 ELSE 0 END AS worth FROM roles),
evidence AS (SELECT *, (CASE WHEN role = 'non_page' OR role = 'account' THEN 0 WHEN role = 'home' THEN 1 WHEN role = 'legal' THEN least(round(worth, 3), 0.35) ELSE least(round(worth, 3), 1) END)::DOUBLE AS importance,
 ok AND kind = 'page' AND words > 0 AS is_html FROM sums)"""

_CONDITIONS = {
    "sitemap_missing_important_pages": f"ok AND big AND role IN {_in(V.CONTENT_ROLES)} AND role <> 'home' AND NOT in_sitemap",
    "important_page_http_error": "status = 404 AND importance >= 0.4",
    "noindex_on_important_page": "noindex AND big",
    "important_page_deep": "big AND role <> 'home' AND depth >= 3",
    "important_page_orphaned": "big AND role <> 'home' AND incoming = 0 AND ok",
    "thin_important_page": "is_html AND big AND words < 80 AND out_links < 6 AND role NOT IN ('contact', 'legal')",
    "missing_h1": "is_html AND big AND h1_total = 0",
    "missing_meta_description": "is_html AND big AND NOT described",
    "missing_product_structured_data": "is_html AND role = 'products' AND NOT names_product",
    "facts_in_images": "is_html AND big AND images >= 5 AND words < 80 AND images_without_alt >= 0.6 * images",
    "page_identity_unclear": f"is_html AND big AND role <> 'home' AND (lower(title) IN {_in(text.GENERIC_TITLES)} OR length(title) < 6) AND h1_total = 0",
    "context_loss_orphan": "is_html AND role <> 'home' AND out_links <= 1 AND words >= 50",
}
_BASE = {c: s for c, s, _ in V.CHECKS}
_EASE = {c: f for c, _, f in V.CHECKS}
_ORDER = {c: i + 1 for i, (c, *_) in enumerate(V.CHECKS)}
_RANKS = {s: i for i, s in enumerate(V.SEVERITIES)}
_DIMENSIONS = {c: f"'{x}'" for c, x in S.DIMENSION.items()} | {c: "'engagement'" for c in S.ENGAGEMENT}


def _judged(source: str, direct: str, conflict: str) -> str:
    """CTEs from ``source`` (check, sample, affected, raw_reach, important) to ``priced`` with severity, confidence and priority."""
    return f"""stepped AS (SELECT *, {_case('"check"', {c: _RANKS[s] for c, s in _BASE.items()}, 1)} AS r0 FROM {source}),
bounded AS (SELECT *, CASE WHEN raw_reach >= 0.6 AND important THEN least(r0 + 1, 3) WHEN raw_reach <= 0.15 AND NOT important THEN greatest(r0 - 1, 0) ELSE r0 END AS r1 FROM stepped),
trusted AS (SELECT *, {_of(V.SEVERITIES)}[CASE WHEN r1 = 3 AND "check" NOT IN {_in(V.MAY_BE_CRITICAL)} THEN 2 ELSE r1 END + 1] AS severity, {_r('raw_reach', 3)} AS reach,
 greatest(0.3, least(round_even((0.75 + CASE WHEN {direct} THEN 0.1 ELSE 0 END + CASE WHEN sample >= 5 THEN 0.08 WHEN sample <= 1 THEN -0.1 ELSE 0 END
 + CASE WHEN sample = 0 OR affected = 0 THEN 0 WHEN affected >= 0.8 * sample THEN 0.07 WHEN affected <= 0.2 * sample THEN -0.03 ELSE 0 END - CASE WHEN {conflict} THEN 0.2 ELSE 0 END)::DOUBLE * 1e2, 0) / 1e2, 0.98))::DOUBLE AS confidence FROM bounded),
{_priced('trusted')}"""


def _priced(source: str) -> str:
    return f"""priced AS (SELECT *, round_even(({_case('severity', V.IMPACT, 0.5)}::DOUBLE * (0.35::DOUBLE + 0.65::DOUBLE * greatest(0.1, least(reach, 1))) * confidence * (0.55::DOUBLE + 0.45::DOUBLE * {_case('"check"', _EASE, 0.6)}::DOUBLE)) * 1e4, 0) / 1e4 AS priority_score FROM {source})"""


_BAND = "CASE WHEN priority_score >= 0.55 THEN 'high' WHEN priority_score >= 0.28 THEN 'medium' ELSE 'low' END"
_HITS = " UNION ALL ".join(f"SELECT site, url, importance, depth, '{c}' AS \"check\", '{S.TRIGGERS[c][0]}' AS base, {S.TRIGGERS[c][1]} AS least_n, {S.TRIGGERS[c][2]} AS least_share, {S.TRIGGERS[c][3]} AS least_base FROM seen WHERE {w}" for c, w in _CONDITIONS.items())
_FINDINGS = f"""{_EVIDENCE}, seen AS (SELECT *, importance >= 0.5 AS big FROM evidence),
totals AS (SELECT site, count(*) AS pages, count(*) FILTER (big) AS important, count(*) FILTER (is_html) AS html, count(*) FILTER (is_html AND role = 'products') AS products,
 count(*) FILTER (is_html AND role <> 'home') AS inner_, count(*) FILTER (is_html AND names_organisation) AS organisations, bool_or(in_sitemap) AS sitemap FROM seen GROUP BY site),
hits AS ({_HITS}),
sized AS (SELECT h.site, "check", any_value(least_n) AS least_n, any_value(least_share) AS least_share, any_value(least_base) AS least_base, any_value(sitemap) AS sitemap, count(*) AS affected,
 any_value(CASE base WHEN 'pages' THEN pages WHEN 'important' THEN t.important WHEN 'products' THEN products ELSE inner_ END) AS n, bool_or(importance >= 0.5) AS any_big,
 array_to_string(list(url ORDER BY importance DESC, depth, url)[1:{S.LISTED}], ' ') AS urls FROM hits h JOIN totals t USING (site) GROUP BY h.site, "check"),
raised AS (SELECT site, "check", urls, affected, greatest(n, 1) AS sample, affected / greatest(n, 1) AS raw_reach, "check" <> 'important_page_http_error' OR any_big AS important FROM sized
 WHERE affected >= greatest(least_n, least_share * n) AND n >= least_base AND ("check" <> 'sitemap_missing_important_pages' OR sitemap)
 UNION ALL SELECT site, 'sitemap_missing', '', 1, html, 0.5, false FROM totals WHERE NOT sitemap AND html >= 5
 UNION ALL SELECT site, 'missing_organization_identity', '', html, html, 1.0, true FROM totals WHERE organisations = 0 AND html >= 3),
{_judged('raised', 'true', '"check" IN ' + _in(S.UNRENDERED))},
found AS (SELECT *, {_BAND} AS priority, {_case('"check"', _DIMENSIONS, "'discoverability'")} AS dimension, {_case('"check"', _ORDER, 0)} AS ordinal FROM priced)"""
# No two checks of one group fire at one address here unless both name it first; the SQL merges them by the same key.
_RANKED = f"""{_FINDINGS}, keyed AS (SELECT *, CASE WHEN "check" IN ('important_page_deep', 'important_page_orphaned') THEN 'reachability' ELSE "check" END AS grp, CASE WHEN urls = '' THEN site ELSE split_part(urls, ' ', 1) END AS scope FROM found),
one AS (SELECT site, grp, scope, arg_min("check", ordinal) AS "check", min(ordinal) AS ordinal, arg_min(dimension, ordinal) AS dimension, max({_case('severity', _RANKS, 1)}) AS rank, max(reach) AS reach, max(confidence) AS confidence, max(affected) AS affected,
 len(list_distinct(list_filter(string_split(string_agg(urls, ' '), ' '), lambda x: x <> ''))) AS listed FROM keyed GROUP BY site, grp, scope),
named AS (SELECT *, {_of(V.SEVERITIES)}[rank + 1] AS severity FROM one)"""
_FINAL = _priced("named").replace("priced AS", "final AS", 1)

_ORG = lambda x: rf"lower(trim(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9& .]', ' ', 'g'), '\s+', ' ', 'g')))"
ORACLES = {
    "freshness_risk": """WITH y AS (SELECT source AS site, 2015 + doc_id % 12 AS year FROM documents), s AS (SELECT site, count(*) AS dated, count(*) FILTER (year <= 2025) AS stale, max(year)::INTEGER AS newest FROM y GROUP BY site)
 SELECT *, dated >= 3 AND stale >= greatest(2, 0.5 * dated) AS at_risk FROM s""",
    "contact_conflicts": "SELECT c_custkey AS site, 'phone' AS kind, '555000000' || (c_custkey % 3) AS stated, '555000000' || (c_custkey % 2) AS shown FROM customer WHERE c_custkey % 3 <> c_custkey % 2",
    "robots_blocks": "SELECT c_custkey AS site, c_custkey % 3 = 2 AS blocks_site, CASE c_custkey % 3 WHEN 0 THEN '/private /tmp' ELSE '' END AS paths FROM customer",
    "ai_agent_rules": """SELECT c_custkey AS site, agent, blocked, paths FROM customer JOIN (VALUES (1, 'gptbot', true, '/'), (1, 'ccbot', false, '/'), (2, 'claude-user', false, '/docs')) AS v(k, agent, blocked, paths) ON c_custkey % 3 = k""",
    "parsed_pages": rf"""SELECT page_id, {_TITLE} AS title, trim(regexp_extract(html, '(?i)<html[^>]*\slang=["'']([^"'']*)["'']', 1)) AS lang, {_WORDS} AS words, {_N(r'(?i)<h[1-6][\s>]')} AS headings_total, {_N(r'(?i)<img[\s>]')} AS images,
 {_N(r'(?i)<form[\s>]')} AS forms, regexp_matches(html, '(?i)<nav[\s>]|role=["'']navigation["'']') AS has_nav, regexp_matches(html, '(?i)<main[\s>]|role=["'']main["'']') AS has_main, {_N(r'(?i)<h1[\s>]')} AS h1_total FROM pages""",
    "page_text_words": f"SELECT page_id, {_WORDS} AS words FROM pages",
    "link_indegree": f"WITH {_LINKS} SELECT dst AS page_id, count(DISTINCT src) AS incoming, bool_or(is_nav) AS in_nav FROM links GROUP BY dst",
    "page_role": f"WITH {_EVIDENCE} SELECT page_id, site, role, importance, incoming, in_nav, words FROM evidence",
    "resource_kind": f"WITH {_EVIDENCE} SELECT page_id, kind, kind_confidence, siblings FROM evidence",
    "role_histogram": f"WITH {_EVIDENCE} SELECT site, role, count(*) AS pages, round(avg(importance), 6) AS mean_importance FROM evidence GROUP BY site, role",
    "sitemap_coverage": f"WITH {_PAGES} SELECT site, {_r('count(*) FILTER (status = 200 AND in_sitemap) / nullif(count(*) FILTER (status = 200), 0)', 3)} AS coverage, count(*) FILTER (in_sitemap AND status = 404) AS broken FROM pages0 GROUP BY site",
    "repeated_links": f"""WITH {_PAGES}, {_LINKS}, sizes AS (SELECT site, count(*) AS n FROM pages0 GROUP BY site), shared AS (SELECT site, dst, count(DISTINCT src) AS pages FROM links JOIN pages0 ON src = page_id GROUP BY site, dst)
 SELECT site, dst AS page_id, pages, {_r('pages / n', 3)} AS share FROM shared JOIN sizes USING (site) WHERE pages >= greatest(3, round(0.6 * n))""",
    "navigation_strength": f"""WITH {_EVIDENCE}, h AS (SELECT * FROM evidence WHERE is_html), shared AS (SELECT site, dst, count(DISTINCT src) AS k FROM links JOIN h ON src = page_id GROUP BY site, dst),
 t AS (SELECT site, count(*) AS pages, {_r('avg(has_nav::INT)', 3)} AS landmark_share, coalesce(max(out_links) FILTER (is_home), 0) AS home_links, list(out_links ORDER BY out_links) AS o FROM h GROUP BY site),
 u AS (SELECT t.*, (SELECT count(*) FROM shared s WHERE s.site = t.site AND k >= greatest(3, round(0.6 * t.pages))) AS repeated, (o[(pages + 1) // 2] + o[pages // 2 + 1]) // 2 AS median_links FROM t)
 SELECT site, pages, landmark_share, home_links, repeated, median_links, CASE WHEN pages < 3 THEN CASE WHEN landmark_share >= 0.5 OR home_links >= 4 THEN 'probable' WHEN home_links >= 1 THEN 'weak' ELSE 'absent' END
 WHEN landmark_share >= 0.5 AND repeated >= 3 THEN 'strong' WHEN landmark_share >= 0.5 OR repeated >= 3 THEN 'probable' WHEN median_links >= 2 OR home_links >= 4 THEN 'weak' ELSE 'absent' END AS strength FROM u""",
    "site_findings": f'WITH {_FINDINGS} SELECT site, "check" AS check_id, affected, sample, reach, severity, confidence, priority, priority_score, dimension, urls FROM found',
    "findings_ranked": f"""WITH {_RANKED}, {_FINAL} SELECT site, printf('F-%03d', row_number() OVER (PARTITION BY site ORDER BY rank DESC, priority_score DESC, ordinal, scope)) AS finding_id, "check" AS check_id, severity, {_BAND} AS priority, priority_score, affected, listed FROM final""",
    "dimension_scores": f"""WITH {_RANKED}, lost AS (SELECT site, dimension, sum(round({_case('severity', V.PENALTY, 10.0)}::DOUBLE * (0.4 + 0.6 * greatest(0.1, least(CASE WHEN reach = 0 THEN 0.3 ELSE reach END, 1))) * confidence, 6)::DECIMAL(18, 6)) AS lost FROM named GROUP BY site, dimension),
 judged AS (SELECT site, bool_or(is_html) AS page, bool_or(regexp_matches(html, '(?i)<footer>&copy; [a-z0-9]')) AS known, bool_or(is_html AND regexp_matches({_VISIBLE}, '\\b(19[89][0-9]|20[0-4][0-9])\\b')) AS dated FROM evidence GROUP BY site), grid AS (SELECT site, page, known, dated, unnest({_of(V.DIMENSION_WEIGHT)}) AS dimension FROM judged),
 scored AS (SELECT g.site, g.dimension, CASE WHEN CASE g.dimension WHEN 'fact_consistency' THEN known WHEN 'freshness' THEN dated ELSE page END THEN round_even(greatest(0, 100 - coalesce(lost, 0)::DOUBLE), 0)::INTEGER END AS score FROM grid g LEFT JOIN lost l ON l.site = g.site AND l.dimension = g.dimension)
 SELECT * FROM scored UNION ALL SELECT site, 'overall', round_even(round(sum({_case('dimension', V.DIMENSION_WEIGHT, 0)}::DOUBLE * score) / sum({_case('dimension', V.DIMENSION_WEIGHT, 0)}::DOUBLE) FILTER (score IS NOT NULL), 6), 0)::INTEGER FROM scored GROUP BY site""",
    "canonical_to_broken": f"WITH {_PAGES} SELECT a.page_id, b.page_id AS canonical_id, b.status AS canonical_status FROM pages0 a JOIN pages0 b ON b.page_id = a.page_id + {SITES} WHERE b.status >= 300",
    "org_names": f"SELECT s_suppkey, {_ORG('s_name')} || ' technologies pvt' AS plain, {_ORG('s_name')} AS short FROM supplier",
    "name_prefixes": f"WITH n AS (SELECT c_custkey, string_split({_ORG('c_name')}, ' ') AS a, string_split({_ORG('left(c_name, 4) || chr(32) || split_part(c_name, chr(35), 2)')}, ' ') AS b FROM customer) SELECT c_custkey, len(b) = len(a) AND starts_with(a[1], b[1]) AND a[2] = b[2] AS alike FROM n",
    "title_brands": f"SELECT page_id, 'site' || (page_id % {SITES}) || '.example' AS brand FROM pages",
    "social_links": f"SELECT DISTINCT page_id % {SITES} AS site, 'https://www.linkedin.com/company/' || (page_id % {SITES}) AS social FROM pages WHERE page_id % 3 = 0",
    "severity_matrix": f"""WITH cases AS (SELECT DISTINCT doc_id % 11 / 10 AS raw_reach, doc_id % 2 = 0 AS important, doc_id % 13 AS sample FROM labels), wide AS (SELECT *, unnest({_of(_BASE)}) AS "check", least(sample, 3) AS affected FROM cases),
 {_judged('wide', 'important', 'false')} SELECT reach, important, sample, "check" AS check_id, affected, severity, confidence, {_BAND} AS priority, priority_score FROM priced""",
    "script_dependence": f"""WITH raw AS (SELECT page_id, {_WORDS} AS raw FROM pages), more AS (SELECT doc_id AS page_id, len(regexp_extract_all(coalesce(text, ''), '{text.WORD.replace(chr(39), chr(39) * 2)}')) AS added FROM documents)
 SELECT page_id, added, {_r('added / greatest(raw + added, 1)', 3)} AS ratio, raw + added >= 30 AND {_r('added / greatest(raw + added, 1)', 3)} >= 0.35 AND added >= 40 AS depends FROM raw JOIN more USING (page_id)""",
    "language_mode": rf"""WITH {_PAGES}, n AS (SELECT site, lower(split_part(trim(regexp_extract(html, '(?i)<html[^>]*\slang=["'']([^"'']*)["'']', 1)), '-', 1)) AS lang, count(*) AS n FROM pages0 GROUP BY ALL)
 SELECT site, arg_min(lang, (-n, lang)) AS lang, max(n) AS pages FROM n WHERE lang <> '' GROUP BY site""",
}
