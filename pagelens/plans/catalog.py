"""Every query over the driver's tables that belongs to the site-evidence operators, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions import html, text, urls
from pagelens.session import table

HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
SITE = rf"regexp_replace(regexp_replace({HOST}, '\.+$', ''), '^www\.', '')"
TOKENS = rf"list_filter(regexp_split_to_array(lower({PATH}), '[/\-_.]+'), lambda x: x <> '')"
_quoted = lambda words: ", ".join(f"'{w}'" for w in words)


def _pages(spark, d):
    return table(spark, d, "pages")


def url_columns(spark, d):
    u = F.col("url")
    return _pages(spark, d).select(
        "page_id",
        urls.registrable_host(urls.host(u)).alias("site"),
        urls.looks_like_page(u).alias("page_like"),
        urls.path_depth(u).alias("depth"),
        urls.is_account_path(u).alias("account"),
        urls.path_shape(u).alias("shape"),
    )


def url_normalize_abs(spark, d):
    return _pages(spark, d).select("page_id", urls.normalize_absolute(F.col("url")).alias("normalized"))


def html_flags(spark, d):
    return _pages(spark, d).select("page_id", *[c.alias(k) for k, c in html.flags(F.col("html")).items()])


def html_title_lang(spark, d):
    return _pages(spark, d).select("page_id", html.title(F.col("html")).alias("title"), html.lang(F.col("html")).alias("lang"), text.generic_title(html.title(F.col("html"))).alias("generic"))


def html_counts(spark, d):
    return _pages(spark, d).select("page_id", *[c.alias(k) for k, c in html.counts(F.col("html")).items()])


def page_links(spark, d):
    return _pages(spark, d).select("page_id", F.explode(html.hrefs(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


def pages_per_site(spark, d):
    site = urls.registrable_host(urls.host(F.col("url")))
    return _pages(spark, d).select(site.alias("site"), urls.path_depth(F.col("url")).alias("depth")).groupBy("site").agg(F.count("*").alias("pages"), F.max("depth").alias("deepest"))


def document_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).cast("long").alias("word_count"))


def conversation_word_count(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.sum(text.word_count(F.col("text"))).alias("words"), F.count("*").alias("turns"))


def document_emails(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(text.emails(F.col("text"))).alias("email")).select("doc_id", text.normalize_email(F.col("email")).alias("email")).distinct()


def customer_phone(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.normalize_address(F.col("c_name")).alias("name_words"), text.normalize_phone(F.col("c_name")).alias("digits"))


def primary_language(spark, d):
    langs = table(spark, d, "documents").groupBy("source", "lang").count()
    return langs.groupBy("source").agg(F.min(F.struct((-F.col("count")).alias("n"), "lang")).alias("best")).select("source", F.col("best.lang").alias("primary_lang"), (-F.col("best.n")).alias("documents"))


FLAGSHIP = "pages_per_site"
QUERIES = {f.__name__: f for f in (url_columns, url_normalize_abs, html_flags, html_title_lang, html_counts, page_links, pages_per_site, document_word_count, conversation_word_count, document_emails, customer_phone, primary_language)}

_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for _written, _meant in html.REFERENCES.items():
    _TITLE = f"replace({_TITLE}, '{_written}', '{_meant.replace(chr(39), chr(39) * 2)}')"
_TITLE = f"trim({_TITLE})"
_N = lambda p: f"len(regexp_extract_all(html, '{p}'))::BIGINT"
_DEPTH = f"CASE WHEN regexp_replace({PATH}, '^/+|/+$', '', 'g') = '' THEN 0 ELSE len(string_split(regexp_replace({PATH}, '^/+|/+$', '', 'g'), '/')) END::INTEGER"
_ASKED = f"list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT list_contains([{_quoted(urls.TRACKING_PARAMS)}], lower(split_part(x, '=', 1))))"
ORACLES = {
    "url_normalize_abs": f"""WITH parts AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, {HOST} AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*:([0-9]+)', 1) AS port,
 rtrim(regexp_replace({PATH}, '/{{2,}}', '/', 'g'), '/') AS path, array_to_string({_ASKED}, '&') AS asked FROM (SELECT page_id, trim(url) AS url FROM pages))
 SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN scheme || '://' || host || CASE WHEN port = '' OR (scheme, port) IN (('http', '80'), ('https', '443')) THEN '' ELSE ':' || port END
 || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN asked = '' THEN '' ELSE '?' || asked END END AS normalized FROM parts""",
    "url_columns": rf"""SELECT page_id, {SITE} AS site, NOT regexp_matches(lower({PATH}), '\.({'|'.join(urls.ASSET_SUFFIXES)})$') AS page_like, {_DEPTH} AS depth,
 list_has_any({TOKENS}, [{_quoted(urls.ACCOUNT_TOKENS)}]) AS account, array_to_string(list_filter(string_split(lower({PATH}), '/'), lambda x: x <> '')[1:2], '/') AS shape FROM pages""",
    "html_flags": r"""SELECT page_id, starts_with(lower(ltrim(left(html, 2048))), '<!doctype') AS has_doctype, regexp_matches(left(html, 4096), '(?i)<html[\s>]') AS has_html,
 regexp_matches(left(html, 8192), '(?i)<head[\s>]') AS has_head, regexp_matches(html, '(?i)<body[\s>]') AS has_body, regexp_matches(html, '(?i)<main[\s>]|role=["'']main["'']') AS has_main,
 regexp_matches(html, '(?i)<nav[\s>]|role=["'']navigation["'']') AS has_nav, regexp_matches(html, '(?i)<header[\s>]|role=["'']banner["'']') AS has_header, regexp_matches(html, '(?i)<footer[\s>]|role=["'']contentinfo["'']') AS has_footer FROM pages""",
    "html_title_lang": rf"""SELECT page_id, {_TITLE} AS title, trim(regexp_extract(html, '(?i)<html[^>]*\slang=["'']([^"'']*)["'']', 1)) AS lang,
 lower({_TITLE}) IN ({_quoted(text.GENERIC_TITLES)}) OR length({_TITLE}) < 6 AS generic FROM pages""",
    "html_counts": rf"SELECT page_id, {_N(r'(?i)<h[1-6][\s>]')} AS headings_total, {_N(r'(?i)<h1[\s>]')} AS h1_total, {_N(r'(?i)<h2[\s>]')} AS h2_total, {_N(r'(?i)<form[\s>]')} AS forms, {_N(r'(?i)<img[\s>]')} AS images_total FROM pages",
    "page_links": """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id, href""",
    "pages_per_site": f"SELECT {SITE} AS site, count(*) AS pages, max({_DEPTH}) AS deepest FROM pages GROUP BY 1",
    "document_word_count": f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{text.WORD.replace(chr(39), chr(39) * 2)}'))::BIGINT AS word_count FROM documents",
    "conversation_word_count": f"SELECT conv_id, role, sum(len(regexp_extract_all(coalesce(text, ''), '{text.WORD.replace(chr(39), chr(39) * 2)}')))::BIGINT AS words, count(*) AS turns FROM conversations GROUP BY conv_id, role",
    "document_emails": rf"SELECT DISTINCT doc_id, lower(trim(email)) AS email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{text.EMAIL}')[1:10]) AS email FROM documents) WHERE NOT regexp_matches(lower(email), '\.(png|jpg|webp)$')",
    "customer_phone": "SELECT c_custkey, array_to_string(list_transform(list_filter(string_split(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.ADDRESS_WORDS.items()) + " ELSE x END), ' ') AS name_words, right(regexp_replace(c_name, '[^0-9]', '', 'g'), 10) AS digits FROM customer",
    "primary_language": "SELECT source, lang AS primary_lang, documents FROM (SELECT source, lang, count(*) AS documents, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY source, lang) WHERE r = 1",
}
