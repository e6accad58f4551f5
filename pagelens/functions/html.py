"""Document structure by regular expressions: the part of a page's evidence that needs no parser."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def flags(html: Column) -> dict[str, Column]:
    return {
        "has_doctype": F.lower(F.ltrim(F.substring(html, 1, 2048))).startswith("<!doctype"),
        "has_html": F.substring(html, 1, 4096).rlike(r"(?i)<html[\s>]"),
        "has_head": F.substring(html, 1, 8192).rlike(r"(?i)<head[\s>]"),
        "has_body": html.rlike(r"(?i)<body[\s>]"),
        "has_main": html.rlike(r"(?i)<main[\s>]|role=[\"']main[\"']"),
        "has_nav": html.rlike(r"(?i)<nav[\s>]|role=[\"']navigation[\"']"),
        "has_header": html.rlike(r"(?i)<header[\s>]|role=[\"']banner[\"']"),
        "has_footer": html.rlike(r"(?i)<footer[\s>]|role=[\"']contentinfo[\"']"),
    }


# The references that pages use for characters with a meaning of their own; the ampersand comes last.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def decoded(text: Column) -> Column:
    """The text with its common character references resolved."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), REFERENCES.items(), text)


#: Values of attributes with their quotes, if any: those of ``lang``, and those of links' ``href``. The quotes come off after.
LANG = r"(?i)<html[^>]*\slang\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
HREF = r"(?i)<a\s[^>]*?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
QUOTES = r"^[\"']|[\"']$"


def title(html: Column) -> Column:
    return F.trim(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def lang(html: Column) -> Column:
    """The attribute's value, quoted or not."""
    found = F.regexp_extract(html, LANG, 1)
    return F.trim(F.regexp_replace(found, QUOTES, ""))


def counts(html: Column) -> dict[str, Column]:
    n = lambda p: F.regexp_count(html, F.lit(p)).cast("long")
    return {"headings_total": n(r"(?i)<h[1-6][\s>]"), "h1_total": n(r"(?i)<h1[\s>]"), "h2_total": n(r"(?i)<h2[\s>]"), "forms": n(r"(?i)<form[\s>]"), "images_total": n(r"(?i)<img[\s>]")}


def hrefs(html: Column) -> Column:
    """Targets of links, quoted or not, in tags of any case."""
    return F.transform(F.regexp_extract_all(html, F.lit(HREF), 1), lambda x: F.regexp_replace(x, QUOTES, ""))
