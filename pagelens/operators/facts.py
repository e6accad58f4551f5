"""Facts that pages state or show about their site: names, contacts, addresses, prices and profiles, as rows.

A page's facts are one array column, built where the page is parsed, so the text itself is never kept; rows come from it by
explode. Null texts show nothing; a value that normalises to nothing stays with an empty normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import facts, text
from pagelens.functions import vocab as V

_FACT = "struct<kind:string,value:string,source:string>"
#: How much of a page's text is searched for contacts.
SEARCHED = 8_000


def _facts(kind: str, source: str, values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value"), F.lit(source).alias("source")))


def _one(kind: str, source: str, value: Column) -> Column:
    return _facts(kind, source, F.when(value.isNotNull() & (value != ""), F.array(value)))


def profiles(links: Column) -> Column:
    """The links to hosts of social profiles, the first of each spelling."""
    host = lambda x: F.lower(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    known = F.filter(links, lambda x: F.exists(F.array(*map(F.lit, V.SOCIAL_HOSTS)), lambda h: F.contains(host(x), h)))
    spelt = F.transform(known, profile_key)
    return F.filter(known, lambda x, i: F.array_position(spelt, profile_key(x)) == i + 1)


def profile_key(link: Column) -> Column:
    return F.regexp_replace(F.lower(link), "/+$", "")


def fact_columns(host: Column) -> list[Column]:
    """Columns ``facts`` (in blocks, footer, title, properties, profiles) and ``text_facts`` (in the text, which count for some roles only) over the parser's columns."""
    c = F.col
    shown = F.left(c("text"), F.lit(SEARCHED))
    every = [
        F.transform("stated", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), F.lit("jsonld").alias("source"))),
        _facts("email", "footer", text.emails(c("footer_text"))),
        _facts("phone", "footer", text.phones(c("footer_text"))),
        _one("organization_name", "title", facts.brand_from_title(c("title"), host)),
        _one("organization_name", "og", c("og")["site_name"]),
        _one("organization_name", "footer", text.footer_brand(c("footer_text"))),
        _facts("social", "text", profiles(c("external_links"))),
    ]
    return [F.concat(*[x.cast(f"array<{_FACT}>") for x in every]).alias("facts"), F.concat(_facts("email", "text", text.emails(shown)), _facts("phone", "text", text.phones(shown))).cast(f"array<{_FACT}>").alias("text_facts")]


def counted() -> Column:
    """A page's facts that count for its role."""
    none = F.array().cast(f"array<{_FACT}>")
    return F.concat("facts", F.when(F.col("role").isin(V.CONTACT_ROLES), F.col("text_facts")).otherwise(none))


def has_fact(kinds: list[str]) -> Column:
    return F.exists(counted(), lambda x: x["kind"].isin(kinds))


def page_facts(evidence: DataFrame) -> DataFrame:
    """(site, page_id, url, seq, kind, value, normalized, source) of every fact, seq in the page's order."""
    rows = evidence.select("site", "page_id", "url", F.posexplode(counted()).alias("seq", "fact")).select("site", "page_id", "url", "seq", "fact.*")
    v = F.col("value")
    spelt = {
        "organization_name": facts.normalize_org_name(v), "email": text.normalize_email(v), "phone": text.normalize_phone(v), "address": text.normalize_address(v),
        "social": profile_key(v), "price": F.regexp_replace(F.element_at(F.split(v, " "), -1), r"[^0-9.]", ""),
    }
    return rows.select("site", "page_id", "url", "seq", "kind", "value", F.coalesce(*[F.when(F.col("kind") == k, x) for k, x in spelt.items()]).alias("normalized"), "source")


def facts_by_kind(found: DataFrame) -> DataFrame:
    """(site, kind, observations, distinct_values, sources) of each kind of fact."""
    return found.groupBy("site", "kind").agg(F.count("*").alias("observations"), F.count_distinct("normalized").alias("distinct_values"), F.array_sort(F.collect_set("source")).alias("sources"))
