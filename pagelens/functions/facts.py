"""Names, brands and profiles as built-in expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import vocab as V


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_org_name(name: Column | str) -> Column:
    """Lower case without punctuation, legal forms at the end and words without weight. A null name is empty."""
    s = F.lower(F.coalesce(_column(name), F.lit("")))
    s = F.regexp_replace(F.regexp_replace(s, "[‘’“”]", "'"), r"[^a-z0-9&\s.]", " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    s = F.regexp_replace(s, rf"(?:(?:^| )(?:{'|'.join(V.LEGAL_PAIRS)}))+$", "")
    s = F.regexp_replace(s, rf"(?:(?:^| )\.*(?:{'|'.join(V.LEGAL_WORDS)})\.*)+$", "")
    kept = F.filter(F.split(s, " "), lambda x: (x != "") & ~x.isin(V.NAME_STOPWORDS))
    return F.btrim(F.array_join(kept, " "), F.lit(" ."))


def token_prefixes(a: Column, b: Column) -> Column:
    """Whether every word of one name begins, or is begun by, the word at its place in the other, with three letters at least."""
    x, y = F.split(a, " "), F.split(b, " ")
    near = F.zip_with(x, y, lambda p, q: (p == q) | ((F.least(F.length(p), F.length(q)) >= 3) & (p.startswith(q) | q.startswith(p))))
    return (a != "") & (b != "") & (F.size(x) == F.size(y)) & F.forall(near, lambda ok: F.coalesce(ok, F.lit(False)))


def brand_from_title(title: Column, host: Column) -> Column:
    """The first short part of a parted title that agrees with the host's first telling label; null where none does."""
    parts = F.filter(F.transform(F.split(title, r"\s[|–—\-·:]\s"), lambda x: F.trim(x)), lambda x: x != "")
    short = F.filter(parts, lambda x: (F.length(x) <= 60) & (F.size(F.split(x, r"\s+")) <= 6))
    # Labels of a host that tell nothing.
    telling = F.filter(F.split(F.lower(host), r"\."), lambda x: ~x.isin("www", "com", "org", "net", "co", "io", "ai") & (x != ""))
    label = F.regexp_replace(F.get(telling, F.lit(0)), "[^a-z0-9]", "")
    squash = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    agreed = F.filter(short, lambda x: (label != "") & (squash(x) != "") & (squash(x).startswith(label) | label.startswith(squash(x))))
    return F.when(F.size(parts) >= 2, F.get(agreed, F.lit(0)))


def socials(links: DataFrame, key: str, link: str) -> DataFrame:
    """(key, social): the distinct links to hosts of social profiles, in lower case without a slash at the end."""
    host = F.lower(F.regexp_extract(link, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    known = F.exists(F.array(*map(F.lit, V.SOCIAL_HOSTS)), lambda h: F.contains(host, h))
    return links.filter(known).select(key, F.regexp_replace(F.lower(link), "/+$", "").alias("social")).distinct()
