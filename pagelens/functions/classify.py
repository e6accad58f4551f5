"""Roles, importance, resource kinds, severity, confidence and priority as built-in expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.functions import vocab as V


def _list(words) -> Column:
    return F.array(*map(F.lit, words))


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def slug_tokens(url: Column) -> Column:
    """Path segments and the words inside them."""
    segments = F.filter(F.split(F.lower(urls.path(url)), "/"), lambda x: x != "")
    return F.array_union(segments, urls.path_tokens(url))


def rounded(value: Column, places: int) -> Column:
    """To the nearest, ties to the even digit, on the binary value: decimal rounding would lift what lies just under a tie."""
    return F.rint(value * 10.0**places) / 10.0**places


def _first_of(cases, otherwise) -> Column:
    return reduce(lambda chain, case: F.when(case[0], F.lit(case[1])).otherwise(chain), reversed(cases), F.lit(otherwise))


def role(url: Column, title: Column, headings: Column, is_home: Column) -> Column:
    """Home, else by the path's words, else by title and headings, else ``other``. Null texts say nothing."""
    tokens = slug_tokens(url)
    said = F.lower(F.concat_ws(" ", title, headings))
    listing = F.coalesce(F.lower(F.regexp_extract(url, r"\?([^#]*)", 1)).rlike(r"(^|&)p?type=listing"), F.lit(False))
    cases = [(F.coalesce(is_home, F.lit(False)), "home"), (listing, "other")]
    cases += [(F.coalesce(F.arrays_overlap(tokens, _list(words)), F.lit(False)), name) for name, words in V.ROLE_WORDS.items()]
    cases += [(said.rlike("|".join(phrases)), name) for name, phrases in V.TITLE_PHRASES.items()]
    return _first_of(cases, "other")


def importance(role: Column, depth: Column, in_nav: Column, incoming: Column, in_sitemap: Column, words: Column) -> Column:
    """Between 0 and 1, to three places."""
    worth = F.coalesce(_map(V.ROLE_WEIGHT)[role], F.lit(V.OTHER_WEIGHT))
    score = (
        worth
        + F.when(in_nav, 0.28).otherwise(0.0)
        + F.when(depth <= 1, 0.16).when(depth == 2, 0.06).otherwise(0.0)
        + F.when(incoming >= 5, 0.16).when(incoming >= 2, 0.08).otherwise(0.0)
        + F.when(in_sitemap, 0.05).otherwise(0.0)
        + F.when(words >= 400, 0.06).otherwise(0.0)
    )
    score = F.when(role == "legal", F.least(score, F.lit(0.35))).otherwise(score)
    return F.when(role == "home", 1.0).when(role == "account", 0.0).otherwise(rounded(F.least(score, F.lit(1.0)), 3))


def resource_kind(url: Column, content_type: Column, status: Column, has_html: Column, has_head: Column, has_title: Column, words: Column, out_links: Column, siblings: Column) -> tuple[Column, Column]:
    """(kind, confidence) of what an address answers. An unknown content type counts as HTML; an unknown status as none."""
    ctype = F.lower(F.coalesce(content_type, F.lit("")))
    among = lambda types: reduce(lambda a, b: a | b, [ctype.contains(t) for t in types])
    path = F.lower(urls.path(url))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    tokens = F.array_union(segments, F.filter(F.split(path, r"[/\-_.]+"), lambda x: x != ""))
    holds = lambda words_: F.coalesce(F.arrays_overlap(tokens, _list(words_)), F.lit(False))
    shape = has_html.cast("int") + has_head.cast("int") + has_title.cast("int")
    weak = (shape < 3) | (words < 25)
    answered = F.coalesce(status.between(200, 299), F.lit(False))
    cases = [
        (among(V.STRUCTURED_TYPES), "api_resource", 0.97),
        ((ctype != "") & ~among(V.HTML_TYPES), "asset", 0.95),
        (~answered, "other_non_page", 0.9),
        (shape == 0, "component_fragment", 0.94),
        (holds(V.API_WORDS) & weak, "api_resource", 0.8),
        (holds(V.FRAGMENT_WORDS) & weak, "component_fragment", 0.85),
        (holds(V.FRAGMENT_WORDS) & (siblings >= 2) & (words < 120), "component_fragment", 0.7),
        (holds(V.UTILITY_WORDS) & weak, "utility_endpoint", 0.75),
        (~has_title & (words < 25) & (out_links == 0), "other_non_page", 0.72),
    ]
    return _first_of([(c, k) for c, k, _ in cases], "page"), _first_of([(c, s) for c, _, s in cases], 0.9)


def script_dependence(raw_words: Column, rendered_words: Column) -> tuple[Column, Column, Column]:
    """(words added by scripts, their share of the rendered words, whether the page depends on them)."""
    added = F.greatest(rendered_words - raw_words, F.lit(0))
    ratio = rounded(added / F.greatest(rendered_words, F.lit(1)), 3)
    return added, ratio, (rendered_words >= 30) & (ratio >= 0.35) & (added >= 40)


def severity_rank(severity: Column) -> Column:
    return F.array_position(_list(V.SEVERITIES), severity).cast("int") - 1


def severity(check: Column, reach: Column, important: Column, forced: Column | None = None) -> Column:
    """The base severity, one step up where much of the site and an important page is hit, one down where neither is; a forced one stands as it is."""
    base = severity_rank(F.coalesce(_map({c: s for c, s, _ in V.CHECKS})[check], F.lit("medium")))
    rank = F.when((reach >= 0.6) & important, F.least(base + 1, F.lit(3))).when((reach <= 0.15) & ~important, F.greatest(base - 1, F.lit(0))).otherwise(base)
    rank = F.when((rank == 3) & ~check.isin(V.MAY_BE_CRITICAL), 2).otherwise(rank)
    found = F.element_at(_list(V.SEVERITIES), (rank + 1).cast("int"))
    return found if forced is None else F.coalesce(forced, found)


def confidence(sample: Column, affected: Column, direct: Column, conflict: Column, sources: Column) -> Column:
    """How far a deterministic rule's finding can be trusted: 0.3 to 0.98, to two places."""
    share = affected / F.greatest(sample, F.lit(1))
    counted = (sample > 0) & (affected > 0)
    score = (
        F.lit(0.75)
        + F.when(direct, 0.1).otherwise(0.0)
        + F.when(sample >= 5, 0.08).when(sample <= 1, -0.1).otherwise(0.0)
        + F.when(counted & (share >= 0.8), 0.07).when(counted & (share <= 0.2), -0.03).otherwise(0.0)
        + F.when(sources >= 2, 0.05).otherwise(0.0)
        - F.when(conflict, 0.2).otherwise(0.0)
    )
    return F.greatest(F.lit(0.3), F.least(rounded(score, 2), F.lit(0.98)))


def priority(severity: Column, check: Column, reach: Column, confidence: Column) -> tuple[Column, Column]:
    """(band, score to four places)."""
    impact = F.coalesce(_map(V.IMPACT)[severity], F.lit(0.5))
    ease = F.coalesce(_map({c: f for c, _, f in V.CHECKS})[check], F.lit(0.6))
    score = rounded(impact * (F.lit(0.35) + F.lit(0.65) * F.greatest(F.lit(0.1), F.least(reach, F.lit(1.0)))) * confidence * (F.lit(0.55) + F.lit(0.45) * ease), 4)
    return F.when(score >= 0.55, "high").when(score >= 0.28, "medium").otherwise("low"), score


def penalty(severity: Column, reach: Column, confidence: Column) -> Column:
    """What a finding takes from its dimension's score. A reach of zero counts as 0.3."""
    known = F.when(F.coalesce(reach, F.lit(0.0)) == 0, 0.3).otherwise(reach)
    return F.coalesce(_map(V.PENALTY)[severity], F.lit(10.0)) * (F.lit(0.4) + F.lit(0.6) * F.greatest(F.lit(0.1), F.least(known, F.lit(1.0)))) * confidence
