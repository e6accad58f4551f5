"""What follows from findings: stages, phases, effort, a plan for each site, and guards against claims that nobody measured.

Columns are only ever added; ``unchanged`` holds what was measured against what comes out.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagelens.functions import classify, wording
from pagelens.functions import vocab as V
from pagelens.operators import site

# Effort of a fix where it is not medium.
EFFORT = {
    **dict.fromkeys("robots_blocks_site noindex_on_important_page ai_crawler_blocked missing_organization_identity invalid_structured_data no_next_step entity_name_conflict contact_fact_conflict".split(), "low"),
    "js_dependent_content": "high",
}
# The phase of a plan in which a severity is dealt with.
PHASE = {"critical": 1, "high": 1, "medium": 2, "low": 3}
#: What a stage that fails costs, in this project's words.
STAGE_COST = {
    "discover": "The site is not found, so nothing of it is read.",
    "access": "Pages are known but left out.",
    "understand": "Pages are read, and their subject is guessed.",
    "extract": "Facts on pages cannot be taken from them.",
    "trust": "Nothing elsewhere or recent supports what is said.",
    "represent": "Pages contradict each other about the owner.",
}
#: Themes of a plan: stages that call for them, and what is advised.
THEMES = {
    "reach": (["discover", "access"], "Let readers in: open robots rules, a sound sitemap, pages that answer."),
    "meaning": (["understand", "extract"], "Say in headings and structured data what pages show."),
    "standing": (["trust", "represent"], "One name, confirmed contacts and profiles, revised pages."),
}
# Bounds of what a reasoner may return, and the domains that it may cite.
TEXT_CHARS, LIST_ITEMS, ITEM_CHARS = 1200, 12, 400
CITABLE = ["schema.org", "w3.org", "developers.google.com", "www.robotstxt.org", "json-ld.org"]
# Addresses in prose, claims of counts and of shares, and numbers.
ADDRESS = r"(?i)https?://[^\s\"'>)]+"
COUNTED = re.compile(r"\b(\d+(?:\.\d+)?)\s*(?:of|/|out of)\s*(\d+(?:\.\d+)?)\b", re.I)
SHARED = re.compile(r"\b(\d+(?:\.\d+)?)\s*%")
NUMBER = re.compile(r"\d+(?:\.\d+)?")
UNKNOWN_ADDRESS, UNKNOWN_COUNT, UNKNOWN_SHARE = "[unverified URL]", "[unverified count]", "[unverified proportion]"
TOP = 5


def enriched(found: DataFrame) -> DataFrame:
    """Ranked findings with title, impact, steps, stage, phase, effort, cost and up to three ids of other findings of their category and site, in order."""
    c, check = F.col, F.col("check")
    rows = found.withColumns({
        "category": F.when(check.isin(site.ENGAGEMENT), "engagement").otherwise("discoverability"), "title": wording.title(check, c("affected")), "impact": wording.impact(check), "steps": wording.steps(check),
        "stage": wording.stage(check), "phase": F.coalesce(classify._map(PHASE)[c("severity")], F.lit(2)), "effort": F.coalesce(classify._map(EFFORT)[check], F.lit("medium")),
    })
    rows = rows.withColumn("cost", F.coalesce(classify._map(STAGE_COST)[F.coalesce("stage", F.lit("discover"))], F.lit("")))
    order = Window.partitionBy("site", "category").orderBy("place")
    near = rows.withColumn("at", F.row_number().over(order)).filter("at <= 4").groupBy("site", "category").agg(F.array_sort(F.collect_list(F.struct("at", "finding_id"))).alias("near"))
    others = F.slice(F.filter(F.transform("near", lambda x: x.finding_id), lambda x: x != F.col("finding_id")), 1, 3)
    return rows.join(near, ["site", "category"]).withColumn("depends_on", others).drop("near")


def plans(rows: DataFrame) -> DataFrame:
    """(site, findings, severities, stages, bottleneck, themes, roadmap) from enriched findings: of each phase the first five titles.

    A site's findings are at most as many as there are checks times the addresses they first name; what is listed is cut before it meets."""
    c = F.col
    stage = F.coalesce("stage", F.lit("discover"))
    staged = rows.groupBy("site", stage.alias("stage")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    by_stage = staged.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n")))).alias("stages"), F.min_by("stage", F.struct(-c("n"), "first")).alias("bottleneck"))
    counts = rows.groupBy("site").agg(F.count("*").alias("findings"), F.create_map(*[x for s in V.SEVERITIES for x in (F.lit(s), F.count_if(c("severity") == s))]).alias("severities"))
    order = Window.partitionBy("site", "phase").orderBy("place")
    listed = rows.withColumn("at", F.row_number().over(order)).filter(c("at") <= TOP).groupBy("site", "phase").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat("title", F.lit(" ("), "finding_id", F.lit(")")).alias("said")))), lambda x: x.said).alias("actions"))
    roadmap = listed.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("phase", "actions"))).alias("roadmap"))
    named = [F.when(F.arrays_overlap(F.map_keys("stages"), classify._list(stages)), F.struct(F.lit(k).alias("theme"), F.lit(advice).alias("advice"))) for k, (stages, advice) in THEMES.items()]
    return counts.join(by_stage, "site").join(roadmap, "site").withColumn("themes", F.array_compact(F.array(*named)))


# --- guards ---------------------------------------------------------------------------------------------------------------


def ungrounded(text: Column, known: Column) -> Column:
    """Addresses in a text that are neither known (without a final slash) nor of a domain that may be cited."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ADDRESS), 0), lambda x: F.rtrim(x, F.lit(".,;")))
    plain = F.transform(known, lambda x: F.regexp_replace(x, "/+$", ""))
    cited = lambda x: F.exists(classify._list(CITABLE), lambda d: F.contains(x, d))
    return F.filter(found, lambda x: ~cited(x) & ~F.array_contains(plain, F.regexp_replace(x, "/+$", "")))


def grounded_text(text: Column, known: Column) -> Column:
    """The text with every ungrounded address struck out. A null text is empty."""
    said = F.coalesce(text, F.lit(""))
    return F.aggregate(ungrounded(said, F.coalesce(known, F.array().cast("array<string>"))), said, lambda t, x: F.replace(t, x, F.lit(UNKNOWN_ADDRESS)))


def numbers_of(*said: Column) -> Column:
    """Every number in the given columns' texts, whole ones without a fraction as well."""
    found = F.regexp_extract_all(F.concat_ws(" ", *said), F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0)
    return F.array_distinct(F.concat(found, F.transform(F.filter(found, lambda x: x.rlike(r"\.0+$")), lambda x: F.regexp_replace(x, r"\.0+$", ""))))


def struck(text: str | None, known: set[str]) -> str:
    """The text with claims of counts and shares struck out whose numbers nobody measured."""

    def count(m: re.Match) -> str:
        return m[0] if {m[1], m[2]} <= known else UNKNOWN_COUNT

    def share(m: re.Match) -> str:
        return m[0] if {m[1], str(round(float(m[1])))} & known else UNKNOWN_SHARE

    return SHARED.sub(share, COUNTED.sub(count, text or ""))


@F.pandas_udf(StringType())
def measured_text(text: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([struck(t, set(() if k is None else k)) for t, k in zip(text, known, strict=True)])


def bounded_text(text: Column, most: int = TEXT_CHARS) -> Column:
    said = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(said) <= most, said).otherwise(F.concat(F.rtrim(F.left(said, F.lit(most))), F.lit("...")))


def one_of(value: Column, allowed: list[str], otherwise: str) -> Column:
    """The allowed word that a text is, whatever its case."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.coalesce(F.get(F.filter(classify._list(allowed), lambda x: F.lower(x) == low), F.lit(0)), F.lit(otherwise))


def bounded_list(values: Column, items: int = LIST_ITEMS, chars: int = ITEM_CHARS) -> Column:
    said = F.transform(F.slice(F.coalesce(values, F.array().cast("array<string>")), 1, items), lambda x: F.left(F.trim(F.coalesce(x, F.lit(""))), F.lit(chars)))
    return F.filter(said, lambda x: x != "")


MEASURED = ["site", "finding_id", "check", "severity", "priority", "priority_score", "confidence", "reach"]


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of what was measured that are in only one of the two; none if reasoning has kept to adding."""
    a, b = before.select(*MEASURED), after.select(*MEASURED)
    return a.exceptAll(b).withColumn("lost", F.lit(True)).unionByName(b.exceptAll(a).withColumn("lost", F.lit(False)))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after``, or ValueError if anything measured was changed."""
    if wrong := changed(before, after).limit(5).collect():
        raise ValueError(f"findings were changed: {[(r.site, r.finding_id) for r in wrong]}")
    return after
