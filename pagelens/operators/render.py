"""Pages as a browser has rendered them, beside the pages as they were sent. Rendering itself happens elsewhere; its pages are a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import classify, urls
from pagelens.operators import parse

# Pages worth rendering for a site, words that scripts must add before they are quoted, letters of a sentence, and of all that is quoted.
MOST_RENDERED, ADDED_WORDS, SENTENCE, EXCERPT = 8, 40, 25, 260


def early_importance(evidence: DataFrame) -> Column:
    """Importance before the link graph is known: by role, address, navigation and words alone."""
    return classify.importance(F.col("role"), urls.path_depth(F.col("url")), F.col("in_nav"), F.lit(0), F.lit(False), F.col("words"))


def render_candidates(evidence: DataFrame, most: int = MOST_RENDERED) -> DataFrame:
    """(site, page_id, url, place) of the pages that are in order and matter most by what is known early; ties by address."""
    rows = evidence.filter("ok and kind = 'page'").withColumn("early", early_importance(evidence))
    order = Window.partitionBy("site").orderBy(F.desc("early"), "url", "page_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("site", "page_id", "url", "place")


def added_text(raw: Column, rendered: Column, most: int = EXCERPT) -> Column:
    """The first sentences of a rendered text that the raw one lacks, up to so many letters."""
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    known = plain(F.coalesce(raw, F.lit("")))
    parts = F.transform(F.split(F.coalesce(rendered, F.lit("")), r"(?<=[.!?])\s+"), lambda x: F.trim(x))
    fresh = F.filter(parts, lambda x: (F.length(x) >= SENTENCE) & ~F.contains(known, plain(x)))
    # Sentences are taken until the wanted length is reached.
    state = F.struct(F.lit("").alias("said"), F.lit(0).alias("n"))
    taken = F.aggregate(fresh, state, lambda s, x: F.when(s["n"] >= most, s).otherwise(F.struct(F.concat(s["said"], F.when(s["said"] == "", "").otherwise(" "), x).alias("said"), (s["n"] + F.length(x)).alias("n"))))["said"]
    return F.when(F.length(taken) > most, F.concat(F.left(taken, F.lit(most)), F.lit("..."))).otherwise(taken)


def render_evidence(pages: DataFrame, rendered: DataFrame) -> DataFrame:
    """(page_id, rendered, raw_words, rendered_words, added_words, added_ratio, script_dependent, excerpt, rendered_types, render_error).

    pages: (page_id, url, html); rendered: (url, ok, html, error). A page without a rendered one, or with one that failed, depends on nothing."""
    c = F.col
    raw = parse.parsed_pages(pages.select("page_id", "url", "html")).select("page_id", "url", c("text").alias("raw_text"), c("words").alias("raw_words"))
    one = rendered.groupBy("url").agg(F.max_by(F.struct("ok", "html", "error"), F.coalesce(c("ok"), F.lit(False))).alias("r")).select("url", "r.*")
    met = pages.select("page_id", "url").join(one, "url")
    seen = parse.parsed_pages(met.withColumn("html", F.when(c("ok"), c("html"))).select("page_id", "url", "html", "ok", "error"), keep=["ok", "error"])
    seen = seen.select("page_id", F.coalesce("ok", F.lit(False)).alias("rendered"), c("text").alias("new_text"), c("words").alias("rendered_words"), c("jsonld_types").alias("rendered_types"), c("error").alias("render_error"))
    rows = raw.join(seen, "page_id", "left").withColumn("rendered", F.coalesce("rendered", F.lit(False)))
    added, ratio, depends = classify.script_dependence(c("raw_words"), c("rendered_words"))
    only = lambda x, other: F.when(c("rendered"), x).otherwise(other)
    rows = rows.withColumns({"added_words": only(added, F.lit(0).cast("long")), "added_ratio": only(ratio, F.lit(0.0)), "script_dependent": only(depends, F.lit(False))})
    rows = rows.withColumn("excerpt", F.when(c("added_words") >= ADDED_WORDS, added_text(c("raw_text"), c("new_text"))).otherwise(""))
    return rows.select("page_id", "rendered", "raw_words", "rendered_words", "added_words", "added_ratio", "script_dependent", "excerpt", "rendered_types", "render_error")


def render_status(rendered: DataFrame) -> DataFrame:
    """(site, attempted, rendered, failed) of a table of rendered pages."""
    ok = F.coalesce("ok", F.lit(False))
    return rendered.groupBy(urls.registrable_host(urls.host(F.col("url"))).alias("site")).agg(F.count("*").alias("attempted"), F.count_if(ok).alias("rendered"), F.count_if(~ok).alias("failed"))


def most_dependent(evidence: DataFrame) -> DataFrame:
    """(site, url, added_ratio) of the page of each site to which scripts add most; ties by address."""
    rows = evidence.filter("script_dependent")
    return rows.groupBy("site").agg(F.min_by(F.struct("url", "added_ratio"), F.struct(-F.col("added_ratio"), "url")).alias("p")).select("site", "p.*")


def crawl_summary(pages: DataFrame) -> DataFrame:
    """(site, pages, ok, shallowest, deepest, statuses, content_types) of crawled pages."""
    counts = lambda column: pages.groupBy("site", F.coalesce(F.col(column).cast("string"), F.lit("none")).alias("k")).agg(F.count("*").alias("n")).groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(column))
    sums = pages.groupBy("site").agg(F.count("*").alias("pages"), F.count_if(F.coalesce("ok", F.lit(False))).alias("in_order"), F.min("depth").alias("shallowest"), F.max("depth").alias("deepest"))
    return sums.join(counts("status").withColumnRenamed("status", "statuses"), "site").join(counts("content_type").withColumnRenamed("content_type", "content_types"), "site")
