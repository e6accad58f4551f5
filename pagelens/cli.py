"""``python -m pagelens.cli``: audit a table of pages, or crawl sites first, and write reports as JSON lines."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import vocab as V
from pagelens.operators import reasoning, robots, site
from pagelens.session import prepare, stored
from pagelens.sources import crawl, tables

# The checks that each module of an audit reports; the rest are of discoverability.
MODULES = {
    "freshness": ["entity_name_conflict", "contact_fact_conflict", "structured_visible_mismatch", "freshness_risk"],
    "engagement": site.ENGAGEMENT,
    "discoverability": [c for c, *_ in V.CHECKS if c not in [*site.ENGAGEMENT, "entity_name_conflict", "contact_fact_conflict", "structured_visible_mismatch", "freshness_risk"]],
}


def of_modules(found: DataFrame, modules: list[str] | None) -> DataFrame:
    """The findings of the named modules, or all. An unknown module is an error."""
    if not modules:
        return found
    if unknown := sorted(set(modules) - set(MODULES)):
        raise ValueError(f"no such modules: {unknown}")
    return found.filter(F.col("check").isin([c for m in modules for c in MODULES[m]]))


def audited(spark: SparkSession, pages: DataFrame, year: int, files: DataFrame | None = None, modules: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(evidence, reports) of a table of pages. files: (site, robots, sitemap_urls) of the sites, if known."""
    columns = stored(site.page_columns(pages))
    edges = site.link_edges(columns)
    evidence = stored(site.page_evidence(pages))
    homes = agents = sizes = None
    if files is not None:
        rules = files.select("site", "robots")
        outcome = crawl.homes(pages) if "outcome" in pages.columns else files.select("site", F.lit("ok").alias("home_outcome"))
        homes = robots.site_block(rules).select("site", "blocks_site").join(outcome, "site", "left")
        agents = robots.ai_agents(rules)
        sizes = files.select("site", F.size("sitemap_urls").cast("long").alias("sitemap_size"))
    found = of_modules(site.audit(evidence, edges, year, homes, agents, sizes), modules)
    rows = site.ranked(found)
    return evidence, tables.reports(reasoning.unchanged(rows, reasoning.enriched(rows)), site.scores(found, evidence))


def main(words: list[str] | None = None) -> int:
    ask = argparse.ArgumentParser(prog="pagelens")
    ask.add_argument("out", help="folder for the reports")
    ask.add_argument("--pages", help="Parquet table (page_id, site, url, status, is_home, in_sitemap, html)")
    ask.add_argument("--sites", nargs="*", default=[], help="addresses to crawl instead")
    ask.add_argument("--private", action="store_true", help="allow addresses that are not public")
    ask.add_argument("--max-pages", type=int, default=crawl.Limits().pages)
    ask.add_argument("--year", type=int, default=datetime.date.today().year)
    ask.add_argument("--module", action="append", choices=sorted(MODULES))
    ask.add_argument("--evidence", help="folder for the evidence as JSON lines")
    given = ask.parse_args(words)
    if bool(given.pages) == bool(given.sites):
        print("name either --pages or --sites", file=sys.stderr)
        return 2
    spark = prepare(SparkSession.builder.appName("pagelens").getOrCreate())
    files = None
    if given.pages:
        pages = spark.read.parquet(given.pages)
    else:
        spark.dataSource.register(crawl.SiteCrawl)
        read = spark.read.format("site_crawl").option("sites", "\n".join(given.sites)).option("private", str(given.private).lower()).option("pages", given.max_pages)
        pages, files = stored(read.load()), stored(read.option("what", "files").load())
    evidence, reports = audited(spark, pages, given.year, files, given.module)
    if given.evidence:
        tables.write_json(evidence, given.evidence)
    reports = stored(reports)
    if wrong := tables.problems(reports).limit(5).collect():
        print(f"reports are not well formed: {[tuple(r) for r in wrong]}", file=sys.stderr)
        return 1
    tables.write_json(reports, given.out)
    for r in reports.select("site", "overall", F.size("findings").alias("n")).orderBy("site").limit(20).collect():
        print(f"{r.site}: {'not assessed' if r.overall is None else r.overall}, {r.n} findings")
    return 0


if __name__ == "__main__":
    sys.exit(main())
