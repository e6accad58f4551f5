"""robots.txt and sitemaps as rows. Rules are read by line with window functions; permission and sitemaps need Python.

A null file has no rules and allows everything; a sitemap that breaks off gives the addresses before the break.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import resolve
from pagelens.functions import vocab as V
from pagelens.session import prepare

LISTED = 50
#: Parsed files that a worker keeps at a time.
PARSERS = 64


def lines(files: DataFrame, key: str = "site", text: str = "robots") -> DataFrame:
    """(key, pos, name, value) of every directive, comments left out, in file order."""
    rows = files.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "raw"))
    rows = rows.withColumn("raw", F.trim(F.split_part("raw", F.lit("#"), F.lit(1)))).filter(F.contains("raw", F.lit(":")))
    return rows.select(key, "pos", F.lower(F.trim(F.split_part("raw", F.lit(":"), F.lit(1)))).alias("name"), F.trim(F.regexp_replace("raw", "^[^:]*:", "")).alias("value"))


def site_block(files: DataFrame, key: str = "site", text: str = "robots") -> DataFrame:
    """(key, blocks_site, paths): whether everyone is shut out of the whole site, and the first paths closed to everyone.

    Only the last named agent before a rule counts here, and permissions are not weighed against it."""
    order = Window.partitionBy(key).orderBy("pos")
    found = lines(files, key, text).withColumn("agent", F.last(F.when(F.col("name") == "user-agent", F.col("value")), ignorenulls=True).over(order))
    closed = found.filter((F.col("name") == "disallow") & (F.col("value") != "") & (F.col("agent").isNull() | (F.col("agent") == "*")))
    placed = closed.withColumn("place", F.row_number().over(Window.partitionBy(key, F.col("value") == "/").orderBy("pos")))
    paths = F.transform(F.array_sort(F.collect_list(F.when((F.col("value") != "/") & (F.col("place") <= LISTED), F.struct("pos", "value")))), lambda x: x.value)
    judged = placed.groupBy(key).agg(F.max(F.col("value") == "/").alias("blocks_site"), paths.alias("paths"))
    return files.select(key).distinct().join(judged, key, "left").select(key, F.coalesce("blocks_site", F.lit(False)).alias("blocks_site"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


def agent_rules(files: DataFrame, key: str = "site", text: str = "robots") -> DataFrame:
    """(key, agent, name, value): rules by agent. Agents named one after the other share the rules that follow; an agent's groups add up."""
    order = Window.partitionBy(key).orderBy("pos")
    found = lines(files, key, text).filter(F.col("name").isin("user-agent", "allow", "disallow"))
    is_agent = F.col("name") == "user-agent"
    # A group starts at an agent that follows a rule, or at the first line.
    starts = is_agent & F.coalesce(F.lag("name").over(order) != "user-agent", F.lit(True))
    found = found.withColumn("grp", F.sum(starts.cast("int")).over(order))
    agents = found.filter(is_agent).select(key, "grp", F.lower("value").alias("agent")).distinct()
    rules = found.filter(~is_agent).select(key, "grp", "pos", "name", "value")
    return agents.join(rules, [key, "grp"]).select(key, "agent", "pos", "name", "value")


def ai_agents(files: DataFrame, key: str = "site", text: str = "robots") -> DataFrame:
    """(key, agent, blocked, paths) for the known AI agents that a file names and restricts: wholly, unless the root is allowed, or in part."""
    rules = agent_rules(files, key, text).filter(F.col("agent").isin(V.AI_AGENTS))
    root = lambda name: F.max((F.col("name") == name) & (F.col("value") == "/"))
    shut = F.array_sort(F.collect_set(F.when((F.col("name") == "disallow") & (F.col("value") != ""), F.struct("pos", "value"))))
    judged = rules.groupBy(key, "agent").agg((root("disallow") & ~root("allow")).alias("blocked"), F.slice(F.transform(shut, lambda x: x.value), 1, 10).alias("paths"))
    return judged.filter(F.size("paths") > 0)


def may_fetch(pages: DataFrame, files: DataFrame, agent: str, key: str = "site", text: str = "robots", url: str = "url") -> DataFrame:
    """``pages`` with ``robots_allowed``: whether the agent by name, or anyone, may fetch the address. A site without a file allows all."""
    prepare(pages.sparkSession)

    @F.pandas_udf("boolean")
    def allowed(addresses: pd.Series, robots: pd.Series) -> pd.Series:
        from urllib.robotparser import RobotFileParser

        known, out = {}, []
        for address, file in zip(addresses, robots, strict=True):
            if file not in known:
                if len(known) >= PARSERS:
                    known.pop(next(iter(known)))
                known[file] = RobotFileParser()
                known[file].parse((file or "").splitlines())
            out.append(not file or known[file].can_fetch(agent, address or "") or known[file].can_fetch("*", address or ""))
        return pd.Series(out)

    file = files.select(F.col(key).alias("__robots_site"), F.col(text).alias("__robots_file")).dropDuplicates(["__robots_site"])
    rows = pages.join(file, F.col(key) == F.col("__robots_site"), "left")
    return rows.withColumn("robots_allowed", allowed(F.col(url), F.col("__robots_file"))).drop("__robots_site", "__robots_file")


def locations(xml: str | None, base: str | None = None) -> tuple[list[str], bool]:
    """(addresses, whether they are sitemaps themselves) of a sitemap file, well formed or not."""
    body = re.sub(r"(?s)<!--.*?-->", "", xml or "")
    found = [re.sub(r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", r"\1", x).strip() for x in re.findall(r"(?is)<(?:\w+:)?loc\b[^>]*>(.*?)</(?:\w+:)?loc\s*>", body)]
    spelt = [resolve.normal(unescape(x), base) for x in found]
    return list(dict.fromkeys(x for x in spelt if x)), bool(re.search(r"(?i)<(?:\w+:)?sitemapindex\b", body))


def sitemap_urls(maps: DataFrame, key: str = "site", url: str = "url", text: str = "xml") -> DataFrame:
    """(key, url, is_index): a row for every address of every sitemap, in one spelling."""
    prepare(maps.sparkSession)

    @F.pandas_udf("struct<urls array<string>, is_index boolean>")
    def read(files: pd.Series, bases: pd.Series) -> pd.DataFrame:
        rows = [locations(f, b) for f, b in zip(files, bases, strict=True)]
        return pd.DataFrame({"urls": [r[0] for r in rows], "is_index": [r[1] for r in rows]})

    got = maps.select(key, read(F.col(text), F.col(url)).alias("got"))
    return got.select(key, F.explode("got.urls").alias("url"), F.col("got.is_index").alias("is_index")).distinct()
