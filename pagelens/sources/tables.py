"""Reports as tables: assembly, JSON source and sink, validation and a page to read."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.functions import vocab as V

LISTED = 25
FINDING = "struct<finding_id:string,check:string,severity:string,priority:string,priority_score:double,reach:double,confidence:double,affected:bigint,urls:array<string>>"
SCHEMA = f"site string, overall int, dimensions map<string,int>, severities map<string,bigint>, findings array<{FINDING}>"


def reports(found: DataFrame, scores: DataFrame) -> DataFrame:
    """One row for each site: overall score (null where nothing was judged), scores by dimension, counts by severity and the ranked findings.

    A site has at most as many findings as there are checks times addresses they first name, so its row stays short."""
    item = F.struct("place", F.struct("finding_id", "check", "severity", "priority", "priority_score", "reach", "confidence", "affected", F.slice("urls", 1, LISTED).alias("urls")).alias("finding"))
    per_severity = [F.count_if(F.col("severity") == s).alias(s) for s in V.SEVERITIES]
    listed = found.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.finding).alias("findings"), *per_severity)
    listed = listed.select("site", "findings", F.create_map(*[c for s in V.SEVERITIES for c in (F.lit(s), F.col(s))]).alias("severities"))
    scored = scores.groupBy("site").agg(F.max(F.when(F.col("dimension") == "overall", F.col("score"))).alias("overall"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("dimension") != "overall", F.struct("dimension", "score"))))).alias("dimensions"))
    none = F.create_map(*[c for s in V.SEVERITIES for c in (F.lit(s), F.lit(0).cast("long"))])
    rows = scored.join(listed, "site", "left")
    return rows.select("site", "overall", "dimensions", F.coalesce("severities", none).alias("severities"), F.coalesce("findings", F.array().cast(f"array<{FINDING}>")).alias("findings"))


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines, nulls written out, so that reading gives back the same rows."""
    rows.write.option("ignoreNullFields", "false").mode("errorifexists").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines of a known schema; a line that does not fit is an error, unknown fields are left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def non_pages(evidence: DataFrame) -> DataFrame:
    """(site, resources) the first addresses, in order, that answer and are no pages, with their kinds."""
    order = Window.partitionBy("site").orderBy("url", "page_id")
    rows = evidence.filter("ok and kind <> 'page'").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= LISTED)
    return rows.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url", "kind"))), lambda x: F.struct(x["url"].alias("url"), x["kind"].alias("kind"))).alias("resources"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports from JSON lines; unknown fields are left out."""
    return spark.read.schema(SCHEMA).json(path)


def problems(report: DataFrame) -> DataFrame:
    """(site, problem) for whatever a report gets wrong; no row if all is well."""
    f = F.col("findings")
    ids = F.transform(f, lambda x: x.finding_id)
    bad = {
        "no site": F.coalesce(F.col("site"), F.lit("")) == "",
        "score out of range": ~F.coalesce(F.col("overall").between(0, 100), F.lit(True)),
        "dimension out of range": F.exists(F.map_values("dimensions"), lambda x: ~F.coalesce(x.between(0, 100), F.lit(True))),
        "unknown severity": F.exists(f, lambda x: ~F.coalesce(x.severity.isin(V.SEVERITIES), F.lit(False))),
        "confidence out of range": F.exists(f, lambda x: ~F.coalesce(x.confidence.between(0, 1), F.lit(False))),
        "finding id used twice": F.size(F.array_distinct(ids)) < F.size(ids),
        "too many addresses": F.exists(f, lambda x: F.size(x.urls) > LISTED),
    }
    of = F.transform(f, lambda x: x.severity)
    for s in V.SEVERITIES:
        bad[f"wrong count of {s}"] = F.size(of) - F.size(F.array_remove(of, s)) != F.col("severities")[s]
    found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in bad.items()]))
    return report.select("site", F.explode(found).alias("problem"))


def viewer(report: Row) -> str:
    """One site's report as a page of its own, every value escaped; the first eight addresses of a finding."""
    told = lambda x: escape(str("not assessed" if x is None else x))
    rows = "".join(f"<tr><td>{told(d)}</td><td>{told(s)}</td></tr>" for d, s in sorted((report.dimensions or {}).items()))
    found = "".join(f"<section><h2>{told(x.finding_id)} {told(x.check)}</h2><p>{told(x.severity)}, priority {told(x.priority)} ({told(x.priority_score)}), {told(x.affected)} affected</p><ul>{''.join(f'<li>{told(u)}</li>' for u in x.urls[:8])}</ul></section>" for x in report.findings)
    return f"<!doctype html><html lang=en><head><meta charset=utf-8><title>{told(report.site)}</title></head><body><main><h1>{told(report.site)}: {told(report.overall)}</h1><table>{rows}</table>{found}</main></body></html>"
