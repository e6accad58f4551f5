"""Plans and guards on small findings; every check has its words and a place."""

import pytest
from pyspark.sql import functions as F

from pagelens.functions import vocab as V
from pagelens.functions import wording
from pagelens.operators import reasoning as R

DDL = "site string, finding_id string, place int, check string, severity string, priority string, priority_score double, confidence double, reach double, affected long"
ROWS = [("a", f"F-{i + 1:03d}", i + 1, check, severity, "high", 0.5, 0.9, 0.4, i) for i, (check, severity) in enumerate([("site_unreachable", "critical"), ("missing_h1", "low"), ("thin_important_page", "medium"), ("sitemap_missing", "medium"), ("weak_navigation", "medium"), ("no_next_step", "medium")])]


def test_every_check_is_worded_and_staged():
    assert set(wording.TEXTS) == {c for c, *_ in V.CHECKS}
    staged = [c for checks in wording.STAGES.values() for c in checks]
    assert len(staged) == len(set(staged)) and set(staged) <= set(wording.TEXTS) and len(set(wording.TEXTS) - set(staged)) == 6
    assert set(R.STAGE_COST) == set(wording.STAGES) and all(len(s) >= 1 and t and why for t, why, s in wording.TEXTS.values())


def test_plans(spark):
    found = spark.createDataFrame([*ROWS, ("b", "F-001", 1, "freshness_risk", "low", "low", 0.1, 0.7, 0.5, 4)], DDL)
    rows = R.unchanged(found, R.enriched(found))
    got = {(r.site, r.finding_id): r for r in rows.collect()}
    assert got["a", "F-001"].depends_on == ["F-002", "F-003", "F-004"] and got["a", "F-005"].depends_on == ["F-006"] and got["a", "F-002"].phase == 3
    assert got["a", "F-002"].title == "1 important pages have no main heading" and got["a", "F-005"].stage is None and got["a", "F-006"].effort == "low"
    plan = {r.site: r for r in R.plans(rows).collect()}
    a = plan["a"]
    assert (a.findings, a.severities["medium"], a.stages, a.bottleneck) == (6, 4, {"discover": 4, "understand": 2}, "discover")
    assert [x.theme for x in a.themes] == ["reach", "meaning"] and [x.theme for x in plan["b"].themes] == ["standing"]
    assert [(x.phase, len(x.actions)) for x in a.roadmap] == [(1, 1), (2, 4), (3, 1)]
    assert R.plans(R.enriched(found.limit(0))).count() == 0


def test_changed_findings_are_told(spark):
    found = spark.createDataFrame(ROWS, DDL)
    with pytest.raises(ValueError, match="F-003"):
        R.unchanged(found, found.withColumn("severity", F.when(F.col("finding_id") == "F-003", "low").otherwise(F.col("severity"))))


def test_guards(spark):
    rows = [("See https://e.org/a/, https://bad.org/x. and https://schema.org/Product", ["https://e.org/a"]), ("14 of 16 pages, 3/4, 75%, 74.6 %, 12% and 2 out of 9", []), (None, None)]
    df = spark.createDataFrame(rows, "t string, known array<string>")
    got = df.select(R.grounded_text(F.col("t"), F.col("known")).alias("g")).collect()
    assert got[0].g == "See https://e.org/a/, [unverified URL]. and https://schema.org/Product" and got[2].g == ""
    known = F.array(*map(F.lit, ["14", "16", "75"]))
    assert df.select(R.measured_text(F.col("t"), known).alias("m")).collect()[1].m == "14 of 16 pages, [unverified count], 75%, 74.6 %, [unverified proportion] and [unverified count]"
    one = spark.range(1).select(
        R.numbers_of(F.lit("5.0 of 7"), F.lit("x12")).alias("n"), R.bounded_text(F.lit("  " + "y" * 1300)).alias("b"), R.one_of(F.lit(" HIGH"), ["low", "high"], "low").alias("o"), R.one_of(F.lit(None).cast("string"), ["low"], "low").alias("d"),
        R.bounded_list(F.array(*map(F.lit, [" a ", "", "z" * 500, *"bcdefghijklmn"]))).alias("l"),
    ).first()
    assert one.n == ["5.0", "7", "12", "5"] and len(one.b) == 1203 and (one.o, one.d) == ("high", "low") and one.l[:2] == ["a", "z" * 400] and len(one.l) == 11
