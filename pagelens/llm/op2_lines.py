"""Line dedup by distinct-site spread.

Every non-blank line (trimmed) is known by a 128-bit hash. One aggregation merges a HyperLogLog sketch of the sites per line;
a line whose estimate is clearly under the threshold stays, one clearly above is boilerplate, and lines near the threshold get
exact distinct counts. Boilerplate lines are removed from every document but their first carrier (least id, then position),
so no text vanishes from the corpus altogether; ``keep_first=False`` removes them everywhere.

Cases: a null text has no lines and stays null; a null site counts as no site; blank lines are never removed; a document that
repeats a row is treated row by row alike; equal ids with different texts are told apart; an empty table gives an empty one;
all columns of the input are kept, and helper columns carry the prefix ``__line_`` so they clash with none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.session import table

MIN_SITES = 6
#: Sketches have 2^LG_K buckets: relative error about 1.04 / 2^(LG_K / 2), 1.6 % at 12.
LG_K = 12
#: Estimates within this share of the threshold are counted exactly; many times the sketch's error.
NEAR = 0.25
#: Tasks that share the rows of one line when they meet its verdict; verdicts are copied as often, and are few.
SALTS = 32
_SPACE = "\t\n\x0b\f\r "


def line_table(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(__line_id, __line_text: the row's key; __line_pos, __line_site, __line_a, __line_b: the line's hash) for non-blank lines."""
    line = F.btrim("__line_raw", F.lit(_SPACE))
    rows = docs.select(
        F.col(id_col).alias("__line_id"),
        F.xxhash64(text_col).alias("__line_text"),
        F.col(site_col).cast("string").alias("__line_site"),
        F.posexplode(F.split(text_col, "\n", -1)).alias("__line_pos", "__line_raw"),
    )
    rows = rows.withColumn("__line_raw", line).filter("__line_raw <> ''")
    return rows.select("__line_id", "__line_text", "__line_pos", "__line_site", F.xxhash64("__line_raw").alias("__line_a"), F.xxhash64(F.lit(1), "__line_raw").alias("__line_b"))


def _salted(lines: DataFrame) -> DataFrame:
    return lines.withColumn("__line_salt", F.pmod(F.xxhash64("__line_id", "__line_text"), F.lit(SALTS)).cast("int"))


def _copied(verdicts: DataFrame) -> DataFrame:
    return verdicts.withColumn("__line_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """Hashes of the lines on at least ``min_sites`` sites, with their first carrier."""
    keys = ["__line_a", "__line_b"]
    spread = lines.groupBy(*keys).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("__line_site", lg_k)).alias("__line_sites"),
        F.min(F.struct("__line_id", "__line_text", "__line_pos")).alias("__line_first"),
    )
    spread = spread.filter(F.col("__line_sites") >= max(1, min_sites - max(1, near * min_sites)))
    doubtful = F.col("__line_sites") < min_sites + max(1, near * min_sites)
    exact = (
        _salted(lines)
        .join(_copied(spread.filter(doubtful).select(*keys)), [*keys, "__line_salt"], "left_semi")
        .filter("__line_site is not null")
        .groupBy(*keys, "__line_site")
        .agg(F.lit(1).alias("__line_one"))
        .groupBy(*keys)
        .agg(F.count("*").alias("__line_exact"))
    )
    judged = spread.join(exact, keys, "left")
    return judged.filter(F.when(doubtful, F.coalesce("__line_exact", F.lit(0))).otherwise(F.col("__line_sites")) >= min_sites).select(*keys, "__line_first")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", keep_first: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines gone from the text, plus ``n_lines`` and ``n_removed`` (of non-blank lines)."""
    lines = line_table(docs, id_col, text_col, site_col)
    bad = boilerplate(lines, min_sites)
    hit = _salted(lines).join(_copied(bad), ["__line_a", "__line_b", "__line_salt"])
    if keep_first:
        hit = hit.filter(~F.struct("__line_id", "__line_text", "__line_pos").eqNullSafe(F.col("__line_first")))
    gone = hit.groupBy("__line_id", "__line_text").agg(F.collect_set("__line_pos").alias("__line_gone"))
    gone = gone.withColumnsRenamed({"__line_id": "__line_gid", "__line_text": "__line_gtext"})
    out = docs.withColumn("__line_text", F.xxhash64(text_col)).join(gone, F.col(id_col).eqNullSafe(F.col("__line_gid")) & (F.col("__line_text") == F.col("__line_gtext")), "left")
    parts = F.split(text_col, "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("__line_gone", i)), "\n")
    return out.withColumns(
        {
            "n_lines": F.coalesce(F.size(F.filter(parts, lambda x: F.btrim(x, F.lit(_SPACE)) != "")), F.lit(0)).cast("long"),
            "n_removed": F.when(F.col("__line_gone").isNull(), 0).otherwise(F.size("__line_gone")).cast("long"),
            text_col: F.when(F.col("__line_gone").isNull(), F.col(text_col)).otherwise(kept),
        }
    ).drop("__line_text", "__line_gid", "__line_gtext", "__line_gone")


def op2_lines(spark, sf_dir: str) -> DataFrame:
    out = remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH parts AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
lines AS (SELECT *, regexp_replace(raw, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g') AS line FROM parts),
bad AS (SELECT line, min((doc_id, pos)) AS first FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
judged AS (SELECT l.*, b.line IS NOT NULL AND (l.doc_id, l.pos) <> b.first AS gone FROM lines l LEFT JOIN bad b USING (line))
SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
