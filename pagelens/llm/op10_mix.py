"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source group, language group, topic). A source or language that the targets do not name falls
into the group ``*``, so the number of cells is bounded by the targets' sizes and not by the data; only this table of cells
reaches the driver. Raking scales the cells' token weights to each marginal in turn until all of them hold; the inclusion
probability of a document is its cell's calibrated weight, scaled to the wanted share of all tokens and held at 1. The sample
keeps a document when a uniform hash of its id and the seed is under that probability: the same documents every time.

Cases: a null source or language is in ``*`` (or its own group if the targets name it as ``*null``); a null or empty text has
no tokens and follows its cell; target groups that have no tokens are left out and the others scaled to one; a group with
tokens that no target names is an error (a target of 0 leaves it out), and so are marginals that cannot all hold; repeated rows
share one fate, rows with a null id that of their text; an empty table gives an empty one; input columns are kept but for those
named as the results, which carry the prefix ``mix_``.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.session import table

#: Target shares of tokens. ``*`` is every group that is not named.
TARGETS = {
    "source": {"src0": 0.15, "*": 0.85},
    "lang": {"en": 0.50, "de": 0.18, "fr": 0.18, "es": 0.12, "*": 0.02},
    "topic": {"prose": 0.90, "listing": 0.04, "marked": 0.04, "shout": 0.02},
}
SHARE = 0.6
SEED = 20
MOST_CELLS = 100_000


def default_topic(text: Column) -> Column:
    """Shape of a text as its topic: a listing with bars, marked up with symbols, shouted, or prose."""
    n = F.greatest(F.length(text), F.lit(1))
    return (
        F.when(F.regexp_count(text, F.lit(r" \| ")) * 100 >= n, "listing")
        .when(F.regexp_count(text, F.lit(r"[#*$%&]{2,}")) * 50 >= n, "marked")
        .when(F.regexp_count(text, F.lit(r"!")) * 50 >= n, "shout")
        .otherwise("prose")
    )


def rake(cells: dict[tuple, float], targets: list[dict[str, float]], rounds: int = 2000, tolerance: float = 1e-9, most: float = 1e-4) -> dict[tuple, float]:
    """Calibrated weights: of the cells' shape, with every marginal at its target share (total 1).

    Raises ValueError where a group has no target, or where some marginal is still off by more than ``most`` at the end: empty
    cells can make marginals impossible to meet together."""
    names = [k for k, v in cells.items() if v > 0]
    if not names:
        return {}
    w = np.array([cells[k] for k in names], float)
    w /= w.sum()
    margins = []
    for d, target in enumerate(targets):
        present = sorted({k[d] for k in names})
        if missing := [g for g in present if g not in target]:
            raise ValueError(f"groups of marginal {d} without a target: {missing[:10]}")
        goal = np.array([target.get(g, 0.0) for g in present], float)
        if goal.sum() <= 0:
            raise ValueError(f"no group of marginal {d} has a target")
        margins.append((np.array([present.index(k[d]) for k in names]), goal / goal.sum()))
    for _ in range(rounds):
        worst = 0.0
        for at, goal in margins:
            now = np.bincount(at, w, len(goal))
            worst = max(worst, np.abs(now - goal).max())
            w *= np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[at]
        if worst < tolerance:
            break
    off = max(np.abs(np.bincount(at, w, len(goal)) - goal).max() for at, goal in margins)
    if not off <= most:
        raise ValueError(f"the marginals cannot all be met: one is off by {off:.2g}")
    return dict(zip(names, (w / w.sum()).tolist(), strict=True))


def probabilities(cells: dict[tuple, float], weights: dict[tuple, float], share: float) -> dict[tuple, float]:
    """min(1, scale * weight / tokens) for each cell, with the scale at which the expected tokens are ``share`` of all (or all that can be had)."""
    total = sum(cells.values())
    ratio = {k: w / cells[k] for k, w in weights.items()}
    want = share * total
    low, high = 0.0, total / min((r for r in ratio.values() if r > 0), default=1.0)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(cells[k] * min(1.0, mid * r) for k, r in ratio.items()) < want:
            low = mid
        else:
            high = mid
    return {k: min(1.0, high * r) for k, r in ratio.items()}


def group(column: str, target: dict[str, float]) -> Column:
    named = [k for k in target if k != "*"]
    value = F.coalesce(F.col(column).cast("string"), F.lit("*null"))
    return F.when(value.isin(named), value).otherwise("*") if named else F.lit("*")


def assign_cells(docs: DataFrame, targets: dict, topic: Column | None = None, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns(
        {
            "mix_source": group(source_col, targets["source"]),
            "mix_lang": group(lang_col, targets["lang"]),
            "mix_topic": topic if topic is not None else default_topic(text),
            "mix_tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
        }
    )


def mix_sources(docs: DataFrame, targets: dict = TARGETS, share: float = SHARE, seed: int = SEED, topic: Column | None = None, id_col: str = "doc_id", **columns) -> DataFrame:
    """The sampled rows of ``docs`` with ``mix_source``, ``mix_lang``, ``mix_topic``, ``mix_tokens``, ``mix_probability`` and ``mix_weight`` (the calibrated weight per token over the probability: weighted tokens meet the targets)."""
    keys = ["mix_source", "mix_lang", "mix_topic"]
    rows = assign_cells(docs, targets, topic, **columns)
    bound = (len(targets["source"]) + 1) * (len(targets["lang"]) + 1) * (len(targets["topic"]) + 1)
    if bound > MOST_CELLS:
        raise ValueError(f"the targets allow {bound} cells; at most {MOST_CELLS} are raked on the driver")
    found = rows.groupBy(*keys).agg(F.sum("mix_tokens").alias("n")).limit(bound + 1).collect()
    cells = {(r.mix_source, r.mix_lang, r.mix_topic): float(r.n) for r in found}
    if len(cells) > bound:
        raise ValueError("topics outside the targets")
    weights = rake(cells, [targets["source"], targets["lang"], targets["topic"]])
    chance = probabilities(cells, weights, share)
    total = sum(cells.values())
    # A chain of conditions over the bounded cells instead of a join: the plan stays one map over the documents.
    entries = [(F.lit("\u0001".join(k)), F.struct(F.lit(chance[k]).alias("p"), F.lit(weights[k] * total / cells[k]).alias("w"))) for k in sorted(chance)]
    cell = F.concat_ws("\u0001", *keys)
    lookup = F.create_map(*[x for e in entries for x in e])[cell] if entries else F.lit(None).cast("struct<p:double,w:double>")
    rows = rows.withColumn("__mix_cell", lookup)
    by_text = F.xxhash64(F.lit(seed), F.col(columns.get("text_col", "text")))
    identity = F.when(F.col(id_col).isNull(), by_text).otherwise(F.xxhash64(F.lit(seed), F.col(id_col)))
    uniform = F.shiftrightunsigned(identity, 11).cast("double") / float(1 << 53)
    # A cell without tokens has no weight to calibrate: its documents stay, as they change no marginal.
    rows = rows.withColumn("mix_probability", F.coalesce(F.col("__mix_cell.p"), F.lit(1.0)))
    rows = rows.withColumn("mix_weight", F.coalesce(F.col("__mix_cell.w"), F.lit(1.0)) / F.greatest("mix_probability", F.lit(1e-300)))
    return rows.filter(uniform < F.col("mix_probability")).drop("__mix_cell")


def op10_mix(spark, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens", F.round("mix_probability", 9).alias("mix_probability"), F.round("mix_weight", 9).alias("mix_weight"))
