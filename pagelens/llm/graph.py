"""Links between classes: exact verification of candidate pairs and connected components, without ever gathering a group in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.session import cut

#: A table of at most so many (id) rows, 16 bytes each, may be broadcast; beyond that it is joined by shuffle.
BROADCAST_ROWS = 500_000


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted size is within the bound, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: A key with more than one row in so many of a table is hot: there can be no more hot keys than this.
HOT_KEYS = 1_000


def salted_join(left: DataFrame, right: DataFrame, key: str, weights: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` by ``key``, with the left rows of hot keys dealt over several tasks and the right rows of these keys copied as often.

    weights: (key, n), the left rows of each key, or of each that can be hot. spread: a whole number that differs among the left rows of a key.
    The list of hot keys has ``HOT_KEYS`` rows at most (n of them reach the total over ``HOT_KEYS``), so it is small whatever the data."""
    total = weights.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    share = max(1, total // HOT_KEYS)
    hot = weights.filter(F.col("n") > share).select(key, F.least(F.ceil(F.col("n") / share), F.lit(HOT_KEYS)).cast("int").alias("__salts")).collect() if total > HOT_KEYS else []
    if not hot:
        return left.join(right, key, how)
    spark = left.sparkSession
    listed = F.broadcast(spark.createDataFrame(hot, f"`{key}` {dict(weights.dtypes)[key]}, __salts int"))
    salts = F.coalesce("__salts", F.lit(1))
    dealt = left.join(listed, key, "left").withColumn("__salt", F.pmod(spread, salts).cast("int")).drop("__salts")
    copied = right.join(listed, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt.join(copied, [key, "__salt"], how).drop("__salt")


#: So many links, 16 bytes each, are followed in one task; beyond that in rounds of shuffles.
SMALL_LINKS = 200_000


def _followed(batches):
    """(node, comp) of all links of one task: labels are lowered along links and then along themselves until none moves."""
    found = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if len(b)]
    if not found:
        return
    node, at = np.unique(np.concatenate(found, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(node))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[label])], ["node", "comp"])


def components(edges: DataFrame, small: int | None = None) -> DataFrame:
    """(node, comp): comp is the least node reachable. Few links are followed in one task; many by large-star and small-star rounds until nothing changes (a logarithmic number)."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if now.count() <= (SMALL_LINKS if small is None else small):
        return cut(now.coalesce(1).mapInArrow(_followed, "node long, comp long"))
    mark = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state.n == 0 or state == mark:
            break
        mark = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(least, "u")
        small_star = small_star.select("u", F.col("m").alias("v")).unionByName(small_star.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v")
        now = cut(small_star.distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def whole(shingles: bytes) -> np.ndarray:
    return np.frombuffer(shingles, np.uint64)


def short(shingles: np.ndarray) -> bytes:
    """The upper 40 bits of sorted hashes, five bytes each: enough to tell apart the shingles of two texts."""
    return shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def long(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.view(">u8").ravel().astype(np.uint64)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, read=whole) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union. sets: (node, shingles binary of sorted distinct hashes, as ``read`` takes them)."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = read(x), read(y)
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < percent * len(y):
                    keep.append(False)
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(run, "a long, b long")
