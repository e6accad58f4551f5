"""N-gram Jaccard join by universe partitioning.

Equal shingle sets are one class. For classes r no larger than s, Jaccard >= p % bounds the symmetric difference by
H = (100 - p)(|r| + |s|) / (100 + p). Sizes fall into bands whose bounds grow by 100 / p, so partners are in the same band or
the next. The universe of shingles is hashed into m = H + 1 segments per band. Every class indexes its subset of each segment
(in its own band and, where a partner can be there, in the next), and in a pool of segments also the subset's one-deletion
neighbours. A class probes with thresholds -1, 0 or 1 per segment: by the pigeonhole principle any choice with
sum(threshold + 1) > H finds every partner. The choice is made by cost: small subsets collide often, an empty one with all, so
the dearest segments are left out and pool segments take one deletion instead. Keys are 64-bit sums, so a deletion is a
subtraction. The cost takes shingles that are common in a bounded sample of documents as no help; it decides where to probe,
never what is found. Candidates pass odd sketches (the popcount of two sketches' XOR never exceeds the symmetric difference,
so a pair beyond its bound is surely no link) and are then verified on the whole sets.

Large groups: the classes of a key are first compared with one class of another component only, round by round; all pairs of
components that are still different are compared afterwards, so a group of near copies costs in proportion to its size, and no link between components is lost.

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a text of fewer words than a
shingle is one shingle; repeated rows are equal sets; rows with equal ids count as one document with several texts; null ids
take part and are ignored by the least id; an empty table gives an empty one; the results carry the id and their own columns.
Sets and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm import words as W
from pagelens.llm.graph import components, if_small, salted_join, verified
from pagelens.session import cut, prepare, table

WORDS, PERCENT = 4, 85
#: One segment in so many (one at least) belongs to the pool that also indexes one-deletion neighbours.
POOL = 32
#: A subset of k shingles is taken to collide with THIN^-k of the classes of its band.
THIN = 4.0
#: Documents sampled for common shingles, and how many of them a shingle must be in. Cost estimates only.
COMMON_SAMPLE, COMMON_TIMES, COMMON_MOST = 2_000, 3, 200_000
INDEX, PROBE = 1, 2
#: Rounds in which each entry of a key is compared with one of another component, before all that remain are.
STAR_ROUNDS = 4
#: Entries of a key that are compared with as many others at once, about.
BLOCK = 512


class Scheme:
    """Bands and segment numbers for a percentage."""

    def __init__(self, percent: int = PERCENT, longest: int = 1 << 28):
        self.percent = percent
        self.low = [max(1, -(-percent // (100 - percent)))]
        while self.low[-1] < longest:
            self.low.append(max(self.low[-1] + 1, -(-100 * self.low[-1] // percent)))

    def difference(self, n: int) -> int:
        """Most symmetric difference of a class of n shingles with a partner no larger."""
        return (100 - self.percent) * 2 * n // (100 + self.percent)

    def segments(self, band: int) -> int:
        return self.difference(self.low[band + 1] - 1) + 1

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, "right")) - 1


def allocate(counts: np.ndarray, common: np.ndarray, need: int, pool: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments probed exactly and with one deletion: credits (1 and 2) of at least ``need`` at the least cost."""
    rare = np.minimum(counts - common, 60)
    cost = THIN ** -(rare + 0.25 * np.minimum(common, 4))
    order = np.argsort(cost, kind="stable")
    exact, wide = list(order[:need]), []
    extra = cost * (1 + rare * THIN + common)  # deletions of the prober's subset and of the partner's
    for i in sorted(range(min(pool, len(counts))), key=lambda i: extra[i]):
        if len(exact) < 2 or i not in exact:
            continue
        worst = next(x for x in reversed(exact) if x != i)
        if extra[i] < cost[worst]:
            exact.remove(i), exact.remove(worst)
            wide.append(i)
    return np.array(exact, np.int64), np.array(wide, np.int64)


def keys_of(shingles: np.ndarray, scheme: Scheme, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, role) of a class. A key belongs to index entries of one kind (whole subsets, or subsets less a shingle) and to the probes that such entries can answer."""
    n = len(shingles)
    if n < scheme.low[0]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8)
    own = scheme.band(n)
    keys, roles = [], []
    known = np.zeros(n, bool)
    if len(common):
        at = np.searchsorted(common, shingles)
        at[at == len(common)] = 0
        known = common[at] == shingles
    for band in (own, own + 1):
        if band > own and scheme.percent * scheme.low[band] > 100 * n:
            continue
        m = scheme.segments(band)
        pool = max(1, m // POOL)
        with np.errstate(over="ignore"):
            g = W.mix(shingles + W.U(band + 1) * W.U(0x9E3779B97F4A7C15))
            segment = ((g >> W.U(32)) * W.U(m)) >> W.U(32)
            order = np.argsort(segment, kind="stable")
            segment, value = segment[order].astype(np.int64), W.mix(g[order] + W.U(77))
            edge = np.searchsorted(segment, np.arange(m + 1))
            running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
            total = running[edge[1:]] - running[edge[:-1]]
            salt = W.mix(np.arange(m, dtype=np.uint64) + W.U(band << 32))
            whole = W.mix(total + salt)
            fewer = edge[pool]
            less_total = total[segment[:fewer]] - value[:fewer] + salt[segment[:fewer]]
            kind = W.U(0x2545F4914F6CDD1D)
            keys += [whole, W.mix(less_total + kind)]
            role = np.full(m, INDEX, np.int8)
            roles += [role, np.full(fewer, INDEX, np.int8)]
            if band == own and scheme.difference(n):
                exact, wide = allocate(np.diff(edge), np.bincount(segment[known[order]], minlength=m), scheme.difference(n) + 1, pool)
                role[exact] |= PROBE
                role[wide] |= PROBE
                # One deletion either way: subsets less a shingle that are indexed, and indexed subsets that are less a shingle of this.
                keys += [W.mix(total[wide] + salt[wide] + kind), W.mix(less_total[np.isin(segment[:fewer], wide)])]
                roles += [np.full(len(wide), PROBE, np.int8), np.full(len(keys[-1]), PROBE, np.int8)]
    return np.concatenate(keys), np.concatenate(roles)


def odd_sketch(shingles: np.ndarray, scheme: Scheme) -> bytes:
    """Parity bits of the set, about sixteen for each difference that a partner may have; a power of two, at least 64."""
    bits = 64
    n = len(shingles)
    while bits < 16 * (scheme.difference(n) + 1):
        bits *= 2
    at = W.mix(shingles + W.U(0x1234567)) & W.U(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def sketches_allow(pairs: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sizes and odd sketches do not rule out. one: as ``class_table`` gives it."""

    def run(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True):
                most = (100 - percent) * (n + m) // (100 + percent)
                if abs(n - m) > most:
                    keep.append(False)
                    continue
                if len(x) > len(y):
                    x, y = y, x
                x, y = (np.frombuffer(v, np.uint64) for v in (x, y))
                while len(y) > len(x):  # the shorter sketch of the longer one's set: bit positions modulo its size
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                keep.append(int(np.bitwise_count(x ^ y).sum()) <= most)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = one.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    right = one.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return joined.mapInArrow(run, "a long, b long")


def _class(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = np.add.reduce(W.mix(shingles + W.U(3))) + W.U(len(shingles)) * W.U(0xD6E8FEB86659FD93)
    return int(W.mix(np.array([total], np.uint64)).view(np.int64)[0])


def _sets(batches, k: int, text_at: int):
    """(batch, row, sorted distinct shingles) of every row."""
    for batch in batches:
        for block in W.blocks(batch.column(text_at)):
            docs = len(block.offsets) - 1
            for i, s in enumerate(W.shingle_sets(W.words(block, lower=True), docs, k)):
                yield batch, block.row + i, s


def classes(docs: DataFrame, k: int, percent: int, text_col: str, id_col: str) -> DataFrame:
    """(id_col, n_shingles, node, sketch): the set's size, the class (null for an empty set) and its odd sketch."""

    def run(batches):
        scheme = Scheme(percent)
        for batch in batches:
            size, node, sketch = [], [], []
            for _, _, s in _sets([batch], k, 1):
                size.append(len(s)), node.append(_class(s) if len(s) else None), sketch.append(odd_sketch(s, scheme) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary())], [id_col, "n_shingles", "node", "sketch"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_shingles long, node long, sketch binary")


def tied(comps: DataFrame) -> DataFrame:
    """(a, b): a link of each class to its component, which stands for all the links found so far."""
    return comps.filter("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))


def class_table(found: DataFrame, id_col: str) -> DataFrame:
    """(node, n: shingles, sketch, __least: least id, __rows) of every class, checkpointed: rows of a class meet by partial aggregation, once."""
    some = found.filter("node is not null").groupBy("node")
    return cut(some.agg(F.first("n_shingles").alias("n"), F.max("sketch").alias("sketch"), F.min(id_col).alias("__least"), F.count("*").alias("__rows")))


def common_shingles(docs: DataFrame, one: DataFrame, k: int, text_col: str, id_col: str) -> np.ndarray:
    """Sorted hashes of shingles that several documents of a bounded sample share (at most ``COMMON_MOST``)."""
    ids = one.orderBy("node").limit(COMMON_SAMPLE).select(F.col("__least").alias("__rep"))

    def run(batches):
        for _, _, s in _sets(batches, k, 0):
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["shingle"])

    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(ids), F.col("__id") == F.col("__rep"), "left_semi").select("__text")
    shared = texts.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_TIMES)
    got = shared.orderBy(F.desc("n"), "shingle").limit(COMMON_MOST).select("shingle").toArrow().column(0).to_numpy()
    return np.sort(got.astype(np.int64).view(np.uint64))


def index_rows(docs: DataFrame, k: int, percent: int, text_col: str, common: np.ndarray) -> DataFrame:
    """(key, node, role) of every class, once per task that meets it."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        scheme, met = Scheme(percent), set()
        out, held = [], 0

        def flush():
            keys = np.concatenate([x[0] for x in out]).view(np.int64)
            nodes = np.repeat(np.array([x[2] for x in out], np.int64), [len(x[0]) for x in out])
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes), pa.array(np.concatenate([x[1] for x in out]))], ["key", "node", "role"])

        for _, _, s in _sets(batches, k, 0):
            if len(s) < scheme.low[0] or (node := _class(s)) in met:
                continue
            met.add(node)
            out.append((*keys_of(s, scheme, shared.value), node))
            held += len(out[-1][0])
            if held > 200_000:
                yield flush()
                out, held = [], 0
        if out:
            yield flush()

    return docs.select(text_col).mapInArrow(run, "key long, node long, role byte")


def shingles_of(docs: DataFrame, nodes: DataFrame, one: DataFrame, k: int, text_col: str, id_col: str, pack=np.ndarray.tobytes) -> DataFrame:
    """(node, shingles, as ``pack`` writes them) of the given classes, read again from one document of each."""
    spark = docs.sparkSession
    reps = cut(one.join(nodes, "node", "left_semi").select(F.col("__least").alias("__rep")).distinct())

    def run(batches):
        for batch in batches:
            rows = [(_class(s), pack(s)) for _, _, s in _sets([batch], k, 0) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())], ["node", "shingles"])

    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(if_small(reps), F.col("__id").eqNullSafe(F.col("__rep")), "left_semi")
    sets = prepare(spark) and chosen.select("__text").mapInArrow(run, "node long, shingles binary")
    # Only rows with repeated ids can bring a class twice.
    return sets.groupBy("node").agg(F.first("shingles").alias("shingles"))


def remaining_pairs(rows: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components that meet in a key and that sizes and sketches allow.

    rows: (key, node, role, comp). The entries of a key are dealt into blocks; blocks are compared with blocks as matrices, so
    a key of many entries that are alike but not linked yields its few survivors and never the list of its pairs."""

    many = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocks = rows.join(many, "key").join(one.select("node", "n", "sketch"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    blocks = blocks.groupBy("key", "block").agg(F.collect_list(F.struct("node", "role", "comp", "n", "sketch")).alias("entries"))
    blocks = cut(blocks)

    def arrays(entries: pa.StructScalar):
        flat = entries.values
        node, role, comp, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("node", "role", "comp", "n"))
        return node, role, comp, n, flat.field("sketch").to_pylist()

    def folded(sketches: list[bytes], size: int) -> np.ndarray:
        out = np.zeros((len(sketches), size // 8), np.uint64)
        for i, x in enumerate(sketches):
            x = np.frombuffer(x, np.uint64)
            while len(x) > size // 8:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            out[i] = x
        return out

    def run(batches):
        met: list[np.ndarray] = []  # a pair meets in many keys; a task tells it once
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                node, role, comp, n, sketch = arrays(left)
                node2, role2, comp2, n2, sketch2 = arrays(right)
                size = min(map(len, [*sketch, *sketch2]))
                x, y = folded(sketch, size), folded(sketch2, size)
                a, b = [], []
                for i in range(len(node)):
                    most = (100 - percent) * (n[i] + n2) // (100 + percent)
                    able = ((role[i] & INDEX > 0) & (role2 & PROBE > 0)) | ((role[i] & PROBE > 0) & (role2 & INDEX > 0))
                    at = np.flatnonzero(able & (comp2 != comp[i]) & (np.abs(n2 - n[i]) <= most))
                    at = at[np.bitwise_count(x[i] ^ y[at]).sum(axis=1) <= most[at]]
                    a.append(np.minimum(node[i], node2[at])), b.append(np.maximum(node[i], node2[at]))
                met.append(np.unique(np.stack([np.concatenate(a), np.concatenate(b)]).astype(np.int64), axis=1))
                if sum(x.shape[1] for x in met) > 500_000:
                    met = [np.unique(np.concatenate(met, axis=1), axis=1)]
                    if met[0].shape[1] > 250_000:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, met.pop())), ["a", "b"])
        if met:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, np.unique(np.concatenate(met, axis=1), axis=1))), ["a", "b"])

    left = blocks.select("key", F.col("block").alias("x"), F.col("entries").alias("left"))
    right = blocks.select("key", F.col("block").alias("y"), F.col("entries").alias("right"))
    return left.join(right, "key").filter("x <= y").select("left", "right").mapInArrow(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_shingles, component_id: the least id reachable by links) of every row."""
    prepare(docs.sparkSession)
    found = cut(classes(docs, k, percent, text_col, id_col))
    one = class_table(found, id_col)
    key = Window.partitionBy("key")
    is_index, is_probe = (F.col("role").bitwiseAND(F.lit(bit).cast("byte")) != 0 for bit in (INDEX, PROBE))

    def live(rows: DataFrame) -> DataFrame:
        """Rows (key, node, role, comp) of keys where an index entry meets a probe of another component, with the node that a star links it to."""
        who = F.struct("comp", "node")
        ends = {f"{side}_{f.__name__}": f(F.when(cond, who)).over(key) for side, cond in (("index", is_index), ("probe", is_probe)) for f in (F.min, F.max)}
        rows = rows.withColumns(ends).filter("least(index_min.comp, probe_min.comp) <> greatest(index_max.comp, probe_max.comp)")
        other = lambda side, cond: F.when(cond & (F.col(f"{side}_min.comp") != F.col("comp")), F.col(f"{side}_min.node")).when(cond & (F.col(f"{side}_max.comp") != F.col("comp")), F.col(f"{side}_max.node"))
        rows = rows.withColumn("star", F.coalesce(other("index", is_probe), other("probe", is_index)))
        return rows.filter("star is not null").select("key", "node", "role", "star")

    buckets = cut(live(index_rows(docs, k, percent, text_col, common_shingles(docs, one, k, text_col, id_col)).withColumn("comp", F.col("node"))))

    def linked(pairs: DataFrame) -> DataFrame:
        near = cut(sketches_allow(pairs, one, percent))
        nodes = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
        return cut(verified(near, cut(shingles_of(docs, nodes, one, k, text_col, id_col)), percent))

    tried = comps = None
    rows = buckets
    for _ in range(STAR_ROUNDS):
        stars = rows.select(F.least("node", "star").alias("a"), F.greatest("node", "star").alias("b")).distinct()
        stars = cut(stars.join(tried, ["a", "b"], "left_anti") if tried is not None else stars)
        new = linked(stars)
        tried = stars if tried is None else tried.unionByName(stars)
        if not new.limit(1).count():
            break
        comps = components(new if comps is None else tied(comps).unionByName(new))
        rows = buckets.select("key", "node", "role").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        rows = cut(live(rows))
    # What is left: every pair of different components that meets in a key and was not compared.
    rows = rows.select("key", "node", "role").distinct()
    rows = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")) if comps is not None else rows.withColumn("comp", F.col("node"))
    rows = cut(rows)
    last = linked(cut(remaining_pairs(rows, one, percent).join(tried, ["a", "b"], "left_anti")))
    final = components(last if comps is None else tied(comps).unionByName(last))

    out = with_component(found, component_ids(one, final), id_col)
    return out.select(id_col, "n_shingles", F.coalesce("component_id", id_col).alias("component_id"))


def jaccard_links(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The whole join: (every verified link (a, b) between different classes, a < b; membership (id_col, n_shingles, node) of every row).

    Unlike the components, links inside a group are all compared: a group of n near copies with different sets has up to
    n (n - 1) / 2 of them. They are found in blocks, so no task holds a group."""
    prepare(docs.sparkSession)
    found = cut(classes(docs, k, percent, text_col, id_col))
    one = class_table(found, id_col)
    rows = index_rows(docs, k, percent, text_col, common_shingles(docs, one, k, text_col, id_col)).withColumn("comp", F.col("node"))
    pairs = cut(remaining_pairs(cut(rows.distinct()), one, percent))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return cut(verified(pairs, cut(shingles_of(docs, nodes, one, k, text_col, id_col)), percent)), found.select(id_col, "n_shingles", "node")


def component_ids(one: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, component_id: least id, n: rows) of the classes whose component has two rows or more, checkpointed. linked: (node, comp)."""
    nodes = one.select("node", "__least", F.col("__rows").alias("n"))
    nodes = cut(nodes.join(linked, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    # The classes of a large component are dealt over tasks when they meet its least id.
    least = nodes.groupBy("comp").agg(F.min("__least").alias("component_id"), F.sum("n").alias("__rows"), F.count("*").alias("n")).filter("__rows > 1")
    least = cut(least)
    return cut(salted_join(nodes.select("node", "n", "comp"), least.drop("n", "__rows"), "comp", least.select("comp", "n"), F.col("node")).select("node", "component_id", "n"))


def with_component(found: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """``found`` with ``component_id`` (null where the row is in no group). The rows of a class with very many copies are dealt over tasks."""
    rows = found.select(id_col, "n_shingles", "node")
    return salted_join(rows, groups.select("node", "component_id"), "node", groups.select("node", "n"), F.xxhash64(id_col), "left")


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
