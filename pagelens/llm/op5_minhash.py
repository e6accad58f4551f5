"""Document fingerprints by MinHash.

The distinct five-word shingles of a text go through ``PERMUTATIONS`` multiply-shift universal hash functions, in numpy for
all texts of a block at once; the least value of each is a component of the fingerprint (16 bits of it, in hex). The share of
equal components estimates the Jaccard similarity. ``near_duplicates`` joins bands of the signature in Spark and verifies
each candidate's exact Jaccard; equal shingle sets are one class beforehand. A band's bucket first links each class to the
least class of another component only, round by round, so that large groups cost no square number of pairs; all pairs of
classes that share a bucket and are still in different components are compared afterwards, in blocks. The registered query
carries each document's group of near duplicates beside the fingerprints.

Cases: a null text is empty; an empty text has the fingerprint of no shingle (every minimum at its maximum), which is
like itself only and in no group but its own; a text of fewer than five words is one shingle; rows with equal ids follow each
other in text order, a null id comes last; the next document of a single row is itself; an id that is no whole number is an
error where documents are compared with the next one; an empty table gives an empty one; the results carry the id and their
own columns only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm import graph, op4_jaccard
from pagelens.llm import words as W
from pagelens.session import cut, discard, prepare, release, stored, table

WORDS = 5
PERMUTATIONS = 128
SEED = 5
#: Rows a range partition of the ordered pass should hold, about, and most ranges: what the driver holds of each is two numbers.
RANGE_ROWS, MOST_RANGES = 8_000, 20_000
BANDS, ROWS, PERCENT = 25, 5, 80
#: Tasks that share the rows of one band's bucket when they meet its ends.
SALTS = 16
#: Rounds in which each class of a bucket is compared with one of another component, before all that remain are.
STAR_ROUNDS = 2


def permutations(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of n permutations h(x) = a x + b mod 2^32 of 32-bit shingle hashes."""
    draw = np.random.Generator(np.random.PCG64(seed))
    a = draw.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
    return a, draw.integers(0, 1 << 32, n, dtype=np.uint32)


def signatures(block: W.Block, a: np.ndarray, b: np.ndarray, k: int = WORDS) -> np.ndarray:
    """uint16 matrix: a row for each text of the block. Repeated shingles change no minimum, so they need not be told apart."""
    w, docs = W.words(block), len(block.offsets) - 1
    h, at = W.grams(w.hash, w.doc, k)
    doc = w.doc[at]
    short = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < k))
    if len(short):
        with np.errstate(over="ignore"):
            own = [W.mix(np.array([sum((x * W.U(W._STEP[j]) for j, x in enumerate(w.hash[w.first[i] : w.first[i + 1]])), W.U(0)) + W.U(1000)])) for i in short]
        h, doc = np.concatenate([h, *own]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    out = np.full((len(a), docs), (1 << 32) - 1, np.uint32)
    if len(h):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        rows, x = doc[first], (h >> W.U(32)).astype(np.uint32)
        y = np.empty_like(x)
        with np.errstate(over="ignore"):
            for j in range(len(a)):
                np.multiply(x, a[j], out=y)
                np.add(y, b[j], out=y)
                out[j, rows] = np.minimum.reduceat(y, first)
    # Of the 32-bit minimum 16 mixed bits are kept: unequal minima meet by chance once in 65,536.
    return (W.mix(np.ascontiguousarray(out.T).astype(np.uint64)) >> W.U(48)).astype(np.uint16)


def hexed(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, n: int = PERMUTATIONS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, fingerprint string) of every row."""
    prepare(docs.sparkSession)
    a, b = permutations(n)

    def run(batches):
        for batch in batches:
            for block in W.blocks(batch.column(1)):
                ids = batch.column(0).slice(block.row, len(block.offsets) - 1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(map(hexed, signatures(block, a, b)), pa.string())], [id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fingerprint string")


def _text_block(texts: list[str]) -> list[W.Block]:
    return list(W.blocks(pa.array(texts, pa.large_string())))


def compare_with_next(docs: DataFrame, n: int = PERMUTATIONS, text_col: str = "text", id_col: str = "doc_id", groups: DataFrame | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and of the next text in descending order of ids.

    Ids alone fix range bounds (at most ``MOST_RANGES``); each row goes to its range, and a range's first row also to the range
    before it, so one shuffle of the texts puts every row beside its successor. Ranges are read in order, two rows at a time
    and no more. groups: (id, node, component_id) of documents whose group is not their own id alone; they travel with the
    texts, and the result then has ``component_id`` as well."""
    spark = prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"the order of documents needs whole numbers as ids, not {kind}")
    a, b = permutations(n)
    grouped = groups is not None
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.count()
    ranges = min(MOST_RANGES, max(1, -(-total // RANGE_ROWS)))
    probes = [i / ranges for i in range(1, ranges)]
    bounds = rows.approxQuantile("id", probes, 0.1 / ranges) if probes else []
    # Ranges run in the order of the result: the highest ids first, null ids in the last.
    up = np.array(sorted({int(x) for x in bounds}), np.int64)

    def place(batches):
        for batch in batches:
            ids = batch.column(0)
            part = len(up) - np.searchsorted(up, ids.fill_null(0).to_numpy(zero_copy_only=False), "left")
            part[ids.is_null().to_numpy(zero_copy_only=False)] = len(up)
            yield pa.RecordBatch.from_arrays([ids, pa.array(part, pa.int32())], ["id", "part"])

    heads = {r.part: r.top for r in rows.select("id").mapInArrow(place, "id long, part int").groupBy("part").agg(F.max("id").alias("top")).collect()}
    order = sorted(heads)
    # The first row of a range succeeds the last row of the range before; the last range is followed by the first.
    before = {p: order[i - 1] for i, p in enumerate(order)}

    def send(batches):
        for batch in batches:
            (placed,) = place([batch])
            part, ids = placed.column(1).to_pylist(), batch.column(0).to_pylist()
            lead = [i for i, (x, p) in enumerate(zip(ids, part, strict=True)) if heads[p] == x]
            for at, to, helper in ((range(len(ids)), part, False), (lead, [before[part[i]] for i in lead], True)):
                taken = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(to, pa.int32()), pa.array([helper] * len(taken), pa.bool_())], ["id", "text", "part", "helper"])

    nothing = F.lit(None).cast("long")
    rows = rows.mapInArrow(send, "id long, text string, part int, helper boolean").withColumns({"node": nothing, "component": nothing})
    if grouped:
        placed = groups.select(F.col("id").cast("long"), "node", F.col("component_id").cast("long").alias("component")).mapInArrow(
            lambda batches: (pa.RecordBatch.from_arrays([*x.columns, next(place([x])).column(1)], ["id", "node", "component", "part"]) for x in batches), "id long, node long, component long, part int"
        )
        rows = rows.unionByName(placed.select("id", F.lit(None).cast("string").alias("text"), "part", F.lit(False).alias("helper"), "node", "component"))
    rows = rows.repartitionById(max(1, len(up) + 1), F.col("part")).sortWithinPartitions("part", "helper", F.col("id").desc_nulls_last(), F.col("text").asc_nulls_first())

    def close(pending: list[tuple], following: str):
        """Rows whose successors are known, as a batch; pending: (id, text, groups of that id)."""
        texts = [t for _, t, _ in pending]
        nexts = [*texts[1:], following]
        changed = [edited(t, f) for t, f in zip(texts, nexts, strict=True)]
        own = np.concatenate([signatures(x, a, b) for x in _text_block([*texts, following])])
        new = np.concatenate([signatures(x, a, b) for x in _text_block(changed)])
        likeness = lambda x, y: (x == y).mean(axis=1)
        columns = [
            pa.array([i for i, _, _ in pending], pa.int64()),
            pa.array(map(len, texts), pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array(map(hexed, own[:-1]), pa.string()),
            pa.array(map(hexed, new), pa.string()),
            pa.array(likeness(own[:-1], new), pa.float64()),
            pa.array(likeness(own[:-1], own[1:]), pa.float64()),
        ]
        if grouped:
            columns.append(pa.array([i if not known else known.get(_node(t), i) for i, t, known in pending], pa.int64()))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        part, pending, held = None, [], 0
        skip = False
        at, known = None, {}
        for batch in batches:
            for i, text, p, is_helper, node, component in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is None:  # groups of an id come before its texts
                    if at != (p, i):
                        at, known = (p, i), {}
                    known[node] = component
                    continue
                if p != part:
                    part, skip = p, False
                if skip:
                    continue
                if is_helper:  # the first helper row in order is the successor of the range's last row
                    skip = True
                    if pending:
                        yield close(pending, text)
                    pending, held = [], 0
                    continue
                if held > W.BLOCK:
                    yield close(pending, text)
                    pending, held = [], 0
                pending.append((i, text, known if at == (p, i) else None))
                held += len(text)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", *(["component_id"] if grouped else [])]
    out = rows.mapInArrow(run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double" + (", component_id long" if grouped else ""))
    return out if kind == "bigint" else out.withColumns({c: F.col(c).cast(kind) for c in names if c in (id_col, "component_id")})


# --- near duplicates ------------------------------------------------------------------------------------------------------


def _node(text: str, k: int = WORDS) -> int | None:
    """The class of a text's lower-cased shingle set."""
    (block,) = _text_block([text])
    (found,) = W.shingle_sets(W.words(block, lower=True), 1, k)
    return op4_jaccard._class(found) if len(found) else None


def band_keys(docs: DataFrame, bands: int, rows: int, k: int, text_col: str) -> DataFrame:
    """(key, node): the bands of each class's signature, once per task that meets the class."""
    a, b = permutations(bands * rows)
    number = np.arange(bands, dtype=np.uint64) * W.U(0x9E3779B97F4A7C15)

    def run(batches):
        met = set()
        for batch in batches:
            for block in W.blocks(batch.column(0)):
                low = W.Block(block.row, W.LOWER[block.data], block.offsets)
                sets = W.shingle_sets(W.words(low), len(block.offsets) - 1, k)
                nodes = [op4_jaccard._class(s) if len(s) else None for s in sets]
                some = [i for i, x in enumerate(nodes) if x is not None and x not in met and not met.add(x)]
                if not some:
                    continue
                parts = signatures(low, a, b, k)[some].reshape(len(some), bands, rows).astype(np.uint64)
                with np.errstate(over="ignore"):
                    key = number[None, :].repeat(len(some), 0)
                    for j in range(rows):
                        key = W.mix(key * W.U(0xC2B2AE3D27D4EB4F) + parts[:, :, j] + W.U(1))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(np.array([nodes[i] for i in some], np.int64), bands))], ["key", "node"])

    return docs.select(text_col).mapInArrow(run, "key long, node long")


def groups_of(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, k: int = WORDS, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(found: (id, n_shingles, node, sketch) of every row; (node, component_id) of classes in a group of two documents or more).

    Classes that share a band's bucket are compared unless links join them already, and verified exactly on shingle sets."""
    prepare(docs.sparkSession)
    found = cut(op4_jaccard.classes(docs, k, percent, text_col, id_col))
    one = op4_jaccard.class_table(found, id_col)
    keyed = stored(band_keys(docs, bands, rows, k, text_col))

    def live(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
        """Rows (key, node, comp, star) of buckets of several components, with the node that a star links each to.

        Buckets are counted by aggregation and their rows dealt by salt, so a group of very many classes is in no one task."""
        rows = rows.select("key", "node")
        rows = rows.withColumn("comp", F.col("node")) if comps is None else rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        who = F.struct("comp", "node")
        ends = rows.groupBy("key").agg(F.min(who).alias("low"), F.max(who).alias("high")).filter("low.comp <> high.comp")
        ends = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(ends, ["key", "salt"])
        return cut(rows.select("key", "node", "comp", F.when(F.col("low.comp") != F.col("comp"), F.col("low.node")).otherwise(F.col("high.node")).alias("star")))

    def verified(pairs: DataFrame) -> DataFrame:
        near = cut(op4_jaccard.sketches_allow(pairs, one, percent))
        nodes = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
        sets = stored(op4_jaccard.shingles_of(docs, nodes, one, k, text_col, id_col, graph.short))
        links = cut(graph.verified(near, sets, percent, graph.long))
        discard(sets)
        return links

    tried = comps = None
    left = live(keyed, None)
    discard(keyed)
    for _ in range(STAR_ROUNDS):
        stars = left.select(F.least("node", "star").alias("a"), F.greatest("node", "star").alias("b")).distinct()
        stars = cut(stars.join(tried, ["a", "b"], "left_anti") if tried is not None else stars)
        new = verified(stars)
        tried = stars if tried is None else tried.unionByName(stars)
        if not new.limit(1).count():
            break
        comps = graph.components(new if comps is None else op4_jaccard.tied(comps).unionByName(new))
        left = live(left, comps)
    every = left.select("key", "node", F.lit(op4_jaccard.INDEX | op4_jaccard.PROBE).cast("byte").alias("role"), "comp").distinct()
    rest = cut(op4_jaccard.remaining_pairs(every, one, percent).join(tried, ["a", "b"], "left_anti"))
    last = verified(rest)
    linked = graph.components(last if comps is None else op4_jaccard.tied(comps).unionByName(last))
    return found, op4_jaccard.component_ids(one, linked)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, k: int = WORDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, component_id: the least id of the group of near duplicates, its own id where it has none) of every row."""
    found, groups = groups_of(docs, percent, bands, rows, k, text_col, id_col)
    joined = op4_jaccard.with_component(found, groups, id_col)
    return joined.select(id_col, F.coalesce("component_id", id_col).alias("component_id"))


def fingerprint_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The columns of ``compare_with_next`` and each document's group of near duplicates: bands joined, Jaccard verified."""
    found, groups = groups_of(docs, text_col=text_col, id_col=id_col)
    members = op4_jaccard.with_component(found, groups, id_col).filter("component_id is not null")
    members = cut(members.select(F.col(id_col).alias("id"), "node", "component_id"))
    del found, groups
    release(docs.sparkSession)  # what the groups were found by is not needed while the texts are shuffled
    return compare_with_next(docs, PERMUTATIONS, text_col, id_col, members)


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
