"""Language-model scoring by online logistic context mixing.

A text is its lower-cased words and an end mark; each token is spelt in bytes with a terminator, each byte in eight bits.
Five bit predictors count zeros and ones by context: the last byte, the last two, three and five bytes, and the whole spelling
so far. A logistic mixer combines their stretched probabilities; its weight set is gated by how much the two longest contexts
have seen and by the place in the token. An adaptive probability map refines the mix by the last byte. The sum of the bits'
logarithms is the spelling's probability.

Over the text a match model goes across words: after each word it foretells the word that followed the same word last in this
text, and its word is mixed with the spelling's probability by how often it has been right in the text so far, told apart by
whether it was right just before. So a text's score hangs on the order of its words, and passages that it repeats cost little.

Spark's part: texts become chunks of local token numbers and a vocabulary with training counts (one pass over the texts, one
written table); counts of all training tokens meet by word; words form packs by their hashes, whose number follows the words.
Packs are learned from in their order, so scores do not hang on how the tables are partitioned. A pack's entries (context, next byte) go to
shards by their 64-bit keys (56 bits of the context, 8 of the byte), whose number grows with the words; a shard adds up what
every distinct training word has, weighted by its count, and tells each pack the sums of its own entries and of their bit
nodes. So nothing is dropped, no two contexts share a slot and no table is held whole; mixer and map learn online, in mini-batches over all training words (each bit's own occurrence left out of the
counts it is predicted from), and the learners' weights are averaged; every distinct word is scored once, and scores return to
the chunks. Only the mixer's weights and the map, of fixed size, are broadcast.

Cases: a null or empty text is the end mark alone; a text of any length is scored whole; words of any length are spelt whole;
equal texts score alike; a null id is in the training fold; without training texts counts are zero and the predictors know
nothing; an empty table gives an empty one; the result carries the id and the operator's columns only.
"""

from __future__ import annotations

import ctypes
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm import words as W
from pagelens.session import discard, prepare, release, stored, table

#: Of each predictor, the slots (as powers of two) of ``Spelling.bits``, a small stand-in of the counts to try the mixer on. The model has no table of fixed size.
TABLE_BITS = (16, 18, 20, 20, 20)
#: From this predictor on the contexts are long.
LONG = 3
#: Bytes of words that a task learns from, about, and the least and most such tasks; their weights are averaged.
LEARNER_BYTES, LEARNERS = 2_000_000, (12, 512)
CHUNK_WORDS, CHUNK_TOKENS = 260_000, 2_000_000
BATCH_BYTES = 100_000
#: Bytes of words in a pack, and entries that a shard should hold, about.
PACK_BYTES, SHARD_ENTRIES = 500_000, 2_000_000
#: What the match model takes for granted before it has been tried: (right, tried) after a wrong word and after a right one.
TRIED = ((0.02, 1.0), (0.5, 1.0))
END = b"\n"
GATES = 2 * 4 * 4
RATE, LEAST = 0.05, 1e-6
_LOWER = bytes(W.LOWER.tolist())


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is not learned from: crc32 of the id as text, modulo 5, is 1. A null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


# --- chunks ---------------------------------------------------------------------------------------------------------------


def chunks(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """One row for some thousands of texts: ids, folds, sizes, token numbers (16 or 32 bits), the chunk's words and their training counts."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"chunk long, ids array<{kind}>, held array<boolean>, sizes array<int>, tokens binary, words array<binary>, counts array<int>"

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId() << 32, 0
        number, ids, held, tokens, sizes, total = {END: 0}, [], [], [], [], 0

        def flush():
            flat = np.concatenate(tokens)
            learned = np.concatenate([t for t, h in zip(tokens, held, strict=True) if not h] or [np.zeros(0, np.int32)])
            counts = np.bincount(learned, minlength=len(number)).astype(np.int32)
            # A text of more different words than numbers of 16 bits has its tokens in 32.
            packed = flat.astype(np.uint16 if len(number) <= 1 << 16 else np.uint32).tobytes()
            columns = [pa.array([task + made]), pa.array([ids], pa.list_(id_type)), pa.array([held]), pa.array([sizes], pa.list_(pa.int32())), pa.array([packed], pa.binary()), pa.array([list(number)], pa.list_(pa.binary())), pa.array([counts.tolist()], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "held", "sizes", "tokens", "words", "counts"])

        for batch in batches:
            id_type = batch.column(0).type
            for i, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = (text or "").encode().translate(_LOWER).split()
                if ids and (len(number) > CHUNK_WORDS or total > CHUNK_TOKENS):
                    yield flush()
                    made += 1
                    number, ids, held, tokens, sizes, total = {END: 0}, [], [], [], [], 0
                put = number.setdefault
                mine = np.array([put(x, len(number)) for x in found] + [0], np.int32)
                ids.append(i), held.append(h), tokens.append(mine), sizes.append(len(mine))
                total += len(mine)
        if ids:
            yield flush()

    return docs.select(F.col(id_col), F.col(text_col), held_out(id_col).alias("__held")).mapInArrow(run, schema)


# --- the model ------------------------------------------------------------------------------------------------------------


class Spelling:
    """The bytes of many words with the 64-bit number of each byte's context in every predictor."""

    def __init__(self, found: list[bytes]):
        size = np.fromiter(map(len, found), np.int64, len(found)) + 1
        data = np.frombuffer(b" ".join([*found, b""]), np.uint8)
        self.first = np.concatenate([[0], np.cumsum(size)[:-1]])
        self.word = np.repeat(np.arange(len(found)), size)
        self.byte = data.astype(np.uint32)
        place = np.arange(len(data)) - self.first[self.word]
        last = []
        for k in range(1, 6):
            b = np.zeros(len(data), np.uint64)
            b[k:] = data[:-k]
            b[place < k] = 0
            last.append(b)
        self.last, self.start = last[0].astype(np.uint32), place == 0
        with np.errstate(over="ignore"):
            two = last[0] | (last[1] << W.U(8))
            three = two | (last[2] << W.U(16))
            five = three | (last[3] << W.U(24)) | (last[4] << W.U(32))
            up, down = W._power_table(len(data) + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W._BYTE[data] * up[: len(data)])])
            begin = self.first[self.word]
            whole = W.mix((total[np.arange(len(data))] - total[begin]) * down[begin] + place.astype(np.uint64))
            self.contexts = [W.mix(c + (W.U(k + 1) << W.U(60))) for k, c in enumerate([last[0], two, three, five, whole])]

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct entries, index of each byte's entry in every predictor): 56 bits of the context, then the byte."""
        keys = np.concatenate([(c & ~W.U(255)) | self.byte for c in self.contexts])
        entry, at = np.unique(keys, return_inverse=True)
        return entry, at.reshape(len(self.contexts), -1)

    def bits(self):
        """(bit, slots of each table) for the eight bits of all bytes."""
        for j in range(8):
            node = (np.uint32(1) << np.uint32(j)) | (self.byte >> np.uint32(8 - j))
            bit = (self.byte >> np.uint32(7 - j)) & np.uint32(1)
            with np.errstate(over="ignore"):
                yield bit, [(W.mix(c + node) >> W.U(64 - size)).astype(np.int64) for c, size in zip(self.contexts, TABLE_BITS, strict=True)]


def give_back() -> None:
    """Freed memory goes back to the system: the worker lives on into the next stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def packs_of(words: DataFrame, n_bytes: int) -> DataFrame:
    """(pack, words, counts) from (word, c): about ``PACK_BYTES`` of words, each followed by a blank, and their training counts.

    A word's pack and place in it follow from the word alone and the number of packs."""
    packs = max(1, -(-n_bytes // PACK_BYTES))

    def run(batches):
        now, found, counts = None, [], []

        def close():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b" ".join([*found, b""])], pa.binary()), pa.array([np.array(counts, np.float64).tobytes()], pa.binary())], ["pack", "words", "counts"])

        for batch in batches:
            for pack, w, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if pack != now:
                    if found:
                        yield close()
                    now, found, counts = pack, [], []
                found.append(w), counts.append(c)
        if found:
            yield close()

    rows = words.select(F.pmod(F.xxhash64("word"), F.lit(packs)).alias("pack"), "word", "c")
    return rows.repartition(max(1, -(-packs // 4)), "pack").sortWithinPartitions("pack", "word").mapInArrow(run, "pack long, words binary, counts binary")


def _pack(found: bytes, counts: bytes) -> tuple[list[bytes], np.ndarray]:
    return found.split(b" ")[:-1], np.frombuffer(counts)


def count_entries(packs: DataFrame, n_bytes: int) -> DataFrame:
    """(pack, shard, part): for a pack's entries of a shard, in order, nine rows of int64. Level j is the training count of the
    context with any next byte that has the first j bits of the entry's; row j is level j less level j + 1, the last is level 8."""
    shards = max(1, -(-n_bytes * len(TABLE_BITS) // SHARD_ENTRIES))

    def ask(batches):
        for batch in batches:
            for pack, blob, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, counts = _pack(blob, weights)
                s = Spelling(found)
                entry, at = s.entries()
                total = np.bincount(at.ravel(), np.tile(counts[s.word], len(at)), len(entry)).astype(np.int64)
                shard = ((entry >> W.U(32)) * W.U(shards)) >> W.U(32)
                some, first = np.unique(shard, return_index=True)
                ends = [*first[1:], len(entry)]
                keys = [entry[a:b].tobytes() for a, b in zip(first, ends, strict=True)]
                sums = [total[a:b].tobytes() for a, b in zip(first, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([pack] * len(some), pa.int64()), pa.array(keys, pa.binary()), pa.array(sums, pa.binary())], ["shard", "pack", "entries", "counts"])
        give_back()

    def add(rows: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in rows.column("entries").to_pylist()]
        entry, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist()])).astype(np.int64)
        levels = np.empty((9, len(entry)), np.int64)
        for j in range(9):
            node = entry >> W.U(8 - j)
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            levels[j] = np.repeat(np.add.reduceat(total, first), np.diff(np.r_[first, len(entry)]))
        levels[:8] -= levels[1:]
        ends = np.cumsum([len(x) for x in keys])
        parts = [zlib.compress(levels[:, at[b - len(x) : b]].tobytes(), 1) for x, b in zip(keys, ends, strict=True)]
        return pa.table([rows.column("pack"), rows.column("shard"), pa.array(parts, pa.binary())], ["pack", "shard", "part"])

    asked = packs.mapInArrow(ask, "shard int, pack long, entries binary, counts binary")
    return asked.groupBy("shard").applyInArrow(add, "pack long, shard int, part binary")


def told(packs: DataFrame, counted: DataFrame, tasks: int) -> DataFrame:
    """(pack, shard, data, counts) in order: each pack's words, then the parts of its entries' counts."""
    rows = packs.select("pack", F.lit(-1).alias("shard"), F.col("words").alias("data"), "counts")
    rows = rows.unionByName(counted.select("pack", "shard", F.col("part").alias("data"), F.lit(None).cast("binary").alias("counts")))
    task = F.pmod("pack", F.lit(tasks)).cast("int")
    return rows.repartitionById(tasks, task).sortWithinPartitions("pack", "shard")


def counted_packs(batches):
    """(words, counts, spelling, entry index, levels) of each pack from the rows of ``told``."""

    def close(head, parts):
        found, counts = _pack(*head)
        s = Spelling(found)
        levels = np.concatenate([np.frombuffer(zlib.decompress(x), np.int64).reshape(9, -1) for x in parts], axis=1)
        for j in range(7, -1, -1):
            levels[j] += levels[j + 1]
        return found, counts, s, s.entries()[1], levels

    head, parts = None, []
    for batch in batches:
        for shard, data, counts in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
            if shard < 0:
                if head:
                    yield close(head, parts)
                head, parts = (data, counts), []
            else:
                parts.append(data)
    if head:
        yield close(head, parts)
    give_back()


def slices(s: Spelling):
    """Ranges of bytes of about ``BATCH_BYTES`` that end with a word."""
    ends = np.r_[s.first[1:], len(s.byte)]
    at = 0
    while at < len(s.byte):
        end = int(ends[min(np.searchsorted(ends, at + BATCH_BYTES), len(ends) - 1)])
        yield slice(at, end)
        at = end


def _seen(n: np.ndarray) -> np.ndarray:
    return (n > 0.5).astype(np.int64) + (n > 3.5) + (n > 63.5)


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(0.02)) / (n0 + np.float32(0.02)))


def _mixed(inputs: np.ndarray, seen: tuple[np.ndarray, np.ndarray], start: np.ndarray, weights: np.ndarray):
    """(gate, probability of a one) from the predictors' stretched probabilities and what the two longest contexts have seen."""
    gate = (seen[1] * np.int64(4) + seen[0]) * 2 + start
    mixed = np.einsum("ki,ik->i", inputs, weights.astype(np.float32)[gate])
    return gate, 1 / (1 + np.exp(-np.clip(mixed, -14, 14).astype(np.float64)))


def _map_place(last: np.ndarray, p: np.ndarray) -> np.ndarray:
    return last.astype(np.int64) * 24 + np.clip((np.log(p / (1 - p)) + 12).astype(np.int64), 0, 23)


def _initial() -> tuple[np.ndarray, np.ndarray]:
    centre = 1 / (1 + np.exp(-(np.arange(24) - 11.5)))
    return np.full((GATES, len(TABLE_BITS) + 1), 0.3), np.tile(np.stack([1 - centre, centre]), (1, 256)) * 4


def learn_mixer(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(weights, map counts) from the rows of ``told``: online over all training words in each learner, averaged over the learners."""

    def run(batches):
        weights, refine = _initial()
        squares, mass, start_refine = np.full_like(weights, 1e-2), 0.0, refine.copy()
        for _, counts, s, entry, levels in counted_packs(batches):
            every = counts[s.word]
            for part in slices(s):
                at = part.start + np.flatnonzero(every[part] > 0)
                if not len(at):
                    continue
                weight, last, mine = every[at], s.last[at], [levels[:, e] for e in entry[:, at]]
                for j in range(8):
                    bit = (s.byte[at] >> np.uint32(7 - j)) & np.uint32(1)
                    inputs, seen = np.full((len(mine) + 1, len(bit)), 0.3, np.float32), []
                    for k, x in enumerate(mine):
                        same = (x[j + 1] - 1).astype(np.float32)  # without the bit's own occurrence
                        other = (x[j] - x[j + 1]).astype(np.float32)
                        inputs[k] = np.where(bit == 1, _stretch(other, same), _stretch(same, other))
                        if k >= LONG:
                            seen.append(_seen(same + other))
                    gate, p = _mixed(inputs, seen, s.start[at], weights)
                    error = (bit - p) * weight
                    step = np.stack([np.bincount(gate, error * x, GATES) for x in inputs], axis=1)
                    scale = np.bincount(gate, weight, GATES)[:, None] + 1
                    squares += (step / scale) ** 2
                    weights += RATE * (step / scale) / np.sqrt(squares)
                    refine += np.bincount(_map_place(last, p) + bit * np.int64(refine.shape[1]), weight, refine.size).reshape(refine.shape)
                mass += weight.sum()
        if mass:
            yield pa.RecordBatch.from_arrays([pa.array([mass]), pa.array([(weights * mass).tobytes()], pa.binary()), pa.array([(refine - start_refine).tobytes()], pa.binary())], ["mass", "weights", "refine"])

    weights, refine = _initial()
    learned = rows.mapInArrow(run, "mass double, weights binary, refine binary").collect()  # a row for each learner
    if learned:
        weights = sum(np.frombuffer(r.weights).reshape(weights.shape) for r in learned) / sum(r.mass for r in learned)
        refine = refine + sum(np.frombuffer(r.refine).reshape(refine.shape) for r in learned)
    return weights, refine


def score_words(rows: DataFrame, weights: np.ndarray, refine: np.ndarray) -> DataFrame:
    """(word, c, score) from the rows of ``told``: the model's log10 probability of every word's spelling."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, refine))

    def run(batches):
        w, r = shared.value
        refined = r[1] / (r[0] + r[1])
        for found, counts, s, entry, levels in counted_packs(batches):
            total = np.zeros(len(s.byte))
            for j in range(8):
                same, both = levels[j + 1].astype(np.float32), levels[j].astype(np.float32)
                toward, seen = _stretch((levels[j] - levels[j + 1]).astype(np.float32), same), _seen(both).astype(np.int8)
                for part in slices(s):
                    bit = (s.byte[part] >> np.uint32(7 - j)) & np.uint32(1)
                    sign = bit.astype(np.float32) * 2 - 1
                    inputs = np.full((len(entry) + 1, len(bit)), 0.3, np.float32)
                    for k, e in enumerate(entry):
                        inputs[k] = toward[e[part]] * sign
                    _, p = _mixed(inputs, tuple(seen[e[part]] for e in entry[LONG:]), s.start[part], w)
                    p = np.clip((p + refined[_map_place(s.last[part], p)]) / 2, LEAST, 1 - LEAST)
                    total[part] += np.log10(np.where(bit == 1, p, 1 - p))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(counts.astype(np.int64)), pa.array(np.add.reduceat(total, s.first))], ["word", "c", "score"])

    return rows.mapInArrow(run, "word binary, c long, score double")


def matched(tokens: np.ndarray, size: np.ndarray, first: np.ndarray, score: np.ndarray) -> np.ndarray:
    """log10 probability of every token where the match model has its say: tokens of texts one after the other, of each its number and score by its spelling."""
    n = len(tokens)
    text = np.repeat(np.arange(len(size)), size)
    inner = np.ones(n, bool)
    inner[first] = False
    # Places with the same word before them, text by text, in order: the place before in this order is where the word was last.
    key = np.full(n, -1, np.int64)
    key[1:] = (text[1:].astype(np.int64) << 32) | tokens[:-1]
    key[~inner] = -1
    order = np.argsort(key, kind="stable")
    again = (key[order[1:]] == key[order[:-1]]) & (key[order[1:]] >= 0)
    tried, right = np.zeros(n, bool), np.zeros(n, bool)
    tried[order[1:][again]] = True
    right[order[1:][again]] = tokens[order[1:][again]] == tokens[order[:-1][again]]
    was = np.zeros(n, bool)
    was[1:] = right[:-1] & inner[1:]
    share = np.zeros(n)
    for state, (a, b) in enumerate(TRIED):
        here = tried & (was == bool(state))
        met, hits = np.cumsum(here), np.cumsum(here & right)
        met, hits = (x - (here & y) for x, y in ((met, True), (hits, right)))  # before this place
        met, hits = (x - x[first][text] for x in (met, hits))  # in this text; its first place is never tried
        share = np.where(here, (hits + a) / (met + b), share)
    return np.where(right, np.log10((1 - share) * 10.0**score + share + 1e-300), score + np.log10(1 - share))


# --- the operator ---------------------------------------------------------------------------------------------------------


def score_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row."""
    spark = prepare(docs.sparkSession)
    coded = stored(chunks(docs, text_col, id_col))

    def vocabulary() -> DataFrame:
        pairs = F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "pair")
        return coded.select("chunk", pairs).select("chunk", "pos", F.col("pair.words").alias("word"), F.col("pair.counts").alias("n"))

    words = stored(vocabulary().groupBy("word").agg(F.sum("n").cast("long").alias("c")))
    n_bytes = words.agg(F.coalesce(F.sum(F.octet_length("word") + 1), F.lit(0))).first()[0]
    total, distinct = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    packs = stored(packs_of(words, n_bytes))
    learners = min(max(LEARNERS[0], -(-n_bytes // LEARNER_BYTES)), LEARNERS[1])
    discard(words)
    counted = stored(count_entries(packs, n_bytes))
    weights, refine = learn_mixer(told(packs, counted, learners))
    release(spark)
    scored = stored(score_words(told(packs, counted, max(learners, -(-n_bytes // (4 * PACK_BYTES)))), weights, refine))
    discard(packs, counted)
    release(spark)
    back = vocabulary().drop("n").join(scored, "word").groupBy("chunk").agg(F.collect_list(F.struct("pos", "c", "score")).alias("scores"))
    rows = coded.select("chunk", "ids", "held", "sizes", "tokens", F.transform("words", lambda w: F.octet_length(w)).alias("lengths")).join(back, "chunk")
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                get = lambda c: batch.column(batch.schema.get_field_index(c))[row]  # noqa: B023, E731
                flat = get("scores").values
                at = flat.field("pos").to_numpy()
                c, score = np.zeros(len(at)), np.zeros(len(at))
                c[at], score[at] = flat.field("c").to_numpy(), flat.field("score").to_numpy()
                tokens = np.frombuffer(get("tokens").as_py(), np.uint16 if len(at) <= 1 << 16 else np.uint32).astype(np.int64)
                size = get("sizes").values.to_numpy()
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
                base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
                per_text = lambda x: np.add.reduceat(x[tokens], first)  # noqa: B023, E731
                n_bytes = per_text(get("lengths").values.to_numpy().astype(np.int64) + 1)
                model = np.add.reduceat(matched(tokens, size, first, score[tokens]), first)
                bits = -model * np.log2(10) / n_bytes
                columns = [get("ids").values, get("held").values, pa.array(size, pa.int64()), pa.array(per_text((c > 0).astype(np.int64))), pa.array(np.full(len(size), total, np.int64)), pa.array(per_text(base)), pa.array(model), pa.array(n_bytes), pa.array(bits)]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
