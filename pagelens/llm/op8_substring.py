"""Substring dedup with compressed FM-indexes.

A window is ``WINDOW`` consecutive words. Sharding: each window belongs to its minimiser, the least hash of its eight-word
runs, so equal windows always meet; a maximal run of windows with one minimiser is a segment. Segments whose minimiser occurs
once in the whole corpus are done. The others go, each distinct text once with its multiplicity, to shards by minimiser. A
shard builds an FM-index of its segments (suffix array, Burrows-Wheeler transform, a wavelet matrix over packed bit vectors
with rank directories) and streams the segments through it: backward search steps to the left, and where the match would
become unique the interval goes to its parent by the LCP array. That gives, at every word, the length of the longest match
that also occurs elsewhere; the words from there on for ``WINDOW`` words are reported where it is long enough.

Hot minimisers (a passage that very many texts share) are cut into single windows, sharded by the hash of the window, and
equal ones are merged before the shuffle, so no shard grows with a hot passage.

Cases: a null or empty text has no words; texts under a window's length lose nothing; texts of any length are streamed whole;
repeated rows are occurrences of each other; null ids take part; an empty table gives an empty one; the results carry the id
and their own columns only. Minimisers, texts and segments are told apart by hashes of 64, 64 and 128 bits.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm import words as W
from pagelens.llm.graph import BROADCAST_ROWS, if_small, salted_join
from pagelens.session import cut, prepare, table

WINDOW, ANCHOR = 35, 8
#: Segments of one shard, about; and occurrences from which a minimiser's segments are cut into windows.
SHARD_SEGMENTS, HOT = 6_000, 4_000
_NONE = np.uint64((1 << 64) - 1)


# --- segments -------------------------------------------------------------------------------------------------------------


def runs(w: W.Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, last window) of the segments, windows numbered by their first word in the block."""
    n = len(w.hash)
    none = np.zeros(0, np.int64)
    if n < window:
        return np.zeros(0, np.uint64), none, none
    value = np.full(n, _NONE)
    h, at = W.grams(w.hash, w.doc, anchor)
    value[at] = h
    place = np.arange(n)
    reach, want = 1, window - anchor + 1
    while reach < want:
        step = min(reach, want - reach)
        later, later_place = np.full(n, _NONE), place.copy()
        later[:-step], later_place[:-step] = value[step:], place[step:]
        left = value <= later
        value, place = np.where(left, value, later), np.where(left, place, later_place)
        reach += step
    start = np.flatnonzero(w.doc[: n - window + 1] == w.doc[window - 1 :])
    if not len(start):
        return np.zeros(0, np.uint64), none, none
    new = np.r_[True, (start[1:] != start[:-1] + 1) | (place[start[1:]] != place[start[:-1]])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    return value[start[first]], start[first], start[last]


def run_rows(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, text_key, spread, first, last) of every segment; texts: (text_key, text, spread: a number that copies of a text differ by)."""

    def run(batches):
        for batch in batches:
            for block in W.blocks(batch.column(1)):
                w = W.words(block)
                h, a, b = runs(w, window, anchor)
                doc = w.doc[a]
                keys = batch.column(0).take(pa.array(block.row + doc))
                base = w.first[doc]
                spread = batch.column(2).take(pa.array(block.row + doc))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), keys, spread, pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32))], ["anchor", "text_key", "spread", "first", "last"])

    return texts.mapInArrow(run, "anchor long, text_key long, spread short, first int, last int")


_STEP, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def range_ids(hashed: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each range [low, high) of words, by polynomial prefix sums."""
    n = len(hashed)
    out = []
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.r_[W.U(1), np.full(n, base, np.uint64)]) for base in (_STEP, _BACK))
        for salt in (0, 0x51ED270B7D4CE52D):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(hashed ^ W.U(salt)) * up[:n])])
            out.append(W.mix((total[high] - total[low]) * down[low] + (high - low).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _pieces(batch: pa.RecordBatch, window: int):
    """For each block: its raw bytes, words, and the segments' text row, first word in the text, word range, ids, home and copies."""
    text_at, run_at = (batch.schema.get_field_index(c) for c in ("text", "runs"))
    for block in W.blocks(batch.column(text_at)):
        w, docs = W.words(block), len(block.offsets) - 1
        lists = batch.column(run_at).slice(block.row, docs)
        flat = lists.flatten()
        anchor, first, last, hot, copies = (np.asarray(flat.field(c).to_numpy(zero_copy_only=False)) for c in ("anchor", "first", "last", "hot", "copies"))
        row = np.repeat(np.arange(docs), lists.value_lengths().to_numpy(zero_copy_only=False))
        # A hot segment is its single windows.
        parts = np.where(hot.astype(bool), last - first + 1, 1)
        at = np.repeat(np.arange(len(parts)), parts)
        offset = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        hot = hot.astype(bool)[at]
        begin = first[at].astype(np.int64) + np.where(hot, offset, 0)
        end = np.where(hot, begin, last[at]) + window
        base = w.first[row[at]]
        a, b = range_ids(w.hash, base + begin, base + end)
        yield block, w, block.row + row[at], begin, base + begin, base + end, a, b, np.where(hot, a, anchor[at]), copies[at]


def segment_rows(chosen: DataFrame, window: int, shards: int) -> DataFrame:
    """(shard, seg_a, seg_b, words binary, copies) of the texts' segments, merged within a task. chosen: (text, text_key, runs array<struct<anchor,first,last,hot,copies>>)."""

    def run(batches):
        met: dict[tuple[int, int], list] = {}
        held = 0

        def flush():
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            rows = [(home % shards, a, b, p, n) for (a, b), (home, p, n) in met.items()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "seg_a", "seg_b", "words", "copies"])

        for batch in batches:
            for block, w, _, _, low, high, a, b, home, copies in _pieces(batch, window):
                raw = block.data.tobytes()
                for x, y, lo, hi, h, n in zip(a.tolist(), b.tolist(), w.start[low].tolist(), w.end[high - 1].tolist(), home.tolist(), copies.tolist(), strict=True):
                    have = met.get((x, y))
                    if have:
                        have[2] = min(2, have[2] + n)
                        continue
                    met[x, y] = [h, raw[lo:hi], min(2, n)]
                    held += hi - lo + 300
                if held > 60_000_000:
                    yield flush()
                    met, held = {}, 0
        if met:
            yield flush()

    return chosen.mapInArrow(run, "shard int, seg_a long, seg_b long, words binary, copies int")


def occurrences(chosen: DataFrame, window: int) -> DataFrame:
    """(text_key, seg_a, seg_b, first) of every segment of the texts."""

    def run(batches):
        for batch in batches:
            key = batch.column(batch.schema.get_field_index("text_key"))
            for _, _, row, begin, _, _, a, b, _, _ in _pieces(batch, window):
                yield pa.RecordBatch.from_arrays([key.take(pa.array(row)), pa.array(a), pa.array(b), pa.array(begin.astype(np.int32))], ["text_key", "seg_a", "seg_b", "first"])

    return chosen.mapInArrow(run, "text_key long, seg_a long, seg_b long, first int")


def merge_spans(spans: DataFrame) -> DataFrame:
    """(text_key, spans) with overlapping and touching ranges made one, in order."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            lo, hi = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((lo, row))
            lo, hi, row = lo[order], hi[order], row[order]
            wide = row << 32  # rows apart, so one running maximum serves all
            reach = np.maximum.accumulate(hi + wide)
            new = np.r_[True, lo[1:] + wide[1:] > reach[:-1]] if len(lo) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(lo)] - 1
            ranges = pa.StructArray.from_arrays([pa.array(lo[first], pa.int32()), pa.array((reach[last] - wide[last]).astype(np.int32))], ["lo", "hi"])
            edge = np.searchsorted(row[first], np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edge), ranges)], ["text_key", "spans"])

    return spans.mapInArrow(run, "text_key long, spans array<struct<lo:int,hi:int>>")


# --- the index ------------------------------------------------------------------------------------------------------------


class WaveletMatrix:
    """Rank queries over a sequence of symbols: a packed bit vector with a rank directory for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels = len(symbols), max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, bool)
            padded[: self.n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        self.base = np.zeros(sigma, np.int64)
        self.base = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            block = at >> 6
            inside = self.words[k][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[k][block] + np.bitwise_count(inside)
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._walk(symbol, at) - self.base[symbol]


class FMIndex:
    """Index of a sequence of symbols (0 separates texts); weight: occurrences that each position stands for."""

    def __init__(self, text: np.ndarray, weight: np.ndarray, depth: int = 64):
        """depth: a match of more symbols need not be told from one of so many; the window's length at least."""
        n = len(text)
        self.n, self.sigma = n, int(text.max()) + 1
        rank = text.astype(np.int64)
        ranks, k = [rank], 1
        while k < depth or k < 2:
            after = np.zeros(n, np.int64)
            after[: max(0, n - k)] = rank[k:] + 1
            key = rank * (max(n, self.sigma) + 2) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
            k *= 2
            ranks.append(rank)
        self.order = order
        # LCP of neighbours, up to the depth: the greatest equal block first.
        left, right, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
        for level in range(len(ranks) - 2, -1, -1):
            inside = (left < n) & (right < n)
            same = np.zeros(n - 1, bool)
            same[inside] = ranks[level][left[inside]] == ranks[level][right[inside]]
            move = same * (1 << level)
            lcp, left, right = lcp + move, left + move, right + move
        level = np.concatenate([[-1], lcp, [-1]]).astype(np.int8 if k < 128 else np.int32)  # level[i]: LCP of rows i - 1 and i
        self.least = [level]
        step = 1
        while 2 * step <= n + 1:
            last = self.least[-1]
            self.least.append(np.minimum(last[:-step], last[step:]))
            step *= 2
        counts = np.bincount(text, minlength=self.sigma)
        self.smaller = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.wavelet = WaveletMatrix(text[order - 1].astype(np.int64), self.sigma)
        self.mass = np.concatenate([[0], np.cumsum(weight[order])])

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: rows that start with the symbol followed by what the rows [low, high) start with."""
        r = self.smaller[symbol] + self.wavelet.rank(np.r_[symbol, symbol], np.r_[low, high]).reshape(2, -1)
        return r[0], r[1]

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least wider interval, and the length its rows share."""
        level = self.least[0]
        shared = np.maximum(level[low], level[high])
        low, high = low.copy(), high.copy()
        for k in range(len(self.least) - 1, -1, -1):
            size, row = 1 << k, self.least[k]
            at = low - size + 1
            ok = at >= 0
            ok[ok] = row[at[ok]] >= shared[ok]
            low[ok] -= size
            ok = high < len(row)
            ok[ok] = row[high[ok]] >= shared[ok]
            high[ok] += size
        return low, high, shared


def repeated_windows(first: np.ndarray, size: np.ndarray, text: np.ndarray, index: FMIndex, window: int) -> np.ndarray:
    """Matching statistics of the texts (rows of ``text`` from first on): true at each word from which a match of a window's length has weight 2 or more."""
    out = np.zeros(len(text), bool)
    at = first + size  # the match starts here; what is left of it comes next
    low, high = np.zeros(len(first), np.int64), np.full(len(first), index.n)
    length = np.zeros(len(first), np.int64)
    start = first.copy()
    while len(at):
        a, b = index.step(text[at - 1], low, high)
        good = index.mass[b] - index.mass[a] >= 2
        at = at - good
        low, high, length = np.where(good, a, low), np.where(good, b, high), length + good
        out[at[good & (length >= window)]] = True
        bad = np.flatnonzero(~good)
        if len(bad):
            root = length[bad] == 0
            at[bad[root]] -= 1  # a word that is nowhere else: no match goes through it
            wide = bad[~root]
            if len(wide):
                lo, hi, shared = index.parent(low[wide], high[wide])
                shared = np.minimum(shared, length[wide] - 1)  # rows that are alike beyond the match leave it one shorter
                root = shared <= 0
                low[wide], high[wide], length[wide] = np.where(root, 0, lo), np.where(root, index.n, hi), np.where(root, 0, shared)
        more = at > start
        at, low, high, length, start = at[more], low[more], high[more], length[more], start[more]
    return out


def search_shard(rows: pa.Table, window: int) -> pa.Table:
    """(seg_a, seg_b, spans) of the segments with repeated windows; spans are ranges of words that such windows cover."""
    met: dict[tuple[int, int], list] = {}
    for a, b, p, n in zip(*(rows.column(c).to_pylist() for c in ("seg_a", "seg_b", "words", "copies")), strict=True):
        have = met.setdefault((a, b), [p, 0])
        have[1] += n
    number: dict[bytes, int] = {}
    parts, size, weight = [], [], []
    for p, n in met.values():
        ids = [number.setdefault(x, len(number) + 1) for x in p.split()]
        parts += [*ids, 0]
        size.append(len(ids))
        weight.append(min(2, n))
    text, size = np.array(parts, np.int64), np.array(size, np.int64)
    first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    index = FMIndex(text, np.repeat(np.array(weight, np.int64), size + 1), window)
    hit = repeated_windows(first, size, text, index, window)
    out_a, out_b, spans = [], [], []
    some = np.add.reduceat(hit, first) > 0
    for i, key in enumerate(met):
        if not some[i]:
            continue
        starts = np.flatnonzero(hit[first[i] : first[i] + size[i]])
        cuts = np.flatnonzero(np.diff(starts) > window)
        lo, hi = starts[np.r_[0, cuts + 1]], starts[np.r_[cuts, len(starts) - 1]] + window
        out_a.append(key[0]), out_b.append(key[1])
        spans.append([{"lo": int(x), "hi": int(y)} for x, y in zip(lo, hi, strict=True)])
    return pa.table([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], ["seg_a", "seg_b", "spans"])


# --- the operator ---------------------------------------------------------------------------------------------------------


def _repeated_runs(texts: DataFrame, window: int) -> DataFrame:
    """(text_key, runs) of the texts that have a segment whose minimiser is found again, checkpointed.

    The rows of a hot minimiser, copies of one text among them, are dealt over several tasks when they meet its count."""
    every = run_rows(texts, window, min(ANCHOR, window))
    twice = cut(every.select("anchor").groupBy("anchor").agg(F.count("*").alias("n")).filter("n >= 2"))
    found = salted_join(every, twice, "anchor", twice, F.col("spread") + F.col("first"))
    found = found.groupBy("text_key", "anchor", "first", "last").agg(F.count("*").cast("int").alias("copies"), (F.first("n") >= HOT).alias("hot"))
    return cut(found.groupBy("text_key").agg(F.collect_list(F.struct("anchor", "first", "last", "hot", "copies")).alias("runs")))


def repeated_spans(docs: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(text_key: xxhash64 of the text, spans array<struct<lo,hi>>: the word ranges that repeated windows cover), checkpointed."""
    prepare(docs.sparkSession)
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(32_000)).cast("short").alias("spread"))
    found = _repeated_runs(texts, window)
    total = found.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-total // SHARD_SEGMENTS))
    wanted = texts.join(if_small(found.select("text_key")), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    chosen = cut(wanted.join(found, "text_key"))
    segments = segment_rows(chosen, window, shards)
    repeats = segments.groupBy("shard").applyInArrow(lambda rows: search_shard(rows, window), "seg_a long, seg_b long, spans array<struct<lo:int,hi:int>>")
    # Segments of one hot window are alike in many texts; the join's skew is split at run time, rows are short.
    spans = occurrences(chosen, window).join(repeats, ["seg_a", "seg_b"])
    spans = spans.select("text_key", F.transform("spans", lambda s: F.struct((s["lo"] + F.col("first")).alias("lo"), (s["hi"] + F.col("first")).alias("hi"))).alias("s"))
    return cut(merge_spans(spans.groupBy("text_key").agg(F.flatten(F.collect_list("s")).alias("spans"))))


def removed_words(docs: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_words, n_removed, spans, kept_text: the words that stay, joined by one space) of every row."""
    spans = repeated_spans(docs, window, text_col, id_col)
    total = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("n")).first().n
    small = F.broadcast(spans) if total <= BROADCAST_ROWS else spans  # of a counted size: 16 bytes a span
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("text_key")).join(small, "text_key", "left").select("id", "text", "spans")

    def run(batches):
        for batch in batches:
            for block in W.blocks(batch.column(1)):
                w, docs_here = W.words(block), len(block.offsets) - 1
                gone = np.zeros(len(w.start), bool)
                marked = batch.column(2).slice(block.row, docs_here).to_pylist()
                for i, ranges in enumerate(marked):
                    for r in ranges or ():
                        gone[w.first[i] + r["lo"] : w.first[i] + r["hi"]] = True
                raw = block.data.tobytes()
                start, end, stay = w.start.tolist(), w.end.tolist(), ~gone
                kept = []
                for i in range(docs_here):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    kept.append(b" ".join([raw[start[j] : end[j]] for j in (np.flatnonzero(stay[a:b]) + a).tolist()]))
                lost = np.add.reduceat(np.r_[gone, False], w.first[:-1]) if docs_here else np.zeros(0)
                lost = np.where(np.diff(w.first) > 0, lost, 0)
                columns = [batch.column(0).slice(block.row, docs_here), pa.array(np.diff(w.first), pa.int64()), pa.array(lost, pa.int64()), batch.column(2).slice(block.row, docs_here), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "n_removed", "spans", "kept_text"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, n_removed long, spans array<struct<lo:int,hi:int>>, kept_text binary")


def op8_substring(spark, sf_dir: str) -> DataFrame:
    out = removed_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
