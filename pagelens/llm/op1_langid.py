"""Language identification by a linear-chain conditional random field.

Words (runs of letters, lower case) of a text are a chain. Affixes, character n-grams, the word itself and learned lexicons of
each language score a word's label; learned transitions score neighbours. Forward-backward gives each word's label
probabilities in code-switched text, and their mean over the text is the document's distribution over languages.

Training: a bounded sample of labelled documents (``SAMPLE_DOCS`` in all, ``DOCS_PER_LANGUAGE`` a language at most on average,
two a language at least; chosen by a hash of the id; of a longer text the first ``MOST_CHARS``), whose passages are shuffled
into code-switched chains so that transitions are learned too. Every language of the table is learned. The gradient takes the
expected transitions from the pairwise marginals of forward-backward.

``known`` is the mean share of a word's features that were met in training: it tells text of no learned language, such as random
letters, from text of one, whatever the number of languages.

Cases: a null text or one without a letter (numerals are none) is ``und`` with score 0; texts of any length are labelled whole;
equal texts get equal results; ties go to the alphabetically first language; null languages and ids are not learned from;
without any labelled row everything is ``und``; an empty table gives an empty one; the result carries the id and the operator's
columns only.
"""

from __future__ import annotations

import re
import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.session import prepare, table

DOCS_PER_LANGUAGE, SAMPLE_DOCS = 240, 4_000
MOST_CHARS = 20_000
BITS = 17
EPOCHS = 14
WINDOW = 40
LEXICON = 2_000
CACHED = 200_000
#: Texts of about so many characters are labelled together.
BLOCK_CHARS = 4_000_000
U = np.uint64


def _not_letters() -> str:
    """Ranges of word characters that are no letters: signs with a numeric value, such as superscripts and fractions."""
    odd = [c for c in range(sys.maxunicode + 1) if (x := chr(c)).isalnum() and not x.isalpha() and not x.isdecimal()]
    first = [c for c in odd if c - 1 not in (known := set(odd))] if odd else []
    last = [c for c in odd if c + 1 not in known] if odd else []
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last, strict=True))


_WORD = re.compile(rf"[^\W\d_{_not_letters()}]+")


class Model(NamedTuple):
    """Labels, hashed feature weights (2^BITS x labels), lexicon weights (label x label), words of the lexicons, transition and start scores, features met in training."""

    labels: list[str]
    weights: np.ndarray
    lexicon_weights: np.ndarray
    lexicon: dict[str, int]
    transition: np.ndarray
    start: np.ndarray
    met: np.ndarray


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _slot(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return (x >> U(64 - BITS)).astype(np.int64)


def features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of words as (word number, slot) pairs of arrays: bi- and trigrams within ^word$, affixes of three letters, and the word."""
    out = []
    length = np.fromiter(map(len, words), np.int64, len(words))
    width = 8
    low = 0
    while low < (length.max() if len(words) else 0):
        at = np.flatnonzero((length > low) & (length <= width))
        low, width = width, 2 * width
        if not len(at):
            continue
        n, size = len(at), length[at]
        c = np.zeros((n, low + 3), np.uint64)
        c[:, 1 : low + 1] = np.array([words[i] for i in at], f"U{low}").view(np.uint32).reshape(n, low)
        c[:, 0] = 2
        c[np.arange(n), size + 1] = 3
        with np.errstate(over="ignore"):
            two = c[:, :-1] * U(0x9E3779B97F4A7C15) + c[:, 1:] * U(0xC2B2AE3D27D4EB4F)
            three = two[:, :-1] + c[:, 2:] * U(0x165667B19E3779F9) + U(3)
            for j in range(low + 1):
                ok = size >= j
                out.append((at[ok], _slot(two[ok, j])))
            for j in range(low):
                ok = size > j
                out.append((at[ok], _slot(three[ok, j])))
            ok = np.flatnonzero(size >= 3)
            head = three[ok, 0] + c[ok, 3] * U(0x85EBCA77C2B2AE63)
            tail = three[ok, size[ok] - 1] + c[ok, size[ok] - 2] * U(0x27D4EB2F165667C5)
            powers = np.cumprod(np.full(low + 3, 0x9E3779B97F4A7C15 | 1, np.uint64))
            out += [(at[ok], _slot(head)), (at[ok], _slot(tail)), (at, _slot((c * powers).sum(axis=1)))]
    return out


def emissions(words: list[str], model: Model) -> np.ndarray:
    """Label scores of each word, and in the last column the share of its features that were met in training."""
    out = np.zeros((len(words), len(model.labels) + 1), np.float32)
    n = np.zeros(len(words), np.float32)
    for at, slot in features(words):
        out[at, :-1] += model.weights[slot]
        out[at, -1] += model.met[slot]
        n[at] += 1
    out[:, -1] /= np.maximum(n, 1)
    lex = np.fromiter((model.lexicon.get(w, -1) for w in words), np.int64, len(words))
    out[lex >= 0, :-1] += model.lexicon_weights[lex[lex >= 0]]
    return out


def marginals(scores: np.ndarray, first: np.ndarray, size: np.ndarray, transition: np.ndarray, start: np.ndarray, moves: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of every word of chains (chain i: size[i] rows from first[i] on), all chains in step.

    moves: to this the expected number of each transition is added, the sum of the pairwise marginals."""
    factor = np.exp(scores.astype(np.float64) - scores.max(axis=1, keepdims=True)) if len(scores) else scores.astype(np.float64)
    move = np.exp(transition - transition.max())
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    alive = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # chains longer than t
    forward = np.empty_like(factor)
    state = np.exp(start - start.max())[None, :]
    for t, k in enumerate(alive):
        at = first[:k] + t
        state = factor[at] * (state[:k] @ move if t else state)
        state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    back = np.ones((0, factor.shape[1]))
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        at = first[:k] + t
        if len(back) < k:  # chains that end here
            back = np.concatenate([back, np.ones((k - len(back), factor.shape[1]))])
        both = forward[at] * back
        here = factor[at] * back
        forward[at] = both / both.sum(axis=1, keepdims=True)
        here /= here.sum(axis=1, keepdims=True)
        back = here @ move.T
        if moves is not None and t:
            before = forward[at - 1]  # still what comes from the left alone
            moves += (before / (before * back).sum(axis=1, keepdims=True)).T @ here * move
    return forward


def train(rows: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 1) -> Model | None:
    """Fit on (text, language) rows: gradient ascent of the conditional likelihood with adaptive steps, all chains at once."""
    texts = [(lang, words_of(text)) for text, lang in rows]
    texts = [(lang, ws) for lang, ws in texts if ws]
    if not texts:
        return None
    labels = sorted({lang for lang, _ in texts})
    n_labels, number = len(labels), {}
    draw = np.random.Generator(np.random.PCG64(seed))
    passages = []
    for lang, ws in texts:
        ids, i = [number.setdefault(w, len(number)) for w in ws], 0
        while i < len(ids):
            n = int(draw.integers(8, 33))
            passages.append((labels.index(lang), ids[i : i + n]))
            i += n
    passages = [passages[i] for i in draw.permutation(len(passages))]
    ids = np.concatenate([np.array(p, np.int64) for _, p in passages])
    gold = np.concatenate([np.full(len(p), y, np.int64) for y, p in passages])
    first = np.arange(0, len(ids), WINDOW)
    size = np.minimum(WINDOW, len(ids) - first)
    vocabulary = list(number)

    by = np.zeros((len(number), n_labels))
    np.add.at(by, (ids, gold), 1)
    lexicon = {}
    for y in range(n_labels):
        sure = np.flatnonzero((by[:, y] >= 5) & (by[:, y] >= 0.8 * by.sum(axis=1)))
        for i in sure[np.argsort(-by[sure, y], kind="stable")[:LEXICON]]:
            lexicon[vocabulary[i]] = y
    lex = np.array([lexicon.get(w, -1) for w in vocabulary])
    pairs = features(vocabulary)
    word = np.concatenate([a for a, _ in pairs])
    slot = np.concatenate([s for _, s in pairs])

    model = Model(labels, np.zeros((1 << BITS, n_labels), np.float32), np.zeros((n_labels, n_labels), np.float32), lexicon, np.zeros((n_labels, n_labels)), np.zeros(n_labels), np.bincount(slot, minlength=1 << BITS) > 0)
    moved = [np.full_like(x, 1e-3, np.float64) for x in (model.weights, model.lexicon_weights, model.transition, model.start)]
    inner = np.ones(len(ids), bool)
    inner[first] = False
    inner_at = np.flatnonzero(inner)
    for _ in range(epochs):
        score = np.zeros((len(number), n_labels), np.float32)
        for a, s in pairs:
            score[a] += model.weights[s]
        score[lex >= 0] += model.lexicon_weights[lex[lex >= 0]]
        expected = np.zeros((n_labels, n_labels))
        p = marginals(score[ids], first, size, model.transition, model.start, expected)
        rest = -p
        rest[np.arange(len(ids)), gold] += 1
        per_word = np.stack([np.bincount(ids, rest[:, y], len(number)) for y in range(n_labels)], axis=1)
        g_weights = np.stack([np.bincount(slot, per_word[word, y], 1 << BITS) for y in range(n_labels)], axis=1) - 1e-2 * model.weights
        g_lex = np.zeros((n_labels, n_labels))
        np.add.at(g_lex, lex[lex >= 0], per_word[lex >= 0])
        seen = np.zeros((n_labels, n_labels))
        np.add.at(seen, (gold[inner_at - 1], gold[inner_at]), 1)
        g_move = seen - expected
        g_start = rest[first].sum(axis=0)
        for x, g, m in zip((model.weights, model.lexicon_weights, model.transition, model.start), (g_weights, g_lex, g_move, g_start), moved, strict=True):
            m += g * g
            x += (0.5 * g / np.sqrt(m)).astype(x.dtype)
    return model


def label(texts: list[str | None], model: Model, known: dict[str, int], table_: list[np.ndarray]) -> tuple[list[str], list[float], list[float]]:
    """Language, mean probability and mean share of known features of each text. known, table_: a worker's remembered words and their emissions."""
    found = [words_of(t) for t in texts]
    size = np.array([len(f) for f in found], np.int64)
    flat = [w for f in found for w in f]
    pred, score, sure = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    if not flat:
        return pred, score, sure
    ids = [known.get(w, -1) for w in flat]
    if -1 in ids:
        new = sorted({w for w, i in zip(flat, ids, strict=True) if i < 0})
        if len(known) + len(new) > CACHED:
            known.clear()
            table_[:] = [np.zeros((0, len(model.labels) + 1), np.float32)]
            new = sorted(set(flat))
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        table_[:] = [np.concatenate([*table_, emissions(new, model)])]
        ids = [known[w] for w in flat]
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    some = np.flatnonzero(size)
    rows = table_[0][np.array(ids)]
    p = marginals(rows[:, :-1], first[some], size[some], model.transition, model.start)
    mean = np.add.reduceat(p, first[some]) / size[some][:, None]
    met = np.add.reduceat(rows[:, -1].astype(np.float64), first[some]) / size[some]
    best = mean.argmax(axis=1)
    for i, b, m, k in zip(some, best, mean, met, strict=True):
        pred[i], score[i], sure[i] = model.labels[b], float(min(1.0, m[b])), float(min(1.0, k))
    return pred, score, sure


def label_all(texts: list[str | None], model: Model | None, known: dict[str, int], table_: list[np.ndarray]) -> tuple[list[str], list[float], list[float]]:
    """``label`` for texts of any total length, about ``BLOCK_CHARS`` at a time. Without a model everything is ``und``."""
    if model is None:
        return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    if not table_:
        table_.append(np.zeros((0, len(model.labels) + 1), np.float32))
    out, i = ([], [], []), 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j] or "") <= BLOCK_CHARS):
            held += len(texts[j] or "")
            j += 1
        for all_, some in zip(out, label(texts[i:j], model, known, table_), strict=True):
            all_ += some
        i = j
    return out


def sample(labelled: DataFrame, per_language: int, text_col: str, lang_col: str, id_col: str) -> list[tuple[str, str]]:
    """About ``per_language`` rows of each language, fewer where there are many languages, by a hash of the id: a bounded sample, the same every time."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # a row for each language
    if not counts:
        return []
    each = max(2, min(per_language, SAMPLE_DOCS // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, each / n))])
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col(id_col)), 11) / float(1 << 53)
    got = rows.filter(uniform < share[F.col(lang_col)]).select(id_col, F.left(F.col(text_col), F.lit(MOST_CHARS)).alias(text_col), lang_col)
    got = got.orderBy(F.xxhash64(F.lit(12), F.col(id_col)), text_col).limit(2 * each * len(counts)).collect()
    return [(r[1], r[2]) for r in got]


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, lang_pred, score, known) of every row."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m, words, table_ = shared.value, {}, []
        for batch in batches:
            pred, score, known = label_all(batch.column(1).to_pylist(), m, words, table_)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())], [id_col, "lang_pred", "score", "known"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double, known double")


def recognised(docs: DataFrame, model: Model | None, least: float, text_col: str = "text", least_known: float = 0.0) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose language is recognised with at least that mean probability and share of known features: one pass, no join."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m, words, table_ = shared.value, {}, []
        for batch in batches:
            found = label_all(batch.column(at).to_pylist(), m, words, table_)
            yield batch.filter(pa.array([p != "und" and s >= least and k >= least_known for p, s, k in zip(*found, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is not learned from: crc32 of the id as text, modulo 4, is 2. A null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model | None:
    return train(sample(docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col)), DOCS_PER_LANGUAGE, text_col, lang_col, id_col))


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "known")
