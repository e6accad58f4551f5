"""Quality rules by tokeniser fertility.

Public vocabularies measure how a text breaks into tokens: characters per token (of a piece vocabulary with byte fallback and
of a byte-level BPE), the share of byte-fallback tokens, and the entropy of the text's own token distribution. Each script has
rejection bands; a text outside its script's band on any measure is rejected. Base rules (too few words, too many repeated
words) come first. The bands are wide: they are meant for encodings gone wrong, random strings, loops and lists, not for style.

Cases: a null or empty text has no words and fails the base rules; texts of any length are measured whole; repeated rows
repeat their result; an empty table gives an empty one; the result carries the id and the operator's columns only.
"""

from __future__ import annotations

from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagelens.llm import words as W
from pagelens.session import prepare, table


class Band(NamedTuple):
    """Least and most characters per token for the piece and the byte vocabulary, most byte-fallback share, least token entropy in bits at so many tokens (linear in the logarithm between the knots; none under the first)."""

    piece: tuple[float, float]
    byte: tuple[float, float]
    fallback: float
    entropy: tuple[tuple[float, float], ...]

    def holds(self, tokens: int, per_piece: float, per_byte: float, fallback: float, entropy: float) -> bool:
        at, least = zip(*self.entropy, strict=True)
        floor = 0.0 if tokens < at[0] else float(np.interp(np.log2(tokens), np.log2(at), least))
        return self.piece[0] <= per_piece <= self.piece[1] and self.byte[0] <= per_byte <= self.byte[1] and fallback <= self.fallback and entropy >= floor


#: Prose uses ever more of a vocabulary as it goes on; lists, loops and markup do not.
GROWTH = ((100, 4.6), (150, 5.3), (300, 5.55), (600, 5.9), (1200, 6.15), (2400, 6.25))
#: By script of most letters. All limits are parameters.
BANDS = {
    "latin": Band((1.25, 12.0), (1.25, 14.0), 0.15, GROWTH),
    "alphabetic": Band((0.6, 12.0), (0.4, 14.0), 0.40, ((200, 3.0),)),
    "wide": Band((0.25, 8.0), (0.25, 8.0), 0.85, ((200, 3.0),)),
}
MIN_WORDS = 50
MOST_REPEATED = 50
CACHED = 150_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_loaded: dict = {}


class Fertility:
    """Token measures of words, remembered for a bounded number of words (two generations)."""

    def __init__(self, piece_path: str, byte_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        from pagelens.llm.op3_bpe import load_ranks

        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.byte = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(byte_path), special_tokens={})
        self.fallback = np.array([self.piece.is_byte(i) for i in range(self.piece.get_piece_size())])
        self.young: dict[bytes, tuple[bytes, int]] = {}
        self.old: dict[bytes, tuple[bytes, int]] = {}

    def measures(self, found: list[bytes]) -> list[tuple[bytes, int]]:
        """Piece ids (native int32) and number of byte-level tokens of each word."""
        got = self.young.get
        parts = [got(w) for w in found]
        if None in parts:
            known = self.learn({w for w, p in zip(found, parts, strict=True) if p is None})
            parts = [p or known[w] for w, p in zip(found, parts, strict=True)]
        return parts

    def learn(self, missing: set[bytes]) -> dict[bytes, tuple[bytes, int]]:
        known = {w: p for w in missing if (p := self.old.get(w))}
        new = sorted(missing - known.keys())
        texts = [w.decode(errors="replace") for w in new]
        pieces = self.piece.encode(texts, num_threads=1)
        sizes = [len(self.byte.encode_ordinary(f" {t}")) for t in texts]
        for w, p, n in zip(new, pieces, sizes, strict=True):
            known[w] = array("i", p).tobytes(), n
        if len(self.young) + len(known) > CACHED:
            self.old, self.young = self.young, {}
        self.young |= known
        return known


def _fertility(*paths: str) -> Fertility:
    if paths not in _loaded:
        _loaded[paths] = Fertility(*paths)
    return _loaded[paths]


def repeated_words(hashed: np.ndarray, doc: np.ndarray, docs: int, k: int = 3) -> np.ndarray:
    """Words of each text in k-word windows that are found twice or more in it."""
    h, at = W.grams(hashed, doc, k)
    if not len(h):
        return np.zeros(docs, np.int64)
    with np.errstate(over="ignore"):
        key = h + doc[at].astype(np.uint64) * W.U(0x9E3779B97F4A7C15)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashed), bool)
    for j in range(k):
        covered[at[twice] + j] = True
    return np.bincount(doc[covered], minlength=docs)


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def scripts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Script of most letters, told by the lead bytes of the encoding; Latin where there is none."""

    def per_text(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    latin = per_text(_LETTER[data] | ((data >= 0xC3) & (data < 0xCD)))
    alphabetic = per_text((data >= 0xCD) & (data < 0xE0))
    wide = per_text((data >= 0xE0) & (data != 0xE2))
    return [("latin", "alphabetic", "wide")[int(np.argmax(x))] for x in zip(latin, alphabetic, wide, strict=True)]


SCHEMA = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("script", pa.string()), ("chars_per_piece", pa.float64()), ("chars_per_byte_token", pa.float64()), ("fallback_share", pa.float64()), ("token_entropy", pa.float64())])
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, chars_per_piece double, chars_per_byte_token double, fallback_share double, token_entropy double"


def measure(block: W.Block, fertility: Fertility, bands: dict[str, Band]) -> pa.RecordBatch:
    w, docs = W.words(block), len(block.offsets) - 1
    data, offsets = block.data, block.offsets

    def per_text(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    n_words = np.diff(w.first)
    chars = per_text(~W.SEPARATOR[data] & ((data & 0xC0) != 0x80))
    symbols = per_text(SYMBOLS[data])
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    lines = [duplicate_lines(t) for t in texts]
    repeats = repeated_words(w.hash, w.doc, docs)
    failed = (n_words < MIN_WORDS) | (100 * repeats > MOST_REPEATED * n_words)
    names = scripts(data, offsets)
    parts = fertility.measures([raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)])
    per_piece, per_byte, share, entropy, kept = [], [], [], [], []
    for i in range(docs):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if a == b:
            per_piece.append(0.0), per_byte.append(0.0), share.append(0.0), entropy.append(0.0), kept.append(False)
            continue
        ids = np.frombuffer(b"".join([p[0] for p in parts[a:b]]), np.int32)
        n_byte = sum([p[1] for p in parts[a:b]])
        n = max(1, len(ids))
        counts = np.unique(ids, return_counts=True)[1]
        bits = float(np.log2(n) - (counts * np.log2(counts)).sum() / n)
        per_piece.append(float(chars[i]) / n)
        per_byte.append(float(chars[i]) / max(1, n_byte))
        share.append(float(fertility.fallback[ids].mean()) if len(ids) else 0.0)
        entropy.append(bits)
        inside = bands[names[i]].holds(n, per_piece[-1], per_byte[-1], share[-1], bits)
        kept.append(bool(inside and not failed[i]))
    columns = [n_words, chars, symbols, lines, repeats, failed, kept, names, per_piece, per_byte, share, entropy]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def fertility_rules(docs: DataFrame, piece_path: str, byte_path: str, pattern: str, bands: dict[str, Band] = BANDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, base counts, base_failed, kept, script and the token measures) of every row."""
    prepare(docs.sparkSession)

    def run(batches):
        f = _fertility(piece_path, byte_path, pattern)
        for batch in batches:
            for block in W.blocks(batch.column(1)):
                out = measure(block, f, bands)
                ids = batch.column(0).slice(block.row, len(block.offsets) - 1)
                yield pa.RecordBatch.from_arrays([ids, *out.columns], [id_col, *out.schema.names])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, {_DDL}")


def op9_fertility(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return fertility_rules(table(spark, sf_dir, "documents"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
