"""Words of UTF-8 text as numpy arrays, straight from Arrow's buffers.

A word is ``[^\\x20\\x09-\\x0D]+``. Texts are worked in blocks of about ``BLOCK`` bytes (a longer text is a block of its own),
so memory follows the block and not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64): spreads every bit over the whole word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 2 * BLOCK)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


class Block(NamedTuple):
    """Rows [row, row + len(offsets) - 1) of a batch: their bytes, and where each text starts and ends in them."""

    row: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Words of a block in order: start and end byte, text they belong to, 64-bit hash; first[i]: first word of text i."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def blocks(column: pa.Array | pa.ChunkedArray, most: int = BLOCK) -> Iterator[Block]:
    """Blocks of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_string()).fill_null("")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(offs, offs[row] + most, "right")) - 1))
        yield Block(row, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row])
        row = end


def words(block: Block, lower: bool = False) -> Words:
    data, offsets = block.data, block.offsets
    n, docs = len(data), len(offsets) - 1
    if lower:
        data = LOWER[data]
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64))
    inside = ~SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power_table(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * U(0xA24BAED4963EE407))
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(start, end, doc, hashed, np.searchsorted(doc, np.arange(docs + 1)))


_STEP = [pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) | 1 for k in range(64)]


def grams(hashed: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words inside one text, and the index of its first word."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        for j in range(k):
            out += hashed[at + j] * U(_STEP[j])
    return mix(out + U(k)), at


def shingle_sets(w: Words, docs: int, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; a text of fewer words has its whole sequence as the one shingle."""
    h, at = grams(w.hash, w.doc, k)
    edge = np.searchsorted(w.doc[at], np.arange(docs + 1)) if len(at) else np.zeros(docs + 1, np.int64)
    out = []
    for i in range(docs):
        a, b = edge[i], edge[i + 1]
        if b > a:
            out.append(np.unique(h[a:b]))
            continue
        own = w.hash[w.first[i] : w.first[i + 1]]
        if not len(own):
            out.append(np.zeros(0, np.uint64))
            continue
        with np.errstate(over="ignore"):
            one = sum((x * U(_STEP[j]) for j, x in enumerate(own)), U(0)) + U(1000 + len(own))
        out.append(mix(np.array([one], np.uint64)))
    return out
