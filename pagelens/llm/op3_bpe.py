"""Byte-level BPE encoding and decoding.

A segment tree over the byte positions of a piece stores, for every live position, the rank of the pair that starts there;
its root is the leftmost pair of minimum rank. A merge changes the pair ranks of two live neighbours and removes one
position: three point updates of logarithmic cost. Pieces come from the vocabulary's pattern, each encoded on its own.

Cases: a null text is empty (no ids, empty bytes); text of any length is encoded whole; repeated rows give repeated results;
other columns of the input are not touched and never clash, as the result carries only ``id_col`` and the operator's columns.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.session import prepare, table

#: Pieces in a generation of a worker's cache: a bound of memory, not of the input.
CACHED = 300_000
_NONE = 1 << 62
_loaded: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the leftmost pair of least rank until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    get = ranks.get
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i  # the least key is the least rank, leftmost
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 2))
    before = list(range(-1, n))

    def put(at: int, key: int) -> None:
        at += size
        tree[at] = key
        while at > 1:
            other = tree[at ^ 1]
            at >>= 1
            if other < key:
                key = other
            if tree[at] == key:
                return
            tree[at] = key

    while (root := tree[1]) < _NONE:
        i = root & (size - 1)
        j = after[i]
        k = after[j]
        after[i] = k
        if k <= n:
            before[k] = i
        put(j, _NONE)
        r = get(piece[i : after[k]]) if k < n else None
        put(i, _NONE if r is None else r * size + i)
        p = before[i]
        if p >= 0:
            r = get(piece[p:k])
            put(p, _NONE if r is None else r * size + p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder for one vocabulary, with a bounded cache of pieces (two generations; the older one goes)."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.token = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        """Ids of a piece that is not in the young generation, as native int32."""
        out = self.old.get(text)
        if out is None:
            out = array("i", encode_piece(text.encode(), self.ranks)).tobytes()
        if len(text) <= 64:
            if len(self.young) >= CACHED:
                self.old, self.young = self.young, {}
            self.young[text] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        got, miss = self.young.get, self.piece
        return np.frombuffer(b"".join([got(p) or miss(p) for p in self.find(text)]), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids.tolist()])


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec(path, pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, token_ids array<int>, decoded binary) of every row."""
    prepare(docs.sparkSession)

    def run(batches):
        c = codec(vocabulary, pattern)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids or [np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(map(c.decode, ids), pa.binary())], [id_col, "token_ids", "decoded"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, token_ids array<int>, decoded binary")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The query's columns: number of tokens and digests of ids and decoded bytes."""
    return encoded.select(
        id_col,
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return digests(encode_documents(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))
