"""Verdicts of the fertility rules against measures taken word by word from the vocabularies, and at the bands' edges."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from pagelens.llm import op9_fertility as Q
from tests.llm.test_llm import words

DDL = "doc_id long, text string, kept string"
PATHS = (P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [prose(60), prose(400), prose(3000), "go on and on " * 60, " ".join(f"{r.getrandbits(64):x}" for _ in range(90)), " ".join(r.choice(["yes", "no", "so"]) for _ in range(400))]
    texts += [" ".join("".join(chr(r.randrange(0x4E00, 0x4E80)) for _ in range(4)) for _ in range(80)), " ".join("".join(chr(r.randrange(0x430, 0x450)) for _ in range(6)) for _ in range(80)), " ".join("\U0001f600\U0001f680" for _ in range(70)), "short text", "", None, prose(40_000)]
    return [(i, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], None), (None, texts[0], "y")]


def test_verdicts_are_as_brute_force(spark, rows):
    import sentencepiece
    import tiktoken

    from pagelens.llm.op3_bpe import load_ranks

    piece = sentencepiece.SentencePieceProcessor(model_file=PATHS[0])
    byte = tiktoken.Encoding("own", pat_str=PATHS[2], mergeable_ranks=load_ranks(PATHS[1]), special_tokens={})
    want = {}
    for i, t, _ in rows:
        found = words(t)
        ids = [x for w in found for x in piece.encode(w)]
        n, chars = len(ids), sum(map(len, found))
        if not found:
            want[i] = (0.0, 0.0, 0.0, 0.0, False)
            continue
        counts = Counter(ids)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        per_byte = chars / sum(len(byte.encode_ordinary(" " + w)) for w in found)
        share = sum(piece.is_byte(x) for x in ids) / n
        grams = Counter(tuple(found[j : j + 3]) for j in range(len(found) - 2))
        hit = {j + d for j in range(len(found) - 2) if grams[tuple(found[j : j + 3])] > 1 for d in range(3)}
        failed = len(found) < 50 or 100 * len(hit) > 50 * len(found)
        script = Q.scripts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
        want[i] = (chars / n, per_byte, share, entropy, Q.BANDS[script].holds(n, chars / n, per_byte, share, entropy) and not failed)
    out = Q.fertility_rules(spark.createDataFrame(rows, DDL).repartition(3), *PATHS).collect()
    assert len(out) == len(rows)
    for r in out:
        got = (r.chars_per_piece, r.chars_per_byte_token, r.fallback_share, r.token_entropy)
        assert got == pytest.approx(want[r.doc_id][:4], abs=1e-9) and r.kept == want[r.doc_id][4], r.doc_id
    verdicts = {r.doc_id: r.kept for r in out}
    assert verdicts[1] and verdicts[2] and verdicts[12] and not any(verdicts[i] for i in (3, 4, 5, 9, 10, 11))
    assert {r.doc_id: r.script for r in out}[6] == "wide" and {r.doc_id: r.script for r in out}[7] == "alphabetic"


def test_edges_of_a_band_are_inside():
    band = Q.Band((1.0, 4.0), (2.0, 5.0), 0.25, ((100, 3.0), (400, 5.0)))
    assert band.holds(100, 1.0, 2.0, 0.25, 3.0) and band.holds(400, 4.0, 5.0, 0.0, 5.0) and band.holds(200, 2.0, 3.0, 0.1, 4.0) and band.holds(9000, 2.0, 3.0, 0.1, 5.0) and band.holds(99, 2.0, 3.0, 0.1, 0.0)
    assert not any((band.holds(100, 0.99, 2.0, 0.2, 3.0), band.holds(100, 1.0, 5.01, 0.2, 3.0), band.holds(100, 1.0, 2.0, 0.26, 3.0), band.holds(200, 2.0, 3.0, 0.1, 3.99)))
