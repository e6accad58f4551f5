"""Language-model scores: the match model against plain loops, any partitioning, and what the corpus has to teach."""

import math
import random
import zlib

import numpy as np
import pytest

from pagelens.llm import op6_mixing as M

DDL = "doc_id long, text string, source string, score double"


def prose(r, n):
    return " ".join("".join(r.choice(["ta", "re", "ion", "the", "ing", "ou", "é"]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = [(i, prose(r, r.choice([5, 40, 120])), "s", 0.0) for i in range(120)]
    return out + [(500, out[1][1] + " " + out[1][1], "s", 1.0), (None, None, None, None), (501, "", "s", None), (3, out[3][1], "t", 0.0)]


def test_the_match_model_is_as_plain_loops():
    r = random.Random(6)
    texts = [[r.randrange(1, 6) for _ in range(n)] + [0] for n in (0, 1, 7, 60, 200)] + [[1, 2, 3, 4] * 30 + [0]]
    spelt = np.array([-1.0, -2.0, -3.0, -400.0, -2.5, -0.5])
    want = []
    for t in texts:
        last, counts, was, before = {}, [list(x) for x in M.TRIED], 0, None
        for w in t:
            p = 10.0 ** spelt[w]
            if before in last:
                a, b = counts[was]
                share, right = a / b, last[before] == w
                want.append(math.log10((1 - share) * p + share) if right else spelt[w] + math.log10(1 - share))
                counts[was] = [a + right, b + 1]
                was = int(right)
            else:
                want.append(spelt[w])
                was = 0
            if before is not None:
                last[before] = w
            before = w
    tokens, size = np.concatenate([np.array(t) for t in texts]), np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    got = M.matched(tokens, size, first, spelt[tokens])
    assert np.allclose(got, want, atol=1e-9)


def test_any_partitioning_gives_the_same_scores(spark, rows, monkeypatch):
    monkeypatch.setattr(M, "PACK_BYTES", 400)
    monkeypatch.setattr(M, "SHARD_ENTRIES", 3_000)
    monkeypatch.setattr(M, "LEARNERS", (3, 5))
    docs = spark.createDataFrame(rows, DDL)
    got = []
    for parts, shuffles in ((1, 4), (7, 9), (50, 3)):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        got.append(sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score, r.base_score) for r in M.score_documents(docs.repartition(parts)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)


def test_order_and_repeats_of_words_count(spark, rows):
    r = random.Random(8)
    once = prose(r, 60)
    mixed = once.split()
    r.shuffle(mixed)
    docs = spark.createDataFrame([*rows, (600, f"{once} {once}", "s", 0.0), (601, f"{once} {' '.join(mixed)}", "s", 0.0)], DDL)
    got = {x.doc_id: x for x in M.score_documents(docs).collect()}
    assert got[600].n_tokens == got[601].n_tokens == 121 and abs(got[600].base_score - got[601].base_score) < 1e-9
    assert got[600].score > got[601].score + 20


def test_without_training_texts_and_with_long_words(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    rows = [(i, x, "s", 0.0) for i, x in zip(held, ["a b", None, "q" * 5_000, "z " * 30_000], strict=True)]
    got = {x.doc_id: x for x in M.score_documents(spark.createDataFrame(rows, DDL)).collect()}
    assert all(x.held_out and x.train_tokens == 0 and x.n_known == 0 and math.isfinite(x.score) and x.score < 0 for x in got.values())
    assert got[held[3]].n_tokens == 30_001 and got[held[1]].n_tokens == 1
