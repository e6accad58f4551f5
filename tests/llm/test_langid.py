"""Language identification: the gradient's expectations against enumeration, code-switched text, and the cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.llm import op1_langid as L

DDL = "doc_id long, text string, lang string"
PARTS = {"aa": ["ka", "ro", "mi", "tul"], "bb": ["sch", "ung", "ei", "pf"], "cc": ["ção", "lho", "nh", "ê"]}


def prose(lang, n, r):
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    r = random.Random(2)
    return L.train([(prose(lang, 80, r), lang) for lang in PARTS for _ in range(40)])


def test_expected_transitions_are_exact():
    r = np.random.default_rng(3)
    scores, move, start = r.normal(size=(9, 3)).astype(np.float32), r.normal(size=(3, 3)), r.normal(size=3)
    first, size = np.array([0, 4, 5]), np.array([4, 1, 4])
    got = np.zeros((3, 3))
    L.marginals(scores, first, size, move, start, got)
    want = np.zeros((3, 3))
    for f, n in zip(first, size, strict=True):
        paths = list(itertools.product(range(3), repeat=n))
        weight = np.array([np.exp(start[p[0]] + sum(scores[f + i, y] for i, y in enumerate(p)) + sum(move[x, y] for x, y in itertools.pairwise(p))) for p in paths])
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for x, y in itertools.pairwise(p):
                want[x, y] += w
    assert np.allclose(got, want, atol=1e-5)


def test_code_switched_words_have_their_own_labels(model):
    r = random.Random(5)
    right = total = 0
    for _ in range(20):
        plan = [lang for lang in r.sample(sorted(PARTS), 3) for _ in range(10)]
        words = L.words_of(" ".join(prose(lang, 1, r) for lang in plan))
        p = L.marginals(L.emissions(words, model)[:, :-1], np.array([0]), np.array([len(words)]), model.transition, model.start)
        right += sum(model.labels[y] == lang for y, lang in zip(p.argmax(axis=1), plan, strict=True))
        total += len(plan)
    assert right >= 0.95 * total
    assert all(model.transition[i, i] > model.transition[i, j] for i in range(3) for j in range(3) if i != j)


def test_numerals_are_no_letters(model):
    pred, score, known = L.label_all(["½ ² Ⅷ ①", "12 ٣ _ !", "m² ½ka"], model, {}, [])
    assert pred[:2] == ["und", "und"] and score[:2] == [0.0, 0.0] and pred[2] != "und"
    assert L.words_of("m² ½ka Ⅷ straße") == ["m", "ka", "straße"]


def test_text_of_no_learned_language_is_little_known(spark, model):
    r = random.Random(7)
    noise = " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(200))
    rows = [(1, prose("aa", 100, r), "x"), (2, noise, "x"), (3, None, None), (None, "", "x"), (5, prose("bb", 100, r), "x")]
    docs = spark.createDataFrame(rows, DDL)
    assert {x.doc_id for x in L.recognised(docs, model, 0.3, least_known=0.8).collect()} == {1, 5}
    got = {x.doc_id: x for x in L.predict(docs, model).collect()}
    assert got[1].known > 0.95 > 0.7 > got[2].known and got[1].lang_pred == "aa"


def test_ties_long_texts_repeats_and_clashing_columns(spark, model):
    r = random.Random(9)
    flat = model._replace(weights=np.zeros_like(model.weights), lexicon={}, transition=np.zeros((3, 3)), start=np.zeros(3))
    assert L.label_all(["xyz qqq"], flat, {}, [])[0] == ["aa"]
    long = prose("cc", 60_000, r)
    docs = spark.createDataFrame([(1, long, "q"), (1, long, "q"), (2, "ka ro", None)], "doc_id long, text string, lang_pred string").withColumn("score", F.lit("x")).withColumn("known", F.lit(1))
    got = L.predict(docs, model)
    assert got.columns == ["doc_id", "lang_pred", "score", "known"]
    rows = got.collect()
    assert [x.lang_pred for x in rows].count("cc") == 2 and len({x.score for x in rows if x.doc_id == 1}) == 1
    kept = L.recognised(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() == 3


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_DOCS", 30)
    r = random.Random(11)
    rows = [(i, prose(lang, 30, r) if lang != "cc" else prose(lang, 9_000, r), lang) for i, lang in enumerate(["aa"] * 40 + ["bb"] * 2 + ["cc"] * 3)]
    rows += [(100 + i, f"{c}{c}{c} {c}{c}", f"l{c}") for i, c in enumerate("defghijklm")]
    docs = spark.createDataFrame(rows + [(None, "ka", "aa"), (7, "ka", None)], DDL)
    got = L.sample(docs, 240, "text", "lang", "doc_id")
    assert {lang for _, lang in got} == {r[2] for r in rows} and max(len(t) for t, _ in got) <= L.MOST_CHARS
    assert sum(lang == "aa" for _, lang in got) <= 20
    assert L.train([]) is None and L.fit(docs.limit(0)) is None
    assert [x.lang_pred for x in L.predict(docs.limit(2), None).collect()] == ["und", "und"]
