"""Pairs, groups and repeated passages against brute force: op4, op5 and op8 beyond their registered parameters."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelens.llm import graph, op4_jaccard, op5_minhash, op8_substring
from pagelens.session import table
from tests.llm.test_llm import DDL, brute_components, corpus, words

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def shingles(text, k):
    low = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(low[i : i + k]) for i in range(len(low) - k + 1)) or (frozenset([tuple(low)]) if low else frozenset())


def links(sets, percent):
    by, met = {}, Counter()
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for ids in by.values():
        met.update((i, j) for n, i in enumerate(ids) for j in ids[n + 1 :])
    return {p for p, both in met.items() if 100 * both >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - both)}


def test_fingerprints_carry_their_groups(spark, docs, empty):
    rows = corpus()
    out = op5_minhash.fingerprint_documents(docs.withColumnRenamed("lang", "node").withColumnRenamed("source", "component_id")).collect()
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter({(i, c): n for (i, _, c), n in brute_components(rows, 5, 80).items()})
    plain = Counter(map(tuple, op5_minhash.compare_with_next(docs).collect()))
    assert Counter(tuple(r)[:-1] for r in out) == plain
    by_text = {}
    for i, t, *_ in rows:
        by_text.setdefault(t or "", set()).update(r.fingerprint for r in out if r.doc_id == i and i is not None and sum(x[0] == i for x in rows) == 1)
    assert all(len(x) <= 1 for x in by_text.values()) and sum(len(x) for x in by_text.values()) > 50
    assert op5_minhash.fingerprint_documents(empty).count() == 0


def test_fingerprints_take_whole_numbers_only(spark, docs):
    got = op5_minhash.compare_with_next(docs.withColumn("doc_id", F.col("doc_id").cast("int")))
    assert dict(got.dtypes)["doc_id"] == "int" and got.count() == docs.count()
    with pytest.raises(TypeError):
        op5_minhash.compare_with_next(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_groups_find_the_links_of_real_tables(spark):
    """Recall of links at 0.8 on a whole table against brute force: 0.9 at least; no document is grouped that brute force does not group."""
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    sets = [shingles(r.text, 5) for r in rows]
    near = links(sets, 80)
    component = {r.doc_id: r.component_id for r in op5_minhash.near_duplicates(table(spark, SF, "documents")).collect()}
    found = sum(component[rows[i].doc_id] == component[rows[j].doc_id] for i, j in near)
    assert len(near) > 50 and found >= 0.9 * len(near)
    want = {i: c for i, _, c in brute_components([(r.doc_id, r.text) for r in rows], 5, 80)}
    assert all(want[i] <= c for i, c in component.items())


def test_every_link_of_the_join(spark, docs, empty):
    rows = corpus()
    found, members = op4_jaccard.jaccard_links(docs)
    node = {}
    sets = list({shingles(t, 4) for _, t, *_ in rows if shingles(t, 4)})
    of = {}
    for r in members.collect():
        node.setdefault(r.doc_id, set()).add(r.node)
    for i, t, *_ in rows:
        if len(node[i]) == 1:
            of[shingles(t, 4)] = next(iter(node[i]))
    want = {tuple(sorted((of[sets[i]], of[sets[j]]))) for i, j in links(sets, 85) if sets[i] in of and sets[j] in of}
    got = {tuple(r) for r in found.collect()}
    assert want and want <= got and len(got) == len(links(sets, 85))
    assert op4_jaccard.jaccard_links(empty)[0].count() == 0


@pytest.mark.parametrize("window", [1, 40, 66, 130])
def test_windows_of_any_length(spark, window):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    passage = [r.choice(vocabulary) for _ in range(300)]
    rows = []
    for i in range(24):
        at, size = r.randrange(0, 150), r.choice([20, 64, 90, 150])
        body = [f"{i}x{j}" for j in range(r.choice([0, 5, 90]))] + passage[at : at + size] + [f"{i}y{j}" for j in range(r.choice([0, 70]))]
        rows.append((i, " ".join(body)))
    count = Counter(tuple(w[j : j + window]) for _, t in rows for w in [words(t)] for j in range(len(w) - window + 1))
    want = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if count[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        want[i] = sum(gone)
    out = op8_substring.removed_words(spark.createDataFrame(rows, "doc_id long, text string"), window).collect()
    assert {x.doc_id: x.n_removed for x in out} == want


def test_components_in_one_task_and_in_rounds(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (1000, 1001)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {x: find(x) for x in list(parent)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    for small in (0, 10_000):
        assert {x.node: x.comp for x in graph.components(df, small).collect()} == want
    assert graph.components(df.limit(0)).count() == 0


def test_salted_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_KEYS", 5)
    left = spark.range(200).select(F.when(F.col("id") < 120, 1).otherwise(F.col("id") % 7).cast("long").alias("k"), "id")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k long, v string")
    weights = left.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = graph.salted_join(left, right, "k", weights, F.col("id"), how)
        assert got.columns == ["k", "id", "v"]
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, left.join(right, "k", how).collect()))


def test_short_shingles_keep_their_order():
    import numpy as np

    s = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 500, dtype=np.uint64))
    assert (graph.long(graph.short(s)) == s >> np.uint64(24) << np.uint64(24)).all() and len(graph.short(s)) == 2500
