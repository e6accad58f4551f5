"""Operators on small fixtures against brute force, exact round trips and held-out accuracy; nulls, empties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from pagelens.llm import op1_langid, op2_lines, op3_bpe, op4_jaccard, op5_minhash, op6_mixing, op7_licenses, op8_substring, op9_fertility, op10_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def corpus(n=120, seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(["ta", "re", "ion", "the", "ing", "ou", "é"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        body = [r.choice(vocabulary) for _ in range(r.choice([3, 20, 60, 150]))]
        if i % 5 == 0:
            body[len(body) // 2 : len(body) // 2] = passage
        if i % 7 == 0 and rows:
            body = words(rows[r.randrange(len(rows))][1]) or body
            if i % 14 == 0 and len(body) > 30:
                body = [*body[:-1], "changed"]
        text = " ".join(body).replace("ou ", "ou\n")
        rows.append((i, text, "en", f"src{i % 9}", len(text)))
    return rows + [(n, None, None, None, None), (n + 1, "", "en", "src1", 0), (n + 2, " \n\t ", None, "src2", 4), (None, "Ta re ion the ing", "en", None, 3), (3, rows[3][1], "en", "src3", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def test_bpe_is_as_the_library_encodes(spark, docs, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = op3_bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ["a" * 3000, "日本語 テキスト" * 50, "x1 y2\n\n  z'll 'S <|endoftext|>  ", "ab" * 700]:
        c = op3_bpe.codec(path, P.PATTERN)
        ids = c.encode(text)
        assert ids.tolist() == library.encode_ordinary(text) and c.decode(ids) == text.encode()
    for r in op3_bpe.encode_documents(docs, path, P.PATTERN).collect():
        assert r.token_ids == library.encode_ordinary(bytes(r.decoded).decode())
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in op3_bpe.digests(op3_bpe.encode_documents(docs, path, P.PATTERN)).collect()}
    assert got == {(i, len(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in corpus()}
    assert op3_bpe.encode_documents(empty, path, P.PATTERN).count() == 0


def brute_components(rows, k=4, percent=85):
    sets = []
    for i, text, *_ in rows:
        w = words((text or "").translate(LOWER))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return Counter((i, len(s), least.get(find(a)) if s else i) for a, (i, s) in enumerate(sets))


def test_jaccard_components(spark, docs, empty):
    got = Counter(map(tuple, op4_jaccard.jaccard_components(docs.withColumnRenamed("source", "node").withColumnRenamed("lang", "comp")).collect()))
    assert got == brute_components(corpus())
    assert op4_jaccard.jaccard_components(empty).count() == 0


def test_jaccard_of_a_chain_of_near_copies(spark):
    r = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        if i % 3 == 0:
            base = base[:]
            base[r.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(base[: 80 - i % 4]), "en", "s", 1))
    got = Counter(map(tuple, op4_jaccard.jaccard_components(spark.createDataFrame(rows, DDL)).collect()))
    assert got == brute_components(rows)


def test_every_partner_shares_a_key():
    scheme, r, none = op4_jaccard.Scheme(), np.random.default_rng(5), np.zeros(0, np.uint64)
    for n in (6, 7, 8, 13, 30, 100, 700):
        for _ in range(30):
            s = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            most = scheme.difference(len(s))
            drop = int(r.integers(0, len(s) * 15 // 100 + 1))
            add = int(r.integers(0, max(1, most - drop + 1)))
            t = np.unique(np.concatenate([s[drop:], r.integers(0, 1 << 63, min(add, drop), dtype=np.uint64)]))
            both = len(np.intersect1d(s, t))
            if len(s) == len(t) == both or 100 * both < 85 * (len(s) + len(t) - both):
                continue
            (ka, ra), (kb, rb) = (op4_jaccard.keys_of(x, scheme, none) for x in (s, t))
            index = lambda k, role: set(k[role & 1 > 0].tolist())
            probe = lambda k, role: set(k[role & 2 > 0].tolist())
            assert index(ka, ra) & probe(kb, rb) or index(kb, rb) & probe(ka, ra)


def test_substring_dedup(spark, docs, empty):
    rows = corpus()
    count = Counter(tuple(w[j : j + 35]) for _, t, *_ in rows for w in [words(t)] for j in range(len(w) - 34))
    want = Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 34):
            if count[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = [True] * 35
        want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()] += 1
    out = op8_substring.removed_words(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text)) for r in out) == want
    assert op8_substring.removed_words(empty).count() == 0


def test_substring_hot_minimisers(spark, docs, monkeypatch):
    usual = Counter((r.doc_id, r.n_removed) for r in op8_substring.removed_words(docs).collect())
    monkeypatch.setattr(op8_substring, "HOT", 2)
    monkeypatch.setattr(op8_substring, "SHARD_SEGMENTS", 3)
    assert Counter((r.doc_id, r.n_removed) for r in op8_substring.removed_words(docs).collect()) == usual


def test_fm_index_counts():
    r = np.random.default_rng(2)
    text = np.r_[r.integers(1, 4, 200), 0]
    index = op8_substring.FMIndex(text, np.ones(len(text), np.int64))
    joined = "".join(map(str, text))
    for _ in range(50):
        pattern = r.integers(1, 4, int(r.integers(1, 6)))
        low, high = np.array([0]), np.array([index.n])
        for c in pattern[::-1]:
            low, high = index.step(np.array([c]), low, high)
        p = "".join(map(str, pattern))
        assert high[0] - low[0] == sum(joined.startswith(p, i) for i in range(len(joined)))


def test_minhash_next_and_edited(spark, docs, empty):
    rows = corpus()
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    out = op5_minhash.compare_with_next(docs).collect()
    want = Counter()
    for (i, t, *_), (_, f, *_) in zip(order, order[1:] + order[:1], strict=True):
        t, f = t or "", f or ""
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + f[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    assert all(0 <= x <= 1 for r in out for x in (r.near_edited, r.near_next))
    assert op5_minhash.compare_with_next(empty).count() == 0
    a, b = op5_minhash.permutations()
    one = [f"w{i}" for i in range(200)]
    two = [*one[:100], *(f"v{i}" for i in range(100))]
    x, y = (op5_minhash.signatures(block, a, b)[0] for block in op5_minhash._text_block([" ".join(one)]) + op5_minhash._text_block([" ".join(two)]))
    assert abs((x == y).mean() - 96 / (196 + 196 - 96)) < 0.12


def test_fertility_base_columns(spark, docs, empty):
    out = op9_fertility.fertility_rules(docs, P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    want = Counter()
    for i, t, *_ in corpus():
        w, t = words(t), t or ""
        lines = [x for x in t.split("\n") if words(x)]
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        hit = {j + d for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for d in range(3)}
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert not any(r.kept and r.base_failed for r in out)
    assert op9_fertility.fertility_rules(empty, P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_language_id(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = op1_langid.fit(docs)
    out = op1_langid.predict(docs, model).join(docs.select("doc_id", "lang", op1_langid.held_out().alias("held")), "doc_id").filter("held").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (None, "the of and")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in op1_langid.predict(odd, model).collect() if r.doc_id} == {1: "und", 2: "und", 3: "und"}
    assert op1_langid.recognised(odd, model, 0.3).count() == 1
    assert op1_langid.fit(empty) is None and op1_langid.predict(odd, None).filter("lang_pred <> 'und'").count() == 0


def test_marginals_are_exact():
    r = np.random.default_rng(0)
    scores, move, start = r.normal(size=(5, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    p = op1_langid.marginals(scores, np.array([0]), np.array([5]), move, start)
    want = np.zeros((5, 3))
    for path in np.ndindex(*[3] * 5):
        weight = math.exp(start[path[0]] + sum(scores[i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
        for i, y in enumerate(path):
            want[i, y] += weight
    assert np.allclose(p, want / want.sum(axis=1, keepdims=True))


def test_context_mixing(spark, docs, empty):
    rows = corpus()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [(i, [*words((t or "").translate(LOWER)), "\n"]) for i, t, *_ in rows]
    count = Counter(x for i, w in tokens if not held(i) for x in w)
    total, distinct = sum(count.values()), len(count)
    want = Counter((i, held(i), len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), 6)) for i, w in tokens)
    out = op6_mixing.score_documents(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 and 0 < r.bits_per_byte < 8 for r in out)
    assert op6_mixing.score_documents(empty).count() == 0


def test_bits_of_a_context_sum_to_one():
    tables = [np.abs(np.random.default_rng(k).normal(size=(2, 1 << b)).astype(np.float32)) for k, b in enumerate(op6_mixing.TABLE_BITS)]
    weights, _ = op6_mixing._initial()
    total = 0.0
    every = [bytes([c]) for c in range(256) if c != 0x20]
    s = op6_mixing.Spelling([*every, b" "])
    first = np.ones(len(every) + 1)
    for bit, slots in s.bits():
        inputs = np.full((len(slots) + 1, len(bit)), 0.3, np.float32)
        for k, x in enumerate(slots):
            inputs[k] = op6_mixing._stretch(tables[k][0][x], tables[k][1][x])
        seen = [op6_mixing._seen(tables[k][0][slots[k]] + tables[k][1][slots[k]]) for k in (op6_mixing.LONG, op6_mixing.LONG + 1)]
        _, p = op6_mixing._mixed(inputs, seen, s.start, weights)
        first *= np.where(bit == 1, p, 1 - p)[s.first]
    total = first.sum()
    assert abs(total - 1) < 1e-4


def test_line_dedup(spark, empty):
    line = "shared line here"
    rows = [(i, f"own {i}\n  {line} \n\nend {i}", "en", f"s{i % 8}" if i < 20 else None, 1) for i in range(24)] + [(50, None, None, None, None), (51, f"{line}\n{line}", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, DDL).withColumnRenamed("lang", "pos")
    out = {r.doc_id: r for r in op2_lines.remove_boilerplate(docs).collect()}
    assert out[0].n_removed == 0 and out[0].text == rows[0][1] and out[50].text is None and out[50].n_lines == 0
    assert all(out[i].text == f"own {i}\n\nend {i}" and out[i].n_removed == 1 for i in range(1, 24)) and out[51].text == ""
    assert op2_lines.remove_boilerplate(docs, min_sites=9).filter("n_removed > 0").count() == 0
    assert op2_lines.remove_boilerplate(empty).count() == 0


def test_licenses(spark, empty):
    texts = {
        1: "Intro.\nLicensed under the Apache License, Version 2.0.\nYou may obtain a copy of the License at x",
        2: "Permission is hereby granted, free of charge, to any person obtaining a copy of this. The above copyright notice and this permission notice shall be included.",
        3: "Redistribution and use in source and binary forms are ok. Redistributions of source code must retain the above copyright notice.\nRedistributions in binary form must reproduce the above copyright notice. Neither the name of X may be used to endorse or promote products.",
        4: "This work is licensed under the GNU General Public License, version 3. Released under the MIT License.",
        5: None,
        6: "A plain text.",
    }
    docs = spark.createDataFrame([(i, t, "a") for i, t in texts.items()], "doc_id long, text string, ids string")
    got = {r.doc_id: r.licenses for r in op7_licenses.scan_licenses(docs).collect()}
    assert got == {1: "Apache-2.0", 2: "MIT", 3: "BSD-3-Clause", 4: "GPL-3.0,MIT", 5: "", 6: ""}
    assert op7_licenses.scan_licenses(empty).count() == 0


def test_raking_meets_the_marginals():
    r = random.Random(4)
    cells = {(a, b): r.uniform(1, 9) for a in "xyz" for b in "pq"}
    goal = [{"x": 0.5, "y": 0.3, "z": 0.2}, {"p": 0.7, "q": 0.3}]
    w = op10_mix.rake(cells, goal)
    for d, target in enumerate(goal):
        for g, share in target.items():
            assert abs(sum(v for k, v in w.items() if k[d] == g) - share) < 1e-6
    p = op10_mix.probabilities(cells, w, 0.4)
    assert abs(sum(cells[k] * p[k] for k in p) - 0.4 * sum(cells.values())) < 1e-6


def test_mix(spark, docs, empty):
    out = op10_mix.mix_sources(docs)
    rows = out.collect()
    assert rows and all(0 < r.mix_probability <= 1 for r in rows) and set(docs.columns) <= set(out.columns)
    assert sorted(map(str, rows)) == sorted(map(str, op10_mix.mix_sources(docs.repartition(5)).collect()))
    assert op10_mix.mix_sources(empty).count() == 0


def test_mix_is_as_brute_force(spark):
    """Cells, calibrated weights, probabilities and the kept rows of a fixture, from plain loops over its rows."""
    r = random.Random(13)
    rows = [(i, " ".join(["w"] * r.choice([0, 3, 40, 200]) + ["!!"] * r.choice([0, 0, 30])), r.choice(["en", "de", "pl", None]), r.choice(["src0", "src1", None]), 1) for i in range(400)]
    rows += [(None, "a b", "en", "src0", 1), (None, "a b", "en", "src0", 1), (None, None, None, None, None), rows[5]]
    targets = {"source": {"src0": 0.5, "*": 0.5}, "lang": {"en": 0.6, "de": 0.3, "*": 0.1}, "topic": {"prose": 0.7, "shout": 0.3}}
    cell = {}
    for k, (i, t, lang, source, _) in enumerate(rows):
        t = t or ""
        cell[k] = (source if source == "src0" else "*", lang if lang in ("en", "de") else "*", "shout" if t.count("!") * 50 >= max(len(t), 1) else "prose"), len(words(t))
    tokens = Counter()
    for key, n in cell.values():
        tokens[key] += n
    w = {k: n / sum(tokens.values()) for k, n in tokens.items() if n}
    for _ in range(3000):
        for d, target in enumerate(targets.values()):
            now = Counter()
            for k, x in w.items():
                now[k[d]] += x
            w = {k: x * target[k[d]] / now[k[d]] for k, x in w.items()}
    low, high = 0.0, 1e9
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(tokens[k], mid * x) for k, x in w.items()) < 0.5 * sum(tokens.values()) else (low, mid)
    chance = {k: min(1.0, high * x / tokens[k]) for k, x in w.items()}
    docs = spark.createDataFrame(rows, DDL)
    from pyspark.sql import functions as F

    hashed = {(x.doc_id, x.text): x.h for x in docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(7), "text")).otherwise(F.xxhash64(F.lit(7), "doc_id")).alias("h")).collect()}
    want = Counter()
    for k, (i, t, *_) in enumerate(rows):
        p = chance.get(cell[k][0], 1.0)
        if ((hashed[i, t] % (1 << 64)) >> 11) / (1 << 53) < p:
            want[i, t, cell[k], round(p, 6)] += 1
    got = op10_mix.mix_sources(docs.withColumn("mix_topic", F.lit("old")).repartition(5), targets, 0.5, 7).collect()
    assert Counter((x.doc_id, x.text, ((x.mix_source, x.mix_lang, x.mix_topic), x.mix_tokens), round(x.mix_probability, 6)) for x in got) == want and 100 < len(got) < 400
    for name, part in (("source", {"src0": 1.0}), ("lang", {"en": 0.6, "de": 0.4})):
        with pytest.raises(ValueError, match="without a target"):
            op10_mix.mix_sources(docs, targets | {name: part})


def test_marginals_that_cannot_hold_are_an_error():
    with pytest.raises(ValueError, match="cannot all be met"):
        op10_mix.rake({("a", "x"): 5.0, ("b", "y"): 5.0}, [{"a": 0.9, "b": 0.1}, {"x": 0.1, "y": 0.9}])


def test_pipeline_stages(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    now = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, now, "/root/testdata/sf0.001")
        assert after.columns == docs.columns, name
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in now.collect()}
        now = spark.createDataFrame(after.collect(), docs.schema)
    out = pipeline.STAGES[-1][1](spark, now, "")
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in now.collect())


def test_minhash_near_duplicates(spark, docs, empty):
    want = {(i, c) for i, _, c in brute_components(corpus(), 5, 80)}
    got = {tuple(r) for r in op5_minhash.near_duplicates(docs).collect()}
    assert len(got & want) >= 0.98 * len(want)
    assert op5_minhash.near_duplicates(empty).count() == 0


def test_predictors_count_every_training_word(spark, monkeypatch):
    r = random.Random(8)
    found = {"".join(r.choice("abcé") for _ in range(r.randint(1, 9))).encode(): r.choice([0, 1, 1, 2, 5]) for _ in range(300)}
    monkeypatch.setattr(op6_mixing, "PACK_BYTES", 300)
    monkeypatch.setattr(op6_mixing, "SHARD_ENTRIES", 500)
    table = spark.createDataFrame(list(found.items()), "word binary, c long").repartition(3).sortWithinPartitions("word")
    packs = op6_mixing.packs_of(table, sum(map(len, found)) + len(found)).cache()
    counted = op6_mixing.count_entries(packs, sum(map(len, found)) + len(found))
    contexts = lambda w, i: [w[max(0, i - n) : i].rjust(n, b"\0") for n in (1, 2, 3, 5)] + [w[:i]]
    want = Counter()
    for word, c in found.items():
        for i, b in enumerate(word + b" "):
            for k, x in enumerate(contexts(word, i)):
                want.update({(k, x, j, b >> (8 - j)): c for j in range(9)})
    rows = op6_mixing.told(packs, counted, 4).toArrow().to_batches()
    met = []
    for mine, counts, s, entry, levels in op6_mixing.counted_packs(rows):
        met += list(zip(mine, counts.astype(int).tolist(), strict=True))
        at = 0
        for word in mine:
            for i, b in enumerate(word + b" "):
                for k, x in enumerate(contexts(word, i)):
                    assert [want[k, x, j, b >> (8 - j)] for j in range(9)] == levels[:, entry[k, at]].tolist()
                at += 1
    assert dict(met) == found and len(met) == len(found) and packs.count() > 3 and counted.select("shard").distinct().count() > 3


def test_two_byte_predictor_is_mixed():
    s = op6_mixing.Spelling([b"abxy", b"cbxy", b"abz"])
    entry, at = s.entries()
    assert len(entry) == at.max() + 1 and at.shape == (5, 14) and op6_mixing._initial()[0].shape[1] == 6
    same = lambda k: [(i, j) for i in range(14) for j in range(i) if at[k, i] == at[k, j]]
    assert (7, 2) in same(0) and (7, 2) not in same(1) and (8, 3) in same(1) and (8, 3) not in same(2)


def test_pipeline_links_near_copies_of_five_words(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    one = [f"w{i}" for i in range(200)]
    # A replaced passage of 17 words takes 21 of 196 five-word shingles: 175 / 217 = 0.806; of four words 177 / 217 = 0.816, below 0.85.
    two = [*one[:80], *(f"x{i}" for i in range(17)), *one[97:]]
    # 20 words: 172 / 220 = 0.782 is no link.
    three = [*one[:80], *(f"y{i}" for i in range(20)), *one[100:]]
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate((one, two, three))]
    assert brute_components(rows, 4, 85) == Counter({(0, 197, 0): 1, (1, 197, 1): 1, (2, 197, 2): 1})
    kept = pipeline.jaccard_dedup(spark, spark.createDataFrame(rows, DDL), "")
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in brute_components(rows, 5, 80) if i == c} == {0, 2}


def test_licenses_without_trigger_words_and_several_in_a_sentence(spark):
    texts = {
        "This work is available under CC BY-SA 4.0.": "CC-BY-SA",
        "Released under the BSD 3-clause terms.": "BSD",
        "Released\n  under the 3-clause BSD terms.": "BSD",
        "CC0 1.0 Universal": "CC0",
        "Dataset released under CC BY 4.0": "CC-BY",
        "It is distributed under BSD": "BSD",
        "Creative Commons\tZero": "CC0",
        "Key 9acc0f and acc0unt, freed and given under no terms": "",
        "Code is released under the MIT License and data are released under CC BY-NC 4.0": "CC-BY-NC,MIT",
        "Licensed under the Apache License, Version 2.0 or the GNU General Public License, version 2": "Apache-2.0,GPL-2.0",
        "Under the GNU General Public License version 2 or later": "GPL-or-later",
        "GNU Lesser General Public License version 3": "LGPL",
        "GNU Affero General Public License version 3 and GNU General Public License version 2 and GNU General Public License version 3": "AGPL,GPL-2.0,GPL-3.0",
        "Available under CC BY-SA 4.0 or CC BY 4.0": "CC-BY,CC-BY-SA",
        "Copyright (c) 2020 A, all rights reserved": "Proprietary",
        "Copyright 2020 A, licensed under terms": "UnknownLicence",
        "Licensed under terms, all rights reserved": "Proprietary,UnknownLicence",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = op7_licenses.scan_licenses(docs).collect()
    assert {r.text: r.licenses for r in rows} == texts
    assert {r.unmatched for r in rows} == {"", "copyright"}


def test_minhash_links_that_miss_the_least_class(spark):
    r = random.Random(6)
    rows = []
    # A template of 400 words in families of two: near copies in a family (6 words differ), across only where passages meet (25 words differ), yet all share buckets.
    base = [f"t{i}" for i in range(400)]
    for family in range(60):
        at = r.randrange(0, 375)
        own = [*base[:at], *(f"f{family}x{i}" for i in range(25)), *base[at + 25 :]]
        for member in range(2):
            at = r.randrange(0, 394)
            rows.append((len(rows), " ".join([*own[:at], *(f"m{family}y{member}z{i}" for i in range(6)), *own[at + 6 :]]), "en", "s", 1))
    want = {(i, c) for i, _, c in brute_components(rows, 5, 80)}
    got = {tuple(x) for x in op5_minhash.near_duplicates(spark.createDataFrame(rows, DDL)).collect()}
    assert got == want and len({c for _, c in want}) == 40


def test_pipeline_stages_keep_what_brute_force_keeps(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    kept = lambda stage, rows: Counter(map(tuple, stage(spark, spark.createDataFrame(rows, DDL).repartition(3), "").collect()))
    line = "shared line here"
    rows = corpus() + [(1000 + i, f"own {i}\n {line}\n\nend {i}", "en", f"s{i % 8}", 5) for i in range(16)] + [(1100, line, "en", "s1", 5)]

    assert kept(pipeline.language_id, rows) == Counter(x for x in rows if words(x[1]))

    parts = [(x, [(p, y.strip("\t\n\x0b\f\r ")) for p, y in enumerate(x[1].split("\n"))] if x[1] is not None else []) for x in rows]
    sites, first = {}, {}
    for x, mine in parts:
        for p, y in mine:
            sites.setdefault(y, set()).add(x[3])
            place = (x[0] is not None, x[0] or 0, p)
            first[y] = min(first.get(y, place), place)
    want = Counter()
    for x, mine in parts:
        gone = {p for p, y in mine if y and len(sites[y] - {None}) >= op2_lines.MIN_SITES and (x[0] is not None, x[0] or 0, p) != first[y]}
        if gone and len(gone) == sum(1 for _, y in mine if y):
            continue
        text = "\n".join(y for p, y in enumerate(x[1].split("\n")) if p not in gone) if gone else x[1]
        want[(x[0], text, x[2], x[3], len(text) if gone else x[4])] += 1
    assert kept(pipeline.line_dedup, rows) == want and sum(want.values()) < len(rows)

    component = {i: c for i, _, c in brute_components(rows, 5, 80)}
    want = Counter(x for x in rows if component[x[0]] == x[0])
    assert kept(pipeline.jaccard_dedup, rows) == want and sum(want.values()) < len(rows)
