import random
from fractions import Fraction

import numpy as np

from speechframe.llm import near_duplicates, shingles
from tests.llm.test_decontaminate import words


def shingle_set(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(docs, threshold=Fraction(4, 5)):
    sets = [shingle_set(t) if d is not None else set() for d, t in docs]
    links = [[j for j in range(len(docs)) if j != i and sets[i] and sets[j] and Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= threshold] for i in range(len(docs))]
    group = list(range(len(docs)))
    for i, js in enumerate(links):
        for j in js:
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for (d, _), g in zip(docs, group, strict=True):
        least[g] = d if g not in least else min(least[g], d)
    return sorted(((d, least[g], len(n)) for (d, _), g, n in zip(docs, group, links, strict=True)), key=str)


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS class", "1 AS row", "2 AS signature")
    return sorted((tuple(r) for r in near_duplicates.digest(df).collect()), key=str)


def corpus(seed, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)] + ["É", "日本"]
    docs = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 40, 120]))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs), rng.choice([" ", ", "]).join(copy)))
    rng.shuffle(docs)
    return docs


def test_equals_brute_force(spark):
    docs = corpus(1) + [(900, None), (901, ""), (902, "!!"), (3, "only me here with this id"), (None, "w1 w2 w3 w4 w5 w6"), (904, "W1, w2 w3 w4 w5 w6"), (904, "W1, w2 w3 w4 w5 w6")]
    assert run(spark, docs) == brute(docs)


def test_small_blocks_and_shuffled_join_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_CLASSES", 3)
    monkeypatch.setattr(near_duplicates, "BROADCAST_ROWS", 0)
    docs = corpus(2)
    assert run(spark, docs) == brute(docs)


def forest_roots(nodes, edges):
    root = {n: n for n in nodes}
    for u, v in edges:
        a, b = root[u], root[v]
        root = {n: min(a, b) if r in (a, b) else r for n, r in root.items()}
    return root


def banded(spark, monkeypatch, groups, block, pairs=1 << 18):
    """Components by class of what the bands' comparison links, and the pairs in a band that it may not lose."""
    monkeypatch.setattr(near_duplicates, "BLOCK_CLASSES", block)
    monkeypatch.setattr(near_duplicates, "SLOT_PAIRS", pairs)
    rng = np.random.default_rng(3)
    rows = []
    for kind in range(groups):
        base = rng.integers(0, 1 << 32, 128, dtype=np.uint32)
        for _ in range(rng.integers(1, 12)):
            row = np.where(rng.random(128) < rng.choice([0.0, 0.1, 0.9]), rng.integers(0, 1 << 32, 128, dtype=np.uint32), base)
            row[: 4 * (kind % 2)] = 7  # a band that half of all have in common
            rows.append((rng.bytes(16), row.tobytes(), row.view(np.uint8)[::8].tobytes()))
    df = spark.createDataFrame(rows, "class binary, signature binary, sketch binary")
    found = {bytes(r["class"]): bytes(r.root) for r in near_duplicates._candidates(df, 0.8, 1e-6).collect()}
    least = near_duplicates.least_matches(0.8, 1e-6, near_duplicates.SKETCH, near_duplicates.STEP)
    sketches = np.array([np.frombuffer(r[2], np.uint8) for r in rows])
    bands = np.array([np.frombuffer(r[1], np.uint8) for r in rows]).reshape(len(rows), near_duplicates.BANDS, -1)
    i, j = np.triu_indices(len(rows), 1)
    meet = (bands[i] == bands[j]).all(axis=2).any(axis=1) & near_duplicates._alike(sketches, i, j, least)
    return found, forest_roots([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in zip(i[meet], j[meet], strict=True)])


def test_bands_link_what_sketches_do_not_rule_out(spark, monkeypatch):
    for block, pairs in ((1024, 1 << 18), (1024, 8), (4, 1 << 18)):
        found, expected = banded(spark, monkeypatch, 12, block, pairs)
        linked = {c for c, r in expected.items() if c != r or list(expected.values()).count(r) > 1}
        assert len(linked) > 20 and found == {c: expected[c] for c in linked}


def test_components_with_hubs(spark, monkeypatch):
    from speechframe.llm import common, graph

    monkeypatch.setattr(common, "HOT_LEAST", 3)
    rng = random.Random(8)
    edges = [(0, i) for i in range(1, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(90, i) for i in range(50, 70)] + [(i, i + 1) for i in range(200, 230)]
    expected = forest_roots({n for e in edges for n in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    assert {r.node: r.root for r in graph.components(df).collect()} == expected


def test_very_long_text(spark):
    rng = random.Random(14)
    text = " ".join(f"w{rng.randrange(9999)}" for _ in range(200_000))
    docs = [(1, text), (2, text + " more"), (3, text[: len(text) // 3])]
    assert run(spark, docs) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_pruning_keeps_pairs_at_the_threshold():
    least = near_duplicates.least_matches(0.8, 1e-6, 128, 16)
    assert least == sorted(least) and all(0 < m < 0.8 * 16 * (k + 1) for k, m in enumerate(least))


def test_words_of_many_texts_are_those_of_each():
    texts = ["Aa b", "", "É é, É", "日本 x-y", "  ", "z" * 5000]
    data = [t.encode() for t in texts]
    hashes, starts, ends, bounds = shingles.words_of(data)
    for i, text in enumerate(texts):
        got = [data[i][a:b].decode() for a, b in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]], strict=True)]
        assert [w.translate(str.maketrans("AB", "ab")) for w in got] == words(text)
        alone = shingles.words_of([data[i]])[0]
        assert np.array_equal(alone, hashes[bounds[i] : bounds[i + 1]])
