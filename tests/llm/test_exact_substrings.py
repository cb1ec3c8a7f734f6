import hashlib
import random

import numpy as np
import pytest

from speechframe.llm import blocks, exact_substrings
from speechframe.llm.suffix_array import common_prefixes, sorted_starts


def brute(docs, size=50):
    least = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for d, b in data:
        if d is not None:
            for i in range(len(b) - size + 1):
                w = b[i : i + size]
                least[w] = min(least.get(w, d), d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - size + 1):
                if least[b[i : i + size]] < d:
                    gone[i : i + size] = b"\1" * size
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not p for p, g in zip(b"\0" + bytes(gone), gone, strict=False))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, alphabet, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [text(rng.choice([49, 50, 51, 70, 300])) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [text(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a:] if rng.random() < 0.5 else s, text(rng.randint(0, 60))]
        docs.append((i, "".join(parts)))
    rng.shuffle(docs)
    return docs


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS block", "1 AS kept")
    return sorted((tuple(r) for r in exact_substrings.digest(df).collect()), key=str)


@pytest.mark.parametrize("alphabet", ["abcdefgh é日", "ab", "a"])
def test_equals_brute_force(spark, monkeypatch, alphabet):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(exact_substrings, "SEGMENT_BYTES", 200)
    monkeypatch.setattr(blocks, "KEY_TASK_BYTES", 2000)
    docs = corpus(1, alphabet) + [(900, None), (901, ""), (3, "z" * 80), (3, "z" * 80), (902, "z" * 60), (None, "z" * 90), (903, "y" * 3000), (904, "x" + "y" * 200)]
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "short")]) == brute([(1, None), (2, "short")])


@pytest.mark.parametrize("alphabet", [2, 3, 26, 256])
def test_two_stage_sort_orders_all_starts(alphabet):
    rng = np.random.default_rng(alphabet)
    for depth in (3, 10, 50):
        strings = [rng.integers(0, alphabet, rng.integers(depth, depth + 40), dtype=np.uint8).tobytes() for _ in range(40)] + [bytes(depth + 30), b"\xff" * (depth + 5)]
        data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        length = np.array([len(s) for s in strings])
        first = np.cumsum(length) - length
        order = sorted_starts(data, first, length, depth)
        keys = [data[i : i + depth].tobytes() for i in order]
        assert keys == sorted(keys)
        assert sorted(order.tolist()) == [a + k for a, n in zip(first.tolist(), length.tolist(), strict=True) for k in range(n - depth + 1)]
        want = [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(keys, keys[1:], strict=False)]
        assert common_prefixes(data, order, depth).tolist() == want
