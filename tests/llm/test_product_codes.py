import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from speechframe.llm import product_codes


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, code, error, label_error, digest) of (id, vector, label) rows, all distances each round."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = max((len(v) for _, v, _ in kept), default=0)
    width = max(1, -(-size // parts))
    padded = [v + [0] * (parts * width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[padded[r][p * width : (p + 1) * width] for r in order] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for v in padded:
                x = v[p * width : (p + 1) * width]
                members[nearest(x, books[p])[1]].append(x)
            for k, xs in members.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found = [[nearest(v[p * width : (p + 1) * width], books[p]) for p in range(parts)] for v in padded]
    errors, by_label = [sum(d for d, _ in f) for f in found], defaultdict(int)
    for (_, _, label), error in zip(kept, errors, strict=True):
        by_label[label] += error
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True)), key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS id", "1 AS v", "2 AS code", "3 AS error").repartition(3)
    return sorted((tuple(r) for r in product_codes.codes(df, **how).collect()), key=str)


def sample(rng, n, dims, grid=None):
    v = rng.standard_normal((n, dims)) if grid is None else rng.integers(-grid, grid + 1, (n, dims)) / 4096
    return [(i, [float(np.float32(x)) for x in row], int(rng.integers(0, 3)) if i % 7 else None) for i, row in enumerate(v)]


def test_equals_brute_force(spark):
    assert run(spark, (rows := sample(np.random.default_rng(1), 300, 64))) == brute(rows)


def test_many_ties(spark):
    rows = sample(np.random.default_rng(2), 250, 16, grid=1)  # few different parts: most distances tie
    assert run(spark, rows) == brute(rows)
    rows = [(i, [0.5] * 8, 1) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = sample(rng, 60, 16) + [(70, None, 1), (71, [None] * 16, 1), (72, [float("nan")] * 16, None), (73, [float("inf")] * 16, 2), (74, [], 1), (75, [0.25], None), (None, [1.0] * 16, 1), (3, [0.1] * 16, None), (3, [0.1] * 16, None)]
    assert run(spark, rows) == brute(rows)
    rows = sample(rng, 30, 13)
    assert run(spark, rows, parts=4, entries=5, rounds=3) == brute(rows, 4, 5, 3)


def test_few_and_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1)]) == []
    for n in (1, 3):
        rows = sample(np.random.default_rng(4), n, 16)
        assert run(spark, rows) == brute(rows)


def test_too_large_components_are_refused(spark):
    with pytest.raises(ValueError, match="2684|below"):
        run(spark, [(1, [1e9] * 8, 1)])


def test_many_labels_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(product_codes, "BROADCAST_ROWS", 1)
    rows = [(i, v, i % 50) for i, v, _ in sample(np.random.default_rng(5), 120, 16)]
    assert run(spark, rows) == brute(rows)


def test_bounds_spare_distances_and_stay_bounds():
    rng = np.random.default_rng(6)
    centres = rng.integers(-9000, 9000, (16, 8))
    x = (centres[rng.integers(0, 16, 4000)] + rng.integers(-400, 400, (4000, 8))).astype(np.int64)
    books, before, worked, state = x[:16].copy(), None, [], None
    for _ in range(6):
        part = product_codes.Part(books, before)
        *state, n = part.first(x) if before is None else part.again(x, *state)
        worked.append(n)
        d = ((x[:, None, :] - books[None]) ** 2).sum(-1)
        best, upper, lower = state
        assert (best == d.argmin(1)).all()
        assert (upper.astype(float) >= np.sqrt(d[np.arange(len(x)), best])).all() and (lower <= np.sqrt(d)).all()
        before, books = books, np.stack([x[best == k].sum(0) // (best == k).sum() if (best == k).any() else books[k] for k in range(16)])
    assert worked[0] == 16 * len(x) and sum(worked[1:]) < 0.3 * 5 * 16 * len(x), worked
